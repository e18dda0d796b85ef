"""Masked pseudo-likelihood of documents: a network predicts every token from the tokens on both sides.

Words (A-Z lower-cased) are mapped to ``TOP`` symbols for the most frequent words and ``BUCKETS`` symbols for all others by
the CRC-32 of their bytes; one more symbol stands for the ends of a text. A hidden layer over the embeddings of the left and
the right neighbour ends in a softmax over the symbols. The model needs nothing but the number of times that each (left,
token, right) occurs, so these are counted over every word of every document, summed by Spark, and the network is fitted in
numpy to the sums: all of the corpus trains it, and what reaches the driver is bounded by the cube of the symbols.

A word inside a bucket has its share by frequency, its count among the bucket's, whatever the number of words. Tasks hold the
shares of the ``COMMON`` most frequent words; all others are looked up in the table of all words, by a join on the word, and
their shares are added to the scores. One more count of each bucket is for words that the corpus doesn't hold: words are hashed
to ``SLOTS`` slots, a slot belongs to one bucket, and that count is dealt equally among the bucket's slots without words.
So the probabilities add up to one, and frequent words score above rare ones.

A document's score is the sum of the conditional log-probabilities of its tokens, each masked in its turn. Null or empty
text has no tokens, score 0 and no mean. Repeated rows are counted and scored each; further columns aren't read. On an
empty corpus all symbols are equally likely.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, word_codes
from .common import stored

TOP, BUCKETS = 64, 32
SYMBOLS = 1 + TOP + BUCKETS
#: A multiple of ``BUCKETS``. The table of shares takes eight bytes a slot.
SLOTS = 1 << 20
#: Words at most whose shares every task holds.
COMMON = 1 << 17
HIDDEN, STEPS = 32, 150


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, slot) over all texts."""

    def run(batches):
        for batch in batches:
            for _, texts in slices(batch, "text"):
                codes, words, _ = word_codes(texts, lower=True)
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], names=["word", "n"])

    counts = docs.select(docs[text].alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.withColumn("slot", F.crc32(F.encode("word", "UTF-8")) % SLOTS)


class Symbols:
    """Symbols of words: 0 for the ends of a text, then the top words, then the buckets."""

    def __init__(self, top: list[str]):
        self.of = {w: 1 + i for i, w in enumerate(top)}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Symbols of all texts with an end symbol before, between and after them, the code of every word, the words that the
        codes number, and the number of words of each text."""
        codes, words, counts = word_codes(texts, lower=True)
        symbols = np.array([self.of.get(w) or 1 + TOP + zlib.crc32(w.encode()) % BUCKETS for w in words.to_pylist()], np.int64)
        return np.insert(symbols[codes], np.concatenate(([0], np.cumsum(counts))), 0), codes, words, counts


def contexts(docs: DataFrame, symbols: Symbols, text: str = "text") -> DataFrame:
    """(cell, n): how often each (left, token, right) occurs, as one number in base ``SYMBOLS``."""

    def run(batches):
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                s = symbols.encode(texts)[0]
                cell = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                total += np.bincount(cell[s[1:-1] > 0], minlength=len(total))
        cell = np.flatnonzero(total)
        if len(cell):
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    return docs.select(docs[text].alias("text")).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


class Network:
    """Left and right embedding, one hidden layer, softmax over the symbols."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = {"left": rng.normal(0, 0.3, (SYMBOLS, HIDDEN)), "right": rng.normal(0, 0.3, (SYMBOLS, HIDDEN)), "b": np.zeros(HIDDEN),
                  "out": rng.normal(0, 0.3, (HIDDEN, SYMBOLS - 1)), "c": np.zeros(SYMBOLS - 1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _forward(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.w
        h = np.tanh(w["left"][:, None] + w["right"][None] + w["b"]).reshape(-1, HIDDEN)
        z = h @ w["out"] + w["c"]
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, counts: np.ndarray, steps: int = STEPS) -> list[float]:
        """Full-batch Adam on counts[left, right, token]; the mean loss before every step."""
        n = counts.reshape(-1, SYMBOLS - 1).astype(np.float32)
        total = float(n.sum())
        if not total:
            self.w = {k: np.zeros_like(v) for k, v in self.w.items()}
            return []
        start = n.sum(0) + 1
        self.w["c"] = np.log(start / start.sum()).astype(np.float32)
        n /= total
        mass, m, v, losses = n.sum(1, keepdims=True), {}, {}, []
        for t in range(1, steps + 1):
            h, logp = self._forward()
            losses.append(float(-(n * logp).sum()))
            dz = mass * np.exp(logp) - n
            dh = (dz @ self.w["out"].T) * (1 - h * h)
            grid = dh.reshape(SYMBOLS, SYMBOLS, HIDDEN)
            g = {"out": h.T @ dz, "c": dz.sum(0), "left": grid.sum(1), "right": grid.sum(0), "b": dh.sum(0)}
            for k in g:
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g[k] ** 2
                self.w[k] -= (0.03 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-9)).astype(np.float32)
        return losses

    def table(self) -> np.ndarray:
        """Log-probability by [left, token, right]; the end symbol is never a token."""
        logp = self._forward()[1].reshape(SYMBOLS, SYMBOLS, SYMBOLS - 1)
        out = np.full((SYMBOLS,) * 3, -np.inf, np.float32)
        out[:, 1:, :] = logp.transpose(0, 2, 1)
        return out


def shares(slot: np.ndarray, n: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Log share in its bucket of a word in the mean, by slot, from the count and the different words of every slot that has any;
    0 for the slot after the last, which stands for top words. Only the empty slots' are used for words, see ``Model``."""
    seen = np.zeros(SLOTS, np.int64)
    seen[slot] = n
    words = np.ones(SLOTS, np.int64)
    words[slot] = types
    by_bucket = seen.reshape(-1, BUCKETS)  # slot % BUCKETS is the column
    empty = np.maximum((by_bucket == 0).sum(0), 1)
    mass = np.where(by_bucket > 0, by_bucket, 1 / empty) / (by_bucket.sum(0) + 1)
    return np.append(np.log(mass.ravel() / words), 0)


class Scorer:
    """What a task needs of a model: symbols, the log-probability of a symbol by [left, symbol, right], log shares of the most
    frequent words, and those of a word that the corpus doesn't hold by bucket. ``all_words``: no other word has been counted."""

    def __init__(self, symbols: Symbols, table: np.ndarray, common: dict[str, float], unseen: np.ndarray, all_words: bool):
        self.symbols, self.table, self.common, self.unseen, self.all_words = symbols, table, common, unseen, all_words

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Words and score of every text, without the shares of words that must be looked up; these words by text, with how
        often they occur there (text, word, n)."""
        s, codes, words, counts = self.symbols.encode(texts)
        text, names = np.repeat(np.arange(len(counts)), counts), words.to_pylist()
        share = np.array([self.common.get(w, np.nan) for w in names], float)
        other = np.flatnonzero(np.isnan(share))
        share[other] = [self.unseen[zlib.crc32(names[i].encode()) % BUCKETS] if self.all_words else 0 for i in other.tolist()]
        each = self.table[s[:-2], s[1:-1], s[2:]][s[1:-1] > 0].astype(np.float64) + share[codes]
        asked = np.zeros(len(names) + 1, bool)
        asked[other] = not self.all_words
        at = np.flatnonzero(asked[codes])
        pair, n = np.unique(text[at] * len(names) + codes[at], return_counts=True)
        return counts, np.bincount(text, weights=each, minlength=len(counts)), pair // max(len(names), 1), words.take(pa.array(pair % max(len(names), 1))), n


class Model:
    """A scorer, the (word, share) of all words it doesn't hold, or None, and the log shares by slot."""

    def __init__(self, scorer: Scorer, rest: DataFrame | None, share: np.ndarray):
        self.scorer, self.rest, self.share = scorer, rest, share
        self.symbols, self.table = scorer.symbols, scorer.table


def train(docs: DataFrame, text: str = "text") -> Model:
    """Model of all texts of ``docs``."""
    words = stored(vocabulary(docs, text), "vocabulary")
    top = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(TOP).collect()]
    other = words.where(~F.col("word").isin(top)) if top else words
    slots = other.groupBy("slot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toArrow()  # at most SLOTS rows
    slot, n, types = (slots[c].to_numpy() for c in ("slot", "n", "types"))
    symbols = Symbols(top)
    cells = contexts(docs, symbols, text).toArrow()  # at most SYMBOLS ** 3 rows
    counts = np.zeros(SYMBOLS ** 3, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    net = Network()
    net.fit(counts.reshape((SYMBOLS,) * 3)[:, 1:, :].transpose(0, 2, 1))

    share, total = shares(slot, n, types), np.bincount(slot % BUCKETS, weights=n, minlength=BUCKETS)
    unseen = np.minimum(share[:-1].reshape(-1, BUCKETS).min(0), -np.log(total + 1))  # the share of an empty slot is the least
    least = common_from(other)
    common = other.where(F.col("n") >= least).select("word", "n", (F.col("slot") % BUCKETS).alias("bucket")).toArrow()  # at most COMMON rows
    logs = np.log(common["n"].to_numpy()) - np.log(total + 1)[common["bucket"].to_numpy()]
    known = dict(zip(common["word"].to_pylist(), logs.tolist())) | dict.fromkeys(top, 0.0)
    rest = other.where(F.col("n") < least).select("word", (F.log("n") - F.get(F.array(*[F.lit(float(x)) for x in np.log(total + 1)]), (
        F.col("slot") % BUCKETS).cast("int"))).alias("share")) if types.sum() > common.num_rows else None
    return Model(Scorer(symbols, net.table(), known, unseen, rest is None), rest, share)


def common_from(words: DataFrame) -> int:
    """A count that at most ``COMMON`` words reach; counts are told apart by their leading six bits."""
    cut = "greatest(length(bin(n)) - 6, 0)"
    sizes = words.groupBy(F.expr(f"shiftleft(shiftright(n, {cut}), {cut})").alias("least")).agg(F.count(F.lit(1)).alias("words"))
    least, held = 1 << 62, 0
    for r in sizes.orderBy(F.desc("least")).collect():
        held += r["words"]
        if held > COMMON:
            break
        least = r["least"]
    return least


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, n_tokens, log_prob, mean_log_prob) of every row."""
    model = model or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer)
    asks = model.rest is not None

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                counts, total, of, words, n = shared.value.score(texts)
                columns = [rows.column(0), pa.array(counts.astype(np.int64)), pa.array(total)]
                if asks:
                    edges = pa.array(np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32))
                    columns += [pa.array(row + np.arange(len(counts))), pa.ListArray.from_arrays(edges, words),
                                pa.ListArray.from_arrays(edges, pa.array(n.astype(np.int32)))]
                    row += len(counts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["key", "n_tokens", "log_prob"] + ["row", "words", "times"] * asks
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_tokens bigint, log_prob double"
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, schema + ", row bigint, words array<string>, times array<int>" * asks)
    if asks:
        out = stored(out, "scored")  # rows keep their numbers
        asked = out.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), "x.times")
        unseen = F.get(F.array(*[F.lit(float(x)) for x in model.scorer.unseen]), (F.crc32(F.encode("word", "UTF-8")) % BUCKETS).cast("int"))
        found = asked.join(model.rest, "word", "left").groupBy(F.col("row").alias("__row")).agg(
            F.sum(F.col("times") * F.coalesce("share", unseen)).alias("more"))
        out = out.join(found, F.col("row") == F.col("__row"), "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.select(F.col("key").alias(key), "n_tokens", "log_prob", mean.alias("mean_log_prob"))
