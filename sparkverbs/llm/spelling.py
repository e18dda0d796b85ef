"""Spelling variants: every word of the corpus, the words that are one edit away from it, and the common form it belongs to.

Words are counted over all texts. One edit changes the counts of a word's letters by one (a letter more or less) or by two (one
letter for another), so near words are found by range searches in k-d trees over letter-count vectors, one tree for each length
of words, and the order of the letters is compared for the few words in range.

1. *Vectors.* Letters a to z have a coordinate each; other letters share six. A count up to four is written as that many ones
   of four bits, so the L1 distance of two vectors is the number of differing bits; larger counts and shared coordinates only
   make it smaller, never larger, and no near word is missed.
2. *Upper levels.* A tree that is fitted to a bounded sample (about ``SAMPLE`` words, those with small hashes) cuts the words
   of each length into cells. A word is a point of one cell, and a query to each cell of its own length and of one letter more
   or less whose box is in range. A cell with more than ``CELL_MOST`` words is held in several parts, which all get its queries.
3. *Lower levels.* A task builds the tree of one part of a cell and streams the queries through it: boxes are tight, and a box
   is opened only if the letters to gain and the letters to lose allow one edit. What a query finds in a part is added up where
   it is found (how many, and the most frequent), so no pairs are shuffled.

Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. A run whose crc32 (of ``<id>:<run>``) is divisible by 31
loses the code point at crc32 modulo length; a row without id has no such number and its runs stay. Null and empty texts have no
words. Rows are counted as they come: repeated rows and ids count again. Words need at least 7 code points and occurrences
``OFTEN`` times. An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ink_spans, raw, slices, strings
from .common import stored

LEAST, OFTEN, RARE, FACTOR = 7, 2, 31, 10
#: Words that the upper levels are fitted to, words of a cell (aimed at, and most), points of a leaf of the lower levels.
SAMPLE, CELL, CELL_MOST, LEAF = 200_000, 16_384, 100_000, 24
#: Different words that a task counts before it sends them on; queries and candidate pairs that are worked on at once.
HELD, QUERIES, PAIRS, CELLS = 400_000, 2_048, 1 << 19, 1 << 23
DIMENSIONS, LEVELS = 32, 4

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LEAD = 0xC3  # first byte of U+00C0 to U+00FF
COORDINATE = np.zeros(256, np.int64)
COORDINATE[97:123] = np.arange(26)
COORDINATE[0xC0:] = 26 + np.arange(64) % 6


# ------------------------------------------------------------------ words

@cache
def appended(length: int) -> np.ndarray:
    """Tables of what ``length`` more bytes make of a crc32, by its four bytes: crc32(a + b) = appended(a) ^ crc32(b)."""
    zeros = bytes(length)
    none = zlib.crc32(zeros)
    basis = np.array([zlib.crc32(zeros, 1 << b) ^ none for b in range(32)], np.uint32)
    table = np.zeros((4, 256), np.uint32)
    for b in range(32):
        byte = np.arange(256)
        table[b // 8] ^= np.where(byte >> (b % 8) & 1, basis[b], np.uint32(0)).astype(np.uint32)
    return table


def run_crcs(heads: np.ndarray, tails: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each head followed by a tail of ``lengths`` bytes, from the crc32 of both."""
    out = tails.copy()
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for at in np.split(order, edges[1:]) if len(order) else []:
        table = appended(int(lengths[at[0]]))
        h = heads[at]
        out[at] ^= table[0][h & 255] ^ table[1][h >> 8 & 255] ^ table[2][h >> 16 & 255] ^ table[3][h >> 24]
    return out


def slice_words(ids: list, texts: pa.Array) -> tuple[list[str], list[int]]:
    """Words of some texts, and how often each occurs (a word can be listed more than once)."""
    data, at = raw(texts)
    lead = data == LEAD
    ink = LETTER[data] | lead
    ink[1:] |= lead[:-1]
    starts, ends, _ = ink_spans(ink, at)
    before = np.concatenate(([0], np.cumsum(lead)))
    length = (ends - starts) - (before[ends] - before[starts])
    long = length >= LEAST
    starts, ends, length = starts[long], ends[long], length[long]
    if not len(starts):
        return [], []
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    np.subtract.at(mark, ends, 1)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    coded = strings(lower[np.cumsum(mark[:-1], dtype=np.int8) > 0], ends - starts).dictionary_encode()
    codes, listed = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    tails = np.array([zlib.crc32(w.encode()) for w in listed], np.uint32)
    heads = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    named = np.array([i is not None for i in ids], bool)
    row = np.searchsorted(at, starts, "right") - 1
    crc = run_crcs(heads[row], tails[codes], ends - starts)
    cut = named[row] & (crc % RARE == 0)
    times = np.bincount(codes[~cut], minlength=len(listed))
    whole = np.flatnonzero(times)
    words, counts = [listed[c] for c in whole.tolist()], times[whole].tolist()
    if cut.any():
        place = crc[cut].astype(np.int64) % length[cut]
        pairs, times = np.unique(np.stack([codes[cut], place]), axis=1, return_counts=True)
        for c, p, n in zip(*pairs.tolist(), times.tolist()):
            word = listed[c]
            if len(word) > LEAST:
                words.append(word[:p] + word[p + 1:])
                counts.append(n)
    return words, counts


def _count(batches):
    held: dict[str, int] = {}

    def flush():
        words, counts = list(held), list(held.values())
        for k in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(words[k:k + (1 << 16)], pa.string()), pa.array(counts[k:k + (1 << 16)], pa.int64())], names=["word", "n"])

    for batch in batches:
        for part, texts in slices(batch, "text"):
            for word, n in zip(*slice_words(part.column("id").to_pylist(), texts)):
                held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield from flush()
                held.clear()
    yield from flush()


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of all texts."""
    parts = docs.select(docs[key].alias("id"), docs[text].alias("text")).where("text is not null").mapInArrow(_count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


# ------------------------------------------------------------------ vectors and trees

def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words in a row (a byte each), and how many letters a word has."""
    joined = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return joined, np.fromiter(map(len, words), np.int64, len(words))


def vectors_of(words: list[str]) -> np.ndarray:
    """Letter counts as ones: two 64-bit numbers for each word, ``LEVELS`` bits for each coordinate."""
    out = np.zeros((len(words), 2), np.uint64)
    for k in range(0, len(words), 1 << 15):
        letters, lengths = codes_of(words[k:k + (1 << 15)])
        n = len(lengths)
        cell = np.repeat(np.arange(n), lengths) * DIMENSIONS + COORDINATE[letters]
        counts = np.minimum(np.bincount(cell, minlength=n * DIMENSIONS), LEVELS).astype(np.uint64).reshape(n, 2, DIMENSIONS // 2)
        ones = (np.uint64(1) << counts) - np.uint64(1)
        shifts = (np.arange(DIMENSIONS // 2) * LEVELS).astype(np.uint64)
        out[k:k + n] = np.bitwise_or.reduce(ones << shifts, axis=2)
    return out


def bits_of(vectors: np.ndarray) -> np.ndarray:
    """The bits of each vector as a matrix of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(vectors).view(np.uint8).reshape(len(vectors), 16), axis=1, bitorder="little")


def gains_and_losses(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters that vectors have to gain, and to lose, to get into boxes: their distance is the sum."""
    gain = np.bitwise_count(low & ~q).sum(1, dtype=np.int64)
    loss = np.bitwise_count(q & ~high).sum(1, dtype=np.int64)
    return gain, loss


class Tree:
    """k-d tree: a node is cut at one count of one letter, so that its halves are as equal as can be. Boxes are those of the
    points (``tight``) or those that the cuts leave, which hold all vectors that aren't among the points as well."""

    def __init__(self, vectors: np.ndarray, most: int, tight: bool):
        n = len(vectors)
        self.order = np.arange(n)
        nodes, low, high, kids, span, cut = [(0, n)], [], [], [], [], []
        full = np.full(2, ~np.uint64(0))
        boxes = [(np.zeros(2, np.uint64), full)]
        k = 0
        while k < len(nodes):
            (a, b), (lo, hi) = nodes[k], boxes[k]
            k += 1
            some = vectors[self.order[a:b]]
            if tight and b > a:
                lo, hi = np.bitwise_and.reduce(some, axis=0), np.bitwise_or.reduce(some, axis=0)
            low.append(lo)
            high.append(hi)
            span.append((a, b))
            bit = -1
            if b - a > most:
                bits = bits_of(some)
                ones = bits.sum(0, dtype=np.int64)
                bit = int(np.argmax(np.minimum(ones, b - a - ones)))
                if not 0 < ones[bit] < b - a:
                    bit = -1  # all alike
            cut.append(bit)
            if bit < 0:
                kids.append(-1)
                continue
            right = bits[:, bit] > 0
            order = self.order[a:b]
            middle = a + int((~right).sum())
            self.order[a:b] = np.concatenate((order[~right], order[right]))
            kids.append(len(nodes))
            nodes += [(a, middle), (middle, b)]
            boxes += _halves(lo, hi, bit)
        self.low, self.high = np.array(low).reshape(-1, 2), np.array(high).reshape(-1, 2)
        self.kids, self.span, self.cut = np.array(kids), np.array(span).reshape(-1, 2), np.array(cut)
        self.leaf = np.where(self.kids < 0, np.cumsum(self.kids < 0) - 1, -1)

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf in whose box each vector lies."""
        node = np.zeros(len(q), np.int64)
        while True:
            inner = np.flatnonzero(self.kids[node] >= 0)
            if not len(inner):
                return self.leaf[node]
            bit = self.cut[node[inner]]
            right = q[inner, bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1)
            node[inner] = self.kids[node[inner]] + right.astype(np.int64)

    def reach(self, q: np.ndarray, gain: int, loss: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all leaves whose box a query reaches by so many letters more and less."""
        query, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        found = []
        while len(query):
            g, l = gains_and_losses(q[query], self.low[node], self.high[node])
            keep = (g <= gain) & (l <= loss)
            query, node = query[keep], node[keep]
            kid = self.kids[node]
            ends = kid < 0
            found.append((query[ends], node[ends]))
            query, kid = query[~ends], kid[~ends]
            query, node = np.concatenate((query, query)), np.concatenate((kid, kid + 1))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (query, node)


def _halves(low: np.ndarray, high: np.ndarray, bit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes of both sides of a cut: a letter that occurs less than t times, or t times and more."""
    word, first = bit // 64, bit % 64 // LEVELS * LEVELS
    whole = ((1 << LEVELS) - 1) << first
    below = (1 << bit % 64) - 1 & whole
    left, right = high.copy(), low.copy()
    left[word] &= np.uint64(~(whole & ~below) & (1 << 64) - 1)
    right[word] |= np.uint64(below | 1 << bit % 64)
    return [(low, left), (right, high)]


# ------------------------------------------------------------------ cells

def fit_cells(sample: list[str], share: float) -> dict[int, tuple[Tree, int]]:
    """By length: the upper levels of the tree, and the number of its first cell. ``share`` of the words are in the sample."""
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    out, first = {}, 0
    for length in sorted(by_length):
        tree = Tree(vectors_of(by_length[length]), max(8, int(CELL * share)), tight=False)
        out[length] = tree, first
        first += int(tree.leaf.max()) + 1
    return out


def _by_length(words: list[str]):
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for at in np.split(order, edges[1:]) if len(order) else []:
        yield int(lengths[at[0]]), at


def cells_of(trees: dict, words: list[str]) -> np.ndarray:
    """The cell that each word is a point of; words of a length that the sample lacks make one cell."""
    out = np.zeros(len(words), np.int64)
    for length, at in _by_length(words):
        if length in trees:
            tree, first = trees[length]
            out[at] = first + tree.home(vectors_of([words[i] for i in at]))
        else:
            out[at] = -length
    return out


#: Letters that a word may gain and lose to become a word that has so many letters more.
EDITS = {-1: (0, 1), 0: (1, 1), 1: (1, 0)}


def _route(trees: dict, parts: dict[int, int]):
    """(cell, part, role, word, n): role 0 for points, 1 for queries."""

    def rows(cell, at, role):
        split = np.array([parts.get(int(c), 1) for c in cell], np.int64)
        return cell, split, at, np.full(len(at), role, np.int8)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, QUERIES):
                some = batch.slice(k, QUERIES)
                words = some.column("word").to_pylist()
                vectors, own = vectors_of(words), cells_of(trees, words)
                got = [rows(own, np.arange(len(words)), 0)]
                for length, at in _by_length(words):
                    for more, (gain, loss) in EDITS.items():
                        if length + more not in trees:
                            got.append(rows(np.full(len(at), -(length + more)), at, 1))
                            continue
                        tree, first = trees[length + more]
                        query, node = tree.reach(vectors[at], gain, loss)
                        got.append(rows(first + tree.leaf[node], at[query], 1))
                cell, split, at, role = (np.concatenate(c) for c in zip(*got))
                hashed = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
                point = role == 0
                times = np.where(point, 1, split)  # a query goes to every part
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cell, split, at, role = (np.repeat(x, times) for x in (cell, split, at, role))
                part = np.where(role == 0, hashed[at] % split, part)
                for j in range(0, len(at), 1 << 16):
                    p = slice(j, j + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[p]), pa.array(part[p]), pa.array(role[p]),
                                                      some.column("word").take(pa.array(at[p])), some.column("n").take(pa.array(at[p]))],
                                                     names=["cell", "part", "role", "word", "n"])

    return run


def _cells(trees: dict):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cells_of(trees, batch.column("word").to_pylist()))], names=["cell"])

    return run


# ------------------------------------------------------------------ the search in a cell

def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letters."""
    letters, lengths = codes_of(words)
    return letters.reshape(len(words), int(lengths[0]) if len(words) else 0)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_more(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether leaving out one letter of the long word gives the short one: equal letters from both ends meet."""
    n = short.shape[1]
    front, back = short == long[:, :-1], (short == long[:, 1:])[:, ::-1]
    ahead = np.where(front.all(1), n, np.argmin(front, axis=1))
    behind = np.where(back.all(1), n, np.argmin(back, axis=1))
    return ahead + behind >= n


class Cell:
    """The words of one part of a cell, all of one length, in their tree."""

    def __init__(self, words: list[str], n: list[int]):
        order = np.argsort(np.array(words, object), kind="stable")  # code-point order decides ties
        self.words, self.n = [words[i] for i in order], np.array(n, np.int64)[order]
        self.length, self.vectors, self.letters = len(words[0]), vectors_of(self.words), _letters(self.words)
        self.tree = Tree(self.vectors, LEAF, tight=True)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all near pairs; the queries are of one length."""
        more = self.length - len(words[0])
        gain, loss = EDITS[more]
        q, letters = vectors_of(words), _letters(words)
        query, node = self.tree.reach(q, gain, loss)
        span = self.tree.span[node]
        size = span[:, 1] - span[:, 0]
        at_once = max(1, min(PAIRS, CELLS // max(1, self.length)))
        found = []
        for a, b in _groups(size, at_once):
            i = np.repeat(query[a:b], size[a:b])
            first = np.repeat(span[a:b, 0] - (np.cumsum(size[a:b]) - size[a:b]), size[a:b])
            j = self.tree.order[first + np.arange(len(i))]
            for k in range(0, len(i), at_once):  # a leaf of equal vectors can be larger than that
                x, y = i[k:k + at_once], j[k:k + at_once]
                g, l = gains_and_losses(q[x], self.vectors[y], self.vectors[y])
                keep = (g <= gain) & (l <= loss)
                x, y = x[keep], y[keep]
                if more == 0:
                    keep = one_replaced(letters[x], self.letters[y])
                elif more > 0:
                    keep = one_more(letters[x], self.letters[y])
                else:
                    keep = one_more(self.letters[y], letters[x])
                found.append((x[keep], y[keep]))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _groups(size: np.ndarray, most: int):
    """Consecutive stretches whose sizes add up to about ``most``."""
    if len(size):
        part = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        yield from zip(edges, edges[1:])


_HITS = "word string, n_near bigint, form_n bigint, form string"


def _match(batches):
    """What each query finds in each part of a cell. Rows come sorted by cell, part and role."""
    place, points, cell = None, ([], []), None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "part", "role")])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b == a:
                continue
            if place != (key[0, a], key[1, a]):
                place, points, cell = (key[0, a], key[1, a]), ([], []), None
            words, n = (batch.column(c).slice(a, b - a) for c in ("word", "n"))
            if key[2, a] == 0:
                points[0].extend(words.to_pylist())
                points[1].extend(n.to_pylist())
                continue
            if not points[0]:
                continue
            cell = cell or Cell(*points)
            words = words.to_pylist()
            for _, at in _by_length(words):
                for k in range(0, len(at), QUERIES):
                    some = [words[i] for i in at[k:k + QUERIES]]
                    q, w = cell.near(some)
                    if not len(q):
                        continue
                    order = np.lexsort((w, -cell.n[w], q))
                    first = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
                    times = np.bincount(q, minlength=len(some))[q[first]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([some[i] for i in q[first].tolist()], pa.string()), pa.array(times), pa.array(cell.n[w[first]]),
                        pa.array([cell.words[i] for i in w[first].tolist()], pa.string())], names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near words: how many, and the most frequent of them (ties: the
    first in code-point order), from (word, n)."""
    total = words.count()
    hashed = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    sample = words.where(hashed < (SAMPLE << 30) // max(total, SAMPLE)).select("word").toArrow().column("word").to_pylist()
    trees = fit_cells(sample, len(sample) / max(1, total))
    large = words.select("word").mapInArrow(_cells(trees), "cell bigint").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_MOST)
    parts = {r["cell"]: -(-r["n"] // CELL_MOST) for r in large.collect()}  # one row for each CELL_MOST words at most
    routed = words.mapInArrow(_route(trees, parts), "cell bigint, part bigint, role tinyint, word string, n bigint")
    hits = routed.repartition("cell", "part").sortWithinPartitions("cell", "part", "role").mapInArrow(_match, _HITS)
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form"))).alias("best")
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))


def rooted(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) from (word, form): the last form of each chain. Counts grow ``FACTOR`` times with every step, which bounds
    the length of chains; every round doubles what is followed."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(max(1, largest), FACTOR)))) if largest else 0):
        on = now.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        now = stored(now.join(on, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    words = stored(counted(docs, key, text), "words")
    near = near_words(words).withColumnRenamed("word", "__word")
    out = words.join(near, F.col("word") == F.col("__word"), "left").drop("__word")
    known = F.col("form_n") >= FACTOR * F.col("n")
    out = stored(out.withColumns({"form": F.when(known, F.col("form")), "form_n": F.when(known, F.col("form_n")),
                                  "n_near": F.coalesce("n_near", F.lit(0).cast("bigint"))}), "near")
    largest = words.agg(F.max("n")).first()[0] or 0
    roots = rooted(out.where("form is not null"), largest).withColumnRenamed("word", "__word")
    return out.join(roots, F.col("word") == F.col("__word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
