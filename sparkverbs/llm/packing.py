"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous supersteps.

Sizes are whole tokens, so documents are range-sorted by counting: every piece has a length and a rank among the pieces of
that length over the whole table. Gaps are kept in size order as runs of sequences with equal gaps. A superstep takes the
longest open length: all of its documents at once look for their successor, the smallest gap that holds them; ranks decide
which documents get which gaps of a run; those that find none open new sequences; the gaps are updated; the next length
follows. Runs depend on the sequence length alone, never on the number of documents, so the sweep works on run-length
tables (the length histogram comes to the driver, at most ``size`` rows), and the documents themselves meet their runs in a
distributed pass. The outcome is that of serial best-fit decreasing.

Tokenising: text is cut between a character and the white space after it, and between an ASCII letter and an ASCII mark
after it, where no token of the byte-level pattern can lie; equal stretches are tokenised once in a batch, and a bounded cache keeps them for later batches. A text with white
space outside ASCII, or with a special token (which keeps its id, as the tokenizer does by itself), is tokenised as a whole.

Null or empty text is one piece that holds only the end token. Null and repeated ids and further columns are no matter:
every row is packed by itself. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BLANK, raw, slices, strings
from .common import stored

SIZE = 2048
END = 0
#: Stretches of text that each half of a worker's cache holds.
CACHED = 100_000
#: Stretches of text that the tokenizer gets as one string.
JOINED = 16

#: ASCII letters, and the visible ASCII characters that are neither letters nor digits.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
for _c in range(33, 127):
    LETTER[_c], MARK[_c] = chr(_c).isalpha(), not chr(_c).isalnum()

ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Token ids of many texts at once."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        #: Number and text of a special token that takes nothing from the text beside it.
        self.between = next(((i, t.content) for i, t in added.items() if t.special and not (
            t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.new, self.old = {}, {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One encoder for each file and worker."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch, four bytes each."""
        found = list(map(self.new.get, stretches))
        missing = []
        for i in [i for i, x in enumerate(found) if x is None]:
            x = self.old.get(stretches[i])
            if x is None:
                missing.append(i)
            else:
                found[i] = self.new[stretches[i]] = x
        for k in range(0, len(missing), 4096):
            some = missing[k:k + 4096]
            for i, x in zip(some, self._encoded([stretches[i] for i in some])):
                found[i] = self.new[stretches[i]] = x
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        return found

    def _encoded(self, stretches: list[str]) -> list[bytes]:
        """Ids of stretches that aren't known. They are handed over ``JOINED`` at a time with a special token between them, where
        the tokenizer cuts before all else; stretches that hold special tokens themselves are handed over one by one."""
        whole = "".join(stretches)
        if self.between is None or any(s in whole for s in self.special):
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]
        number, mark = self.between
        joined = [mark.join(stretches[k:k + JOINED]) + mark for k in range(0, len(stretches), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends, flat = (4 * np.flatnonzero(ids == number)).tolist(), ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        data, at = raw(texts)
        blank = BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (blank[1:] & ~blank[:-1]) | (MARK[data[1:]] & LETTER[data[:-1]])
        whole = self._whole(texts, data, at)
        for i in whole:
            cut[at[i]:at[i + 1]] = False
        cut[at] = True
        edges = np.flatnonzero(cut)
        if len(edges) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = strings(data, np.diff(edges)).dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, where = np.frombuffer(b"".join(ids), np.uint32), np.concatenate(([0], np.cumsum(sizes)))
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[code]
        upto = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(where[code] - upto[:-1], n) + np.arange(upto[-1])]
        return out, np.diff(upto[np.searchsorted(edges, at)])

    def _whole(self, texts: pa.Array, data: np.ndarray, at: np.ndarray) -> list[int]:
        """Texts that must not be cut."""
        lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        lead = lead[lead + 1 < len(data)]
        pair = data[lead].astype(np.int32) * 256 + data[lead + 1]
        lead = lead[np.isin(pair, [0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380])]
        rows = set(np.unique(np.searchsorted(at, lead, "right") - 1).tolist())
        odd = {i for i in rows if ODD_SPACE.search(texts[i].as_py())}
        for s in self.special:
            if data.tobytes().find(s.encode()) >= 0:
                odd |= {i for i, t in enumerate(texts.to_pylist()) if s in t}
        return sorted(odd)


def pieces_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of the pieces of documents with ``counts`` ids: the first piece takes what is left over."""
    n = -(-counts // size)
    row = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    head = counts - (n - 1) * size
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
    return row, piece, start, np.where(piece == 0, head[row], size)


def tokenise(docs: DataFrame, key: str, text: str, path: str, size: int, end: int, keep_ids: bool) -> DataFrame:
    """Pieces of all rows with their task (``part``) and their place among the task's pieces of equal length."""

    def run(batches):
        encoder, seen, part = Encoder.at(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for rows, texts in slices(batch, "__text"):
                ids, counts = encoder.encode(texts)
                closed = np.insert(ids, np.cumsum(counts), end).astype("<u4")
                counts = counts + 1
                base = np.cumsum(counts) - counts
                row, piece, start, length = pieces_of(counts, size)
                order = np.argsort(length, kind="stable")
                tally = np.bincount(length, minlength=size + 1)
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.repeat(np.cumsum(tally) - tally, tally)
                place += seen[length]
                seen += tally
                data = memoryview(closed)
                first = (base[row] + start).tolist()
                crc = [zlib.crc32(data[a:a + n]) for a, n in zip(first, length.tolist())]
                columns = [rows.column("__key").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(place)]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate((first, [len(closed)])).astype(np.int32)), pa.array(closed.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "piece", "start", "length", "ids_crc32", "part", "place"] + ["input_ids"] * keep_ids
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"
    return docs.select(docs[key].alias("__key"), docs[text].alias("__text")).mapInArrow(
        run, schema + ", input_ids array<int>" * keep_ids)


def sweep(tally: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Supersteps over run-length tables. Rows (length, first rank, first sequence, offset, count): documents of a length
    from the first rank on lie in as many sequences from the first sequence on. Also the number of sequences."""
    runs, gaps, sizes, opened = [], defaultdict(list), [], 0

    def give(gap, first, n):
        if gap and n:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(tally, reverse=True):
        left, rank = tally[length], 0
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(k)
            else:
                gap, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            for slot in range(each if full else 0):
                runs.append((length, rank, first, size - gap + slot * length, full))
                rank += full
            give(gap - each * length, first, full)
            left -= full * each
            if full < n:
                some = min(left, each)  # fewer than one sequence takes
                for slot in range(some):
                    runs.append((length, rank, first + full, size - gap + slot * length, 1))
                    rank += 1
                left -= some
                if some:
                    give(gap - some * length, first + full, 1)
                give(gap, first + full + bool(some), n - full - bool(some))
    return np.array(runs, np.int64).reshape(-1, 5), opened


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE,
         end: int = END, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset), and input_ids if asked for, of every piece.

    Texts are tokenised once; a written table holds the pieces, so ranks stay the same if tasks run again.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pieces = stored(tokenise(docs, key, text, path, size, end, keep_ids), "pieces")
    tally = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    runs, _ = sweep({r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "before", "place")
    columns = ["key", "piece", "start", "length", "ids_crc32", "rank"] + ["input_ids"] * keep_ids
    shared = docs.sparkSession.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def place(batches):
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            out = {c: b.column(c) for c in columns if c != "rank"}
            out |= {"sequence_id": pa.array(run[:, 2] + rank - run[:, 1]), "offset": pa.array(run[:, 3])}
            yield pa.RecordBatch.from_pydict({c: out[c] for c in names})

    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["input_ids"] * keep_ids
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select(*columns).mapInArrow(place, schema + ", input_ids array<int>" * keep_ids).withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, input_ids) from the pieces of ``pack(..., keep_ids=True)``; a sequence holds at most ``size`` ids."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "input_ids"))).alias("p")).select(
        "sequence_id", F.flatten("p.input_ids").alias("input_ids"))
