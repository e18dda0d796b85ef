"""Records of delimited text whose quoted values hold line breaks, read by many tasks.

A line of such a file is a record of its own only if it doesn't begin inside quotes, which depends on everything before it. So a
file is read in byte ranges as lines, and

1. for every line the engine works out whether it ends inside quotes, once if it began outside and once if it began inside;
2. each range is scanned under both beginnings, which gives one small row per range: how it ends either way;
3. these rows are followed through each file in order, so that the true beginning of every range is known;
4. ranges put their lines together on their own. What a range holds of a record that began in an earlier range, or ends in a
   later one, is a fragment; fragments are joined by the range in which their record began.

A quote opens a value at its start only, and is doubled inside; quotes within an unquoted value are letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise

#: Ranges up to which those that begin inside quotes are sent to every task; beyond, files must be read whole.
MAX_RANGES = 1_000_000
OUTSIDE, INSIDE, CLOSED, AT_START = 0, 1, 2, 3


def ends_inside(line: Column, sep: str, begins_inside: bool) -> Column:
    """Whether a line ends inside quotes. The line is cut at its quotes; each piece tells what the quote after it does."""
    pieces = F.split(line, '"', -1)

    def quote(state: Column, piece: Column) -> Column:
        opens = piece.endswith(sep) | ((piece == "") & state.isin(CLOSED, AT_START))  # a new value, or the second of two quotes
        return F.when(state == INSIDE, CLOSED).when(opens, INSIDE).otherwise(OUTSIDE)

    start = F.lit(INSIDE if begins_inside else AT_START)
    last = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, quote)
    return F.when(F.contains(line, F.lit('"')), last == INSIDE).otherwise(F.lit(begins_inside))


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        ends_inside(F.col("value"), sep, False).alias("after_out"), ends_inside(F.col("value"), sep, True).alias("after_in"), "value")


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((file, start), lines) of the parts of a batch that belong to one range."""
    file = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = batch.column("start").to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (batch.column("file")[a].as_py(), int(start[a])), batch.slice(a, b - a)


def _turns(lines: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """How each line ends either way, and the lines that don't simply keep the state."""
    out, inside = (lines.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("after_out", "after_in"))
    return out, inside, np.flatnonzero(out | ~inside).tolist()


_ENDS = "file string, start bigint, end_out boolean, end_in boolean, closes boolean"


def _both_ends(batches):
    """How each range ends if it begins outside quotes, and if it begins inside."""
    key, state, closes = None, [False, True], False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), *[pa.array([x]) for x in (*state, closes)]],
                                          names=["file", "start", "end_out", "end_in", "closes"])

    for batch in batches:
        for here, lines in _ranges(batch):
            if here != key:
                if key is not None:
                    yield row()
                key, state, closes = here, [False, True], False
            out, inside, turns = _turns(lines)
            for i in turns:
                state = [bool(inside[i] if s else out[i]) for s in state]
                closes |= not state[1]
    if key is not None:
        yield row()


def _follow(ranges: pd.DataFrame) -> pd.DataFrame:
    """The true beginning of the ranges of one file, and the range in which the record began that is open there."""
    state, origin, rows = False, -1, []
    for r in ranges.sort_values("start").itertuples():
        end = r.end_in if state else r.end_out
        rows.append((r.file, r.start, state, origin, bool(end)))
        if end and not (state and not r.closes):
            origin = r.start
        state = bool(end)
    return pd.DataFrame(rows, columns=["file", "start", "inside", "origin", "open"])


def _assembled(fragments: bool):
    """Records that lie in one range; or the parts of those that don't."""
    names = ["file", "origin", "start", "text", "first"] if fragments else ["record", "first"]

    def run(batches):
        key, state, origin, held, foreign, line = None, False, -1, [], False, 0
        leading = False  # whether the open record is the first of its file

        def part():
            if fragments and held:
                yield _batch(names, [[key[0]], [origin if foreign else key[1]], [key[1]], ["\n".join(held)], [leading]])

        for batch in batches:
            for here, lines in _ranges(batch):
                if here != key:
                    yield from part()
                    key, held, line, leading = here, [], 0, False
                    state = foreign = bool(lines.column("inside")[0].as_py())
                    origin = lines.column("origin")[0].as_py()
                out, inside, turns = _turns(lines)
                n = lines.num_rows
                if not state and not turns and not fragments:
                    first = np.zeros(n, bool)
                    first[0] = line == 0 and key[1] == 0
                    line += n
                    yield pa.RecordBatch.from_arrays([lines.column("value"), pa.array(first)], names=names)
                    continue
                before, now, done = np.empty(n, bool), state, 0
                for i in turns:
                    before[done:i + 1] = now
                    now, done = bool(inside[i] if now else out[i]), i + 1
                before[done:] = now
                texts, firsts, starts = lines.column("value").to_pylist(), [], np.flatnonzero(~before).tolist()
                records = []
                if held or foreign and state:
                    held += texts[:starts[0] if starts else n]
                    if starts or not now:  # the open record ends here
                        if foreign:
                            yield from part()
                        else:
                            records.append("\n".join(held))
                            firsts.append(leading)
                        held, foreign, leading = [], False, False
                for a, b in zip(starts, [*starts[1:], n]):
                    is_first = line + a == 0 and key[1] == 0
                    if b == n and now:
                        held, leading = texts[a:], is_first
                    else:
                        records.append("\n".join(texts[a:b]))
                        firsts.append(is_first)
                state, line = now, line + n
                if records and not fragments:
                    yield _batch(names, [records, firsts])
        yield from part()

    return run


def _batch(names: list[str], columns: list[list]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "origin": pa.int64(), "start": pa.int64(), "text": pa.string(), "record": pa.string(), "first": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, columns)], names=names)


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(record, first) of all files below a path: the text of each record, and whether it is the first of its file."""
    lines = _lines(spark, path, sep)
    ends = lines.drop("value").mapInArrow(_both_ends, _ENDS)
    followed = ends.groupBy("file").applyInPandas(_follow, "file string, start bigint, inside boolean, origin bigint, open boolean")
    edges = materialise(followed.where("inside or open"))
    n = edges.count()
    if n > MAX_RANGES:
        raise ValueError(f"more than {MAX_RANGES} ranges begin or end inside quotes; read the files whole")
    if n == 0:  # no record lies in two ranges
        known = lines.withColumns({"inside": F.lit(False), "origin": F.lit(-1).cast("bigint")})
        out = known.mapInArrow(_assembled(False), "record string, first boolean")
    else:
        where = F.broadcast(edges.select(F.col("file").alias("__file"), F.col("start").alias("__start"), "inside", "origin"))
        on = (F.col("file") == F.col("__file")) & (F.col("start") == F.col("__start"))
        known = lines.join(where, on, "left").drop("__file", "__start").withColumn("inside", F.coalesce("inside", F.lit(False)))
        whole = known.mapInArrow(_assembled(False), "record string, first boolean")
        parts = lines.join(where, on).drop("__file", "__start").mapInArrow(
            _assembled(True), "file string, origin bigint, start bigint, text string, first boolean")
        joined = parts.groupBy("file", "origin").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"), F.max("first").alias("first"))
        out = whole.unionByName(joined.select(F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("record"), "first"))
    return out.withColumn("record", F.expr("if(endswith(record, '\\r'), left(record, length(record) - 1), record)"))
