"""Order-dependent columns over any number of rows: row numbers, running sums, previous values.

A window without keys, or with a key that holds a large share of the rows, puts those rows into one
task. ``ordered_scan`` spreads them instead: rows are range-partitioned and sorted, every partition is
scanned where it lies, batch by batch, and one small row per partition carries the state over to the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..functions.nulls import ColumnOrName, as_col
from ..session import materialise

PARTITION, POSITION = "__part", "__pos"
MAX_HEADS = 200_000


def _ordering(order_by) -> list[Column]:
    if not order_by:
        raise ValueError("rows have no order of their own: order_by is required")
    return [as_col(c) if not isinstance(c, str) else F.col(c).asc_nulls_last() for c in order_by]


def stamp(df: DataFrame, order_by: Sequence[ColumnOrName], keys: Sequence[str] = ()) -> DataFrame:
    """Rows sorted over all partitions, each with its partition and a position that rises within the partition.

    One range shuffle; the stamp is taken in the sorted stage and fixed by writing the rows.
    """
    ranged = df.orderBy(*[F.col(k).asc_nulls_first() for k in keys], *_ordering(order_by))
    stamped = materialise(ranged.withColumn(POSITION, F.monotonically_increasing_id()))
    return stamped.withColumn(PARTITION, F.shiftright(POSITION, 33))


def ordered_scan(
    df: DataFrame,
    order_by: Sequence[ColumnOrName],
    keys: Sequence[str] = (),
    row_number: str | None = None,
    running: dict[str, ColumnOrName] | None = None,
    previous: dict[str, tuple[ColumnOrName, object]] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add order-dependent columns, per group of ``keys`` or over the whole table.

    order_by    must be a total order within the group, or the result depends on chance
    row_number  name for the row number from 1
    running     name -> expression: running sum up to and with the row
    previous    name -> (expression, default): value of the row before; the default is used for the first row only
    bounded     the caller proves that a group is small (for example after a top-k): one plain window is used
    """
    keys, running, previous = list(keys), dict(running or {}), dict(previous or {})
    ordering = _ordering(order_by)
    inputs = {f"__sum_{n}": as_col(e) for n, e in running.items()}
    inputs |= {f"__val_{n}": as_col(e) for n, (e, _) in previous.items()}

    if bounded:
        rows = df.withColumns(inputs) if inputs else df
        w = Window.partitionBy(*keys).orderBy(*ordering)
        new = {f"__run_{n}": F.sum(f"__sum_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in running}
        new |= {f"__lag_{n}": F.lag(f"__val_{n}").over(w) for n in previous}
        new["__scan_n"] = F.row_number().over(w)
        rows = rows.withColumns(new)
        final = {n: F.col(f"__run_{n}") for n in running}
        final |= {n: F.when(F.col("__scan_n") == 1, F.lit(d)).otherwise(F.col(f"__lag_{n}"))
                  for n, (_, d) in previous.items()}
        if row_number:
            final[row_number] = F.col("__scan_n").cast("bigint")
        return _finish(rows, df, final)

    if row_number and not (running or previous):
        stamped = stamp(df, order_by, keys)
        numbered = _number_by_heads(stamped, keys, row_number)
        if numbered is not None:
            return _finish(numbered, df, {row_number: F.col(row_number)})
        df, source = stamped.drop(PARTITION), df  # rows keep their order: stamps rise
        order_by = [POSITION]
        ordering = _ordering(order_by)
    else:
        source = df

    rows = materialise(_scanned(df.withColumns(inputs) if inputs else df, ordering, keys, list(running), list(previous)))

    # only the last group of a partition can go on in the next one, so one row per partition carries its state over
    names = [f"__c{i}" for i in range(len(keys))]
    ends = rows.where("__scan_last").select(
        PARTITION, *[F.col(k).alias(c) for k, c in zip(keys, names)], "__scan_n", *[f"__run_{n}" for n in running], *[f"__val_{n}" for n in previous])
    upto = Window.partitionBy(*(names or [F.lit(0)])).orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, 0)
    carry = ends.select(
        F.lead(PARTITION).over(Window.orderBy(PARTITION)).alias("__cpart"), *names,
        F.sum("__scan_n").over(upto).alias("__before"),
        *[F.sum(f"__run_{n}").over(upto).alias(f"__b_{n}") for n in running],
        *[F.col(f"__val_{n}").alias(f"__q_{n}") for n in previous]).where("__cpart is not null")

    on = F.col(PARTITION) == F.col("__cpart")
    for k, c in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(c))
    rows = rows.join(F.broadcast(carry), on, "left")

    # a running sum over only nulls stays null, like the window form
    final = {n: F.when(F.col(f"__b_{n}").isNull(), F.col(f"__run_{n}"))
                 .when(F.col(f"__run_{n}").isNull(), F.col(f"__b_{n}"))
                 .otherwise(F.col(f"__run_{n}") + F.col(f"__b_{n}")) for n in running}
    final |= {n: F.when(F.col("__scan_n") > 1, F.col(f"__lag_{n}"))
                  .when(F.col("__before").isNotNull(), F.col(f"__q_{n}")).otherwise(F.lit(d))
              for n, (_, d) in previous.items()}
    if row_number:
        final[row_number] = F.col("__scan_n") + F.coalesce(F.col("__before"), F.lit(0))
    return _finish(rows, source, final)


def _scanned(df: DataFrame, ordering: list[Column], keys: list[str], sums: list[str], lags: list[str]) -> DataFrame:
    """Rows sorted over all partitions, with what a scan of the own partition tells: place in the group (``__scan_n``), running sums,
    previous values, and a flag on the partition's last row. Groups are told apart by a 64-bit hash of their keys."""
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    by = [*[F.col(k).asc_nulls_first() for k in keys], *ordering]
    # the type of a sum is that of the engine's own aggregate; an average over nothing but the schema is asked for here
    kinds = df.limit(0).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"__sum_{n}").alias(n) for n in sums]).schema if sums else None
    totals = df.withColumns({f"__sum_{n}": F.col(f"__sum_{n}").cast(kinds[n].dataType) for n in sums}) if sums else df
    rows = totals.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__scan_g", group)
    fields = [f for f in rows.schema.fields if f.name != "__scan_g"]
    fields += [StructField(f"__run_{n}", rows.schema[f"__sum_{n}"].dataType) for n in sums]
    fields += [StructField(f"__lag_{n}", rows.schema[f"__val_{n}"].dataType) for n in lags]
    fields += [StructField("__scan_n", LongType()), StructField("__scan_last", BooleanType()), StructField(PARTITION, IntegerType())]
    return rows.mapInArrow(_scanner(sums, lags), StructType(fields)).drop(*[f"__sum_{n}" for n in sums])


def _scanner(sums: list[str], lags: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group, count, totals, last, waiting = None, 0, {n: None for n in sums}, {}, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if waiting is not None:
                yield waiting(False)
            g = batch.column("__scan_g").to_numpy()
            new = np.concatenate(([group is None or g[0] != group], g[1:] != g[:-1]))
            heads = np.flatnonzero(new)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            number = np.arange(n) - start + 1
            number[start < 0] = count + np.arange(1, int((start < 0).sum()) + 1)
            added = []
            for name in sums:
                run, total = _running(batch.column(f"__sum_{name}"), heads, totals[name])
                totals[name] = total
                added.append(run)
            for name in lags:
                values = batch.column(f"__val_{name}")
                added.append(pa.concat_arrays([last.get(name, pa.nulls(1, values.type)), values.slice(0, n - 1)]))
                last[name] = pa.concat_arrays([values.slice(n - 1, 1)])
            group, count = g[-1], int(number[-1])
            kept = [c for c in batch.schema.names if c != "__scan_g"]
            columns = [*[batch.column(c) for c in kept], *added, pa.array(number)]
            names = [*kept, *[f"__run_{s}" for s in sums], *[f"__lag_{s}" for s in lags], "__scan_n", "__scan_last", PARTITION]

            def waiting(end, columns=columns, names=names, n=n):
                flag = np.zeros(n, bool)
                flag[-1] = end
                return pa.RecordBatch.from_arrays([*columns, pa.array(flag), pa.array(np.full(n, part, np.int32))], names=names)

        if waiting is not None:
            yield waiting(True)

    return scan


def _unscaled(values: pa.Array, carried) -> tuple[pa.Array, Decimal] | None:
    """Decimals as whole numbers of their smallest unit, if these and all their sums fit 63 bits."""
    if not pa.types.is_decimal128(values.type):
        return None
    step = Decimal(10) ** values.type.scale
    words = np.frombuffer(values.buffers()[1], "<i8").reshape(-1, 2)[values.offset:values.offset + len(values)]
    known = values.is_valid().to_numpy(zero_copy_only=False)
    low = np.where(known, words[:, 0], 0)
    most = int(np.abs(low).max(initial=0)) * max(1, len(low)) + (0 if carried is None else abs(int(carried * step)))
    if (known & (words[:, 1] != words[:, 0] >> 63)).any() or low.min(initial=0) == np.iinfo(np.int64).min or most >= 2 ** 62:
        return None
    return pa.array(low, mask=~known), step


def _running(values: pa.Array, heads: np.ndarray, carried):
    """Running sum within the stretches that begin at ``heads``, on top of what the first one has carried over (None: only
    nulls so far); and what the last one carries on."""
    n = len(values)
    exact = pa.types.is_decimal(values.type)
    if exact and (small := _unscaled(values, carried)) is not None:
        units, step = small
        run, last = _running(units, heads, None if carried is None else int(carried * step))
        filled = pc.fill_null(run, 0).to_numpy(zero_copy_only=False)
        words = np.stack([filled, filled >> 63], axis=1)  # a small decimal is its low word and the sign
        valid = None if run.null_count == 0 else run.buffers()[0]
        out = pa.Array.from_buffers(values.type, n, [valid, pa.py_buffer(words)], null_count=run.null_count)
        return out, None if last is None else Decimal(int(last)) / step
    known = values.is_valid().to_numpy(zero_copy_only=False)
    if exact:
        filled = np.array([Decimal(0) if v is None else v for v in values.to_pylist()], object)
    else:
        filled = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    sums = np.empty(n, filled.dtype)
    seen = np.zeros(n, bool)
    edges = [0, *heads[heads > 0].tolist(), n]
    for a, b in zip(edges, edges[1:]):
        base = carried if a == 0 and not (len(heads) and heads[0] == 0) else None
        sums[a:b] = np.cumsum(filled[a:b])
        seen[a:b] = np.logical_or.accumulate(known[a:b])
        if base is not None:
            sums[a:b] += base
            seen[a:b] = True
    out = pa.array(sums.tolist() if exact else sums, values.type, mask=None if exact else ~seen)
    if exact:
        out = pc.if_else(pa.array(seen), out, pa.nulls(n, values.type))
    return out, (sums[-1] if seen[-1] else None)


def _number_by_heads(stamped: DataFrame, keys: list[str], name: str) -> DataFrame | None:
    """Row number from the position and the head of each group in each partition, without another shuffle.

    The heads number one per partition plus one per group. They are counted first and broadcast if they are few;
    otherwise the answer is ``None`` and the rows are numbered by a window per partition and group.
    """
    names = [f"__c{i}" for i in range(len(keys))]
    heads = materialise(
        stamped.groupBy(F.col(PARTITION).alias("__cpart"), *[F.col(k).alias(c) for k, c in zip(keys, names)])
        .agg(F.min(POSITION).alias("__head"), F.count(F.lit(1)).alias("__n")))
    if keys and heads.count() > MAX_HEADS:
        return None
    earlier = Window.partitionBy(*(names or [F.lit(0)])).orderBy("__cpart").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    on = F.col(PARTITION) == F.col("__cpart")
    for k, c in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(c))
    rows = stamped.join(F.broadcast(heads), on)
    return rows.withColumn(name, F.col(POSITION) - F.col("__head") + 1 + F.col("__before"))


def _finish(rows: DataFrame, df: DataFrame, final: dict[str, Column]) -> DataFrame:
    kept = [c for c in df.columns if c not in final]
    return rows.select(*kept, *[c.alias(n) for n, c in final.items()])


def number_rows(df: DataFrame, order_by, keys=(), name: str = "row_number", bounded: bool = False) -> DataFrame:
    return ordered_scan(df, order_by, keys, row_number=name, bounded=bounded)


def running_sum(df: DataFrame, value: ColumnOrName, order_by, keys=(), name: str = "running", bounded: bool = False):
    return ordered_scan(df, order_by, keys, running={name: value}, bounded=bounded)


def lag_value(df: DataFrame, value: ColumnOrName, order_by, keys=(), name: str = "previous", default=None, bounded=False):
    return ordered_scan(df, order_by, keys, previous={name: (value, default)}, bounded=bounded)


def slice_rows(df: DataFrame, positions: Column, order_by, name: str = "row_number", last: int | None = None) -> DataFrame:
    """Rows whose position in the order satisfies ``positions`` (an expression over ``name``).

    If no position is beyond ``last``, only so many rows are sorted out and numbered.
    """
    if last is not None:
        return number_rows(df.orderBy(*_ordering(order_by)).limit(last), order_by, name=name, bounded=True).where(positions)
    return number_rows(df, order_by, name=name).where(positions)


def chunk_rows(df: DataFrame, size: int, order_by, name: str = "chunk") -> DataFrame:
    """Number of the block of ``size`` consecutive rows that a row belongs to, from 1."""
    numbered = number_rows(df, order_by, name="__number")
    return numbered.withColumn(name, F.expr(f"(__number - 1) div {int(size)} + 1")).drop("__number")


def zip_rows(left: DataFrame, left_order, right: DataFrame, right_order) -> DataFrame:
    """Put two tables side by side by position; the shorter one is filled with null."""
    a = number_rows(left, left_order, name="__index")
    b = number_rows(right, right_order, name="__index")
    return a.join(b, "__index", "full").drop("__index")
