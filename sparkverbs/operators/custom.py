"""Hooks for functions of the user: on columns, as aggregates, and as folds over sorted groups of any size."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from ..session import materialise

HELD_GROUPS = 100_000
#: States that are merged in one place.
FAN_IN = 16


def scalar_function(f: Callable[..., pd.Series], return_type: str):
    """Column function from a function on pandas Series; batches travel as Arrow.

    Meant for code that no expression can state; every function of this library is an expression.
    """
    return F.pandas_udf(f, return_type)


def fold_groups(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], step: Callable[[object, pd.DataFrame], object],
                merge: Callable[[object, object], object], finish: Callable[[object], dict], schema: str) -> DataFrame:
    """Fold the rows of each group, in order, to one row.

    step(state, rows)   takes the next rows of the group into a state (None before the first rows)
    merge(left, right)  joins the states of two neighbouring stretches of a group
    finish(state)       the columns of the result, as in ``schema``; the keys are added

    Rows are range-partitioned and sorted, and every stretch of a group in a partition becomes one state, batch by batch. States
    of a group that spans partitions are merged in a tree, ``FAN_IN`` neighbours at a time, so no task ever holds a group.
    """
    keys = list(keys)
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order_by]
    rows = df.withColumn("__g", F.xxhash64(*keys)).repartitionByRange(*by).sortWithinPartitions(*by)
    kinds = {k: df.schema[k].dataType.simpleString() for k in keys}
    state_schema = ", ".join([*[f"`{k}` {t}" for k, t in kinds.items()], "__part bigint, __state binary"])

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, group, state, head = TaskContext.get().partitionId(), None, None, None

        def row():
            return head.assign(__part=part, __state=[pickle.dumps(state)])

        for pdf in batches:
            for g, some in pdf.groupby((pdf["__g"] != pdf["__g"].shift()).cumsum(), sort=False):
                here = some["__g"].iloc[0]
                if head is not None and here != group:
                    yield row()
                    head, state = None, None
                group, head = here, some[keys].iloc[:1] if head is None else head
                state = step(state, some.drop(columns="__g"))
        if head is not None:
            yield row()

    def join_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        states = [pickle.loads(s) for s in pdf["__state"]]
        total = states[0]
        for s in states[1:]:
            total = merge(total, s)
        return pdf.iloc[:1].assign(__part=pdf["__up"].iloc[0], __state=[pickle.dumps(total)]).drop(columns="__up")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([finish(pickle.loads(s)) for s in pdf["__state"]], index=pdf.index)
            yield pd.concat([pdf[keys], out], axis=1)

    states = materialise(rows.mapInPandas(stretches, state_schema))
    spread = (states.agg(F.max("__part")).first()[0] or 0) + 1
    while spread > 1:  # a group lies in neighbouring partitions, so the numbers of partitions shrink with the tree
        states = states.withColumn("__up", F.expr(f"__part div {FAN_IN}"))
        states = materialise(states.groupBy(*keys, "__up").applyInPandas(join_states, state_schema))
        spread = -(-spread // FAN_IN)
    out = ", ".join([*[f"`{k}` {t}" for k, t in kinds.items()], schema])
    return states.mapInPandas(last, out)


def aggregate_groups(df: DataFrame, keys: Sequence[str], partial: Callable[[pd.Series], object],
                     merge: Callable[[pd.Series], object], column: str, return_type: str, name: str) -> DataFrame:
    """Aggregate a column per group with functions of the user, in two steps.

    ``partial`` reduces the values of one batch, ``merge`` reduces partial results (in any order and grouping). A task
    sends on one partial result per group, so a group of any size is spread over tasks.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"`{name}` {return_type}"])

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}
        for pdf in batches:
            for key, values in pdf.groupby(keys, dropna=False)[column]:
                value = partial(values)
                held[key] = merge(pd.Series([held[key], value])) if key in held else value
            if len(held) > HELD_GROUPS:
                yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, name])
                held = {}
        if held:
            yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, name])

    partials = df.select(*keys, column).mapInPandas(reduce_batches, schema)
    return partials.groupBy(*keys).agg(F.pandas_udf(merge, return_type, PandasUDFType.GROUPED_AGG)(F.col(name)).alias(name))
