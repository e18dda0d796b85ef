"""Functions of the user on columns and groups."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.custom import aggregate_groups, fold_groups, scalar_function
from ..sources.polygons import star_polygons
from .registry import query


def _luhn(numbers: pd.Series) -> pd.Series:
    """Check digit of each number: every second digit from the right counts double, its digits added up."""
    rest, total, double = numbers.astype("int64"), pd.Series(0, numbers.index, dtype="int64"), True
    while (rest > 0).any():
        digit = rest % 10 * (2 if double else 1)
        total += digit // 10 + digit % 10
        rest, double = rest // 10, not double
    return (-total) % 10


@query("udf_scalar", """
WITH d AS (SELECT p_partkey, unnest(range(1, length(p_partkey::VARCHAR) + 1)) AS i, reverse(p_partkey::VARCHAR) AS t FROM part),
e AS (SELECT p_partkey, t[i]::INT * CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END AS v FROM d)
SELECT p_partkey, ((10 - sum(v // 10 + v % 10) % 10) % 10)::BIGINT AS check_digit FROM e GROUP BY 1""")
def udf_scalar(t):
    """A loop whose length depends on the data, over whole batches."""
    return t.part.select("p_partkey", scalar_function(_luhn, "bigint")("p_partkey").alias("check_digit"))


def _log_total(values: pd.Series) -> float:
    """Logarithm of a sum of exponentials, without overflow; partial results add up the same way."""
    top = float(values.max())
    return top + math.log(float(np.exp(values.to_numpy(float) - top).sum()))


@query("udf_aggregate", """
WITH m AS (SELECT l_returnflag, l_suppkey, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_suppkey, round(any_value(top) + ln(sum(exp(l_extendedprice - top))), 6) AS log_total FROM lineitem JOIN m USING (l_returnflag, l_suppkey) GROUP BY ALL""")
def udf_aggregate(t):
    lines = t.lineitem.select("l_returnflag", "l_suppkey", "l_extendedprice")
    out = aggregate_groups(lines, ["l_returnflag", "l_suppkey"], _log_total, _log_total, "l_extendedprice", "double", "log_total")
    return out.withColumn("log_total", F.round("log_total", 6))


def _walk(state, ring: pd.DataFrame):
    """First point, last point and length of a stretch of a ring."""
    x, y = ring["x"].to_numpy(), ring["y"].to_numpy()
    own = (x[0], y[0]), (x[-1], y[-1]), float(np.hypot(np.diff(x), np.diff(y)).sum())
    return own if state is None else _join(state, own)


def _join(left, right):
    return left[0], right[1], left[2] + right[2] + math.dist(left[1], right[0])


@query("udf_per_group", """
WITH v AS (SELECT s_suppkey, seq, s_suppkey + CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE * cos(seq * 2 * pi() / 10) AS x,
             CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE * sin(seq * 2 * pi() / 10) AS y FROM supplier, range(10) r(seq))
SELECT a.s_suppkey, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS perimeter FROM v a JOIN v b ON a.s_suppkey = b.s_suppkey AND b.seq = (a.seq + 1) % 10 GROUP BY 1""")
def udf_per_group(t):
    ring = star_polygons(t.supplier, "s_suppkey")
    out = fold_groups(ring, ["s_suppkey"], ["seq"], _walk, _join, lambda s: {"perimeter": s[2] + math.dist(s[1], s[0])}, "perimeter double")
    return out.withColumn("perimeter", F.round("perimeter", 6))
