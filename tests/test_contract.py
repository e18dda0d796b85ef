"""Missing-value, tie and order rules on small literal tables with injected nulls."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkverbs.functions import categories as c
from sparkverbs.functions import dates, nulls, numeric, text
from sparkverbs.operators import aggregates, joins, levels, ordered, project, reshape, windows
from sparkverbs.sources.delimited import read_csv, write_csv


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@pytest.fixture
def letters(frame):
    return frame([("a", 1), ("b", 2), (None, 3)], "k string, v int", parts=2)


def test_membership_is_never_null(letters, rows):
    assert rows(letters.where(nulls.not_in_set("k", ["a"])).select("k")) == [("b",), (None,)]
    assert rows(letters.where(nulls.in_set("k", ["a", None])).select("k")) == [("a",), (None,)]
    assert letters.where(nulls.not_in_set("k", [])).count() == 3


def test_filter_drops_null_predicates(letters):
    assert letters.where(F.col("k") == "a").count() == 1


def test_null_joins_null(letters, frame, rows):
    other = frame([("a", 10), (None, 30)], "k string, w int")
    assert rows(joins.join_on(letters, other, ["k"], null_safe=True)) == [("a", 1, 10), (None, 3, 30)]
    assert rows(joins.join_on(letters, other, ["k"])) == [("a", 1, 10)]
    assert rows(joins.set_difference(letters.select("k"), other.select("k"))) == [("b",)]


def test_strict_and_lenient_aggregates(frame, rows):
    df = frame([("x", 1.0), ("x", None), ("y", 2.0), ("y", 4.0)], "g string, v double")
    out = df.groupBy("g").agg(nulls.sum_of("v").alias("s"), nulls.mean_of("v", na_rm=True).alias("m"),
                              nulls.max_of("v").alias("hi"), nulls.min_of("v", na_rm=True).alias("lo"))
    assert rows(out) == [("x", None, 1.0, None, 1.0), ("y", 6.0, 3.0, 4.0, 2.0)]


def test_distinct_count_counts_null(frame):
    df = frame([(1,), (1,), (None,)], "v int")
    assert one(df.agg(nulls.n_distinct("v").alias("n")), "n") == [2]


def test_null_condition_gives_null(letters):
    assert sorted(one(letters, nulls.if_else(F.col("k") == "a", "y", "n")), key=str) == [None, "n", "y"]
    assert sorted(one(letters, nulls.case_when((F.col("k") == "a", 1))), key=str) == [1, None, None]


def test_paste_writes_na(letters):
    assert sorted(one(letters, text.paste("k", F.lit("x")))) == ["NAx", "ax", "bx"]
    assert None in one(letters, text.paste("k", F.lit("x"), na=None))


def test_counts_sort_with_ties_in_key_order(frame):
    df = frame([("b",), ("b",), ("a",), ("a",), ("c",)], "k string")
    assert [r.k for r in aggregates.count_by(df, "k", sort=True).collect()] == ["a", "b", "c"]
    assert [r.k for r in aggregates.top_counts(df, 1, "k").collect()] == ["a"]


def test_numbering_puts_null_last(frame, rows):
    df = frame([(3,), (None,), (1,)], "v int")
    assert rows(ordered.number_rows(df, ["v"])) == [(1, 1), (3, 2), (None, 3)]
    assert rows(ordered.number_rows(df, [F.col("v").desc_nulls_last()])) == [(1, 2), (3, 1), (None, 3)]
    with pytest.raises(ValueError):
        ordered.number_rows(df, [])


def test_top_n_keeps_ties_and_drops_null(frame, rows):
    df = frame([("g", i, v) for i, v in enumerate([5, 5, 4, 4, 3, None])] + [(None, 9, 1)], "g string, i int, v int")
    assert rows(windows.top_n(df, 3, "v", ["g"]).select("i")) == [(0,), (1,), (2,), (3,), (9,)]
    assert rows(windows.top_n(df, 1, "v", ["g"], bottom=True).select("i")) == [(4,), (9,)]
    assert rows(windows.top_n(df, 1, "v").select("i")) == [(0,), (1,)]


def test_first_row_per_key_is_deterministic(frame, rows):
    df = frame([("a", 2), ("a", 1), ("b", 7)], "k string, v int")
    assert rows(windows.first_rows(df, ["k"], ["v"])) == [("a", 1), ("b", 7)]


def test_floor_modulo(frame):
    df = frame([(7, 5), (-7, 5), (7, -5), (-7, -5), (1, 0)], "a int, b int")
    got = {(r.a, r.b): (r.m, r.d) for r in df.select("a", "b", numeric.floor_mod("a", "b").alias("m"), numeric.floor_div("a", "b").alias("d")).collect()}
    for (a, b), pair in got.items():
        assert pair == ((a % b, a // b) if b else (None, None))


def test_half_even_and_division(frame):
    df = frame([(0.5,), (1.5,), (2.5,)], "v double")
    assert sorted(one(df, numeric.half_even("v"))) == [0.0, 2.0, 2.0]
    assert one(df.limit(1), numeric.divide(F.col("v"), F.lit(0))) == [None]


def test_text_rules(spark):
    df = spark.createDataFrame([("yellow-eyed r&b o'brien kākāpō",)], "t string")
    assert one(df, text.title_case("t")) == ["Yellow-Eyed R&B O'brien Kākāpō"]
    assert one(df, text.replace_first("t", "[eo]", "_")) == ["y_llow-eyed r&b o'brien kākāpō"]
    assert one(df, text.replace_first("t", "(y)(e)", "$2$1")) == ["eyllow-eyed r&b o'brien kākāpō"]
    assert one(df, text.remove_first("t", "^yellow-")) == ["eyed r&b o'brien kākāpō"]
    assert one(df, text.extract_first("t", r"\d")) == [None]
    assert one(df, text.split_first("t")) == ["yellow-eyed"]
    assert one(df, text.words("t")) == [["yellow", "eyed", "r", "b", "o'brien", "kākāpō"]]
    assert one(df, text.words(F.lit("Don't pay 3.5 well-balanced. End."))) == [["don't", "pay", "3.5", "well", "balanced", "end"]]


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([(7,), (1234,)], "v int")
    assert one(df, text.pad_left("v", 3, "0")) == ["007", "1234"]


def test_labels(spark):
    df = spark.createDataFrame([(12000.0,), (12340.0,), (123456.0,)], "g double")
    assert one(df, text.format_kg("g")) == ["12.0kg", "12.3kg", "123kg"]
    assert one(df.limit(1), text.format_count(F.lit(1234567))) == ["1,234,567"]
    assert one(df.limit(1), text.format_percent(F.lit(0.125), 1)) == ["12.5%"]


def test_exact_quantiles_are_linear(frame, rows):
    df = frame([("a", float(v)) for v in (1, 2, 3, 10)] + [("b", 5.0), ("b", None)], "g string, v double")
    assert rows(aggregates.exact_quantiles(df, "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}, ["g"])) == [
        ("a", 1.75, 2.5, 4.75), ("b", 5.0, 5.0, 5.0)]
    weighted = frame([(1.0, 3), (2.0, 1)], "v double, n int")
    assert rows(aggregates.exact_quantiles(weighted, "v", {"m": 0.5}, weight="n")) == [(1.0,)]


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (0.02,), (0.05,), (0.06,), (None,)], "v double")
    assert one(df, c.cut("v", [0, 0.02, 0.05])) == [None, "(0,0.02]", "(0.02,0.05]", None, None]


def test_lump_keeps_ties(frame, rows):
    df = frame([(k,) for k in "aaabbccd"] + [(None,)], "k string")
    got = [r[0] for r in levels.lump(df, "k", 2).collect()]
    assert sorted(got, key=str) == sorted(["a"] * 3 + ["b"] * 2 + ["c"] * 2 + ["Other", None], key=str)


def test_level_order_by_median(frame, rows):
    df = frame([("a", 1), ("a", 100), ("a", 101), ("b", 5), ("c", 100)], "k string, v int")
    assert rows(levels.median_order(df, "k", "v").select("k", "k_ord")) == [("a", 2), ("b", 1), ("c", 3)]


def test_unknown_levels_are_null(letters):
    assert sorted(one(letters, c.level_ordinal("k", ["b"])), key=str) == [1, None, None]
    assert sorted(one(letters, c.known_level("k", ["b"])), key=str) == [None, None, "b"]
    assert c.relevel(["a", "b", "c"], "c") == ["c", "a", "b"]
    assert sorted(one(letters, c.recode("k", {"a": "z"})), key=str) == [None, "b", "z"]
    assert sorted(one(letters, c.other("k", ["a"])), key=str) == [None, "Other", "a"]


def test_text_number_comparison(spark):
    df = spark.createDataFrame([("1",), ("Champion",)], "t string")
    assert one(df, nulls.same_text("t", 1)) == [True, False]


def test_dates(spark):
    df = spark.createDataFrame([("01/31/2014 01:30:00 PM",), ("rubbish",)], "t string")
    assert one(df, dates.parse_timestamp("t", "MM/dd/yyyy hh:mm:ss a")) == [dt.datetime(2014, 1, 31, 13, 30), None]
    monday = F.lit("2024-01-01").cast("date")
    assert one(df.limit(1), dates.weekday_index(monday)) == [0]
    assert one(df.limit(1), dates.weekday_label(monday)) == ["Mon"]


def test_safe_cast(spark):
    df = spark.createDataFrame([("7",), ("x",)], "t string")
    assert one(df, nulls.safe_cast("t", "int")) == [7, None]


def test_pandas_style_counts_and_pivot(frame, rows):
    df = frame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 5.0), (None, "y", 9.0)], "k string, c string, v double")
    assert rows(aggregates.count_by(df, "k", drop_null=True)) == [("a", 2), ("b", 1)]
    assert rows(aggregates.count_by(df, "k")) == [("a", 2), ("b", 1), (None, 1)]
    assert rows(reshape.pivot_table(df, ["k"], "c", ["x", "y"], "v", fill=0.0)) == [("a", 2.0, 0.0), ("b", 0.0, 5.0)]


def test_population_deviation(frame, rows):
    assert rows(windows.zscore(frame([(1.0,), (3.0,)], "v double"), ["v"])) == [(-1.0,), (1.0,)]


def test_lag_default_only_before_the_first_row(frame, rows):
    df = frame([("a", 1, None), ("a", 2, 5), ("a", 3, 6)], "k string, i int, v int")
    assert rows(ordered.lag_value(df, "v", ["i"], ["k"], default=0).select("i", "previous")) == [(1, 0), (2, None), (3, 5)]


def test_union_fills_missing_columns(frame, rows):
    a, b = frame([(1, "x")], "i int, t string"), frame([(2,)], "i int")
    assert rows(reshape.union_by_name(a, b)) == [(1, "x"), (2, None)]


def test_cells_split_at_any_run_of_marks(frame, rows):
    df = frame([("a, b/c.d",)], "t string")
    assert rows(reshape.split_rows(df, "t")) == [("a",), ("b",), ("c.d",)]


def test_csv_na_round_trip(frame, rows, tmp_path):
    df = frame([(1, None, 1.5), (2, "x, \"y\"", None)], "i int, t string, d double")
    write_csv(df, f"{tmp_path}/out")
    text_lines = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "1,NA,1.5" in text_lines
    back = read_csv(df.sparkSession, f"{tmp_path}/out", df.schema)
    assert rows(back) == rows(df)


def test_blank_header_gets_a_name(spark, tmp_path):
    (tmp_path / "f.csv").write_text(",b\n1,2\n")
    assert read_csv(spark, f"{tmp_path}/f.csv").columns == ["X1", "b"]


def test_bounds_keep_null(spark):
    df = spark.createDataFrame([(None,), (-5,), (5,)], "v int")
    assert one(df, numeric.at_least("v", 0)) == [None, 0, 5]
    assert one(df, numeric.clamp("v", -1, 1)) == [None, -1, 1]


def test_fill_replaces_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (math.nan,), (2.0,)], "v double")
    assert one(project.fill_missing(df, 0.0), "v") == [0.0, 0.0, 2.0]


def test_names():
    assert [project.snake_case(n) for n in ["Visitor Count (%)", "adminName", "GDP_per.Capita", "2016", " x "]] == [
        "visitor_count_percent", "admin_name", "gdp_per_capita", "x2016", "x"]


def test_running_sum_over_nulls(frame, rows):
    df = frame([(1, None), (2, 4), (3, None), (4, 1)], "i int, v int")
    assert rows(ordered.running_sum(df, "v", ["i"]).select("i", "running")) == [(1, None), (2, 4), (3, 4), (4, 5)]
