"""Aggregations."""

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import aggregates as a
from ..operators.colours import average_colour
from ..operators.windows import first_rows, with_group_stats
from .registry import query


@query("count_sorted", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_brand, p_type")
def count_sorted(t):
    return a.count_by(t.part, "p_brand", "p_type", sort=True)


@query("count_weighted", "SELECT lang, source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def count_weighted(t):
    return a.count_by(t.documents, "lang", "source", weight="n_chars", name="chars")


@query("sum_by", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY ALL""")
def sum_by(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        nulls.sum_of("l_quantity").alias("qty"), nulls.sum_of("l_linenumber").alias("lines"))


@query("mean_narm", "SELECT source, round(avg(quality), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def mean_narm(t):
    df = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return df.groupBy("source").agg(F.round(nulls.mean_of("quality", na_rm=True), 6).alias("quality"))


@query("mean_strict", """
SELECT length_class, CASE WHEN count(quality) = count(*) THEN round(avg(quality), 6) END AS quality,
       CASE WHEN count(quality) = count(*) THEN max(quality) END AS top
FROM (SELECT doc_id, n_chars // 50 AS length_class FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def mean_strict(t):
    df = t.documents.select("doc_id", F.floor(F.col("n_chars") / 50).alias("length_class")).join(t.labels, "doc_id", "left")
    return df.groupBy("length_class").agg(F.round(nulls.mean_of("quality"), 6).alias("quality"), nulls.max_of("quality").alias("top"))


@query("min_max_by", "SELECT event_type, min(value) AS low, max(value) AS high, min(ts)::TIMESTAMP AS first_ts FROM events GROUP BY 1")
def min_max_by(t):
    return t.events.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min("ts").alias("first_ts"))


@query("median_iqr", """
SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median,
       round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr
FROM lineitem GROUP BY ALL""")
def median_iqr(t):
    out = a.median_iqr(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return out.withColumns({c: F.round(c, 6) for c in ("median", "iqr")})


@query("n_distinct_by", """
SELECT source, (count(DISTINCT quality) + max(CASE WHEN quality IS NULL THEN 1 ELSE 0 END))::BIGINT AS n_quality, count(DISTINCT lang) AS n_lang
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def n_distinct_by(t):
    df = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    return df.groupBy("source").agg(nulls.n_distinct("quality").alias("n_quality"), F.count_distinct("lang").alias("n_lang"))


@query("n_distinct_each", """
SELECT p_partkey, p_brand, n FROM part JOIN (SELECT p_brand, count(DISTINCT p_name) AS n FROM part GROUP BY 1) USING (p_brand)""")
def n_distinct_each(t):
    return with_group_stats(t.part.select("p_partkey", "p_brand", "p_name"), ["p_brand"], n=F.count_distinct("p_name")).drop("p_name")


@query("first_by", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1")
def first_by(t):
    return t.orders.groupBy("o_custkey").agg(a.first_by("o_orderpriority", "o_orderkey").alias("first_priority"))


@query("collect_list", """
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types, count(*) AS n_types
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def collect_list(t):
    kinds = t.events.select("user_id", "event_type").distinct()
    lists = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list("event_type")).alias("types"))
    return lists.select("user_id", F.array_join("types", ",").alias("types"), F.size("types").cast("bigint").alias("n_types"))


@query("global_agg", """
SELECT max(o_totalprice) AS top, min(o_orderdate)::TIMESTAMP AS first_date, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders""")
def global_agg(t):
    return t.orders.agg(F.max("o_totalprice").alias("top"), F.min("o_orderdate").alias("first_date"),
                        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("distinct_cols", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def distinct_cols(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query("first_row_per_key", """
SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def first_row_per_key(t):
    return first_rows(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("unique_sorted", "SELECT DISTINCT p_name FROM part ORDER BY 1")
def unique_sorted(t):
    return t.part.select("p_name").distinct().orderBy("p_name")


@query("regroup_parent", """
WITH g AS (SELECT event_type, isodow(ts)::INT - 1 AS weekday, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY ALL)
SELECT *, round(100.0 * n / max(n) OVER (PARTITION BY event_type), 6) AS percentage FROM g""")
def regroup_parent(t):
    g = t.events.groupBy("event_type", F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    out = with_group_stats(g, ["event_type"], top=F.max("n"))
    return out.withColumn("percentage", F.round(F.col("n") * 100 / F.col("top"), 6)).drop("top")


@query("conditional_ratio", """
SELECT p_brand, round(sum(CASE WHEN p_type = 'PROMO' THEN p_size ELSE 0 END)::DOUBLE / sum(p_size), 6) AS ratio FROM part GROUP BY 1""")
def conditional_ratio(t):
    return t.part.groupBy("p_brand").agg(F.round(a.ratio_when("p_size", F.col("p_type") == "PROMO"), 6).alias("ratio"))


@query("group_by_flag", """
SELECT o_orderstatus, o_totalprice > 250000 AS large, count(*) AS n FROM orders GROUP BY ALL""")
def group_by_flag(t):
    return t.orders.groupBy("o_orderstatus", (F.col("o_totalprice") > 250000).alias("large")).agg(F.count(F.lit(1)).alias("n"))


PART_HEX = "'#' || lpad(lower(to_hex((p_partkey * 7919 + 1234567) % 16777216)), 6, '0')"


def part_colours(t):
    """A colour for every part, derived from its key."""
    code = F.pmod(F.col("p_partkey") * 7919 + 1234567, F.lit(16777216))
    return t.part.withColumn("hex", F.concat(F.lit("#"), F.lpad(F.lower(F.hex(code)), 6, "0")))


HLS_SQL = f"""
WITH c AS (SELECT p_partkey, p_name, p_brand, {PART_HEX} AS hex FROM part),
rgb AS (SELECT *, ('0x' || hex[2:3])::INT / 255.0::DOUBLE AS r, ('0x' || hex[4:5])::INT / 255.0::DOUBLE AS g,
               ('0x' || hex[6:7])::INT / 255.0::DOUBLE AS b FROM c),
mm AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM rgb),
hls AS (SELECT *, (mx + mn) / 2 AS l,
  CASE WHEN mx = mn THEN 0 WHEN (mx + mn) / 2 <= 0.5 THEN (mx - mn) / (mx + mn) ELSE (mx - mn) / (2 - mx - mn) END AS s,
  CASE WHEN mx = mn THEN 0 WHEN mx = r THEN (g - b) / (mx - mn) WHEN mx = g THEN (b - r) / (mx - mn) + 2
       ELSE (r - g) / (mx - mn) + 4 END * 60 AS h0 FROM mm),
full_hls AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h FROM hls)
"""


@query("avg_color", HLS_SQL + """
, m AS (SELECT p_brand, avg(h) AS h, avg(l) AS l, avg(s) AS s FROM full_hls GROUP BY 1),
k AS (SELECT *, (1 - abs(2 * l - 1)) * s AS c FROM m),
x AS (SELECT *, c * (1 - abs((h / 60) - 2 * floor(h / 120) - 1)) AS x, l - c / 2 AS o, floor(h / 60)::INT AS z FROM k),
q AS (SELECT p_brand,
  o + CASE WHEN z IN (0, 5) THEN c WHEN z IN (1, 4) THEN x ELSE 0 END AS r,
  o + CASE WHEN z IN (1, 2) THEN c WHEN z IN (0, 3) THEN x ELSE 0 END AS g,
  o + CASE WHEN z IN (3, 4) THEN c WHEN z IN (2, 5) THEN x ELSE 0 END AS b FROM x)
SELECT p_brand, '#' || lpad(lower(to_hex(round_even(r * 255, 0)::BIGINT)), 2, '0') || lpad(lower(to_hex(round_even(g * 255, 0)::BIGINT)), 2, '0')
       || lpad(lower(to_hex(round_even(b * 255, 0)::BIGINT)), 2, '0') AS avg_color FROM q""")
def avg_color(t):
    return average_colour(part_colours(t), "hex", ["p_brand"])
