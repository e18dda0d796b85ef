"""Window functions, sorting and limits."""

from pyspark.sql import functions as F

from ..functions.categories import level_ordinal
from ..operators import ordered as o
from ..operators import windows as w
from ..operators.aggregates import count_by, top_counts
from .registry import query

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


@query("rank_in_group", """
SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders""")
def rank_in_group(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return o.number_rows(rows, [F.col("o_totalprice").desc(), "o_orderkey"], ["o_orderpriority"], name="rank").drop("o_totalprice")


@query("global_row_number", f"""
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY {LINE_ORDER_SQL}) AS row_number FROM lineitem""")
def global_row_number(t):
    return o.number_rows(t.lineitem.select(*LINE_ORDER), LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "row_number")


@query("top_n_ties", """
SELECT l_suppkey, l_orderkey, l_partkey, l_quantity FROM lineitem QUALIFY rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) <= 3""")
def top_n_ties(t):
    return w.top_n(t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity"), 3, "l_quantity", ["l_suppkey"])


@query("bottom_n_ties", """
SELECT p_brand, p_partkey, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size) <= 2""")
def bottom_n_ties(t):
    return w.top_n(t.part.select("p_brand", "p_partkey", "p_size"), 2, "p_size", ["p_brand"], bottom=True)


@query("lag_default", """
SELECT event_id, lag(value, 1, 0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous FROM events""")
def lag_default(t):
    rows = t.events.select("event_id", "event_type", "ts", "value")
    return o.lag_value(rows, "value", ["ts", "event_id"], ["event_type"], default=0.0).select("event_id", "previous")


@query("running_sum", """
SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT AS running,
       round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey), 2) AS price FROM orders""")
def running_sum(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    out = o.running_sum(rows, "o_custkey", ["o_orderdate", "o_orderkey"])
    exact = F.col("o_totalprice").cast("decimal(20,2)")
    out = o.running_sum(out, exact, ["o_orderdate", "o_orderkey"], ["o_orderstatus"], name="price")
    return out.select("o_orderkey", "running", F.col("price").cast("double").alias("price"))


@query("group_total", """
SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def group_total(t):
    out = w.with_group_stats(t.orders, ["o_orderpriority"], n=F.count(F.lit(1)), top=F.max("o_totalprice"))
    return out.select("o_orderkey", "n", "top")


@query("share_of_parent", """
WITH g AS (SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey, n_nationkey, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY n_regionkey), 6) AS share,
       round(sum(n) OVER (PARTITION BY n_regionkey)::DOUBLE / sum(n) OVER (), 6) AS parent_share FROM g""")
def share_of_parent(t):
    n = count_by(t.customer, "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    n = n.select("n_regionkey", "n_nationkey", "n")
    out = w.with_group_stats(n, ["n_regionkey"], parent=F.sum("n"))
    out = w.with_group_stats(out, [], n, total=F.sum("n"))
    return out.select("n_regionkey", "n_nationkey", "n", F.round(F.col("n") / F.col("parent"), 6).alias("share"),
                      F.round(F.col("parent") / F.col("total"), 6).alias("parent_share"))


@query("scale_max", """
SELECT event_id, value / max(value) OVER () AS of_all, value / max(value) OVER (PARTITION BY user_id) AS of_user FROM events""")
def scale_max(t):
    out = w.scale_max(t.events.select("event_id", "user_id", "value"), "value", [], "of_all")
    return w.scale_max(out, "value", ["user_id"], "of_user").select("event_id", "of_all", "of_user")


@query("rescale01", """
SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS l_quantity,
       (l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()) AS l_tax FROM lineitem""")
def rescale01(t):
    return w.rescale01(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query("change_flag", """
WITH l AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, CASE WHEN p IS NOT NULL AND event_type <> p THEN 3 ELSE 0 END::INT AS pad FROM l""")
def change_flag(t):
    out = o.lag_value(t.events.select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"], name="p")
    return out.select("event_id", F.when(F.col("event_type") != F.col("p"), 3).otherwise(0).alias("pad"))


BANDS_SQL = """
WITH g AS (SELECT year(o_orderdate)::INT AS year, o_orderpriority, count(*) AS size FROM orders GROUP BY ALL),
s AS (SELECT *, CASE WHEN lag(year) OVER o IS NOT NULL AND year <> lag(year) OVER o THEN 3 ELSE 0 END AS shift FROM g WINDOW o AS (ORDER BY year, o_orderpriority)),
b AS (SELECT year, o_orderpriority, size, sum(size + shift) OVER (ORDER BY year, o_orderpriority)::BIGINT AS "end" FROM s)
"""


def _year_bands(t):
    sizes = t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count(F.lit(1)).alias("size"))
    return w.bands(sizes, "size", ["year", "o_orderpriority"], gap_when="year", gap=3)


@query("padded_bands", BANDS_SQL + """SELECT *, "end" - size AS start FROM b""")
def padded_bands(t):
    return _year_bands(t)


@query("band_midpoint", BANDS_SQL + """
SELECT DISTINCT year, min("end" - size) OVER (PARTITION BY year) + (sum(size) OVER (PARTITION BY year)) / 2.0::DOUBLE AS midpoint FROM b""")
def band_midpoint(t):
    return w.midpoints(_year_bands(t), ["year"]).select("year", "midpoint").distinct()


@query("main_flag", """
WITH g AS (SELECT l_suppkey, p_brand, sum(l_linenumber)::BIGINT AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY total DESC, p_brand) = 1 AS main FROM g""")
def main_flag(t):
    by_part = t.lineitem.groupBy("l_suppkey", F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_linenumber").alias("n"))
    g = by_part.join(t.part.select("p_partkey", "p_brand"), "p_partkey").groupBy("l_suppkey", "p_brand").agg(F.sum("n").alias("total"))
    return w.mark_first(g, ["l_suppkey"], [F.col("total").desc(), "p_brand"])


@query("zscore", """
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / d, 6) AS z FROM lineitem, s""")
def zscore(t):
    out = w.zscore(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_quantity"])
    return out.withColumn("z", F.round("l_quantity", 6)).drop("l_quantity")


@query("sort_multi", """
SELECT doc_id, quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)
ORDER BY quality ASC NULLS LAST, n_chars DESC NULLS LAST, doc_id""")
def sort_multi(t):
    df = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return df.select("doc_id", "quality", "n_chars").orderBy(
        F.col("quality").asc_nulls_last(), F.col("n_chars").desc_nulls_last(), "doc_id")


@query("top_k", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25")
def top_k(t):
    return top_counts(t.lineitem, 25, "l_partkey")


@query("last_row", "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def last_row(t):
    return t.orders.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(1)


@query("slice_index", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders)
SELECT * FROM r WHERE row_number IN (1, 2, 3, 5, 8, 13) OR row_number BETWEEN 100 AND 110""")
def slice_index(t):
    at = F.col("row_number")
    return o.slice_rows(t.orders.select("o_orderkey", "o_totalprice"), at.isin(1, 2, 3, 5, 8, 13) | at.between(100, 110),
                        ["o_totalprice", "o_orderkey"], last=110).drop("o_totalprice")


@query("sort_by_level", """
SELECT event_id, list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type)::INT AS event_type_ord
FROM events ORDER BY 2, 1""")
def sort_by_level(t):
    levels = ["view", "click", "signup", "purchase", "error"]
    return t.events.select("event_id", level_ordinal("event_type", levels).alias("event_type_ord")).orderBy("event_type_ord", "event_id")
