"""Joins."""

from pyspark.sql import functions as F

from ..functions.nulls import if_else
from ..operators import joins as j
from ..operators.graph import interaction_edges
from ..operators.windows import top_n
from ..session import materialise
from ..sources.sequences import literal_table
from .registry import query

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("left_join_agg", """
SELECT lang, count(*) AS n_docs, count(quality) AS n_labelled, round(avg(quality), 6) AS mean_quality
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def left_join_agg(t):
    df = j.join_on(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"], "left")
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labelled"),
                                  F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("left_join_renamed", """
SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3""")
def left_join_renamed(t):
    nations = t.nation.where("n_regionkey < 3").select("n_nationkey", "n_name")
    return j.join_on(t.customer, nations, [("c_nationkey", "n_nationkey")], "left").select("c_custkey", "c_name", "n_name")


@query("inner_join_multi", """
WITH a AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL),
     b AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT a.*, b.n FROM a JOIN b USING (l_suppkey, l_returnflag)""")
def inner_join_multi(t):
    keys = ["l_suppkey", "l_returnflag"]
    qty = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("qty"))
    n = t.lineitem.where("l_linestatus = 'O'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return j.join_on(qty, n, keys)


@query("natural_join", """
WITH a AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
     b AS (SELECT o_orderpriority, o_orderstatus, max(o_totalprice) AS top FROM orders WHERE o_totalprice < 200000 GROUP BY ALL)
SELECT * FROM a NATURAL JOIN b""")
def natural_join(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    n = t.orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = t.orders.where("o_totalprice < 200000").groupBy(*keys[::-1]).agg(F.max("o_totalprice").alias("top"))
    return j.natural_join(n, top)


@query("right_join", """
WITH sold AS (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT p_partkey, p_brand, qty FROM sold RIGHT JOIN part ON l_partkey = p_partkey""")
def right_join(t):
    sold = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("qty"))
    return j.join_on(sold, t.part.select("p_partkey", "p_brand"), ["p_partkey"], "right")


@query("anti_join_extremes", """
WITH d AS (SELECT DISTINCT o_orderpriority, o_totalprice FROM orders)
SELECT o_orderpriority, o_totalprice FROM d WINDOW w AS (PARTITION BY o_orderpriority)
QUALIFY o_totalprice <> max(o_totalprice) OVER w AND o_totalprice <> min(o_totalprice) OVER w""")
def anti_join_extremes(t):
    rows = materialise(t.orders.select("o_orderpriority", "o_totalprice").distinct())
    top = top_n(rows, 1, "o_totalprice", ["o_orderpriority"])
    low = top_n(rows, 1, "o_totalprice", ["o_orderpriority"], bottom=True)
    return j.set_difference(j.set_difference(rows, top), low)


@query("pair_edges", """
WITH c AS (SELECT user_id, ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT a.event_type AS "from", b.event_type AS "to", sum(a.n)::BIGINT AS weight
FROM c a JOIN c b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type <> b.event_type GROUP BY ALL""")
def pair_edges(t):
    counts = t.events.groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return interaction_edges(counts, [], ["user_id", "day"], "event_type", "n")


@query("cross_dims", """
SELECT n_name, segment, coalesce(n, 0) AS n FROM (SELECT DISTINCT n_nationkey, n_name FROM nation) CROSS JOIN
  (SELECT unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) AS segment)
LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
  ON n_nationkey = c_nationkey AND segment = c_mktsegment""")
def cross_dims(t):
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cells = j.crossing(t.nation, "n_nationkey", segments, "segment")
    n = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    out = j.join_on(cells, n, [("n_nationkey", "c_nationkey"), ("segment", "c_mktsegment")], "left")
    named = j.join_on(out, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])
    return named.select("n_name", "segment", F.coalesce("n", F.lit(0)).alias("n"))


@query("cumulative_expand", """
SELECT until::INT AS until, o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum
FROM orders, range(1996, 2001) AS r(until)
WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) <= until GROUP BY ALL""")
def cumulative_expand(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    # orders of one year are merged before they are repeated
    merged = rows.groupBy("year", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("k"))
    return j.expand_until(merged, "year", 1996, 2000).groupBy("until", "o_orderstatus").agg(
        F.sum("n").alias("n"), F.sum("k").alias("key_sum"))


@query("code_lookup", """
SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' END, lang) AS language
FROM documents""")
def code_lookup(t):
    names = literal_table(t.spark, [("en", "English"), ("fr", "French"), ("de", "German")], "code string, language string")
    return j.code_lookup(t.documents.select("doc_id", "lang"), "lang", F.broadcast(names), "code", "language", "language").drop("lang")


@query("join_suffix", """
SELECT c_custkey AS key, c_acctbal AS "balance.x", s_acctbal AS "balance.y" FROM customer JOIN supplier ON c_custkey = s_suppkey""")
def join_suffix(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return j.join_on(a, b, ["key"])


@query("repair_key", """
SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#1'), trim(replace(p_name, 'red', ''))) AS brand,
       CASE WHEN nullif(p_type, 'PROMO') = 'SMALL' THEN 's' WHEN nullif(p_type, 'PROMO') <> 'SMALL' THEN p_type END AS type
FROM part""")
def repair_key(t):
    kind = F.nullif("p_type", F.lit("PROMO"))
    return t.part.select(
        "p_partkey",
        j.repair(F.nullif("p_brand", F.lit("Brand#1")), F.trim(F.replace("p_name", F.lit("red"), F.lit("")))).alias("brand"),
        if_else(kind == "SMALL", "s", F.col("p_type")).alias("type"))
