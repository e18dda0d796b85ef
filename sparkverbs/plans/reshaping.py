"""Unions, pivots, splitting and sequences."""

from pyspark.sql import functions as F

from ..operators import reshape as r
from ..operators.ordered import chunk_rows as number_chunks
from ..session import materialise
from .registry import query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("union_by_name", """
SELECT c_nationkey AS nationkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier""")
def union_by_name(t):
    c = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nationkey"))
    return r.union_by_name(c, s)


@query("union_tagged", """
SELECT o_orderkey, 1::INT AS id FROM orders WHERE o_totalprice > 100000 UNION ALL
SELECT o_orderkey, 2::INT AS id FROM orders WHERE o_totalprice > 200000 UNION ALL
SELECT o_orderkey, 3::INT AS id FROM orders WHERE o_totalprice > 300000""")
def union_tagged(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return r.union_tagged({i: rows.where(F.col("o_totalprice") > i * 100000).drop("o_totalprice") for i in (1, 2, 3)})


@query("unpivot", """
SELECT l_orderkey, l_linenumber, l_partkey, 'discount' AS measure, l_discount AS value FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, 'tax', l_tax FROM lineitem""")
def unpivot(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    return r.longer(rows, ["l_discount", "l_tax"], "measure", "value", prefix="l_")


PARITY = "SELECT p_partkey, p_size::DOUBLE AS x1, p_retailprice AS y1, p_size + 1.0::DOUBLE AS x2, p_retailprice * 2 AS y2 FROM part"


def _corners(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("x1"), F.col("p_retailprice").alias("y1"),
                         (F.col("p_size") + 1.0).alias("x2"), (F.col("p_retailprice") * 2).alias("y2"))


@query("unpivot_pattern", f"""
WITH c AS ({PARITY})
SELECT p_partkey, name[1:1] AS coord, name[2:2] AS id, value FROM (UNPIVOT c ON x1, y1, x2, y2 INTO NAME name VALUE value)""")
def unpivot_pattern(t):
    return r.longer_by_pattern(_corners(t), ["x1", "y1", "x2", "y2"], ["coord", "id"], r"^([a-z])(\d)$")


@query("unpivot_multi", f"""
WITH c AS ({PARITY})
SELECT p_partkey, 1::INT AS set, x1 AS x, y1 AS y FROM c UNION ALL SELECT p_partkey, 2, x2, y2 FROM c""")
def unpivot_multi(t):
    return r.longer_sets(_corners(t), {1: {"x": "x1", "y": "y1"}, 2: {"x": "x2", "y": "y2"}})


@query("pivot_fill", """
SELECT p_name, sum(CASE WHEN l_returnflag = 'A' THEN n ELSE 0 END)::BIGINT AS "A", sum(CASE WHEN l_returnflag = 'N' THEN n ELSE 0 END)::BIGINT AS "N",
       sum(CASE WHEN l_returnflag = 'R' THEN n ELSE 0 END)::BIGINT AS "R"
FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 40 AND l_tax > 0.06 GROUP BY ALL) JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def pivot_fill(t):
    n = t.lineitem.where("l_quantity > 40 and l_tax > 0.06").groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    named = n.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return r.wider(named, ["p_name"], "l_returnflag", ["A", "N", "R"], "n", fill=0, aggregate=F.sum)


@query("pivot_multi", """
WITH g AS (SELECT c_mktsegment, year(o_orderdate) AS y, count(*) AS total, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, """ + ", ".join(f"max(CASE WHEN y = {y} THEN {c} END) AS {c}_{y}" for y in range(1995, 2002) for c in ("total", "top")) + """
FROM g GROUP BY 1""")
def pivot_multi(t):
    by_customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))
    g = by_customer.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment", "y").agg(
        F.sum("n").alias("total"), F.max("m").alias("top"))
    return r.wider_multi(materialise(g), ["c_mktsegment"], "y", None, ["total", "top"])


@query("pivot_table", """
SELECT l_suppkey, """ + ", ".join(
    f"round(coalesce(avg(CASE WHEN l_linenumber = {i} THEN l_quantity END), 0), 6) AS \"{i}\"" for i in range(1, 8)) + """
FROM lineitem GROUP BY 1""")
def pivot_table(t):
    out = r.pivot_table(t.lineitem, ["l_suppkey"], "l_linenumber", None, "l_quantity", fill=0.0)
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in out.columns if c != "l_suppkey"])


@query("unnest_list", """
SELECT vec_id, label, unnest(embedding)::DOUBLE AS v FROM embeddings""")
def unnest_list(t):
    return t.embeddings.select("vec_id", "label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))


@query("separate_rows", """
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part""")
def separate_rows(t):
    return r.split_rows(t.part.select("p_partkey", "p_name"), "p_name")


WORD_SQL = r"([\p{L}\p{M}\p{N}]+(?:[''’.][\p{L}\p{M}\p{N}]+)*)"


@query("tokenize", rf"""
SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}', 1)) AS word FROM documents) GROUP BY ALL""")
def tokenize(t):
    return r.tokens(t.documents.select("doc_id", "text"), "text").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("densify_days", """
WITH d AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, unnest(range(min(day), max(day) + 1))::INT AS day FROM d GROUP BY 1)
SELECT user_id, day, n FROM s LEFT JOIN d USING (user_id, day)""")
def densify_days(t):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")
    n = t.events.groupBy("user_id", day).agg(F.count(F.lit(1)).alias("n"))
    return r.fill_sequence(n, ["user_id"], "day", F.min("day"), F.max("day"))


@query("chunk_rows", """
SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 5 + 1 AS chunk FROM events""")
def chunk_rows(t):
    return number_chunks(t.events.select("event_id", "ts"), 5, ["ts", "event_id"]).select("event_id", "chunk")
