"""Projection, filters and predicates."""

from pyspark.sql import functions as F

from ..functions.nulls import any_present, case_when, in_set, not_in_set, same_text
from ..functions.numeric import divide
from ..operators import project as p
from ..operators.aggregates import top_counts, within_fence
from ..operators.joins import rows_in, rows_not_in
from ..operators.ordered import zip_rows
from .registry import query


@query("select_cols", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def select_cols(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")


@query("drop_cols", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_cols(t):
    return t.orders.drop("o_custkey", "o_orderdate")


@query("select_helpers", """
SELECT o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders""")
def select_helpers(t):
    df = t.orders
    by_prefix = df.select(*p.starts_with(df, "o_order"), *p.contains(df, "PRICE"), *p.existing(df, ["o_custkey", "medal"]))
    return p.move_first(by_prefix, "o_totalprice").select(*p.except_for(by_prefix, "o_orderdate"))


@query("rename_cols", "SELECT c_custkey AS id, c_name AS name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def rename_cols(t):
    return p.rename(t.customer, id="c_custkey", name="c_name", balance="c_acctbal")


@query("clean_names", "SELECT c_custkey AS customer_id, c_name AS customer_name, c_acctbal AS acct_bal_percent FROM customer")
def clean_names(t):
    messy = t.customer.select(F.col("c_custkey").alias("Customer ID"), F.col("c_name").alias(" customerName."),
                              F.col("c_acctbal").alias("Acct-Bal (%)"))
    return p.clean_names(messy)


@query("mutate_chain", """
SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice, round(o_totalprice * 2 + 1, 2) AS more, o_totalprice * 2 + 1 > 300000 AS big
FROM orders""")
def mutate_chain(t):
    out = p.mutate(t.orders.select("o_orderkey", "o_totalprice"), twice=F.round(F.col("o_totalprice") * 2, 2),
                   more=F.round(F.col("twice") + 1, 2), big=F.col("o_totalprice") * 2 + 1 > 300000)
    return out.drop("o_totalprice")


@query("transmute", "SELECT l_orderkey, l_extendedprice / l_quantity AS unit_price FROM lineitem")
def transmute(t):
    return t.lineitem.select("l_orderkey", divide("l_extendedprice", "l_quantity").alias("unit_price"))


@query("summarize_all_mean", """
SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
       round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem""")
def summarize_all_mean(t):
    names = p.between(t.lineitem, "l_quantity", "l_tax")
    means = p.summarise_columns(t.lineitem, F.avg, names)
    return means.select(*[F.round(c, 4 if c == "l_extendedprice" else 6).alias(c) for c in names])


@query("scalar_join", "SELECT event_id, round(value / (SELECT max(value) FROM events), 6) AS of_max FROM events")
def scalar_join(t):
    top = p.scalar(t.events, F.max("value"))
    return t.events.select("event_id", F.round(divide(F.col("value"), top), 6).alias("of_max"))


@query("zip_by_index", """
WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
     b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS i FROM orders)
SELECT c_custkey, o_orderkey FROM a FULL JOIN b USING (i)""")
def zip_by_index(t):
    return zip_rows(t.customer.select("c_custkey"), ["c_custkey"], t.orders.select("o_orderkey"), [F.col("o_orderkey").desc()])


@query("fill_missing", """
SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(nullif(n_chars, 0), -1) AS n_chars,
       coalesce(CASE WHEN quality = 0 THEN NULL ELSE n_chars / 10.0::DOUBLE END, -1.0) AS tenth
FROM documents d LEFT JOIN labels USING (doc_id)""")
def fill_missing(t):
    df = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    tenth = F.when(F.col("quality") == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 10)
    return p.fill_missing(df.withColumn("tenth", tenth), -1, ["quality", "n_chars"]).transform(
        lambda d: p.fill_missing(d, -1.0, ["tenth"]))


@query("filter_conj", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 30 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'""")
def filter_conj(t):
    rows = t.lineitem.where((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R")
                            & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("not_in_keep_null", """
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders
WHERE coalesce(nullif(o_orderpriority, '5-LOW') NOT IN ('1-URGENT', '2-HIGH'), TRUE)""")
def not_in_keep_null(t):
    rows = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return rows.where(not_in_set("priority", ["1-URGENT", "2-HIGH"]))


TOP_NAMES = """WITH top AS (
  SELECT p_name FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 10)
"""


def _top_names(t):
    lines = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"))
    sold = lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return top_counts(sold, 10, "p_name", weight="lines")


@query("semi_join_top", TOP_NAMES + "SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM top)")
def semi_join_top(t):
    return rows_in(t.part.select("p_partkey", "p_name"), "p_name", _top_names(t))


@query("anti_join_top", TOP_NAMES + "SELECT p_partkey, p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM top)")
def anti_join_top(t):
    return rows_not_in(t.part.select("p_partkey", "p_name"), "p_name", _top_names(t))


@query("is_missing", """
SELECT (quality IS NULL) AS unlabelled, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def is_missing(t):
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return df.groupBy(F.col("quality").isNull().alias("unlabelled")).agg(F.count(F.lit(1)).alias("n"))


@query("drop_missing", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE lang <> 'de'")
def drop_missing(t):
    df = t.documents.select("doc_id", F.nullif("lang", F.lit("de")).alias("lang")).join(
        t.labels.select("doc_id", "quality"), "doc_id", "left")
    return df.na.drop()


@query("regex_filter", """
SELECT doc_id FROM documents WHERE regexp_matches(text, '\\d{3,}') UNION ALL
SELECT doc_id FROM documents WHERE starts_with(text, 'The')""".replace("\\\\", "\\"))
def regex_filter(t):
    d = t.documents
    return d.where(F.col("text").rlike(r"\d{3,}")).select("doc_id").unionByName(
        d.where(F.col("text").startswith("The")).select("doc_id"))


@query("iqr_fence", """
WITH s AS (SELECT o_orderpriority, median(o_totalprice) AS m,
                  quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS w
           FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders JOIN s USING (o_orderpriority)
WHERE abs(o_totalprice - m) <= 0.75 * w""")
def iqr_fence(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return within_fence(rows, "o_totalprice", ["o_orderpriority"], width=0.75)


@query("query_string", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F'")
def query_string(t):
    return t.orders.filter("year(o_orderdate) = 1996 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("string_number_compare", """
SELECT l_orderkey, l_linenumber, CASE WHEN to_value = '1' THEN 'one' WHEN to_value = 'R' THEN 'returned' ELSE 'rest' END AS kind
FROM (SELECT l_orderkey, l_linenumber, l_shipdate,
             CASE WHEN l_returnflag = 'A' THEN l_linenumber::VARCHAR ELSE l_returnflag END AS to_value FROM lineitem)
WHERE l_shipdate > DATE '1996-01-01'""")
def string_number_compare(t):
    mixed = F.when(F.col("l_returnflag") == "A", F.col("l_linenumber").cast("string")).otherwise(F.col("l_returnflag"))
    rows = t.lineitem.where(F.col("l_shipdate") > F.lit("1996-01-01").cast("date")).withColumn("to_value", mixed)
    kind = case_when((same_text("to_value", 1), "one"), (same_text("to_value", "R"), "returned"), default="rest")
    return rows.select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query("any_present", """
SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(nullif(quality, 0), nullif(toxic, 0)) IS NOT NULL""")
def present_in_any(t):
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return df.where(any_present(F.nullif("quality", F.lit(0)), F.nullif("toxic", F.lit(0)))).select("doc_id")


@query("in_set", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def member_of(t):
    return t.orders.where(in_set("o_orderstatus", ["F", "P"])).select("o_orderkey")
