"""Sources and sinks."""

from pyspark.sql import functions as F

from ..functions.dates import WEEKDAYS, weekday_index
from ..functions.nulls import safe_cast
from ..operators.project import table_shape
from ..operators.reshape import union_by_name
from ..session import remove_at_exit, scratch_path
from ..sources.delimited import read_csv, read_csv2, typed, write_csv
from ..sources.markup import extract_attribute, with_tag
from ..sources.polygons import star_polygons
from ..sources.sequences import literal_table, sequence_between, with_random
from .registry import query


@query("read_csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority
FROM orders""")
def read_csv_roundtrip(t):
    rows = t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    path = remove_at_exit(t.spark, scratch_path(t.spark, "csv"))
    write_csv(rows, path)
    return read_csv(t.spark, path, rows.schema)


@query("read_csv_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def read_csv_text(t):
    """Text with quotes, separators and line breaks survives the round trip."""
    path = remove_at_exit(t.spark, scratch_path(t.spark, "read-csv-text"))
    write_csv(t.documents, path)
    return read_csv(t.spark, path, t.documents.schema)


@query("read_csv_inferred", "SELECT p_name, p_size, p_retailprice, p_partkey::int AS p_partkey FROM part")
def read_csv_inferred(t):
    path = remove_at_exit(t.spark, scratch_path(t.spark, "read-csv-inferred"))
    write_csv(t.part.select("p_name", "p_size", "p_retailprice", "p_partkey"), path)
    return read_csv(t.spark, path)


@query("read_csv_headerless", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def read_csv_headerless(t):
    path = remove_at_exit(t.spark, scratch_path(t.spark, "csv"))
    write_csv(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path, header=False)
    return read_csv(t.spark, path, "a bigint, b string, c string", header=False, column_names=["id", "name", "segment"])


@query("read_csv2", "SELECT p_partkey, p_name, p_retailprice FROM part")
def read_decimal_comma(t):
    path = remove_at_exit(t.spark, scratch_path(t.spark, "csv"))
    comma = F.translate(F.col("p_retailprice").cast("string"), ".", ",").alias("p_retailprice")
    write_csv(t.part.select("p_partkey", "p_name", comma), path, sep=";")
    return read_csv2(t.spark, path, {"p_partkey": "bigint", "p_name": "string", "p_retailprice": "double"})


@query("typed_read", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts FROM events")
def typed_read(t):
    fmt = "MM/dd/yyyy hh:mm:ss a"
    text = t.events.select(F.col("event_id").cast("string"), F.date_format("ts", fmt).alias("ts"))
    return typed(text, {"event_id": "bigint"}, {"ts": fmt})


@query("bundle_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in
    ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
     "pages", "benchmark", "labels", "conversations"]))
def bundle_counts(t):
    return union_by_name(*[t[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in t])


@query("vertex_table", """
SELECT n_nationkey, seq::INT AS seq,
       round(n_nationkey + CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE * cos(seq * 2 * pi() / 10), 6) AS x,
       round(CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE * sin(seq * 2 * pi() / 10), 6) AS y
FROM nation, range(10) AS r(seq)""")
def vertex_table(t):
    star = star_polygons(t.nation, "n_nationkey")
    return star.select("n_nationkey", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("page_links", r"""
WITH found AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, (i - 1)::INT AS position, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM found)""")
def page_links(t):
    return extract_attribute(t.pages.select("page_id", "html"), "html", "href", tag="a")


@query("tag_filter", """
SELECT event_id, event_type, value FROM events
WHERE json_extract_string(props, '$.k') IN ('1', '5', '42', '69') AND value BETWEEN 10 AND 200""")
def tag_filter(t):
    return with_tag(t.events, "props", "k", [1, 5, 42, 69], {"value": (10, 200)}).select("event_id", "event_type", "value")


@query("literal_dim", """
WITH d(weekday, label) AS (VALUES (0,'Mon'),(1,'Tue'),(2,'Wed'),(3,'Thu'),(4,'Fri'),(5,'Sat'),(6,'Sun'))
SELECT d.weekday::INT AS weekday, label, count(*) AS n FROM events JOIN d ON isodow(ts) - 1 = d.weekday GROUP BY ALL""")
def literal_dim(t):
    dim = literal_table(t.spark, list(enumerate(WEEKDAYS)), "weekday int, label string")
    counts = t.events.groupBy(weekday_index("ts").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(dim), "weekday")


@query("sequence_table", """
SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY))::DATE AS day FROM orders""")
def sequence_table(t):
    days = F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")
    return sequence_between(t.orders, *days, name="day", step=F.expr("interval 1 day"))


@query("typed_accessor", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""")
def typed_accessor(t):
    return t.events.select("event_id", safe_cast(F.get_json_object("props", "$.k"), "int").alias("k"),
                           safe_cast("event_type", "double").alias("not_a_number"))


@query("random_column", """
SELECT c_custkey, ('0x' || substr(md5('1|' || c_custkey), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS random FROM customer""")
def random_column(t):
    return with_random(t.customer.select("c_custkey"), ["c_custkey"])


@query("row_count", "SELECT count(*) AS n_rows, 11::INT AS n_cols FROM lineitem")
def row_count(t):
    return table_shape(t.lineitem)
