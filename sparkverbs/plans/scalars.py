"""Text, date, number, conditional and category functions."""

import math

from pyspark.sql import functions as F

from ..functions import categories as c
from ..functions import dates as d
from ..functions import numeric as m
from ..functions import text as s
from ..functions.nulls import case_when as branch
from ..functions.nulls import if_else, safe_cast as cast_or_null
from ..operators import levels as lv
from ..operators.aggregates import count_by
from ..operators.windows import with_group_stats
from .registry import query


@query("title_case", """
SELECT p_partkey, array_to_string(list_transform(string_split(upper(p_name), ' '), lambda w: upper(w[1]) || lower(w[2:])), '-') AS name FROM part""")
def title_case(t):
    return t.part.select("p_partkey", s.title_case(F.replace(F.upper("p_name"), F.lit(" "), F.lit("-"))).alias("name"))


@query("case_fold", "SELECT doc_id, upper(source) AS up, lower(lang) AS low FROM documents")
def case_fold(t):
    return t.documents.select("doc_id", F.upper("source").alias("up"), F.lower("lang").alias("low"))


@query("trim_remove", """
SELECT p_partkey, trim(regexp_replace(p_name, '(ring|bolt|gear)', '')) AS name FROM part""")
def trim_remove(t):
    return t.part.select("p_partkey", F.trim(s.remove_first("p_name", "(ring|bolt|gear)")).alias("name"))


@query("replace_first", r"""
SELECT doc_id, regexp_replace(text, '(\w)(e)', '\1<\2>') AS text FROM documents""")
def replace_first(t):
    return t.documents.select("doc_id", s.replace_first("text", r"([0-9A-Za-z_])(e)", "$1<$2>").alias("text"))


@query("replace_all", r"SELECT doc_id, regexp_replace(text, '[aeiou]+', '*', 'g') AS text FROM documents")
def replace_all(t):
    return t.documents.select("doc_id", s.replace_all("text", "[aeiou]+", "*").alias("text"))


@query("substr", "SELECT c_custkey, substr(c_name, 1, 4) AS head, substr(c_name, 10) AS tail FROM customer")
def substr(t):
    return t.customer.select("c_custkey", F.substring("c_name", 1, 4).alias("head"), F.expr("substring(c_name, 10)").alias("tail"))


@query("text_length", "SELECT doc_id, length(text)::INT AS n FROM documents")
def text_length(t):
    return t.documents.select("doc_id", F.char_length("text").alias("n"))


@query("pad_left", """
SELECT o_orderkey, CASE WHEN length(o_orderkey::VARCHAR) >= 4 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 4, '0') END AS key FROM orders""")
def pad_left(t):
    return t.orders.select("o_orderkey", s.pad_left("o_orderkey", 4, "0").alias("key"))


@query("extract_digit", r"SELECT p_partkey, nullif(regexp_extract(p_brand, '[2-9]'), '') AS digit FROM part")
def extract_digit(t):
    return t.part.select("p_partkey", s.extract_first("p_brand", "[2-9]").alias("digit"))


@query("split_first", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word FROM part")
def split_first(t):
    return t.part.select("p_partkey", s.split_first("p_name").alias("first_word"))


@query("paste", """
SELECT d.doc_id, lang || '-' || source AS origin, coalesce(quality::VARCHAR, 'NA') || 'x' AS label
FROM documents d LEFT JOIN labels USING (doc_id)""")
def paste(t):
    df = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return df.select("doc_id", s.paste("lang", "source", sep="-").alias("origin"), s.paste("quality", F.lit("x")).alias("label"))


@query("format_numbers", """
SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS thousands, printf('%.1f', o_orderkey / 2.0::DOUBLE) AS fixed,
       printf('%d%%', o_orderkey % 101) AS percent, lpad(lower(to_hex(o_orderkey % 256)), 2, '0') AS hex FROM orders""")
def format_numbers(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", s.format_count(k * 1000).alias("thousands"), s.format_fixed(k / 2, 1).alias("fixed"),
                           s.format_percent((k % 101) / 100).alias("percent"), s.hex_byte(k % 256).alias("hex"))


@query("regex_class", """
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|blue)') THEN 'primary' WHEN regexp_matches(p_name, 'ring$') THEN 'ring'
  WHEN starts_with(p_name, 'small') THEN 'small' ELSE p_name END AS class FROM part""")
def regex_class(t):
    rules = [("^(red|blue)", "primary"), ("ring$", "ring"), ("^small", "small")]
    return t.part.select("p_partkey", s.classify("p_name", rules).alias("class"))


@query("format_kg", """
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 3125 / 1000 AS kg FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN kg < 100 THEN printf('%.1fkg', round_even(kg, 1)) ELSE printf('%dkg', round_even(kg, 0)::BIGINT) END AS mass FROM k""")
def format_kg(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", s.format_kg(F.col("l_quantity") * 3125).alias("mass"))


@query("weekday_hour", """
SELECT event_id, (isodow(ts) - 1)::INT AS weekday, strftime(ts, '%a') AS label, hour(ts)::INT AS hour, year(ts)::INT AS year, ts::DATE AS day FROM events""")
def weekday_hour(t):
    return t.events.select("event_id", d.weekday_index("ts").alias("weekday"), d.weekday_label("ts").alias("label"),
                           F.hour("ts").alias("hour"), F.year("ts").alias("year"), F.to_date("ts").alias("day"))


@query("year_diff", """
SELECT o_orderkey, (year(TIMESTAMP '2003-05-01') - year(o_orderdate))::INT AS years,
       strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y')::DATE AS day FROM orders""")
def year_diff(t):
    day = d.parse_date(F.date_format("o_orderdate", "MM/dd/yyyy"), "MM/dd/yyyy")
    return t.orders.select("o_orderkey", d.year_diff(F.lit("2003-05-01").cast("date"), "o_orderdate").alias("years"), day.alias("day"))


@query("math_basic", """
SELECT c_custkey, sign(c_acctbal)::INT AS sign, abs(c_acctbal) AS abs, sqrt(abs(c_acctbal)) AS root, round(pow(abs(c_acctbal), 0.3), 6) AS power,
       CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END AS ratio, c_acctbal * 2 - 1 AS line FROM customer""")
def math_basic(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.signum(b).cast("int").alias("sign"), F.abs(b).alias("abs"), F.sqrt(F.abs(b)).alias("root"),
                             F.round(F.pow(F.abs(b), F.lit(0.3)), 6).alias("power"), m.divide(b, F.col("c_nationkey")).alias("ratio"),
                             (b * 2 - 1).alias("line"))


@query("math_round", """
SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity / 4)::BIGINT AS low, ceil(l_quantity / 4)::BIGINT AS high,
       round_even(l_quantity / 2, 0) AS even FROM lineitem""")
def math_round(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.floor(q / 4).alias("low"), F.ceil(q / 4).alias("high"),
                             m.half_even(q / 2).alias("even"))


@query("trig", """
SELECT p_partkey, round(cos(p_size), 6) AS c, round(sin(p_size), 6) AS s, round(tan(p_size), 6) AS t, round(atan(p_size), 6) AS a,
       round(degrees(pi() * p_size / 50), 6) AS deg FROM part""")
def trig(t):
    z = F.col("p_size")
    return t.part.select("p_partkey", *[F.round(f(z), 6).alias(n) for n, f in
                                        {"c": F.cos, "s": F.sin, "t": F.tan, "a": F.atan}.items()],
                         F.round(F.degrees(z * math.pi / 50), 6).alias("deg"))


@query("modulo", """
SELECT p_partkey, ((p_size - 25) % 7 + 7) % 7 AS mod_pos, ((p_size - 25) % -7 - 7) % -7 AS mod_neg, floor((p_size - 25) / 7.0)::BIGINT AS div FROM part""")
def modulo(t):
    z = F.col("p_size") - 25
    return t.part.select("p_partkey", m.floor_mod(z, 7).alias("mod_pos"), m.floor_mod(z, -7).alias("mod_neg"), m.floor_div(z, 7).alias("div"))


@query("clamp", """
SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN greatest(quality - 1, 0) END AS low, greatest(least(n_chars, 400), 100) AS n
FROM documents d LEFT JOIN labels USING (doc_id)""")
def clamp(t):
    df = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return df.select("doc_id", m.at_least(F.col("quality") - 1, 0).alias("low"), m.clamp("n_chars", 100, 400).alias("n"))


@query("linear_scale", "SELECT p_partkey, round(10 + (p_size - 1) / 49.0::DOUBLE * 90, 6) AS x FROM part")
def linear_scale(t):
    return t.part.select("p_partkey", F.round(m.linear_scale("p_size", (1, 50), (10, 100)), 6).alias("x"))


@query("sqrt_scale", "SELECT c_custkey, floor(1 + 19 * sqrt(n) / sqrt(max(n) OVER ()))::BIGINT AS radius FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1)")
def sqrt_scale(t):
    n = count_by(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    top = with_group_stats(n, [], top=F.max("n"))
    return top.select("c_custkey", F.floor(m.sqrt_scale("n", (0, F.col("top")), (1, 20))).alias("radius"))


@query("if_null_aware", """
SELECT d.doc_id, CASE WHEN quality = 1 THEN 'good' WHEN quality <> 1 THEN 'poor' END AS word FROM documents d LEFT JOIN labels USING (doc_id)""")
def if_null_aware(t):
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return df.select("doc_id", if_else(F.col("quality") == 1, "good", "poor").alias("word"))


@query("case_when", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) = 1996 THEN '#a63603' WHEN o_orderstatus = 'F' THEN '#fd8d3c'
  WHEN o_orderstatus = 'P' THEN '#31a354' END AS color FROM orders""")
def case_when(t):
    f = F.col("o_orderstatus") == "F"
    color = branch((f & (F.year("o_orderdate") == 1996), "#a63603"), (f, "#fd8d3c"), (F.col("o_orderstatus") == "P", "#31a354"))
    return t.orders.select("o_orderkey", color.alias("color"))


@query("coalesce", "SELECT d.doc_id, coalesce(nullif(quality, 0), toxic, -1) AS v FROM documents d LEFT JOIN labels USING (doc_id)")
def coalesce(t):
    df = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return df.select("doc_id", F.coalesce(F.nullif("quality", F.lit(0)), "toxic", F.lit(-1)).alias("v"))


@query("safe_cast", """
SELECT o_orderkey, TRY_CAST(o_orderpriority AS INT) AS none, TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS level, o_orderkey::VARCHAR AS text FROM orders""")
def safe_cast(t):
    return t.orders.select("o_orderkey", cast_or_null("o_orderpriority", "int").alias("none"),
                           cast_or_null(F.substring("o_orderpriority", 1, 1), "int").alias("level"), F.col("o_orderkey").cast("string").alias("text"))


@query("factor_levels", """
SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS event_type_ord,
       CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS event_type FROM events""")
def factor_levels(t):
    levels = ["view", "click", "purchase"]
    return t.events.select("event_id", c.level_ordinal("event_type", levels).alias("event_type_ord"), c.known_level("event_type", levels).alias("event_type"))


@query("fct_relevel", """
SELECT o_orderkey, list_position(['5-LOW', '3-MEDIUM', '1-URGENT', '2-HIGH', '4-NOT SPECIFIED'], o_orderpriority)::INT AS priority_ord FROM orders""")
def fct_relevel(t):
    levels = c.relevel(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "5-LOW", "3-MEDIUM")
    return t.orders.select("o_orderkey", c.level_ordinal("o_orderpriority", levels).alias("priority_ord"))


@query("fct_recode", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'pending' ELSE o_orderstatus END AS status FROM orders""")
def fct_recode(t):
    return t.orders.select("o_orderkey", c.recode("o_orderstatus", {"F": "filled", "P": "pending"}).alias("status"))


@query("fct_reorder", """
WITH m AS (SELECT p_brand, row_number() OVER (ORDER BY median(p_retailprice), p_brand) AS p_brand_ord FROM part GROUP BY 1)
SELECT p_partkey, p_brand, p_brand_ord FROM part JOIN m USING (p_brand)""")
def fct_reorder(t):
    return lv.reorder_by_median(t.part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice").drop("p_retailprice")


@query("fct_lump", """
WITH k AS (SELECT p_name FROM part GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 12)
SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM k) THEN p_name ELSE 'Other' END AS p_name FROM part""")
def fct_lump(t):
    return lv.lump(t.part.select("p_partkey", "p_name"), "p_name", 12).select("p_partkey", "p_name")


@query("fct_other", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'else' END AS kind FROM events""")
def fct_other(t):
    return t.events.select("event_id", c.other("event_type", ["click", "view"], "else").alias("kind"))


@query("level_from_table", """
WITH o AS (SELECT n_nationkey, row_number() OVER (ORDER BY b DESC, n_nationkey) AS n_nationkey_ord
           FROM (SELECT c_nationkey AS n_nationkey, max(c_acctbal) AS b FROM customer GROUP BY 1))
SELECT s_suppkey, s_nationkey AS n_nationkey, n_nationkey_ord FROM supplier LEFT JOIN o ON s_nationkey = n_nationkey""")
def level_from_table(t):
    tops = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max("c_acctbal").alias("b"))
    order = lv.order_from(tops, "n_nationkey", [F.col("b").desc()])
    return lv.with_level_order(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", order)


@query("interaction", "SELECT p_partkey, p_brand || '.' || p_size AS cell FROM part")
def interaction(t):
    return t.part.select("p_partkey", c.interaction("p_brand", "p_size").alias("cell"))


@query("cut_bins", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 AND l_tax <= 0.02 THEN 'low' WHEN l_tax > 0.02 AND l_tax <= 0.05 THEN 'mid'
  WHEN l_tax > 0.05 AND l_tax <= 0.07 THEN 'high' END AS bin FROM lineitem""")
def cut_bins(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c.cut("l_tax", [0, 0.02, 0.05, 0.07], ["low", "mid", "high"]).alias("bin"))
