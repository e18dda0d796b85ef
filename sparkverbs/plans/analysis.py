"""Statistics, text, graphs, layouts, colours and iteration."""

import math

from pyspark.sql import functions as F

from ..functions import colour, geometry
from ..functions.nulls import if_else
from ..functions.numeric import linear_scale
from ..functions.text import words
from ..operators import ballots, cooccurrence, density, frames, graph, partition, rings, stats
from ..operators.colours import with_hex, with_rgb, with_space
from ..operators.aggregates import count_by, exact_quantiles, top_counts
from ..operators.joins import expand_until, rows_not_in
from ..operators.ordered import number_rows
from ..operators.reshape import longer, longer_sets, tokens, wider
from ..operators.windows import bands, rescale01, scale_max
from ..session import materialise
from ..sources.polygons import nested_shape, rings_from_json, star_polygons
from ..sources.sequences import literal_table
from .grouping import HLS_SQL, PART_HEX, part_colours
from .joining import EVENT_TYPES
from .registry import query
from .reshaping import WORD_SQL

# --- statistics -----------------------------------------------------------------------------------


@query("ols_fit", """
SELECT round(regr_slope(l_tax, l_discount), 6) AS slope, round(regr_intercept(l_tax, l_discount), 6) AS intercept FROM lineitem""")
def ols_fit(t):
    return stats.ols_fit(t.lineitem, "l_tax", "l_discount").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("ols_residual_sign", """
WITH n AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS a, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS r FROM lineitem GROUP BY 1),
m AS (SELECT regr_slope(r, a) AS s, regr_intercept(r, a) AS i FROM n)
SELECT l_suppkey, round(r - (i + s * a), 6) AS resid, (-sign(r - (i + s * a)))::INT AS sign FROM n, m""")
def ols_residual_sign(t):
    n = wider(t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).cast("double").alias("n")),
              ["l_suppkey"], "l_returnflag", ["A", "R"], "n", fill=0.0, others="drop")
    return stats.ols_augment(n, "R", "A").select("l_suppkey", F.round("resid", 6).alias("resid"), "sign")


CHISQ_SQL = """
WITH o AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
g AS (SELECT b.p_brand, c.p_type, coalesce(n, 0) AS observed FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN
      (SELECT DISTINCT p_type FROM part) c LEFT JOIN o USING (p_brand, p_type)),
e AS (SELECT *, sum(observed) OVER (PARTITION BY p_brand) * sum(observed) OVER (PARTITION BY p_type) / sum(observed) OVER ()::DOUBLE AS expected FROM g),
x AS (SELECT *, (observed - expected) / sqrt(expected) AS residual FROM e)
"""


@query("chisq_residuals", CHISQ_SQL + "SELECT p_brand, p_type, observed, round(expected, 6) AS expected, round(residual, 6) AS residual FROM x")
def chisq_residuals(t):
    out = stats.chisq_residuals(t.part, "p_brand", "p_type")
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "residual")})


@query("chisq_statistic", CHISQ_SQL + """
SELECT round(sum(residual * residual), 4) AS statistic, ((count(DISTINCT p_brand) - 1) * (count(DISTINCT p_type) - 1))::BIGINT AS df FROM x""")
def chisq_statistic(t):
    return stats.chisq_statistic(stats.chisq_residuals(t.part, "p_brand", "p_type")).withColumn("statistic", F.round("statistic", 4))


@query("chisq_levels", """
WITH l AS (SELECT l_returnflag || l_linestatus AS flags, l_suppkey AS supplier FROM lineitem WHERE l_quantity > 49),
o AS (SELECT supplier, flags, count(*) AS n FROM l GROUP BY ALL),
g AS (SELECT s.supplier, f.flags, coalesce(n, 0) AS observed FROM (SELECT DISTINCT supplier FROM l) s CROSS JOIN (SELECT DISTINCT flags FROM l) f
      LEFT JOIN o ON o.supplier = s.supplier AND o.flags = f.flags),
e AS (SELECT *, sum(observed) OVER (PARTITION BY supplier) * sum(observed) OVER (PARTITION BY flags) / sum(observed) OVER ()::DOUBLE AS expected FROM g)
SELECT supplier, flags, observed, round(expected, 6) AS expected, round((observed - expected) / sqrt(expected), 6) AS residual FROM e""")
def chisq_levels(t):
    """Levels of both sides come from the rows, and many pairs do not occur."""
    lines = t.lineitem.where("l_quantity > 49").select(F.concat("l_returnflag", "l_linestatus").alias("flags"), F.col("l_suppkey").alias("supplier"))
    out = stats.chisq_residuals(lines, "supplier", "flags")
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "residual")})


def _points(t):
    at = F.col("embedding")
    return t.embeddings.select("label", at[0].cast("double").alias("x"), at[1].cast("double").alias("y"))


KDE_SQL = """
WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
g AS (SELECT ix::INT AS ix, iy::INT AS iy, -0.5 + ix * (1.0 / 19) AS gx, -0.5 + iy * (1.0 / 9) AS gy FROM range(20) a(ix), range(10) b(iy)),
k AS (SELECT label, ix, iy, sum(exp(-0.5 * ((gx - x) / 0.05) ** 2 - 0.5 * ((gy - y) / 0.05) ** 2)) / (count(*) * 2 * pi() * 0.05 * 0.05) AS density
      FROM p, g GROUP BY ALL)
"""


@query("kde_grid", KDE_SQL + "SELECT label, ix, iy, round(density, 5) AS density FROM k")
def kde_grid(t):
    grid = density.Grid(-0.5, 0.5, 20, -0.5, 0.5, 10)
    return density.kernel_density(_points(t), "x", "y", grid, 0.2, "label").select("label", "ix", "iy", F.round("density", 5).alias("density"))


@query("density_bins", """
WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n,
  1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS sx,
  1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * pow(count(*), -0.2) AS sy FROM p),
g AS (SELECT ix::INT AS ix, iy::INT AS iy, x0 + ix * (x1 - x0) / 49 AS gx, y0 + iy * (y1 - y0) / 49 AS gy, s.* FROM range(50) a(ix), range(50) b(iy), s),
k AS (SELECT ix, iy, sum(exp(-0.5 * ((gx - x) / sx) ** 2 - 0.5 * ((gy - y) / sy) ** 2)) / (any_value(n) * 2 * pi() * any_value(sx) * any_value(sy)) AS density
      FROM p, g GROUP BY ALL)
SELECT ix, iy, round(density, 5) AS density, greatest(1, ceil(density / max(density) OVER () * 20))::INT AS level FROM k""")
def density_bins(t):
    p = _points(t).drop("label")
    k = density.kernel_density(p, "x", "y", density.Grid.around(p, "x", "y", 50, 50), density.normal_bandwidth(p, "x", "y"))
    return density.density_levels(k, 20).select("ix", "iy", F.round("density", 5).alias("density"), "level")


@query("pairwise_distance", """
WITH c AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*)::DOUBLE AS v FROM customer GROUP BY ALL),
f AS (SELECT a.k, b.s, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT k FROM c) a CROSS JOIN (SELECT DISTINCT s FROM c) b LEFT JOIN c ON a.k = c.k AND b.s = c.s)
SELECT a.k AS item1, b.k AS item2, round(sqrt(sum((a.v - b.v) ** 2)), 6) AS distance FROM f a JOIN f b ON a.s = b.s AND a.k <> b.k GROUP BY ALL""")
def pairwise_distance(t):
    profile = count_by(t.customer, "c_nationkey", "c_mktsegment", name="v")
    out = cooccurrence.pairwise_distance(profile, "c_nationkey", "c_mktsegment", "v", complete=True, mirror=True)
    return out.withColumn("distance", F.round("distance", 6))


@query("pairs_that_meet", """
WITH k AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
c AS (SELECT count(DISTINCT o)::DOUBLE AS n FROM k), i AS (SELECT p, count(*)::DOUBLE AS n FROM k GROUP BY 1),
b AS (SELECT x.p AS item1, y.p AS item2, count(*) AS n_both FROM k x JOIN k y ON x.o = y.o AND x.p < y.p GROUP BY ALL)
SELECT item1, item2, n_both, round((c.n * n_both - x.n * y.n) / sqrt(x.n * (c.n - x.n) * y.n * (c.n - y.n)), 6) AS correlation
FROM b JOIN i x ON x.p = item1 JOIN i y ON y.p = item2, c""")
def pairs_that_meet(t):
    """All parts are items; only the pairs that share an order are touched."""
    out = cooccurrence.pairwise_phi(t.lineitem.select("l_orderkey", "l_partkey"), "l_partkey", "l_orderkey")
    return out.withColumn("correlation", F.round("correlation", 6))


WORDS_SQL = f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}', 1)) AS word FROM documents),
"""


def phi_sql(n: int) -> str:
    """Vocabulary of the ``n`` words with most tokens; who meets whom in how many documents."""
    return WORDS_SQL + f"""
top AS (SELECT word, count(*) AS tokens FROM w GROUP BY 1 ORDER BY 2 DESC, word LIMIT {n}),
k AS (SELECT DISTINCT doc_id, word FROM w WHERE word IN (SELECT word FROM top)),
c AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM k),
i AS (SELECT word, count(*)::DOUBLE AS n FROM k GROUP BY 1),
p AS (SELECT a.word AS item1, b.word AS item2, count(*) AS n_both FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.word <> b.word GROUP BY ALL)
"""


# Vocabulary sizes of the word studies.
FEW_WORDS, MANY_WORDS = 120, 150


def top_words(t, n, keep=lambda found: found):
    """The ``n`` words with most tokens as rows (word, n): a top-k."""
    return top_counts(keep(t.documents.select(F.explode(words("text")).alias("word"))), n, "word").collect()


def found_words(t, listed):
    """Tokens of the listed words. Texts are read once more; only these words are kept of them."""
    found = t.documents.select("doc_id", "n_chars", F.explode(words("text")).alias("word"))
    return found.where(F.col("word").isin(list(listed)))


def word_counts(t, listed):
    """The listed words of each document with the number of their tokens."""
    return found_words(t, listed).groupBy("doc_id", "n_chars", "word").agg(F.count(F.lit(1)).alias("tokens"))


@query("pairwise_phi", phi_sql(FEW_WORDS) + """
SELECT x.item1, x.item2, coalesce(n_both, 0) AS n_both,
  round((c.n * coalesce(n_both, 0) - a.n * b.n) / nullif(sqrt(a.n * (c.n - a.n) * b.n * (c.n - b.n)), 0), 6) AS correlation
FROM (SELECT a.word AS item1, b.word AS item2 FROM i a JOIN i b ON a.word <> b.word) x LEFT JOIN p ON x.item1 = p.item1 AND x.item2 = p.item2
JOIN i a ON a.word = x.item1 JOIN i b ON b.word = x.item2, c""")
def pairwise_phi(t):
    top = [r["word"] for r in top_words(t, FEW_WORDS)]
    out = cooccurrence.pairwise_phi(found_words(t, top), "word", "doc_id", complete=True, mirror=True)
    return out.withColumn("correlation", F.round("correlation", 6))


@query("cluster_order", CHISQ_SQL.replace("WITH o", "WITH RECURSIVE o", 1).rstrip() + """,
r AS (SELECT p_brand, p_type, greatest(0, least(1, residual)) AS v FROM x),
d AS (SELECT a.p_brand AS i, b.p_brand AS j, round(sqrt(sum((a.v - b.v) ** 2)), 9) AS w FROM r a JOIN r b ON a.p_type = b.p_type AND a.p_brand <> b.p_brand GROUP BY ALL),
walk AS (
  SELECT 1::BIGINT AS position, min(i) AS item, NULL::DOUBLE AS w, [min(i)] AS seen FROM d
  UNION ALL
  SELECT position + 1, n.j, n.w, list_append(seen, n.j) FROM (
    SELECT position, seen, (SELECT arg_min({j: j, w: w}, {w: w, a: least(i, j), b: greatest(i, j)}) FROM d
                            WHERE list_contains(seen, i) AND NOT list_contains(seen, j)) AS n FROM walk) WHERE n IS NOT NULL)
SELECT item AS p_brand, position, round(w, 6) AS distance FROM walk""")
def cluster_order(t):
    residuals = stats.clipped_residuals(stats.chisq_residuals(t.part, "p_brand", "p_type"))
    far = cooccurrence.pairwise_distance(residuals, "p_brand", "p_type", "residual").withColumn("distance", F.round("distance", 9))
    return stats.similarity_order(far, "p_brand").withColumn("distance", F.round("distance", 6))


def axes_sql(columns: list[str], k: int, squarings: int = 40) -> str:
    """Tables v1 to vk with the first axes of the correlations of table ``t``: a matrix that is squared again and again becomes
    the projection on its leading axis; that axis is taken out for the next. Table ``s`` has means and deviations."""
    n = len(columns)
    cells = [(i, j) for i in range(n) for j in range(n)]
    out = "s AS (SELECT " + ", ".join([f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(columns)]
                                       + [f"corr({columns[i]}, {columns[j]}) AS c{i}{j}" for i, j in cells if j < i]) + " FROM t),\n"
    out += "g1 AS (SELECT " + ", ".join(("1.0::DOUBLE" if i == j else f"c{max(i, j)}{min(i, j)}") + f" AS a{i}{j}" for i, j in cells) + " FROM s),\n"
    size = " + ".join(f"a{i}{j} * a{i}{j}" for i, j in cells)
    for a in range(1, k + 1):
        names = ", ".join(f"a{i}{j}" for i, j in cells)
        squared = ", ".join("(" + " + ".join(f"a{i}{x} * a{x}{j}" for x in range(n)) + f") / ({size}) AS a{i}{j}" for i, j in cells)
        out += f"p{a} AS (SELECT 0 AS step, {names} FROM g{a} UNION ALL SELECT step + 1, {squared} FROM p{a} WHERE step < {squarings}),\n"
        lead = lambda i: " ".join(f"WHEN a{j}{j} = greatest({', '.join(f'a{x}{x}' for x in range(n))}) THEN a{i}{j} / sqrt(a{j}{j})" for j in range(n))
        out += f"v{a} AS (SELECT " + ", ".join(f"CASE {lead(i)} END AS v{i}" for i in range(n)) + f" FROM p{a} WHERE step = {squarings}),\n"
        value = " + ".join(f"v{i} * a{i}{j} * v{j}" for i, j in cells)
        if a < k:
            out += f"g{a + 1} AS (SELECT " + ", ".join(f"a{i}{j} - ({value}) * v{i} * v{j} AS a{i}{j}" for i, j in cells) + f" FROM g{a}, v{a}),\n"
    return out


def on_axes(columns: list[str], k: int, digits: int = 4) -> str:
    return ", ".join(f"round({' + '.join(f'(t.{c} - s.m{i}) / s.d{i} * v{a}.v{i}' for i, c in enumerate(columns))}, {digits}) + 0 AS axis_{a}"
                     for a in range(1, k + 1))


AXES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("embed_2d", "WITH RECURSIVE t AS (SELECT * FROM lineitem),\n" + axes_sql(AXES, 2).rstrip(",\n")
       + f"\nSELECT l_orderkey, l_linenumber, {on_axes(AXES, 2)} FROM t, s, v1, v2")
def embed_2d(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", *AXES)
    return rounded_axes(stats.principal_axes(lines, AXES)).drop(*AXES)


def rounded_axes(df, digits: int = 4):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in df.columns if c.startswith("axis_")})


@query("cumulative_median", """
SELECT until::INT AS until, o_orderpriority, round(median(o_totalprice), 6) AS median FROM orders, range(1996, 2001) AS r(until)
WHERE year(o_orderdate) BETWEEN 1996 AND until GROUP BY ALL""")
def cumulative_median(t):
    rows = t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority", "o_totalprice").agg(F.count(F.lit(1)).alias("copies"))
    grown = expand_until(rows, "year", 1996, 2000)
    out = exact_quantiles(grown, "o_totalprice", {"median": 0.5}, ["until", "o_orderpriority"], weight="copies")
    return out.withColumn("median", F.round("median", 6))


STOP_WORDS = ["the", "and", "of", "to", "in", "a", "is", "for", "un", "la", "le", "de", "der", "die", "und"]


@query("stop_words", f"""
SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD_SQL}', 1)) AS word FROM documents)
WHERE word NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}) AND NOT regexp_matches(word, '^\\d+$') GROUP BY ALL""".replace("\\\\", "\\"))
def stop_words(t):
    listed = F.broadcast(literal_table(t.spark, [(w,) for w in STOP_WORDS], "word string"))
    found = tokens(t.documents.select("doc_id", "text"), "text").where(~F.col("word").rlike(r"^\d+$"))
    return rows_not_in(found, "word", listed).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("word_averages", WORDS_SQL + """
top AS (SELECT word FROM w GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 120)
SELECT word, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, round(avg(quality), 6) AS mean_quality
FROM w JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE word IN (SELECT word FROM top) GROUP BY 1""")
def word_averages(t):
    return token_averages(t, word_counts(t, [r["word"] for r in top_words(t, FEW_WORDS)]))


def token_averages(t, counts):
    """Tokens of each word, and means over the tokens."""
    joined = counts.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    rated = F.sum(F.when(F.col("quality").isNotNull(), F.col("tokens")))
    return joined.groupBy("word").agg(
        F.sum("tokens").alias("n"), F.round(F.sum(F.col("n_chars") * F.col("tokens")) / F.sum("tokens"), 4).alias("mean_chars"),
        F.round(F.try_divide(F.sum(F.col("quality") * F.col("tokens")), rated), 6).alias("mean_quality"))


# --- graphs ---------------------------------------------------------------------------------------

TREE_SQL = """
WITH p AS (SELECT n_name, s_name, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
g AS (SELECT n_name, sum(weight)::BIGINT AS weight FROM p GROUP BY 1),
e AS (SELECT n_name AS "from", s_name AS "to", weight FROM p UNION ALL SELECT 'World', n_name, weight FROM g),
v AS (SELECT s_name AS name, weight AS total, 1 AS level FROM p UNION ALL SELECT n_name, weight, 2 FROM g UNION ALL SELECT 'World', 0, 3)
"""


def _supplier_tree(t):
    n = count_by(t.lineitem, "l_suppkey", name="weight")
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    rows = n.join(s, "l_suppkey").join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")
    return graph.hierarchy(rows, "s_name", "n_name", "weight", "World")


@query("hierarchy_graph", TREE_SQL + """SELECT "from", "to", weight, total, level FROM e JOIN v ON "to" = name""")
def hierarchy_graph(t):
    edges, vertices = _supplier_tree(t)
    return edges.join(vertices.withColumnRenamed("name", "to"), "to").select("from", "to", "weight", "total", "level")


@query("hierarchy_vertices", TREE_SQL + "SELECT name, total, level FROM v")
def hierarchy_vertices(t):
    return _supplier_tree(t)[1].select("name", "total", "level")


@query("graph_tables", phi_sql(MANY_WORDS) + """,
e AS (SELECT p.item1 AS "from", p.item2 AS "to", (c.n * n_both - a.n * b.n) / nullif(sqrt(a.n * (c.n - a.n) * b.n * (c.n - b.n)), 0) AS w
      FROM p JOIN i a ON a.word = p.item1 JOIN i b ON b.word = p.item2, c)
SELECT "from", "to", CASE WHEN w > 0 AND w <= 0.065 THEN 'weak' WHEN w > 0.065 AND w <= 0.13 THEN 'middle' WHEN w > 0.13 AND w <= 1 THEN 'strong' END AS strength,
       top.tokens::BIGINT AS from_n FROM e JOIN top ON top.word = e."from" WHERE w > 0""")
def graph_tables(t):
    top = top_words(t, MANY_WORDS)
    phi = cooccurrence.pairwise_phi(found_words(t, [r["word"] for r in top]), "word", "doc_id", mirror=True).where("correlation > 0")
    edges = phi.select(F.col("item1").alias("from"), F.col("item2").alias("to"), F.when(F.col("correlation") <= 0.065, "weak").when(
        F.col("correlation") <= 0.13, "middle").otherwise("strong").alias("strength"))
    vertices = literal_table(t.spark, [tuple(r) for r in top], "word string, n bigint")
    return graph.with_vertices(edges, F.broadcast(vertices), "word").drop("to_n")


@query("adjacency_union", """
SELECT o_custkey AS "from", o_orderpriority AS "to", count(*) AS n, 'o_orderpriority' AS kind FROM orders GROUP BY ALL UNION ALL
SELECT o_custkey, year(o_orderdate)::VARCHAR, count(*), 'year' FROM orders GROUP BY ALL UNION ALL
SELECT o_custkey, o_orderstatus, count(*), 'o_orderstatus' FROM orders GROUP BY ALL""")
def adjacency_union(t):
    rows = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"))
    return graph.adjacency(rows, "o_custkey", ["o_orderpriority", "year", "o_orderstatus"])


@query("broadcast_attribution", """
WITH m AS (SELECT conv_id, role, length(text) AS n FROM conversations),
s AS (SELECT conv_id, role, sum(n)::BIGINT AS n FROM m WHERE role <> 'system' GROUP BY ALL),
a AS (SELECT conv_id, sum(n)::BIGINT AS shared FROM m WHERE role = 'system' GROUP BY 1)
SELECT conv_id, role, n + coalesce(shared, 0) AS n FROM s LEFT JOIN a USING (conv_id)""")
def broadcast_attribution(t):
    rows = t.conversations.select("conv_id", "role", F.char_length("text").cast("bigint").alias("n"))
    return graph.attribute_broadcasts(rows, ["conv_id"], "role", "n", F.col("role") == "system")


EDGES_SQL = """
WITH c AS (SELECT ts::DATE AS day, user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
e AS (SELECT a.day, a.event_type AS "from", b.event_type AS "to", sum(a.n)::BIGINT AS weight
      FROM c a JOIN c b ON a.day = b.day AND a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY ALL)
"""


def _daily_edges(t):
    counts = t.events.groupBy(F.to_date("ts").alias("day"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return graph.interaction_edges(counts, ["day"], ["user_id"], "event_type", "n")


@query("interaction_edges", EDGES_SQL + "SELECT * FROM e")
def interaction_edges(t):
    return _daily_edges(t)


@query("top_edges", EDGES_SQL + "SELECT * FROM e QUALIFY rank() OVER (PARTITION BY day ORDER BY weight DESC) <= 10")
def top_edges(t):
    return graph.top_edges(_daily_edges(t), 10, ["day"])


# --- layouts and geometry -------------------------------------------------------------------------

MARIMEKKO_SQL = """
WITH g AS (SELECT year(o_orderdate)::INT AS y, n_regionkey AS r, c_mktsegment AS s, count(*)::DOUBLE AS total
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
l1 AS (SELECT y, sum(total) AS t1, sum(total) / (SELECT sum(total) FROM g) AS pct_1 FROM g GROUP BY 1),
b1 AS (SELECT *, sum(pct_1) OVER (ORDER BY y) AS max_1 FROM l1),
l2 AS (SELECT y, r, sum(total) AS t2, sum(total) / any_value(t1) AS pct_2 FROM g JOIN l1 USING (y) GROUP BY ALL),
b2 AS (SELECT *, sum(pct_2) OVER (PARTITION BY y ORDER BY r) AS max_2 FROM l2),
l3 AS (SELECT y, r, s, sum(total) / any_value(t2) AS pct_3 FROM g JOIN l2 USING (y, r) GROUP BY ALL),
b3 AS (SELECT *, sum(pct_3) OVER (PARTITION BY y, r ORDER BY s) AS max_3 FROM l3),
q AS (SELECT y, r, s, max_2 - pct_2 AS xmin, max_2 AS xmax, max_1 - pct_1 + pct_1 * (max_3 - pct_3) AS ymin, max_1 - pct_1 + pct_1 * max_3 AS ymax
      FROM b3 JOIN b2 USING (y, r) JOIN b1 USING (y))
"""


def _rectangles(t):
    by_customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = by_customer.join(t.customer.select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    rows = rows.join(t.nation.select("n_nationkey", "n_regionkey"), "n_nationkey").select(
        "y", F.col("n_regionkey").alias("r"), F.col("c_mktsegment").alias("s"), F.col("n").cast("double").alias("n"))
    ordered = rows.withColumns({"y_ord": F.col("y"), "r_ord": F.col("r"), "s_ord": F.col("s")})
    return partition.marimekko(ordered, [("y", "y_ord"), ("r", "r_ord"), ("s", "s_ord")], "n")


@query("marimekko", MARIMEKKO_SQL + """
SELECT y, r, s, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, round(ymin, 6) AS ymin, round(ymax, 6) AS ymax FROM q""")
def marimekko(t):
    return _rectangles(t).select("y", "r", "s", *[F.round(c, 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query("marimekko_labels", MARIMEKKO_SQL + "SELECT y, round(max_1 - pct_1 / 2, 6) AS ylabel FROM b1")
def marimekko_labels(t):
    return partition.band_labels(_rectangles(t), "y").select("y", F.round("ylabel", 6).alias("ylabel")).distinct()


@query("visible_label", MARIMEKKO_SQL + """
SELECT y, r, s, CASE WHEN ceil((xmax - xmin) * 900) >= 20 AND ceil((ymax - ymin) * 600) >= 20 THEN s ELSE '' END AS label FROM q""")
def visible_label(t):
    rect = _rectangles(t)
    width = F.ceil(linear_scale(F.col("xmax") - F.col("xmin"), (0, 1), (0, 900)))
    height = F.ceil(linear_scale(F.col("ymax") - F.col("ymin"), (0, 1), (0, 600)))
    return rect.select("y", "r", "s", if_else((width >= 20) & (height >= 20), F.col("s"), "").alias("label"))


@query("polygon_centroid", """
WITH v AS (SELECT s_suppkey, seq, s_suppkey + CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE * cos(seq * 2 * pi() / 10) AS x,
             CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE * sin(seq * 2 * pi() / 10) AS y FROM supplier, range(10) r(seq)),
n AS (SELECT a.s_suppkey, a.x, a.y, b.x AS x1, b.y AS y1, a.x * b.y - b.x * a.y AS c FROM v a JOIN v b ON a.s_suppkey = b.s_suppkey AND b.seq = (a.seq + 1) % 10)
SELECT s_suppkey, round(sum(c) / 2, 6) AS area, round(sum((x + x1) * c) / (3 * sum(c)), 6) AS cx, abs(round(sum((y + y1) * c) / (3 * sum(c)), 6)) AS cy FROM n GROUP BY 1""")
def polygon_centroid(t):
    out = rings.centroid(star_polygons(t.supplier, "s_suppkey"), ["s_suppkey"])
    return out.select("s_suppkey", F.round("area", 6).alias("area"), F.round("cx", 6).alias("cx"), F.abs(F.round("cy", 6)).alias("cy"))


@query("polygon_main_part", """
SELECT n_nationkey, CASE WHEN odd THEN 3 ELSE 0 END AS ring, CASE WHEN odd THEN 0 ELSE 1 END::BIGINT AS n_holes, CASE WHEN odd THEN 25 ELSE 15 END::DOUBLE AS area,
       round(CASE WHEN odd THEN x + 22.5 ELSE (16 * (x + 2) - (x + 1.5)) / 15 END, 6) AS cx, round(CASE WHEN odd THEN 2.5 ELSE (16 * 2 - 1.5) / 15 END, 6) AS cy
FROM (SELECT n_nationkey, n_nationkey % 2 = 1 AS odd, n_nationkey * 100.0::DOUBLE AS x FROM nation)""")
def polygon_main_part(t):
    """Shapes of a square with a hole, a triangle and a third square that is the largest part of every other shape."""
    shapes = rings_from_json(t.nation.select("n_nationkey", nested_shape("n_nationkey").alias("shape")), "shape").drop("hole")
    out = rings.main_part(shapes, ["n_nationkey"])
    return out.select("n_nationkey", "ring", "n_holes", *[F.round(c, 6).alias(c) for c in ("area", "cx", "cy")])


@query("ring_vertices", """
SELECT n_nationkey, ring::INT AS ring, seq::INT AS seq, (n_nationkey + seq)::DOUBLE AS x, (ring * 10 + seq * seq)::DOUBLE AS y, ring > 0 AS hole
FROM nation, range(2) a(ring), range(3) b(seq)""")
def ring_vertices(t):
    points = [f"[' || (n_nationkey + {s}) || ',{r * 10 + s * s}]" for r in range(2) for s in range(3)]
    text = "'[[" + ",".join(points[:3]) + "],[" + ",".join(points[3:]) + "]]'"
    return rings_from_json(t.nation.select("n_nationkey", F.expr(text).alias("shape")), "shape")


@query("route_segments", """
WITH p AS (SELECT user_id, event_id, ts, hour(ts)::INT AS x, value AS y FROM events)
SELECT event_id, x, y, lag(x) OVER w AS x_from, lag(y) OVER w AS y_from FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def route_segments(t):
    points = t.events.select("user_id", "event_id", "ts", F.hour("ts").alias("x"), F.col("value").alias("y"))
    return rings.segments(points, ["ts", "event_id"], "x", "y", ["user_id"]).drop("user_id", "ts")


@query("circle_layout", """
WITH n AS (SELECT n_name, row_number() OVER (ORDER BY c DESC, n_name) AS i, count(*) OVER () AS n
           FROM (SELECT n_name, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1))
SELECT n_name, round(cos((i - 1) / n::DOUBLE * 2 * pi()), 6) + 0 AS x, round(sin((i - 1) / n::DOUBLE * 2 * pi()), 6) + 0 AS y FROM n""")
def circle_layout(t):
    c = count_by(t.customer, "c_nationkey", name="c")
    rows = t.nation.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("c", F.lit(0)).alias("c"))
    placed = number_rows(rows, [F.col("c").desc(), "n_name"], name="i").withColumn("n", rows.agg(F.count(F.lit(1))).scalar())
    at = geometry.circle_point(F.col("i"), F.col("n"))
    return placed.select("n_name", (F.round(at["x"], 6) + 0.0).alias("x"), (F.round(at["y"], 6) + 0.0).alias("y"))


def measures_sql(by: str, p: str = "") -> str:
    """Tables m, s and f (with a suffix): mean measures by a column of part, scaled to 0..1, in long form."""
    return MEASURE_TABLES.replace("WITH ", "").replace("p_type", by).replace("m AS (", f"m{p} AS (").replace("s AS (", f"s{p} AS (").replace(
        "f AS (", f"f{p} AS (").replace("FROM m)", f"FROM m{p})").replace("FROM s WHERE", f"FROM s{p} WHERE").strip()


MEASURE_TABLES = """
WITH m AS (SELECT p_type, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax,
             avg(l_linenumber) AS l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT p_type, unnest([{feature: 'discount', v: (l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ())},
   {feature: 'extendedprice', v: (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ())},
   {feature: 'linenumber', v: (l_linenumber - min(l_linenumber) OVER ()) / (max(l_linenumber) OVER () - min(l_linenumber) OVER ())},
   {feature: 'quantity', v: (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ())},
   {feature: 'tax', v: (l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ())}]) AS q FROM m),
f AS (SELECT p_type, q.feature AS feature, q.v AS v, list_position(['discount','extendedprice','linenumber','quantity','tax'], q.feature) AS no FROM s WHERE q.v <> 0)
"""
MEASURES_SQL = MEASURE_TABLES
PETAL_COLUMNS = ["x1", "y1", "x2", "y2", "x3", "y3", "x0", "y0", "r"]


def type_features(t, by="p_type"):
    """Mean line measures per part type (or another column), scaled to 0..1, in long form with the number of the feature."""
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in measures])
    kinds = t.part.select("p_partkey", F.col(by) if isinstance(by, str) else by)
    means = sums.join(kinds, "p_partkey").groupBy(kinds.columns[1]).agg(
        *[(F.sum(c) / F.sum("n")).alias(c) for c in measures])
    long = longer(rescale01(materialise(means), measures), measures, "feature", "v", prefix="l_").where("v <> 0")
    names = sorted(c[2:] for c in measures)
    return long.withColumn("no", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")))


@query("petal_shapes", MEASURES_SQL + """,
a AS (SELECT *, 2 * pi() / 5 AS step, (no - 1) * 2 * pi() / 5 AS b0, no * 2 * pi() / 5 AS b1, (no - 0.5) * 2 * pi() / 5 AS mid FROM f),
d AS (SELECT *, 0.2 * cos(mid + pi() / 2) AS dx, 0.2 * sin(mid + pi() / 2) AS dy FROM a)
SELECT p_type, feature, round(v * cos(b0 + pi() / 2) + dx, 6) + 0 AS x1, round(v * sin(b0 + pi() / 2) + dy, 6) + 0 AS y1,
  round(v * cos(b1 + pi() / 2) + dx, 6) + 0 AS x2, round(v * sin(b1 + pi() / 2) + dy, 6) + 0 AS y2, round(dx, 6) + 0 AS x3, round(dy, 6) + 0 AS y3,
  round(v / cos(step / 2) * cos(mid + pi() / 2) + dx, 6) + 0 AS x0, round(v / cos(step / 2) * sin(mid + pi() / 2) + dy, 6) + 0 AS y0, round(v * tan(step / 2), 6) AS r FROM d""")
def petal_shapes(t):
    rows = type_features(t).withColumn("p", geometry.petal(F.col("v"), F.col("no"), 5))
    return rows.select("p_type", "feature", *[(F.round(F.col("p")[c], 6) + 0.0).alias(c) for c in PETAL_COLUMNS])


@query("ribbon_points", """
WITH g AS (SELECT p_brand, p_size AS rank, count(*) AS n FROM part GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (ORDER BY p_brand, rank DESC)::BIGINT AS e FROM g),
c AS (SELECT p_brand, rank, -2 / 51::DOUBLE * (rank - 0.075) + 1 AS y1, -2 / 51::DOUBLE * (rank + 0.075) + 1 AS y2, (e - n) * 2 / 2000::DOUBLE - 1 AS y3, e * 2 / 2000::DOUBLE - 1 AS y4,
        pow(length(p_brand) / 2.0::DOUBLE, 0.95) * 0.00825 AS off FROM b)
SELECT p_brand, rank, 1::INT AS point, round(off, 6) AS x, round(y1, 6) AS y FROM c UNION ALL SELECT p_brand, rank, 2, round(off, 6), round(y2, 6) FROM c UNION ALL
SELECT p_brand, rank, 3, 1.0, round(y3, 6) FROM c UNION ALL SELECT p_brand, rank, 4, 1.0, round(y4, 6) FROM c""")
def ribbon_points(t):
    sizes = t.part.groupBy("p_brand", F.col("p_size").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    rows = bands(sizes, "n", ["p_brand", F.col("rank").desc()])
    corners = geometry.ribbon_corners("rank", "start", "end", geometry.label_offset("p_brand"), F.lit(2000.0), ranks=51)
    wide = rows.select("p_brand", "rank", *[F.round(v, 6).alias(k) for k, v in corners.items()])
    return longer_sets(wide, {i: {"x": f"x{i}", "y": f"y{i}"} for i in (1, 2, 3, 4)}, "point")


@query("quadrant_offset", """
SELECT o_orderkey, o_custkey, CASE WHEN n > 2 THEN -0.25 ELSE 0.25 END::DOUBLE AS dx, CASE WHEN n % 2 = 0 THEN -0.25 ELSE 0.25 END::DOUBLE AS dy
FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)""")
def quadrant_offset(t):
    rows = number_rows(t.orders.select("o_custkey", "o_orderkey"), ["o_orderkey"], ["o_custkey"], name="n")
    at = geometry.quadrant_offset("n")
    return rows.select("o_orderkey", "o_custkey", at["dx"].alias("dx"), at["dy"].alias("dy"))


@query("hsl_triangle", HLS_SQL + """
SELECT p_partkey, round(CASE WHEN l > 0.5 THEN (2 - 2 * l) * s ELSE 2 * l * s END, 6) AS x, round(2 / tan(pi() / 3) * l - 1 / tan(pi() / 3), 6) AS y FROM full_hls""")
def hsl_triangle(t):
    rows = with_space(with_rgb(part_colours(t), "hex"))
    at = geometry.shade_triangle(F.col("hls.s"), F.col("hls.l"))
    return rows.select("p_partkey", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query("label_offset", "SELECT p_partkey, round(pow(length(p_name) / 2.0::DOUBLE, 0.95) * 0.00825, 6) AS x FROM part")
def label_offset(t):
    return t.part.select("p_partkey", F.round(geometry.label_offset("p_name"), 6).alias("x"))


@query("label_angle", """
WITH a AS (SELECT vec_id, degrees(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)) AS a FROM embeddings)
SELECT vec_id, round(90 - ((90 - a) - 180 * floor((90 - a) / 180)), 6) AS upright, round((a - 90) - 180 * floor((a - 90) / 180) + 270, 6) AS radial FROM a""")
def label_angle(t):
    at = F.col("embedding")
    rows = t.embeddings.select("vec_id", at[0].cast("double").alias("x"), at[1].cast("double").alias("y"))
    angle = F.degrees(F.atan2("y", "x"))
    return rows.select("vec_id", F.round(geometry.upright_angle("x", "y"), 6).alias("upright"), F.round(geometry.radial_angle(angle), 6).alias("radial"))


# Room around a node and between the two directions of a link, as in ``geometry.link_ends``.
LINK_SQL = """w AS (SELECT *, CASE WHEN s = 1 THEN atan2(y1 - y0, x1 - x0) ELSE atan2(y0 - y1, x0 - x1) END AS g FROM l)
SELECT {keys}, s::INT AS direction,
  round(CASE WHEN s = 1 THEN x0 + (r0 + 0.06) * cos(g) ELSE x1 + (r1 + 0.06) * cos(g) END - s * 0.05 * sin(g), 5) + 0 AS x_from,
  round(CASE WHEN s = 1 THEN y0 + (r0 + 0.06) * sin(g) ELSE y1 + (r1 + 0.06) * sin(g) END + s * 0.05 * cos(g), 5) + 0 AS y_from,
  round(CASE WHEN s = 1 THEN x1 - (r1 + 0.06) * cos(g) ELSE x0 - (r0 + 0.06) * cos(g) END - s * 0.05 * sin(g), 5) + 0 AS x_to,
  round(CASE WHEN s = 1 THEN y1 - (r1 + 0.06) * sin(g) ELSE y0 - (r0 + 0.06) * sin(g) END + s * 0.05 * cos(g), 5) + 0 AS y_to FROM w"""


@query("link_offset", EDGES_SQL + """,
n AS (SELECT day, event_type, sum(n)::DOUBLE AS n FROM c GROUP BY ALL),
p AS (SELECT day, event_type, cos((list_position(['click','error','purchase','signup','view'], event_type) - 1) * pi() / 3) AS x,
        sin((list_position(['click','error','purchase','signup','view'], event_type) - 1) * pi() / 3) AS y, sqrt(n / max(n) OVER ()) / 2 AS rad FROM n),
l AS (SELECT e.day, e."from", e."to", a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, a.rad AS r0, b.rad AS r1,
        CASE WHEN b.x > a.x OR (b.x = a.x AND b.y > a.y) THEN 1 ELSE -1 END AS s
      FROM e JOIN p a ON a.day = e.day AND a.event_type = e."from" JOIN p b ON b.day = e.day AND b.event_type = e."to"),
""" + LINK_SQL.format(keys='day, "from", "to"'))
def link_offset(t):
    nodes = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    nodes = scale_max(nodes, "n", [], "size").withColumn("rad", F.sqrt("size") / 2)
    turn = (F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type")) - 1) * math.pi / 3
    nodes = nodes.select("day", "event_type", F.cos(turn).alias("x"), F.sin(turn).alias("y"), "rad")
    a = nodes.toDF("day", "from", "x0", "y0", "r0")
    b = nodes.toDF("day", "to", "x1", "y1", "r1")
    rows = _daily_edges(t).join(a, ["day", "from"]).join(b, ["day", "to"]).withColumn(
        "l", geometry.link_ends("x0", "y0", "x1", "y1", "r0", "r1"))
    return rows.select("day", "from", "to", F.col("l.direction").alias("direction"),
                       *[(F.round(F.col("l")[c], 5) + 0.0).alias(c) for c in ("x_from", "y_from", "x_to", "y_to")])


# --- colours --------------------------------------------------------------------------------------


@query("hex_to_rgb", f"""
SELECT p_partkey, hex, ('0x' || hex[2:3])::INT / 255.0::DOUBLE AS r, ('0x' || hex[4:5])::INT / 255.0::DOUBLE AS g, ('0x' || hex[6:7])::INT / 255.0::DOUBLE AS b
FROM (SELECT p_partkey, {PART_HEX} AS hex FROM part)""")
def hex_to_rgb(t):
    rgb = colour.hex_to_rgb("hex")
    return part_colours(t).select("p_partkey", "hex", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"))


@query("rgb_hls_roundtrip", HLS_SQL + "SELECT p_partkey, round(h, 4) AS h, round(l, 6) AS l, round(s, 6) AS s, hex AS via_hls, hex AS via_lab FROM full_hls")
def rgb_hls_roundtrip(t):
    rows = with_rgb(part_colours(t), "hex")
    rows = with_hex(with_hex(with_space(with_space(rows, "hls"), "lab"), "hls", "via_hls"), "lab", "via_lab")
    return rows.select("p_partkey", F.round("hls.h", 4).alias("h"), F.round("hls.l", 6).alias("l"), F.round("hls.s", 6).alias("s"), "via_hls", "via_lab")


# --- iteration and frames -------------------------------------------------------------------------

IRV_SQL = """
WITH RECURSIVE n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
v AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM n),
r AS (
  SELECT 0 AS round, []::VARCHAR[] AS gone, (SELECT list({c: c, n: k} ORDER BY k DESC, c) FROM (SELECT event_type AS c, count(*) AS k FROM v WHERE rank = 1 GROUP BY 1)) AS board
  UNION ALL
  SELECT round + 1, x.gone2, (SELECT list({c: c, n: k} ORDER BY k DESC, c) FROM (SELECT c, count(*) AS k FROM
      (SELECT user_id, arg_min(event_type, rank) AS c FROM v WHERE NOT list_contains(x.gone2, event_type) GROUP BY 1) GROUP BY 1))
  FROM (SELECT round, board, list_append(gone, board[-1].c) AS gone2 FROM r
        WHERE len(board) > 1 AND (round = 0 OR board[1].n * 2 <= list_sum(list_transform(board, lambda b: b.n)))) x),
b AS (SELECT round, unnest(list_concat(list_transform(board, lambda e: {c: e.c, n: e.n}), list_transform(list_reverse(gone), lambda g: {c: g, n: 0::BIGINT}))) AS e,
        unnest(range(1, len(board) + len(gone) + 1)) AS position, list_sum(list_transform(board, lambda e: e.n)) AS alive FROM r),
rounds AS (SELECT round::INT AS round, position::INT AS position, e.c AS candidate, e.n::BIGINT AS total, round(e.n / alive::DOUBLE, 6) AS share FROM b)
"""


def vote_rounds(t):
    votes = ballots.votes_from_counts(t.events, "user_id", "event_type")
    return ballots.instant_runoff(votes, "user_id", "rank", "event_type")


@query("irv_rounds", IRV_SQL + "SELECT * FROM rounds")
def irv_rounds(t):
    return vote_rounds(t).withColumn("share", F.round("share", 6))


@query("irv_transfers", IRV_SQL + "SELECT a.round, a.candidate, a.total - b.total AS gained FROM rounds a JOIN rounds b ON a.round = b.round + 1 AND a.candidate = b.candidate")
def irv_transfers(t):
    return ballots.transfers(vote_rounds(t))


@query("tween_frames", KDE_SQL + """,
f AS (SELECT ix, iy, label, density AS a, lead(density) OVER (PARTITION BY ix, iy ORDER BY label) AS b, max(label) OVER () AS top FROM k)
SELECT ix, iy, (label * 20 + s)::INT AS frame, round(label + s / 20.0::DOUBLE, 6) AS label, round(CASE WHEN label = top THEN a ELSE a + (b - a) * s / 20 END, 5) AS density
FROM f, range(20) r(s) WHERE label < top OR s = 0""")
def tween_frames(t):
    grid = density.Grid(-0.5, 0.5, 20, -0.5, 0.5, 10)
    k = density.kernel_density(_points(t), "x", "y", grid, 0.2, "label").select("ix", "iy", "label", "density")
    return frames.tween(k, ["ix", "iy"], "label", ["density"]).select(
        "ix", "iy", "frame", F.round("label", 6).alias("label"), F.round("density", 5).alias("density"))


@query("frame_schedule", """
WITH n AS (SELECT year(o_orderdate)::INT AS year, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, o_orderpriority) AS rank, year - 1995 AS step FROM n)
SELECT year, o_orderpriority, n, rank, (step * 12 + f)::INT AS frame FROM k, range(12) r(f)""")
def frame_schedule(t):
    n = t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    ranked = number_rows(n, [F.col("n").desc(), "o_orderpriority"], ["year"], name="rank")
    first = (F.col("year") - 1995) * 12
    return frames.schedule(ranked, "year", F.sequence(first, first + 11))


@query("frame_hold", """
SELECT l_orderkey, l_linenumber, l_partkey, copy::INT AS copy FROM lineitem, range(20) r(copy) WHERE l_orderkey % 20 = 0 OR copy = 0""")
def frame_hold(t):
    return frames.hold(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", 20, 20)
