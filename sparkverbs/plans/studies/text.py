"""Studies on words and talk: wine, ross, friends, makeup."""

import math

from pyspark.sql import functions as F

from ...functions import geometry
from ...functions.categories import cut
from ...functions.text import title_case
from ...operators import cooccurrence, graph, stats
from ...operators.aggregates import count_by, top_counts
from ...operators.colours import average_colour, with_rgb, with_space
from ...operators.joins import join_on, rows_in, rows_not_in
from ...operators.reshape import split_rows, tokens
from ...operators.windows import first_rows, scale_max
from ...session import materialise
from ...sources.sequences import literal_table
from ..analysis import LINK_SQL, STOP_WORDS, token_averages, top_words, word_counts
from ..grouping import HLS_SQL, part_colours
from ..registry import query
from ..reshaping import WORD_SQL

WINE_SQL = """
WITH w AS (SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{w}', 1)) AS word FROM documents) WHERE {keep}),
top AS (SELECT word FROM w GROUP BY 1 ORDER BY count(*) DESC, word LIMIT {n}),
k AS (SELECT DISTINCT doc_id, word FROM w WHERE word IN (SELECT word FROM top)),
c AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM k),
m AS (SELECT word, count(*) AS tokens, avg(n_chars) AS chars, avg(quality) AS quality FROM w JOIN documents USING (doc_id)
      LEFT JOIN labels USING (doc_id) WHERE word IN (SELECT word FROM top) GROUP BY 1),
i AS (SELECT word, count(*)::DOUBLE AS n, any_value(tokens) AS tokens, any_value(chars) AS chars, any_value(quality) AS quality
      FROM k JOIN m USING (word) GROUP BY 1),
p AS (SELECT a.word AS item1, b.word AS item2, count(*) AS n_both FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.word <> b.word GROUP BY ALL),
f AS (SELECT item1 AS "from", item2 AS "to", (c.n * n_both - a.n * b.n) / nullif(sqrt(a.n * (c.n - a.n) * b.n * (c.n - b.n)), 0) AS cor, a.tokens AS n, a.chars AS chars, a.quality AS quality
      FROM p JOIN i a ON a.word = item1 JOIN i b ON b.word = item2, c)
SELECT "from", "to", round(cor, 6) AS correlation, {bins} AS strength, n::BIGINT AS n, round(chars, 4) AS mean_chars, round(quality, 6) AS mean_quality FROM f WHERE cor > {low}"""

# Size of the vocabulary and correlation bins of both parts of the study.
WORDS_1, BINS_1 = 120, [0.02, 0.05, 1]
WORDS_2, BINS_2 = 150, [0, 0.065, 0.13, 1]


def _word_graph(t, keep, n, breaks):
    """Edges between correlated words, with the word's averages; ``keep`` says which words may be among the ``n``."""
    words = materialise(word_counts(t, [r["word"] for r in top_words(t, n, keep)]))
    phi = cooccurrence.pairwise_phi(words.select("word", "doc_id"), "word", "doc_id", mirror=True).where(F.col("correlation") > breaks[0])
    averages = token_averages(t, words)
    edges = phi.select(F.col("item1").alias("from"), F.col("item2").alias("to"), F.round("correlation", 6).alias("correlation"),
                       cut("correlation", breaks).alias("strength"))
    return edges.join(averages.withColumnRenamed("word", "from"), "from")


def _bins_sql(breaks):
    return "CASE " + " ".join(f"WHEN cor > {a} AND cor <= {b} THEN '({a},{b}]'" for a, b in zip(breaks, breaks[1:])) + " END"


@query("study_wine_words", WINE_SQL.format(w=WORD_SQL, n=WORDS_1, low=BINS_1[0], bins=_bins_sql(BINS_1),
                                           keep=f"word IN (SELECT unnest(regexp_extract_all(lower(text), '{WORD_SQL}', 1)) FROM benchmark)"))
def study_wine_words(t):
    listed = tokens(t.benchmark.select("text"), "text").distinct()
    return _word_graph(t, lambda found: rows_in(found, "word", listed), WORDS_1, BINS_1)


@query("study_wine_terms", WINE_SQL.format(w=WORD_SQL, n=WORDS_2, low=BINS_2[0], bins=_bins_sql(BINS_2),
                                           keep=f"word NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}) AND NOT regexp_matches(word, '^\\d+$')"))
def study_wine_terms(t):
    stops = F.broadcast(literal_table(t.spark, [(w,) for w in STOP_WORDS], "word string"))
    return _word_graph(t, lambda found: rows_not_in(found.where(~F.col("word").rlike(r"^\d+$")), "word", stops), WORDS_2, BINS_2)


@query("study_ross", """
WITH o AS (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS word FROM part),
big AS (SELECT word FROM o GROUP BY 1 HAVING count(*) > 150),
n AS (SELECT word, p_type, count(*) AS n FROM o WHERE word IN (SELECT word FROM big) GROUP BY ALL),
g AS (SELECT a.word, b.p_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT word FROM n) a CROSS JOIN (SELECT DISTINCT p_type FROM n) b LEFT JOIN n ON a.word = n.word AND b.p_type = n.p_type),
e AS (SELECT *, sum(n) OVER (PARTITION BY word) * sum(n) OVER (PARTITION BY p_type) / sum(n) OVER ()::DOUBLE AS x FROM g),
r AS (SELECT word, p_type, greatest(0, least(1, (n - x) / sqrt(x))) AS v FROM e)
SELECT a.word AS item1, b.word AS item2, round(sqrt(sum((a.v - b.v) ** 2)), 6) AS distance FROM r a JOIN r b ON a.p_type = b.p_type AND a.word <> b.word GROUP BY ALL""")
def study_ross(t):
    objects = split_rows(t.part.select("p_partkey", "p_type", F.col("p_name").alias("word")), "word", " ")
    frequent = count_by(objects, "word").where("n > 150")
    kept = join_on(objects, frequent.select("word"), ["word"], "right")
    residuals = stats.clipped_residuals(stats.chisq_residuals(kept, "word", "p_type"))
    return cooccurrence.pairwise_distance(residuals, "word", "p_type", "residual", mirror=True).withColumn("distance", F.round("distance", 6))


FRIENDS_SQL = """
WITH m AS (SELECT conv_id AS episode, turn // 2 AS scene, role, length(text) AS n FROM conversations),
s AS (SELECT episode, scene, role, sum(n) AS n FROM m WHERE role <> 'system' GROUP BY ALL),
a AS (SELECT episode, scene, sum(n) AS shared FROM m WHERE role = 'system' GROUP BY ALL),
k AS (SELECT episode, scene, role, (n + coalesce(shared, 0))::BIGINT AS n FROM s LEFT JOIN a USING (episode, scene)),
e AS (SELECT a.episode, a.role AS "from", b.role AS "to", sum(a.n)::BIGINT AS weight FROM k a JOIN k b ON a.episode = b.episode AND a.scene = b.scene AND a.role <> b.role GROUP BY ALL),
t AS (SELECT episode, role, sum(n)::BIGINT AS total FROM k GROUP BY ALL)
SELECT e.episode, e."from", e."to", weight, x.total AS source_total, y.total AS target_total, round(x.total::DOUBLE / max(x.total) OVER (), 6) AS source_size,
       round(sqrt(y.total::DOUBLE / max(y.total) OVER ()) / 2, 6) AS target_radius
FROM e JOIN t x ON e.episode = x.episode AND e."from" = x.role JOIN t y ON e.episode = y.episode AND e."to" = y.role"""


@query("study_friends", FRIENDS_SQL)
def study_friends(t):
    said = t.conversations.select(F.col("conv_id").alias("episode"), F.expr("turn div 2").alias("scene"), "role", F.char_length("text").cast("bigint").alias("n"))
    talk = materialise(graph.attribute_broadcasts(said, ["episode", "scene"], "role", "n", F.col("role") == "system"))
    edges = graph.interaction_edges(talk, ["episode"], ["scene"], "role", "n")
    totals = count_by(talk, "episode", "role", weight="n", name="total")
    edges = join_on(edges, totals.withColumnRenamed("total", "source_total"), ["episode", ("from", "role")], "left")
    edges = join_on(edges, totals.withColumnRenamed("total", "target_total"), ["episode", ("to", "role")], "left")
    edges = materialise(edges)
    sized = scale_max(scale_max(edges, "source_total", [], "source_size"), "target_total", [], "t")
    return sized.select("episode", "from", "to", "weight", "source_total", "target_total", F.round("source_size", 6).alias("source_size"),
                        F.round(F.sqrt("t") / 2, 6).alias("target_radius"))


# Edges shown of an episode.
SHOWN = 10
SPEAKERS = ["click", "purchase", "signup", "view"]


@query("study_friends_main", f"""
WITH m AS (SELECT ((day(ts) - 1) // 7)::INT AS season, ts::DATE AS episode, user_id AS scene, event_type AS speaker, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT * FROM m WHERE speaker <> 'error'),
a AS (SELECT season, episode, scene, n AS shared FROM m WHERE speaker = 'error'),
k AS (SELECT season, episode, scene, speaker, (n + coalesce(shared, 0))::BIGINT AS n FROM s LEFT JOIN a USING (season, episode, scene)),
e AS (SELECT a.season, a.episode, a.speaker AS "from", b.speaker AS "to", sum(a.n)::BIGINT AS weight
      FROM k a JOIN k b ON a.episode = b.episode AND a.scene = b.scene AND a.speaker <> b.speaker GROUP BY ALL),
t AS (SELECT season, episode, speaker, sum(n)::DOUBLE AS total, (list_position({SPEAKERS}, speaker) - 1) * pi() / 3 AS turn FROM k GROUP BY ALL),
l AS (SELECT e.*, cos(x.turn) AS x0, sin(x.turn) AS y0, cos(y.turn) AS x1, sin(y.turn) AS y1, sqrt(x.total / max(x.total) OVER ()) / 2 AS r0, sqrt(y.total / max(y.total) OVER ()) / 2 AS r1,
        CASE WHEN cos(y.turn) > cos(x.turn) OR (cos(y.turn) = cos(x.turn) AND sin(y.turn) > sin(x.turn)) THEN 1 ELSE -1 END AS s
      FROM e JOIN t x ON e.episode = x.episode AND e."from" = x.speaker JOIN t y ON e.episode = y.episode AND e."to" = y.speaker),
""" + LINK_SQL.format(keys='season, episode, "from", "to", weight') + f"""
QUALIFY rank() OVER (PARTITION BY season, episode ORDER BY weight DESC) <= {SHOWN}""")
def study_friends_main(t):
    """The heaviest links of each episode with their end points; what one event says to everyone counts for all present."""
    said = t.events.groupBy(F.expr("int((day(ts) - 1) div 7)").alias("season"), F.to_date("ts").alias("episode"), F.col("user_id").alias("scene"),
                            F.col("event_type").alias("speaker")).agg(F.count(F.lit(1)).alias("n"))
    talk = materialise(graph.attribute_broadcasts(said, ["season", "episode", "scene"], "speaker", "n", F.col("speaker") == "error"))
    edges = graph.interaction_edges(talk, ["season", "episode"], ["scene"], "speaker", "n")
    totals = count_by(talk, "season", "episode", "speaker", weight="n", name="total")
    turn = (F.array_position(F.array(*[F.lit(v) for v in SPEAKERS]), F.col("speaker")) - 1) * math.pi / 3
    nodes = totals.select("season", "episode", "speaker", "total", F.cos(turn).alias("x"), F.sin(turn).alias("y"))
    for i, end in enumerate(("from", "to")):
        edges = join_on(edges, nodes.toDF("season", "episode", end, f"t{i}", f"x{i}", f"y{i}"), ["season", "episode", end], "left")
    sized = scale_max(scale_max(materialise(edges), "t0", [], "s0"), "t1", [], "s1")
    link = geometry.link_ends("x0", "y0", "x1", "y1", F.sqrt("s0") / 2, F.sqrt("s1") / 2)
    best = graph.top_edges(sized.withColumn("l", link), SHOWN, ["season", "episode"])
    return best.select("season", "episode", "from", "to", "weight", "l.direction",
                       *[(F.round(F.col("l")[c], 5) + 0.0).alias(c) for c in ("x_from", "y_from", "x_to", "y_to")])


# Lightest shade that counts, and number of terms.
LIGHTEST, TERMS = 0.95, 25
TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("study_makeup", HLS_SQL + f""",
f AS (SELECT f.*, p_type, p_size FROM full_hls f JOIN part USING (p_partkey)),
shades AS (SELECT p_brand, p_name, p_type, l, hex, h, s FROM f QUALIFY row_number() OVER (PARTITION BY p_brand, p_name, p_type, l ORDER BY p_partkey) = 1),
cats AS (SELECT p_brand, p_name, p_type, l, p_name AS terms, lower(p_type) || ', ' || CASE p_size % 3 WHEN 0 THEN 'food' WHEN 1 THEN 'drink' ELSE 'plant' END AS categories
         FROM f QUALIFY row_number() OVER (PARTITION BY p_brand, p_name, p_type, l ORDER BY p_partkey) = 1),
d AS (SELECT shades.*, {TITLE.format("terms")} AS category, unnest(string_split(categories, ', ')) AS kind FROM shades JOIN cats USING (p_brand, p_name, p_type, l)),
e AS (SELECT * FROM d WHERE kind IN ('food', 'drink') AND l <= {LIGHTEST}),
top AS (SELECT category FROM e GROUP BY 1 ORDER BY count(*) DESC, category LIMIT {TERMS}),
m AS (SELECT category, count(*) AS n, avg(h) AS h, avg(l) AS l, avg(s) AS s FROM e WHERE category IN (SELECT category FROM top) GROUP BY 1),
k AS (SELECT *, (1 - abs(2 * l - 1)) * s AS c FROM m),
x AS (SELECT *, c * (1 - abs((h / 60) - 2 * floor(h / 120) - 1)) AS xx, l - c / 2 AS o, floor(h / 60)::INT AS z FROM k),
q AS (SELECT category, n, round_even(255 * (o + CASE WHEN z IN (0, 5) THEN c WHEN z IN (1, 4) THEN xx ELSE 0 END), 0)::BIGINT AS r,
  round_even(255 * (o + CASE WHEN z IN (1, 2) THEN c WHEN z IN (0, 3) THEN xx ELSE 0 END), 0)::BIGINT AS g,
  round_even(255 * (o + CASE WHEN z IN (3, 4) THEN c WHEN z IN (2, 5) THEN xx ELSE 0 END), 0)::BIGINT AS b FROM x),
w AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS mx, least(r, g, b) / 255.0::DOUBLE AS mn FROM q),
y AS (SELECT *, (mx + mn) / 2 AS l, CASE WHEN mx = mn THEN 0 WHEN (mx + mn) / 2 <= 0.5 THEN (mx - mn) / (mx + mn) ELSE (mx - mn) / (2 - mx - mn) END AS s FROM w)
SELECT category, n, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS avg_color, round(l, 6) AS lightness,
       round(CASE WHEN l > 0.5 THEN (2 - 2 * l) * s ELSE 2 * l * s END, 6) AS x, round(2 * l / tan(pi() / 3) - 1 / tan(pi() / 3), 6) + 0 AS y FROM y""")
def study_makeup(t):
    """Shades and their categories are two tables that meet on four keys; the mean colour of a term is folded into the triangle."""
    keys = ["p_brand", "p_name", "p_type", "lightness"]
    shades = with_space(with_rgb(part_colours(t).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "hex"), "hex"))
    shades = shades.select("p_partkey", "p_brand", "p_name", "p_type", F.col("hls.l").alias("lightness"), "hex", "p_size")
    kind = F.when(F.pmod("p_size", F.lit(3)) == 0, "food").when(F.pmod("p_size", F.lit(3)) == 1, "drink").otherwise("plant")
    table = shades.select(*keys, "p_partkey", F.col("p_name").alias("terms"), F.concat(F.lower("p_type"), F.lit(", "), kind).alias("categories"))
    table = first_rows(table, keys, ["p_partkey"]).drop("p_partkey")
    both = join_on(first_rows(shades, keys, ["p_partkey"]).drop("p_size", "p_partkey"), table, keys)
    terms = split_rows(both, "categories", ", ").withColumn("category", title_case("terms"))
    food = materialise(terms.where(F.col("categories").isin("food", "drink") & (F.col("lightness") <= LIGHTEST)).select("category", "hex"))
    top = top_counts(food, TERMS, "category")
    means = with_space(with_rgb(average_colour(rows_in(food, "category", top), "hex", ["category"]), "avg_color"))
    at = geometry.shade_triangle(F.col("hls.s"), F.col("hls.l"))
    return means.join(top, "category").select("category", "n", "avg_color", F.round("hls.l", 6).alias("lightness"),
                                              F.round(at["x"], 6).alias("x"), (F.round(at["y"], 6) + 0.0).alias("y"))
