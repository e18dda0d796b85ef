"""Studies on shares and layouts: commute, energy, spotify, rap, cran."""

from pyspark.sql import functions as F

from ...functions import geometry
from ...functions.categories import level_ordinal, other, recode
from ...functions.nulls import case_when, in_set
from ...functions.numeric import divide
from ...functions.text import classify
from ...operators import graph, partition
from ...operators.aggregates import count_by, ratio_when, top_counts
from ...operators.joins import join_on, rows_in, rows_not_in
from ...operators.levels import order_from, with_level_order
from ...operators.ordered import number_rows
from ...operators.reshape import longer_sets, union_by_name, union_tagged, wider_multi
from ...operators.windows import bands, mark_first, midpoints, with_group_stats
from ...session import materialise, remove_at_exit, scratch_path
from ...sources.delimited import read_csv, write_csv
from ..analysis import measures_sql, type_features
from ..registry import query

CLEAN = ["BUILDING", "FURNITURE"]


@query("study_commute", """
WITH c AS (SELECT r_name AS state, lower(c_mktsegment) AS city_size, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS mode, count(*) AS total
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
s AS (SELECT state, city_size, sum(total)::BIGINT AS size, sum(total) FILTER (mode = 'fast')::BIGINT AS total_fast, sum(total) FILTER (mode = 'slow')::BIGINT AS total_slow FROM c GROUP BY ALL),
p AS (SELECT *, size::DOUBLE / sum(size) OVER (PARTITION BY state) AS pcs FROM s),
b AS (SELECT *, sum(pcs) OVER (PARTITION BY state ORDER BY city_size) AS e FROM p)
SELECT state, city_size, total_fast, total_slow, round(total_fast::DOUBLE / size, 6) AS percentage_fast, round(total_slow::DOUBLE / size, 6) AS percentage_slow,
       round(pcs, 6) AS percentage_city_size, abs(round(e - pcs, 6)) AS start, round(e, 6) AS "end" FROM b""")
def study_commute(t):
    by_customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.when(in_set("o_orderpriority", ["1-URGENT", "2-HIGH"]), "fast").otherwise("slow").alias("mode")).agg(
        F.count(F.lit(1)).alias("n"))
    states = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("state"))
    rows = by_customer.join(t.customer.select("c_custkey", "c_nationkey", F.lower("c_mktsegment").alias("city_size")), "c_custkey").join(states, "c_nationkey")
    total = materialise(count_by(rows.na.drop(subset=["state", "mode"]), "mode", "state", "city_size", weight="n", name="total"))
    out = with_group_stats(total, ["state", "city_size"], size=F.sum("total"))
    out = with_group_stats(out, ["state"], total, whole=F.sum("total"))
    out = out.select("state", "city_size", "mode", "total", divide("total", "size").alias("percentage"), divide("size", "whole").alias("percentage_city_size"))
    wide = wider_multi(out, ["state", "city_size", "percentage_city_size"], "mode", ["fast", "slow"], ["total", "percentage"])
    placed = bands(wide, "percentage_city_size", ["city_size"], ["state"])
    rounded = ["percentage_fast", "percentage_slow", "percentage_city_size", "start", "end"]
    return placed.withColumns({c: F.abs(F.round(c, 6)) for c in rounded})


def _energy(t):
    """Order value by year, nation group and segment, with the level order of each key."""
    kept = ["NATION_1", "NATION_2", "NATION_3", "NATION_4"]
    by_customer = t.orders.where(F.year("o_orderdate").between(1998, 2000)).groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    people = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("type"))
    named = by_customer.join(people, "c_custkey").join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")
    # a few hundred rows from here on, read by every level of every key order
    rows = materialise(named.withColumn("country", other("n_name", kept, "Rest")).groupBy("year", "country", "type").agg(F.sum("n").alias("total")))
    clean = rows.groupBy("country").agg(ratio_when("total", in_set("type", CLEAN)).alias("ratio"))
    order = order_from(clean, "country", [F.col("ratio").desc_nulls_last()], bounded=True)
    rows = with_level_order(rows, "country", order).withColumn("year_ord", -F.col("year"))
    return rows.withColumn("type_ord", level_ordinal("type", CLEAN + ["AUTOMOBILE", "HOUSEHOLD", "MACHINERY"]))


ENERGY_SQL = """
WITH g0 AS (SELECT year(o_orderdate)::INT AS year, CASE WHEN n_name IN ('NATION_1','NATION_2','NATION_3','NATION_4') THEN n_name ELSE 'Rest' END AS country, c_mktsegment AS type, count(*)::DOUBLE AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) BETWEEN 1998 AND 2000 GROUP BY ALL),
co AS (SELECT country, row_number() OVER (ORDER BY sum(total) FILTER (type IN ('BUILDING', 'FURNITURE')) / sum(total) DESC, country) AS o FROM g0 GROUP BY 1),
g AS (SELECT year, country, type, total, -year AS yo, o AS co, list_position(['BUILDING','FURNITURE','AUTOMOBILE','HOUSEHOLD','MACHINERY'], type) AS tyo FROM g0 JOIN co USING (country)),
"""


def _energy_part(i, k1, o1, k2, o2, k3, o3):
    return f"""a{i} AS (SELECT {k1}, {o1}, sum(total) AS t, sum(total) / (SELECT sum(total) FROM g) AS p1 FROM g GROUP BY ALL),
b{i} AS (SELECT *, sum(p1) OVER (ORDER BY {o1}) AS m1 FROM a{i}),
c{i} AS (SELECT {k1}, {k2}, {o2}, sum(total) AS t2, sum(total) / any_value(t) AS p2 FROM g JOIN a{i} USING ({k1}) GROUP BY ALL),
d{i} AS (SELECT *, sum(p2) OVER (PARTITION BY {k1} ORDER BY {o2}) AS m2 FROM c{i}),
e{i} AS (SELECT {k1}, {k2}, {k3}, g.{o3}, sum(total) / any_value(t2) AS p3 FROM g JOIN c{i} USING ({k1}, {k2}) GROUP BY ALL),
f{i} AS (SELECT *, sum(p3) OVER (PARTITION BY {k1}, {k2} ORDER BY {o3}) AS m3 FROM e{i}),
r{i} AS (SELECT year, country, type, {i}::INT AS chunk_id, m2 - p2 AS xmin, m2 AS xmax, m1 - p1 + p1 * (m3 - p3) AS ymin, m1 - p1 + p1 * m3 AS ymax
  FROM f{i} JOIN d{i} USING ({k1}, {k2}) JOIN b{i} USING ({k1})),"""


ENERGY_PARTS = (ENERGY_SQL + _energy_part(1, "year", "yo", "country", "co", "type", "tyo") + _energy_part(2, "year", "yo", "type", "tyo", "country", "co")
                + _energy_part(3, "type", "tyo", "country", "co", "year", "yo"))
# Colours of a cell by kind and year; all others are grey.
SHADES = {"BUILDING": ["#25929b", "#1b8189", "#147078"], "FURNITURE": ["#f1e4dc", "#eadacf", "#e3cdc0"], "AUTOMOBILE": ["#cc5a4c", "#c64b3c", "#bd4132"]}
YEARS, GREY = [1998, 1999, 2000], "#333333"
YEAR, COUNTRY, KIND = ("year", "year_ord"), ("country", "country_ord"), ("type", "type_ord")
KEY_ORDERS = {1: [YEAR, COUNTRY, KIND], 2: [YEAR, KIND, COUNTRY], 3: [KIND, COUNTRY, YEAR]}
SHADES_SQL = "CASE " + " ".join(f"WHEN type = '{k}' AND year = {y} THEN '{c}'" for k, cs in SHADES.items() for y, c in zip(YEARS, cs)) + f" ELSE '{GREY}' END"


@query("study_energy", ENERGY_PARTS + f"""
u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
SELECT year, country, type, chunk_id, abs(round(xmin, 6)) AS xmin, round(xmax, 6) AS xmax, abs(round(ymin, 6)) AS ymin, round(ymax, 6) AS ymax, {SHADES_SQL} AS color FROM u""")
def study_energy(t):
    rows = _energy(t)
    columns = ["year", "country", "type", "xmin", "xmax", "ymin", "ymax"]
    chunks = union_tagged({i: partition.marimekko(rows, keys, "total").select(*columns) for i, keys in KEY_ORDERS.items()}, "chunk_id")
    colour = case_when(*[((F.col("type") == k) & (F.col("year") == y), c) for k, cs in SHADES.items() for y, c in zip(YEARS, cs)], default=GREY)
    out = chunks.withColumns({c: F.abs(F.round(c, 6)) for c in columns[3:]}).withColumn("color", colour)
    path = remove_at_exit(t.spark, scratch_path(t.spark, "csv"))
    write_csv(out, path)
    return read_csv(t.spark, path, out.schema)


# Countries too small for a label, and the label that is too long.
BLANK, SHORT = 2, {"AUTOMOBILE": "Autom."}


@query("study_energy_labels", ENERGY_PARTS + f"""
blank AS (SELECT country FROM g GROUP BY 1 ORDER BY sum(total), country LIMIT {BLANK}),
u AS (SELECT 1 AS chunk_id, year::VARCHAR AS label, m1 - p1 / 2 AS y FROM b1 UNION ALL SELECT 2, year::VARCHAR, m1 - p1 / 2 FROM b2 UNION ALL SELECT 3, type, m1 - p1 / 2 FROM b3)
SELECT chunk_id, CASE label WHEN 'AUTOMOBILE' THEN 'Autom.' ELSE label END AS label, round(y, 6) AS ylabel FROM u WHERE label NOT IN (SELECT country FROM blank)""")
def study_energy_labels(t):
    """Middle of the bands of the first key of each order, without the smallest countries."""
    rows = _energy(t)
    labels = union_tagged({i: partition.band_labels(partition.marimekko(rows, keys, "total"), keys[0][0]).select(
        F.col(keys[0][0]).cast("string").alias("label"), F.round("ylabel", 6).alias("ylabel")) for i, keys in KEY_ORDERS.items()}, "chunk_id")
    blank = count_by(rows, "country", weight="total", name="total").orderBy("total", "country").limit(BLANK)
    return rows_not_in(labels, "label", blank, "country").withColumn("label", recode("label", SHORT))


GENRE_SQL = "CASE WHEN p_type LIKE 'S%' THEN 'S' ELSE 'Other' END"


@query("study_spotify", "WITH part2 AS (SELECT *, " + GENRE_SQL + " AS genre FROM part),\n" + measures_sql("p_type") + ",\n"
       + measures_sql("genre", "2").replace("JOIN part ON", "JOIN part2 ON") + """,
g AS (SELECT genre, row_number() OVER (ORDER BY genre) AS gno, count(*) OVER () AS n FROM (SELECT DISTINCT genre FROM part2)),
p AS (SELECT 'genre' AS level, genre AS name, genre, cos((gno - 1) / n::DOUBLE * 2 * pi()) AS x, sin((gno - 1) / n::DOUBLE * 2 * pi()) AS y FROM g UNION ALL
      SELECT 'subgenre', p_type, genre, cos((gno - 1) / n::DOUBLE * 2 * pi()) + CASE WHEN sub > 2 THEN -0.25 ELSE 0.25 END, sin((gno - 1) / n::DOUBLE * 2 * pi()) + CASE WHEN sub % 2 = 0 THEN -0.25 ELSE 0.25 END
      FROM (SELECT genre, p_type, row_number() OVER (PARTITION BY genre ORDER BY p_type) AS sub FROM (SELECT DISTINCT genre, p_type FROM part2)) JOIN g USING (genre)),
h AS (SELECT 'genre' AS level, genre AS name, feature, v, no FROM f2 UNION ALL SELECT 'subgenre', p_type, feature, v, no FROM f),
a AS (SELECT h.*, genre, x, y, 2 * pi() / 5 AS step, (no - 1) * 2 * pi() / 5 AS b0, (no - 0.5) * 2 * pi() / 5 AS mid FROM h JOIN p USING (level, name)),
v AS (SELECT *, 'value' AS shape, v AS len FROM a UNION ALL SELECT *, 'full', 1.0 FROM a)
SELECT level, name, genre, feature, shape, round(len * cos(b0 + pi() / 2) + 0.2 * cos(mid + pi() / 2), 6) + 0 AS x1, round(len * tan(step / 2), 6) AS r,
  round(x / 3 + 0.5, 6) + 0 AS at_x, round(y / 3 + 0.5, 6) + 0 AS at_y FROM v""")
def study_spotify(t):
    """Flowers of two levels: genres on a circle, and their subgenres shifted around each genre before the circle is scaled."""
    genre = classify("p_type", [("^S", "S")], F.lit("Other")).alias("genre")
    kinds = materialise(t.part.select(genre, "p_type").distinct())  # a handful
    genres = number_rows(kinds.select("genre").distinct(), ["genre"], name="gno", bounded=True)
    spot = geometry.circle_point(F.col("gno"), F.col("n"))
    genres = with_group_stats(genres, [], n=F.count(F.lit(1))).select("genre", spot["x"].alias("x"), spot["y"].alias("y"))
    shift = geometry.quadrant_offset("sub")
    subs = number_rows(kinds, ["p_type"], ["genre"], name="sub", bounded=True).join(genres, "genre")
    places = union_by_name(
        genres.select(F.lit("genre").alias("level"), F.col("genre").alias("name"), "genre", "x", "y"),
        subs.select(F.lit("subgenre").alias("level"), F.col("p_type").alias("name"), "genre", (F.col("x") + shift["dx"]).alias("x"), (F.col("y") + shift["dy"]).alias("y")))
    features = union_tagged({"genre": type_features(t, genre).withColumnRenamed("genre", "name"), "subgenre": type_features(t).withColumnRenamed("p_type", "name")}, "level")
    both = union_tagged({"value": features, "full": features.withColumn("v", F.lit(1.0))}, "shape")
    petals = both.withColumn("p", geometry.petal(F.col("v"), F.col("no"), 5)).join(places, ["level", "name"])
    return petals.select("level", "name", "genre", "feature", "shape", (F.round("p.x1", 6) + 0.0).alias("x1"), F.round("p.r", 6).alias("r"),
                         *[(F.round(F.col(c) / 3 + 0.5, 6) + 0.0).alias(f"at_{c}") for c in ("x", "y")])


# Number of artists, of ranked titles and the gap between artists.
ARTISTS, RANKED, GAP = 23, 100, 3


@query("study_rap", """
WITH s AS (SELECT o_orderkey, o_custkey AS artist, year(o_orderdate) AS year, o_orderpriority || ' ' || o_orderstatus AS title, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
o AS (SELECT r AS title_rank, pow(length(lpad(r::VARCHAR, 3, '0') || '. ' || title) / 2.0::DOUBLE, 0.95) * 0.00825 AS off FROM s WHERE r <= 100
      UNION ALL SELECT 101, pow(length('101. - ' || count(*) || '.') / 2.0::DOUBLE, 0.95) * 0.00825 FROM s),
a AS (SELECT artist, row_number() OVER (ORDER BY n DESC, artist) AS artist_rank FROM (SELECT artist, count(*) AS n FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 23)),
g AS (SELECT 'artist' AS side, artist AS key, -artist_rank AS place, least(r, 101) AS title_rank, count(*) AS size FROM s JOIN a USING (artist) GROUP BY ALL
      UNION ALL SELECT 'year', year, year, least(r, 101), count(*) FROM s GROUP BY ALL),
l AS (SELECT *, CASE WHEN place <> coalesce(lag(place) OVER w, place) THEN 3 ELSE 0 END AS shift FROM g WINDOW w AS (PARTITION BY side ORDER BY place, title_rank DESC)),
b AS (SELECT *, sum(size + shift) OVER (PARTITION BY side ORDER BY place, title_rank DESC) AS e FROM l),
m AS (SELECT *, min(e - size) OVER (PARTITION BY side, key) + sum(size) OVER (PARTITION BY side, key) / 2.0::DOUBLE AS midpoint, max(e) OVER (PARTITION BY side) AS ticks,
        CASE side WHEN 'year' THEN -1 ELSE 1 END AS sign FROM b),
c AS (SELECT side, key, title_rank, midpoint, sign, off, -2 / 101::DOUBLE * (title_rank - 0.075) + 1 AS y1, -2 / 101::DOUBLE * (title_rank + 0.075) + 1 AS y2,
        (e - size) * 2.0 / ticks::DOUBLE - 1 AS y3, e * 2.0 / ticks::DOUBLE - 1 AS y4 FROM m JOIN o USING (title_rank))
SELECT side, key, title_rank, midpoint, p::INT AS point, round(sign * CASE WHEN p <= 2 THEN off ELSE 1 END, 6) AS x, round(CASE p WHEN 1 THEN y1 WHEN 2 THEN y2 WHEN 3 THEN y3 ELSE y4 END, 6) AS y FROM c, range(1, 5) r(p)""")
def study_rap(t):
    """Ribbons from the ranked titles to the bands of artists on one side, and mirrored to the bands of years on the other."""
    title = F.concat("o_orderpriority", F.lit(" "), "o_orderstatus")
    songs = t.orders.select("o_orderkey", F.col("o_custkey").alias("artist"), F.year("o_orderdate").cast("bigint").alias("year"), title.alias("title"), "o_totalprice")
    best = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    ranked = materialise(number_rows(songs.orderBy(*best).limit(RANKED), best, name="r", bounded=True))  # a top-k
    artists = number_rows(top_counts(songs, ARTISTS, "artist"), [F.col("n").desc(), "artist"], name="artist_rank", bounded=True)
    # both joins are with a top-k table
    titled = songs.join(F.broadcast(ranked.select("o_orderkey", "r")), "o_orderkey", "left").withColumn("title_rank", F.coalesce("r", F.lit(RANKED + 1)).cast("bigint"))
    mine = titled.join(F.broadcast(artists.select("artist", "artist_rank")), "artist")
    label = F.concat(F.lpad(F.col("r").cast("string"), 3, "0"), F.lit(". "), "title")
    others = songs.agg(F.concat(F.lit(f"{RANKED + 1}. - "), F.count(F.lit(1)), F.lit(".")).alias("label")).select(F.lit(RANKED + 1).cast("bigint").alias("title_rank"), "label")
    room = union_by_name(ranked.select(F.col("r").cast("bigint").alias("title_rank"), label.alias("label")), others)
    room = materialise(room.select("title_rank", geometry.label_offset("label").alias("room")))

    def side(name, rows, key, place):
        sizes = materialise(rows.groupBy(F.col(key).alias("key"), place.cast("bigint").alias("place"), "title_rank").agg(F.count(F.lit(1)).alias("size")))
        # at most so many titles for each artist or year
        placed = midpoints(bands(sizes, "size", ["place", F.col("title_rank").desc()], gap_when="place", gap=GAP, bounded=True), ["key"])
        placed = with_group_stats(materialise(placed), [], ticks=F.max("end")).join(room, "title_rank")
        corners = geometry.ribbon_corners("title_rank", "start", "end", "room", F.col("ticks").cast("double"), RANKED + 1, mirrored=name == "year")
        return placed.select(F.lit(name).alias("side"), "key", "title_rank", "midpoint", *[F.round(v, 6).alias(k) for k, v in corners.items()])

    wide = union_by_name(side("artist", mine, "artist", -F.col("artist_rank")), side("year", titled, "year", F.col("year")))
    return longer_sets(wide, {i: {"x": f"x{i}", "y": f"y{i}"} for i in (1, 2, 3, 4)}, "point")


LANGUAGES = [f"Brand#{i}" for i in range(1, 14)]
CRAN_SQL = f"""
WITH c AS (SELECT l_suppkey AS pkg, p_brand AS language, sum(l_linenumber)::BIGINT AS code FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE p_brand IN ({", ".join(f"'{b}'" for b in LANGUAGES)}) GROUP BY ALL),
top AS (SELECT pkg FROM c GROUP BY 1 ORDER BY sum(code) DESC, pkg LIMIT 300),
k AS (SELECT pkg, language, code, row_number() OVER (PARTITION BY pkg ORDER BY code DESC, language) = 1 AS main FROM c WHERE pkg IN (SELECT pkg FROM top)),
g AS (SELECT language, sum(code)::BIGINT AS code FROM k GROUP BY 1)
"""


def _packages(t):
    lines = t.lineitem.groupBy("l_partkey", F.col("l_suppkey").alias("pkg")).agg(F.sum("l_linenumber").alias("code"))
    brands = t.part.where(in_set("p_brand", LANGUAGES)).select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("language"))
    code = materialise(count_by(lines.join(brands, "l_partkey"), "pkg", "language", weight="code", name="code"))
    kept = rows_in(code, "pkg", top_counts(code, 300, "pkg", weight="code"))
    # at most 13 languages for each of 300 packages
    return materialise(mark_first(kept, ["pkg"], [F.col("code").desc(), "language"], bounded=True))


@query("study_cran_edges", CRAN_SQL + """
SELECT language AS "from", pkg::VARCHAR AS "to", code AS weight, main FROM k UNION ALL SELECT 'root', language, code, false FROM g""")
def study_cran_edges(t):
    rows = _packages(t)
    edges, _ = graph.hierarchy(rows.withColumn("pkg", F.col("pkg").cast("string")), "pkg", "language", "code", "root")
    flags = rows.select(F.col("language").alias("from"), F.col("pkg").cast("string").alias("to"), "main")
    return join_on(edges, flags, ["from", "to"], "left").withColumn("main", F.coalesce("main", F.lit(False)))


@query("study_cran_vertices", CRAN_SQL + """,
v AS (SELECT pkg::VARCHAR AS name, max(language) FILTER (main) AS language, sum(code)::BIGINT AS total, 1 AS level FROM k GROUP BY pkg
      UNION ALL SELECT language, language, code, 2 FROM g UNION ALL SELECT 'root', 'root', 0, 3),
o AS (SELECT name, row_number() OVER (ORDER BY language, total DESC, name) AS i, count(*) OVER () AS n FROM v WHERE level = 1)
SELECT v.name, language, total, level, round(pow(total, 1.8), 2) AS radius, round(cos((i - 1) / n::DOUBLE * 2 * pi()), 6) + 0 AS x, round(sin((i - 1) / n::DOUBLE * 2 * pi()), 6) + 0 AS y
FROM v LEFT JOIN o ON v.name = o.name""")
def study_cran_vertices(t):
    rows = _packages(t).withColumn("pkg", F.col("pkg").cast("string"))
    _, vertices = graph.hierarchy(rows, "pkg", "language", "code", "root")
    main = rows.where("main").select(F.col("pkg").alias("name"), "language")
    named = vertices.join(main, "name", "left").withColumn("language", F.coalesce("language", "name"))
    leaves = number_rows(named.where("level = 1"), ["language", F.col("total").desc(), "name"], name="i", bounded=True)
    leaves = with_group_stats(leaves, [], n=F.count(F.lit(1)))
    at = geometry.circle_point(F.col("i"), F.col("n"))
    spots = leaves.select("name", (F.round(at["x"], 6) + 0.0).alias("x"), (F.round(at["y"], 6) + 0.0).alias("y"))
    return named.join(spots, "name", "left").select("name", "language", "total", "level", F.round(F.pow("total", F.lit(1.8)), 2).alias("radius"), "x", "y")
