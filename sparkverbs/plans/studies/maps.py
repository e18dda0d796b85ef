"""Studies on places: plastic, meteor, ufo, trees."""

from pyspark.sql import functions as F

from ...functions import text as s
from ...functions.nulls import any_present
from ...functions.numeric import divide
from ...operators import density, frames
from ...operators.aggregates import count_by, median_iqr
from ...operators.joins import join_on
from ...operators.levels import lump, order_from, with_level_order
from ...operators.ordered import number_rows
from ...operators.project import clean_names
from ...operators.reshape import longer
from ...operators.rings import centroid
from ...operators.windows import scale_max, top_n
from ...session import materialise
from ...sources.polygons import star_polygons
from ..registry import query


@query("study_plastic", """
WITH w AS (SELECT s_nationkey AS k, sum(l_linenumber) FILTER (l_returnflag = 'R') AS mismanaged, nullif(sum(l_linenumber) FILTER (l_linestatus = 'F'), 0) AS total
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
r AS (SELECT n_nationkey, n_name, mismanaged / total::DOUBLE AS rate, mismanaged, total FROM w JOIN nation ON k = n_nationkey WHERE coalesce(mismanaged, total) IS NOT NULL),
k AS (SELECT *, row_number() OVER (ORDER BY rate NULLS LAST, n_name) AS rank FROM r)
SELECT n_nationkey, rank, rank || '. ' || n_name || ' (' || printf('%.1f', round_even(rate * 100, 1)) || '%)' AS label, measure, v::BIGINT AS value, n_nationkey::DOUBLE AS cx
FROM (SELECT *, 'mismanaged' AS measure, mismanaged AS v FROM k UNION ALL SELECT *, 'total', total FROM k)""")
def study_plastic(t):
    sup = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("Nation Key"))
    per_supplier = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("m"),
                                                       F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))).alias("t"))
    placed = materialise(per_supplier.join(sup, "l_suppkey"))
    waste = clean_names(placed.groupBy("Nation Key").agg(F.sum("m").alias("Mismanaged Waste")))
    total = clean_names(placed.groupBy("Nation Key").agg(F.nullif(F.sum("t"), F.lit(0)).alias("Total Waste")))
    rates = join_on(waste, total, ["nation_key"]).select(
        "nation_key", F.col("mismanaged_waste").alias("mismanaged"), F.col("total_waste").alias("total"),
        divide("mismanaged_waste", "total_waste").alias("rate")).where(any_present("mismanaged", "total"))
    named = join_on(rates, t.nation.select("n_nationkey", "n_name"), [("nation_key", "n_nationkey")]).withColumnRenamed("nation_key", "n_nationkey")
    ranked = number_rows(named, ["rate", "n_name"], name="rank")
    label = s.paste("rank", F.lit(". "), "n_name", F.lit(" ("), s.format_percent("rate", 1), F.lit(")"))
    places = centroid(star_polygons(t.nation, "n_nationkey"), ["n_nationkey"]).select("n_nationkey", F.round("cx", 6).alias("cx"))
    out = join_on(ranked.withColumn("label", label), places, ["n_nationkey"], "left").drop("rate", "n_name")
    return longer(out, ["mismanaged", "total"], "measure", "value")


# Thresholds of the meteorite study, at the size of this data, and finds that no fence leaves out.
GROUPS, CLASSES, SIZE, FENCE, BEST, EXEMPT = 50, 4, 20, 0.45, 3, [1, 2, 7]
METEOR_SQL = f"""
WITH p AS (SELECT p_partkey, p_name AS grp, CASE WHEN regexp_matches(p_type, '^S') THEN 'S' WHEN regexp_matches(p_type, '^PROMO') THEN 'P' ELSE p_type END AS class FROM part),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS mass, l_quantity AS x, l_discount AS y, grp, class FROM lineitem JOIN p ON l_partkey = p_partkey
      WHERE l_quantity BETWEEN 1 AND 49 AND l_discount > 0),
kg AS (SELECT grp FROM l GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= {GROUPS}),
kc AS (SELECT class FROM l GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= {CLASSES}),
k AS (SELECT * REPLACE (CASE WHEN class IN (SELECT class FROM kc) THEN class ELSE 'Other' END AS class) FROM l WHERE grp IN (SELECT grp FROM kg)),
s AS (SELECT grp, count(DISTINCT l_partkey) AS group_size, median(x) AS median_x, median(y) AS median_y, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS wx,
        quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS wy FROM k GROUP BY 1),
f AS (SELECT k.*, group_size, median_x, median_y FROM k JOIN s USING (grp) WHERE group_size >= {SIZE}
      AND (abs(x - median_x) <= {FENCE} * wx OR l_orderkey IN {tuple(EXEMPT)}) AND (abs(y - median_y) <= {FENCE} * wy OR l_orderkey IN {tuple(EXEMPT)})),
o AS (SELECT grp, row_number() OVER (ORDER BY any_value(group_size), grp) AS grp_ord FROM f GROUP BY 1)
"""


def _meteorites(t):
    """Finds within both fences of their group, or exempt from them, with the statistics of the group."""
    name = s.replace_all(s.replace_all(s.replace_all("p_name", r"\d"), r"\(.*\)"), r"\s\w$")
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.trim(name).alias("grp"),
                          s.classify("p_type", [("^S", "S"), ("^PROMO", "P")]).alias("class"))
    finds = t.lineitem.where("l_quantity between 1 and 49 and l_discount > 0").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("mass"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    # frequencies and group sizes come from one row per part; the finds themselves are joined once
    seen = materialise(count_by(finds, "l_partkey").join(parts, "l_partkey"))
    rows = lump(finds.join(parts, "l_partkey"), "grp", GROUPS, counts=count_by(seen, "grp", weight="n"))
    rows = lump(rows, "class", CLASSES, counts=count_by(seen, "class", weight="n")).where("grp <> 'Other'")
    sizes = seen.groupBy("grp").agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= SIZE)
    rows = materialise(rows.join(sizes, "grp"))
    inside = rows
    for c in "xy":
        inside = join_on(inside, median_iqr(rows, c, ["grp"], f"median_{c}", f"w{c}"), ["grp"])
    exempt = F.col("l_orderkey").isin(EXEMPT)
    for c in "xy":
        inside = inside.where((F.abs(F.col(c) - F.col(f"median_{c}")) <= FENCE * F.col(f"w{c}")) | exempt)
    inside = materialise(inside.drop("wx", "wy"))
    order = order_from(inside.select("grp", "group_size").distinct(), "grp", ["group_size"], bounded=True)
    return with_level_order(inside, "grp", order).withColumn("grp_ord", F.col("grp_ord").cast("bigint"))


@query("study_meteor", METEOR_SQL + f""",
t AS (SELECT * FROM f QUALIFY rank() OVER (PARTITION BY grp ORDER BY mass DESC) <= {BEST}),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mass DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, grp, class, group_size, grp_ord, mass, rank, rank || '. ' || grp || ' (' ||
  CASE WHEN mass / 1000 < 100 THEN printf('%.1fkg', round_even(mass / 1000, 1)) ELSE printf('%dkg', round_even(mass / 1000, 0)::BIGINT) END || ')' AS label FROM n JOIN o USING (grp)""")
def study_meteor(t):
    best = number_rows(top_n(_meteorites(t), BEST, "mass", ["grp"]), [F.col("mass").desc(), "l_orderkey", "l_linenumber", "l_partkey"], ["grp"], name="rank")
    best = best.withColumn("label", s.paste("rank", F.lit(". "), "grp", F.lit(" ("), s.format_kg("mass"), F.lit(")")))
    return best.drop("x", "y", "median_x", "median_y")


@query("study_meteor_groups", METEOR_SQL + """
SELECT grp, grp_ord, any_value(group_size) AS group_size, any_value(median_x) AS median_x, round(any_value(median_y), 6) AS median_y FROM f JOIN o USING (grp) GROUP BY ALL""")
def study_meteor_groups(t):
    return _meteorites(t).groupBy("grp", "grp_ord").agg(*[F.min(c).alias(c) for c in ("group_size", "median_x")], F.round(F.min("median_y"), 6).alias("median_y"))


UFO_SQL = """
WITH p AS (SELECT label AS year, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings),
g AS (SELECT ix::INT AS ix, iy::INT AS iy, -0.5 + ix * (1.0 / 11) AS gx, -0.4 + iy * (0.8 / 9) AS gy FROM range(12) a(ix), range(10) b(iy)),
k AS (SELECT year, ix, iy, sum(exp(-0.5 * ((gx - x) / 0.1) ** 2 - 0.5 * ((gy - y) / 0.1) ** 2)) / (count(*) * 2 * pi() * 0.01) AS z FROM p, g GROUP BY ALL),
h AS (SELECT year, ix, iy, z / max(z) OVER () AS height FROM k),
f AS (SELECT *, lead(height) OVER (PARTITION BY ix, iy ORDER BY year) AS b, max(year) OVER () AS top FROM h)
SELECT ix, iy, (year * 20 + s)::INT AS frame, floor(year + s / 20.0)::BIGINT AS year, round(CASE WHEN year = top THEN height ELSE height + (b - height) * s / 20 END, 6) AS height
FROM f, range(20) r(s) WHERE year < top OR s = 0"""


@query("study_ufo", UFO_SQL)
def study_ufo(t):
    at = F.col("embedding")
    sightings = t.embeddings.select(F.col("label").alias("year"), at[2].cast("double").alias("x"), at[3].cast("double").alias("y"))
    grid = density.Grid.from_bounds(-0.5, 0.5, -0.4, 0.4, per_unit=12.0)
    heights = scale_max(density.kernel_density(sightings, "x", "y", grid, 0.4, "year"), "density", [], "height")
    shown = frames.tween(heights.select("ix", "iy", "year", "height"), ["ix", "iy"], "year", ["height"])
    return shown.select("ix", "iy", "frame", F.floor("year").alias("year"), F.round("height", 6).alias("height"))


@query("study_trees", """
WITH p AS (SELECT embedding[5]::DOUBLE AS x, embedding[6]::DOUBLE AS y FROM embeddings WHERE label IN (0, 1, 2, 3, 4, 5, 6) AND embedding[5] BETWEEN -0.3 AND 0.3 AND embedding[6] BETWEEN -0.3 AND 0.3),
s AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n,
  1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS sx,
  1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * pow(count(*), -0.2) AS sy FROM p),
g AS (SELECT ix::INT AS ix, iy::INT AS iy, x0 + ix * (x1 - x0) / 249 AS gx, y0 + iy * (y1 - y0) / 249 AS gy, s.* FROM range(250) a(ix), range(250) b(iy), s),
k AS (SELECT ix, iy, sum(exp(-0.5 * ((gx - x) / sx) ** 2 - 0.5 * ((gy - y) / sy) ** 2)) / (any_value(n) * 2 * pi() * any_value(sx) * any_value(sy)) AS density FROM p, g GROUP BY ALL)
SELECT ix, iy, round(density, 5) AS density, greatest(1, ceil(density / max(density) OVER () * 20))::INT AS level FROM k""")
def study_trees(t):
    at = F.col("embedding")
    points = t.embeddings.where(F.col("label").isin(0, 1, 2, 3, 4, 5, 6) & at[4].between(-0.3, 0.3) & at[5].between(-0.3, 0.3))
    points = points.select(at[4].cast("double").alias("x"), at[5].cast("double").alias("y"))
    k = density.kernel_density(points, "x", "y", density.Grid.around(points, "x", "y", 250, 250), density.normal_bandwidth(points, "x", "y"))
    return density.density_levels(k, 20).select("ix", "iy", F.round("density", 5).alias("density"), "level")
