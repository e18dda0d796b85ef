"""Studies on people and prizes: tennis, anime, nobel, school, pizza."""

from pyspark.sql import functions as F

from ...functions.categories import level_ordinal, recode, relevel
from ...functions.nulls import any_present, case_when, in_set, not_in_set, same_text, safe_cast
from ...functions.numeric import sqrt_scale
from ...operators.aggregates import count_by, exact_quantiles
from ...operators.graph import adjacency
from ...operators.joins import expand_until, join_on, natural_join, rows_in
from ...operators.levels import order_from, with_level_order
from ...operators.ordered import number_rows
from ...operators.project import clean_names
from ...operators.reshape import fill_sequence, wider_multi
from ...operators.rings import segments
from ...operators.windows import first_rows, top_n
from ...session import materialise, remove_at_exit, scratch_path
from ...sources.delimited import read_csv, write_csv
from ..registry import query


@query("study_tennis", """
WITH n AS (SELECT c_custkey, c_mktsegment, count(*) AS wins FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE o_orderstatus = 'F' AND c_acctbal > 0 GROUP BY ALL),
top AS (SELECT c_custkey FROM n QUALIFY rank() OVER (PARTITION BY c_mktsegment ORDER BY wins DESC) <= 4),
o AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (SELECT c_custkey FROM top)),
e AS (SELECT o_custkey AS "from", o_orderpriority AS "to", count(*) AS n FROM o WHERE o_orderstatus = 'F' GROUP BY ALL UNION ALL
      SELECT o_custkey, year(o_orderdate)::VARCHAR, count(*) FROM o WHERE o_orderstatus = 'F' GROUP BY ALL UNION ALL
      SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'Champion' ELSE 'Finalist' END, count(*) FROM o GROUP BY ALL)
SELECT *, CASE WHEN "to" = '1996' THEN 'a' WHEN "to" = 'Champion' THEN 'b' WHEN regexp_matches("to", '^[1-5]-') THEN 'c' ELSE 'd' END AS colour FROM e""")
def study_tennis(t):
    outcome = case_when((F.col("o_orderstatus") == "F", "Champion"), (F.col("o_orderstatus") == "P", "Finalist"))
    games = t.orders.select("o_custkey", "o_orderpriority", outcome.alias("outcome"), F.year("o_orderdate").alias("year")).where("outcome is not null")
    players = t.customer.where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    won = F.col("outcome") == "Champion"
    wins = join_on(count_by(games.where(won), "o_custkey", name="wins"), players, [("o_custkey", "c_custkey")], "left").where("c_mktsegment is not null")
    best = top_n(materialise(wins), 4, "wins", ["c_mktsegment"])
    mine = rows_in(games, "o_custkey", best)
    # places and years count for champions only, so they are missing on the other rows
    shown = mine.select("o_custkey", *[F.when(won, F.col(c)).alias(c) for c in ("o_orderpriority", "year")], "outcome")
    edges = adjacency(shown, "o_custkey", ["o_orderpriority", "year", "outcome"]).where("to is not null")
    colour = case_when((same_text("to", 1996), "a"), (same_text("to", "Champion"), "b"), (F.col("to").rlike("^[1-5]-"), "c"), default="d")
    return edges.select("from", "to", "n", colour.alias("colour"))


@query("study_anime", """
WITH o AS (SELECT * FROM orders WHERE NOT o_orderstatus = 'P'
           QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1),
r AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'top' WHEN '2-HIGH' THEN 'top' ELSE o_orderpriority END AS rating, year(o_orderdate) AS year, o_totalprice FROM o)
SELECT until::INT AS until, rating, list_position(['5-LOW', 'top', '3-MEDIUM', '4-NOT SPECIFIED'], rating)::INT AS rating_ord, count(*) AS n, round(median(o_totalprice), 6) AS median
FROM r, range(1996, 2002) AS u(until) WHERE year >= 1996 AND year <= until GROUP BY ALL""")
def study_anime(t):
    shows = first_rows(t.orders.where(not_in_set("o_orderstatus", ["P"])), ["o_custkey", "o_orderdate"], ["o_orderkey"])
    rating = recode("o_orderpriority", {"1-URGENT": "top", "2-HIGH": "top"})
    merged = materialise(shows.groupBy(rating.alias("rating"), F.year("o_orderdate").alias("year"), "o_totalprice").agg(F.count(F.lit(1)).alias("copies")))
    grown = expand_until(merged, "year", 1996, 2001)
    medians = exact_quantiles(grown, "o_totalprice", {"median": 0.5}, ["until", "rating"], weight="copies")
    sizes = count_by(grown, "until", "rating", weight="copies")
    levels = relevel(["top", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "5-LOW")
    return medians.join(sizes, ["until", "rating"]).select(
        "until", "rating", level_ordinal("rating", levels).alias("rating_ord"), "n", F.round("median", 6).alias("median"))


@query("study_nobel", """
WITH d AS (SELECT DISTINCT o_orderpriority AS category, o_orderkey, (year(l_shipdate) - year(o_orderdate))::INT AS years
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT category, avg(years) AS mean_years, max(years) AS hi, min(years) AS lo FROM d GROUP BY 1),
o AS (SELECT category, row_number() OVER (ORDER BY mean_years, category) AS category_ord FROM m)
SELECT category, o_orderkey, years, round(mean_years, 6) AS mean_years, hi AS longest, lo AS shortest, category_ord
FROM d JOIN m USING (category) JOIN o USING (category) WHERE years <> hi AND years <> lo""")
def study_nobel(t):
    """Rows between the extremes of their category; categories are ordered by their mean."""
    shipped = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("ship_year")).distinct()
    prizes = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("category"), F.year("o_orderdate").alias("year"))
    d = shipped.join(prizes, "o_orderkey").select("category", "o_orderkey", (F.col("ship_year") - F.col("year")).alias("years")).distinct()
    d = materialise(d)
    means = d.groupBy("category").agg(F.avg("years").alias("mean_years"), F.max("years").alias("longest"), F.min("years").alias("shortest"))
    ordered = with_level_order(means, "category", order_from(means, "category", ["mean_years"], bounded=True))
    rest = join_on(d, ordered, ["category"]).where((F.col("years") != F.col("longest")) & (F.col("years") != F.col("shortest")))
    return rest.withColumn("mean_years", F.round("mean_years", 6)).withColumn("category_ord", F.col("category_ord").cast("bigint"))


@query("study_school", """
WITH y AS (SELECT o_custkey AS id, year(o_orderdate) AS y, count(*) AS total, avg(o_totalprice) AS m FROM orders WHERE year(o_orderdate) IN (1995, 2000) GROUP BY ALL),
c AS (SELECT *, CASE WHEN m >= 300000 THEN 1 WHEN m >= 200000 THEN 0 ELSE -1 END AS diverse FROM y),
w AS (SELECT id, max(diverse) FILTER (y = 1995) AS diverse_1995, max(total) FILTER (y = 1995) AS total_1995,
        max(diverse) FILTER (y = 2000) AS diverse_2000, max(total) FILTER (y = 2000) AS total_2000 FROM c GROUP BY 1 HAVING count(*) = 2),
t AS (SELECT greatest(max(total_1995), max(total_2000)) AS top FROM w)
SELECT id, diverse_1995::INT AS diverse_1995, total_1995, diverse_2000::INT AS diverse_2000, total_2000,
       floor(1 + 19 * sqrt(total_1995) / sqrt(top))::BIGINT AS source_radius, floor(1 + 19 * sqrt(total_2000) / sqrt(top))::BIGINT AS target_radius,
       (diverse_1995 + 1)::INT AS source_class, (diverse_2000 + 1)::INT AS target_class FROM w, t""")
def study_school(t):
    yearly = t.orders.groupBy(F.col("o_custkey").alias("LEAID"), F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("Total"), F.avg("o_totalprice").alias("m"))
    level = F.when(F.col("m") >= 300000, "Diverse").when(F.col("m") >= 200000, "Undiverse").otherwise("Extremely undiverse")
    raw = clean_names(yearly.select("LEAID", "Total", F.concat("y", F.lit("-"), F.col("y") + 1).alias("School Year"), level.alias("Diverse")))
    codes = {"Diverse": "1", "Undiverse": "0", "Extremely undiverse": "-1"}
    rows = raw.select(F.col("leaid").alias("id"), "total", F.substring("school_year", 1, 4).alias("year"), safe_cast(recode("diverse", codes), "int").alias("diverse"))
    wide = wider_multi(rows.where(in_set("year", ["1995", "2000"])), ["id"], "year", ["1995", "2000"], ["diverse", "total"]).na.drop()
    path = remove_at_exit(t.spark, scratch_path(t.spark, "csv"))
    write_csv(wide, path)
    read = read_csv(t.spark, path, wide.schema)
    top = read.agg(F.greatest(F.max("total_1995"), F.max("total_2000"))).scalar()

    def side(year, name):
        radius = F.floor(sqrt_scale(f"total_{year}", (0, F.col("top")), (1, 20)))
        return read.withColumn("top", top).select("id", radius.alias(f"{name}_radius"), (F.col(f"diverse_{year}") + 1).alias(f"{name}_class"))

    return natural_join(natural_join(read, side(1995, "source")), side(2000, "target"))


@query("study_pizza", """
WITH e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT + 1 AS day, hour(ts)::DOUBLE AS longitude, value AS latitude, ts, event_id FROM events WHERE event_type <> 'error'),
f AS (SELECT user_id, day, longitude, latitude FROM e QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1),
s AS (SELECT *, lag(longitude) OVER w AS x_from, lag(latitude) OVER w AS y_from FROM f WINDOW w AS (PARTITION BY user_id ORDER BY day)),
d AS (SELECT user_id, unnest(range(1, max(day) + 1))::INT AS day FROM f GROUP BY 1)
SELECT d.user_id, d.day, longitude, latitude, x_from, y_from, row_number() OVER (PARTITION BY d.user_id ORDER BY d.day) AS no
FROM d LEFT JOIN s ON d.user_id = s.user_id AND d.day = s.day WHERE longitude IS NOT NULL OR x_from IS NOT NULL""")
def study_pizza(t):
    reviews = t.events.where("event_type <> 'error'").select(
        "user_id", (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("day"),
        F.hour("ts").cast("double").alias("longitude"), F.col("value").alias("latitude"), "ts", "event_id")
    visits = first_rows(reviews, ["user_id", "day"], ["ts", "event_id"]).drop("ts", "event_id").na.drop()
    route = segments(visits, ["day"], "longitude", "latitude", ["user_id"])
    days = fill_sequence(route, ["user_id"], "day", F.lit(1), F.max("day"))
    shown = days.where(any_present("longitude", "x_from"))
    return number_rows(shown, ["day"], ["user_id"], name="no")
