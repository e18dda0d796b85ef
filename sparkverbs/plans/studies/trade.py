"""Studies on counts and traffic over sales and events: pets, bike, econ, birds, parks, olympics."""

from pyspark.sql import functions as F

from ...functions import text as s
from ...functions.categories import interaction, level_ordinal, relevel
from ...functions.dates import WEEKDAYS, weekday_index, weekday_label
from ...functions.nulls import in_set, mean_of, not_in_set, safe_cast
from ...operators import stats
from ...operators.aggregates import count_by
from ...operators.joins import join_on, literal_lookup, repair
from ...operators.levels import order_from, with_level_order
from ...operators.ordered import number_rows
from ...operators.reshape import longer, pivot_table, union_by_name, wider
from ...operators.windows import share_of, zscore
from ...session import materialise
from ..analysis import axes_sql, on_axes, rounded_axes
from ..registry import query

# Thresholds of the popularity flags.
MOST_POPULAR, POPULAR = 230, 70


@query("study_pets", """
WITH n AS (SELECT p_name, l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE l_returnflag IN ('A', 'R') AND p_name NOT IN ('blue rod', 'red ring') GROUP BY ALL),
w AS (SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
        coalesce(sum(n) FILTER (l_returnflag = 'A'), 0)::BIGINT AS accepted, coalesce(sum(n) FILTER (l_returnflag = 'R'), 0)::BIGINT AS returned FROM n GROUP BY 1),
m AS (SELECT regr_slope(returned, accepted) AS b, regr_intercept(returned, accepted) AS a FROM w)
SELECT name, accepted, returned, round(returned - (a + b * accepted), 6) AS resid, (-sign(returned - (a + b * accepted)))::INT AS sign,
       accepted + returned >= 230 AS most_popular, accepted + returned >= 70 AS popular FROM w, m""")
def study_pets(t):
    lines = t.lineitem.where(F.col("l_returnflag").isin("A", "R")).groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name").where(not_in_set("p_name", ["blue rod", "red ring"]))
    named = lines.join(parts, "l_partkey").withColumn("name", s.title_case("p_name"))
    counts = wider(named, ["name"], "l_returnflag", ["A", "R"], "n", fill=0, aggregate=F.sum)
    fitted = stats.ols_augment(counts.select("name", F.col("A").alias("accepted"), F.col("R").alias("returned")), "returned", "accepted")
    total = F.col("accepted") + F.col("returned")
    return fitted.select("name", "accepted", "returned", F.round("resid", 6).alias("resid"), "sign",
                         (total >= MOST_POPULAR).alias("most_popular"), (total >= POPULAR).alias("popular"))


@query("study_bike", """
WITH g AS (SELECT event_type, strftime(ts, '%a') AS weekday, hour(ts)::INT AS hour, sum(value::DECIMAL(18,2))::DOUBLE AS total
           FROM events WHERE value < 400 AND ts >= TIMESTAMP '2024-01-02' GROUP BY ALL)
SELECT event_type || ' ' || weekday AS label, hour, total, round(100 * total / max(total) OVER (PARTITION BY event_type), 6) AS percentage,
       list_position(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'], weekday)::INT AS weekday_ord FROM g""")
def study_bike(t):
    rows = t.events.where(F.col("value").isNotNull() & (F.col("value") < 400) & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")))
    g = rows.groupBy("event_type", weekday_index("ts").alias("d"), weekday_label("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    out = share_of(g, "total", ["event_type"], "share", total=F.max("total"))
    return out.select(s.paste("event_type", "weekday", sep=" ").alias("label"), "hour", "total",
                      F.round(F.col("share") * 100, 6).alias("percentage"), level_ordinal("weekday", WEEKDAYS).alias("weekday_ord"))


@query("study_econ", """
WITH d AS (SELECT l_returnflag AS flag, l_linestatus AS status, avg(l_discount) * 10 AS discount, 1 - avg(l_discount) * 10 AS rest FROM lineitem GROUP BY ALL),
f AS (SELECT flag, row_number() OVER (ORDER BY avg(discount), flag) AS flag_ord FROM d GROUP BY 1),
n AS (SELECT status, row_number() OVER (ORDER BY avg(discount), CASE WHEN status = 'F' THEN 'Filled lines' ELSE 'Open lines' END) AS status_ord FROM d GROUP BY 1)
SELECT flag, flag_ord, CASE WHEN status = 'F' THEN 'Filled lines' ELSE 'Open lines' END AS status, status_ord, kind, round(v, 6) AS value,
       kind || '.' || CASE WHEN discount < rest THEN 'less' ELSE 'not_less' END AS kind_ratio
FROM (SELECT *, 'discount' AS kind, discount AS v FROM d UNION ALL SELECT *, 'rest', rest FROM d) JOIN f USING (flag) JOIN n USING (status)""")
def study_econ(t):
    means = t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        (F.avg("l_discount") * 10).alias("discount"))
    both = means.withColumn("rest", F.lit(1) - F.col("discount"))
    status = s.replace_all(F.when(F.col("status") == "F", "Filled_lines").otherwise("Open_lines"), "_", " ")
    ratio = F.when(F.col("discount") < F.col("rest"), "less").otherwise("not_less")
    both = materialise(both.withColumn("status", status).withColumn("ratio", ratio))  # one row per flag and status
    long = longer(both, ["discount", "rest"], "kind", "value")
    for level in ("flag", "status"):
        order = order_from(both.groupBy(level).agg(mean_of("discount").alias("m")), level, ["m"], bounded=True)
        long = with_level_order(long, level, order)
    long = long.withColumns({"kind_ratio": interaction("kind", "ratio"), "value": F.round("value", 6)}).drop("ratio")
    return long.withColumns({c: F.col(c).cast("bigint") for c in ("flag_ord", "status_ord")})


@query("study_birds", """
WITH light AS (SELECT o_orderdate AS day, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS score FROM orders GROUP BY 1)
SELECT n_regionkey, array_to_string(list_transform(string_split(n_name, '_'), lambda w: upper(w[1]) || lower(w[2:])), '_') AS nation, s_suppkey,
       count(*) AS n, round(avg(score), 6) AS light
FROM lineitem LEFT JOIN light ON l_shipdate = day JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE year(l_shipdate) >= 2000 GROUP BY ALL""")
def study_birds(t):
    light = t.orders.groupBy(F.col("o_orderdate").alias("day")).agg(
        F.nullif(F.count(F.when(F.col("o_orderstatus") == "F", 1)), F.lit(0)).alias("score"))
    falls = t.lineitem.where(F.year("l_shipdate") >= 2000).groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    seen = join_on(falls, light, ["day"], "left", null_safe=True)
    per_supplier = seen.groupBy("s_suppkey").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("score")), F.sum(F.when(F.col("score").isNotNull(), F.col("n")))).alias("light"))
    taxa = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(t.nation, "n_nationkey")
    return per_supplier.join(taxa, "s_suppkey").select(
        "n_regionkey", s.title_case("n_name").alias("nation"), "s_suppkey", "n", F.round("light", 6).alias("light"))


PARK_YEARS_FROM = 1996
HIGHLIGHTED = ["NATION_3", "NATION_7"]


@query("study_parks", """
WITH v AS (SELECT year(o_orderdate)::INT AS year, n_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS visitors
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           WHERE year(o_orderdate) >= 1996 AND n_nationkey % 5 <> 4 GROUP BY ALL)
SELECT year, upper(n_name) AS park, visitors, row_number() OVER (PARTITION BY year ORDER BY visitors DESC, n_name) AS rank,
       CASE WHEN n_name IN ('NATION_3', 'NATION_7') THEN n_name ELSE 'Other' END AS colour,
       CASE WHEN n_name = 'NATION_7' THEN 1 WHEN n_name = 'NATION_3' THEN 2 ELSE 3 END AS colour_ord FROM v""")
def study_parks(t):
    per_customer = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("string").alias("year")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    rows = per_customer.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(t.nation, "n_nationkey")
    visits = rows.groupBy("year", "n_nationkey", "n_name").agg(F.sum("v").cast("double").alias("visitors"))
    totals = visits.groupBy("n_nationkey", "n_name").agg(F.sum("visitors").alias("visitors")).withColumn("year", F.lit("Total"))
    raw = union_by_name(visits, totals).withColumns({
        "unit_type": F.when(F.pmod("n_nationkey", F.lit(5)) == 4, "Preserve").otherwise("National Park"),
        "unit_name": F.concat("n_name", F.lit(" National Park")),
        "parkname": F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.col("n_name"))})
    named = raw.withColumn("parkname", repair("parkname", F.trim(s.remove_first("unit_name", "National Park"))))
    kept = named.where((F.col("year") != "Total") & (F.col("unit_type") == "National Park")).withColumn("year", safe_cast("year", "int"))
    ranked = number_rows(kept.where(F.col("year") >= PARK_YEARS_FROM), [F.col("visitors").desc_nulls_last(), "parkname"], ["year"], name="rank")
    colour = F.when(in_set("parkname", HIGHLIGHTED), F.col("parkname")).otherwise("Other")
    levels = relevel(["NATION_3", "NATION_7", "Other"], "NATION_7")
    return ranked.select("year", F.upper("parkname").alias("park"), "visitors", "rank", colour.alias("colour"),
                         level_ordinal(colour, levels).alias("colour_ord"))


MEDALS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("study_olympics", """
WITH d AS (SELECT DISTINCT o_orderdate, n_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           WHERE year(o_orderdate) = 1996 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
p AS (SELECT CASE n_nationkey WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Beta' ELSE n_nationkey::VARCHAR END AS country,
        count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE AS gold, count(*) FILTER (o_orderpriority = '2-HIGH')::DOUBLE AS silver,
        count(*) FILTER (o_orderpriority = '3-MEDIUM')::DOUBLE AS bronze FROM d GROUP BY 1)
SELECT country, gold, silver, bronze, round((gold - avg(gold) OVER ()) / stddev_pop(gold) OVER (), 6) AS gold_z FROM p ORDER BY gold DESC, silver DESC, bronze DESC""")
def study_olympics(t):
    days = t.orders.filter("year(o_orderdate) = 1996").select("o_custkey", "o_orderdate", F.when(
        F.col("o_orderpriority").isin(MEDALS), F.col("o_orderpriority")).alias("medal")).dropna(subset=["medal"])
    nations = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("noc"))
    # a day counts once per nation and medal
    once = days.join(nations, "o_custkey").select("o_orderdate", "noc", "medal").dropDuplicates()
    named = once.withColumn("country", literal_lookup("noc", {"0": "Alpha", "1": "Beta"}))
    n = count_by(named, "country", "medal", drop_null=True).withColumn("n", F.col("n").cast("double"))
    table = pivot_table(n, ["country"], "medal", MEDALS, "n", fill=0.0).toDF("country", "gold", "silver", "bronze")
    out = zscore(table, ["gold"], "_z").withColumn("gold_z", F.round("gold_z", 6))
    return out.orderBy(F.col("gold").desc(), F.col("silver").desc(), F.col("bronze").desc())


MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("study_olympics_map", "WITH RECURSIVE t AS (SELECT l.*, string_split(p_name, ' ')[1] AS sport FROM lineitem l JOIN part ON l_partkey = p_partkey),\n"
       + axes_sql(MEASURES, 2).rstrip(",\n") + f"\nSELECT l_orderkey, l_linenumber, sport, {on_axes(MEASURES, 2)} FROM t, s, v1, v2")
def study_olympics_map(t):
    measures = MEASURES
    sports = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), s.split_first("p_name").alias("sport")), "l_partkey")
    rows = sports.dropna(subset=measures).select("l_orderkey", "l_linenumber", "sport", *measures)
    return rounded_axes(stats.principal_axes(rows, measures)).drop(*measures)
