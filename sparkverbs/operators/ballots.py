"""Instant-runoff counts.

Equal ballots are merged first, so every round scans distinct preference lists with a weight. A round writes one small table of
counts straight from that table, and only the loser, the largest count and their sum come to the driver, because the next round
depends on them; the ranking of all rounds is put together from the tables. From time to time the ballots are written
anew without the removed candidates, so neither plans nor lists of removed candidates grow with the rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..session import materialise

#: Rounds after which removed candidates are taken out of the ballots.
REWRITE = 50


def preference_lists(votes: DataFrame, ballot: str, rank: str, candidate: str) -> DataFrame:
    """Distinct ballots (array of rank and candidate, in rank order) with the number of times each was cast.

    A ballot is short (one entry per rank), so collecting it is bounded by the ballot paper.
    """
    entry = F.struct(F.col(rank).alias("rank"), F.col(candidate).alias("candidate"))
    papers = votes.na.drop(subset=[ballot, rank, candidate]).groupBy(ballot).agg(F.array_sort(F.collect_list(entry)).alias("prefs"))
    return papers.groupBy("prefs").agg(F.count(F.lit(1)).alias("weight"))


def _first_choices(papers: DataFrame, removed: list[str]) -> DataFrame:
    left = F.filter("prefs", lambda p: ~p["candidate"].isin(removed)) if removed else F.col("prefs")
    live = papers.select("weight", left.alias("left")).where(F.size("left") > 0)
    # every candidate that shares the best remaining rank of a ballot counts
    best = F.filter("left", lambda p: p["rank"] == F.col("left")[0]["rank"])
    return live.select("weight", F.explode(best).alias("p")).groupBy(F.col("p.candidate").alias("candidate")).agg(
        F.sum("weight").alias("total"))


def instant_runoff(votes: DataFrame, ballot: str, rank: str, candidate: str) -> DataFrame:
    """Ranking of every round until a candidate holds more than half of the live ballots.

    Round 0 is the first count. Candidates are ordered by total, then by name. The last one with votes is removed; it
    stays in the ranking with total 0 behind the others, latest removal first. The majority is looked for after each
    removal, so there is at least one. Share is the total over all live ballots of the round.
    Columns: round, position, candidate, total, share.
    """
    spark = votes.sparkSession
    papers = materialise(preference_lists(votes, ballot, rank, candidate))
    counts, gone, open_, number = [], [], [], 0
    while True:
        seen = Observation()  # what the next round depends on comes with the job that writes the counts
        last = F.max(F.struct((-F.col("total")).alias("t"), "candidate"))
        now = materialise(_first_choices(papers, open_).observe(
            seen, last.alias("last"), F.sum("total").alias("alive"), F.max("total").alias("best"), F.count(F.lit(1)).alias("n")))
        got = seen.get
        loser, alive, best, n = got["last"] and got["last"]["candidate"], got["alive"], got["best"], got["n"]
        counts.append(now.select(F.lit(number).alias("round"), "candidate", "total", F.lit(alive).cast("bigint").alias("__alive")))
        if n < 2 or (number > 0 and best * 2 > alive):
            break
        gone.append((loser, number + 1))
        open_.append(loser)
        number += 1
        if len(open_) == REWRITE:
            left = F.filter("prefs", lambda p: ~p["candidate"].isin(open_))
            papers = materialise(papers.select(left.alias("prefs"), "weight").where(F.size("prefs") > 0).groupBy("prefs").agg(F.sum("weight").alias("weight")))
            open_ = []
    # candidates left in each round, then those removed so far, latest removal first
    live = reduce(DataFrame.unionAll, counts)
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.col("total").desc(), "candidate"))
    out = live.select("round", place.alias("position"), "candidate", F.col("total").cast("bigint").alias("total"), (F.col("total") / F.col("__alive")).alias("share"))
    if gone:
        sizes = live.groupBy("round").agg(F.count(F.lit(1)).alias("__n"))
        out_of = spark.createDataFrame(gone, "candidate string, __since int").withColumn("round", F.explode(F.sequence("__since", F.lit(number))))
        behind = out_of.join(sizes, "round").select("round", (F.col("__n") + F.col("round") - F.col("__since") + 1).cast("int").alias("position"), "candidate",
                                                   F.lit(0).cast("bigint").alias("total"), F.lit(0.0).alias("share"))
        out = out.unionByName(behind)
    return out


def transfers(rounds: DataFrame) -> DataFrame:
    """Votes won or lost by each candidate between consecutive rounds, for candidates in both rankings."""
    before = rounds.select((F.col("round") + 1).alias("round"), "candidate", F.col("total").alias("__old"))
    return rounds.join(before, ["round", "candidate"]).select(
        "round", "candidate", (F.col("total") - F.col("__old")).alias("gained"))


def votes_from_counts(df: DataFrame, ballot: str, candidate: str) -> DataFrame:
    """Ballots from behaviour: a voter ranks the candidates by how often they occur, ties by name."""
    counts = df.groupBy(ballot, candidate).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(ballot).orderBy(F.col("n").desc(), F.col(candidate))
    return counts.select(ballot, candidate, F.row_number().over(w).alias("rank"))
