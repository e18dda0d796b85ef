"""Study on an instant-runoff vote."""

from pyspark.sql import functions as F

from ...functions.nulls import safe_cast
from ...functions.numeric import at_least
from ...functions.text import extract_first, title_case
from ...operators import ballots, frames
from ...operators.ordered import chunk_rows
from ...operators.windows import bands
from ...session import materialise
from ..analysis import IRV_SQL
from ..joining import EVENT_TYPES
from ..registry import query


def _ballot_file(t):
    """One row per voter and place, five in a row, with the place as text and empty places left null."""
    votes = ballots.votes_from_counts(t.events, "user_id", "event_type")
    places = votes.select("user_id").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(len(EVENT_TYPES)))))
    return places.join(votes, ["user_id", "rank"], "left").select(
        "user_id", "rank", F.concat(F.lit("vote_"), "rank").alias("vote_rank"), F.col("event_type").alias("bird_breed"))


@query("study_nzbird", IRV_SQL + """,
x AS (SELECT a.round, a.position, a.candidate, a.total, coalesce(greatest(a.total - b.total, 0), 0) AS gained
      FROM rounds a LEFT JOIN rounds b ON a.round = b.round + 1 AND a.candidate = b.candidate),
o AS (SELECT candidate, position AS final FROM rounds WHERE round = (SELECT max(round) FROM rounds)),
y AS (SELECT x.*, (sum(gained) OVER (PARTITION BY round ORDER BY final) - gained)::BIGINT AS start FROM x JOIN o USING (candidate))
SELECT round, position, upper(candidate[1]) || candidate[2:] AS bird, total, gained, start, (round * 5 + f)::INT AS frame FROM y, range(5) r(f)""")
def study_nzbird(t):
    rows = chunk_rows(_ballot_file(t), len(EVENT_TYPES), ["user_id", "rank"], "id")
    votes = rows.select("id", safe_cast(extract_first("vote_rank", r"\d"), "int").alias("rank"), title_case("bird_breed").alias("bird")).na.drop()
    rounds = ballots.instant_runoff(votes, "id", "rank", "bird")
    moves = ballots.transfers(rounds).withColumn("gained", at_least("gained", 0))
    board = materialise(rounds.join(moves, ["round", "candidate"], "left").withColumn("gained", F.coalesce("gained", F.lit(0))))
    last = board.agg(F.max("round")).scalar()
    final = board.where(F.col("round") == last).select("candidate", F.col("position").alias("final"))
    # what goes to each candidate is drawn one behind the other, in the order of the final ranking
    board = bands(board.join(final, "candidate"), "gained", ["final"], ["round"], bounded=True)
    first = F.col("round") * 5
    return frames.schedule(board, "round", F.sequence(first, first + 4)).select(
        "round", "position", F.col("candidate").alias("bird"), "total", "gained", "start", "frame")
