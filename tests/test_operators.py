"""Composite operators against brute force in plain Python, on skewed and shuffled input."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sparkverbs.operators import (aggregates, ballots, colours, cooccurrence, density, frames, graph, joins, ordered, partition,
                                  reshape, rings, stats, windows)
from sparkverbs.functions import geometry


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of the rows, and one value many of them."""
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", i, rng.choice([1, 1, 1, rng.randrange(50)])) for i in range(3000)]
    data += [(None, 3000 + i, i % 3) for i in range(20)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, i int, v int").repartition(5)


def by_key(data):
    groups = defaultdict(list)
    for k, i, v in data:
        groups[k].append((i, v))
    return {k: sorted(g) for k, g in groups.items()}


@pytest.mark.parametrize("bounded", [False, True])
def test_scan_per_group(skewed, bounded):
    data, df = skewed
    out = ordered.ordered_scan(df, ["i"], ["k"], row_number="n", running={"s": "v"}, previous={"p": ("v", -1)}, bounded=bounded)
    got = {r.i: (r.n, r.s, r.p) for r in out.collect()}
    for rows in by_key(data).values():
        total, before = 0, -1
        for n, (i, v) in enumerate(rows, 1):
            total += v
            assert got[i] == (n, total, before)
            before = v


@pytest.mark.parametrize("heads", [0, 10_000])
def test_numbering_with_few_and_with_many_groups(skewed, monkeypatch, heads):
    data, df = skewed
    monkeypatch.setattr(ordered, "MAX_HEADS", heads)
    got = {r.i: r.n for r in ordered.number_rows(df, [F.col("v").desc(), "i"], ["k"], name="n").collect()}
    for rows in by_key(data).values():
        for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
            assert got[i] == n


def test_scan_over_the_whole_table(skewed):
    data, df = skewed
    out = ordered.ordered_scan(df, ["v", "i"], row_number="n", running={"s": "v"})
    got = {r.i: (r.n, r.s) for r in out.collect()}
    total = 0
    for n, (_, i, v) in enumerate(sorted(data, key=lambda r: (r[2], r[1])), 1):
        total += v
        assert got[i] == (n, total)


def test_scan_carries_over_partitions(spark, skewed):
    """The same result however many partitions the sort makes."""
    _, df = skewed
    seen = set()
    for parts in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            out = ordered.ordered_scan(df, ["i"], ["k"], row_number="n", running={"s": "v"}, previous={"p": ("v", None)})
            seen.add(tuple(sorted(map(str, out.collect()))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) == 1


@pytest.mark.parametrize("bottom", [False, True])
def test_top_n_with_hot_key(skewed, bottom):
    data, df = skewed
    got = {r.i for r in windows.top_n(df, 4, "v", ["k"], bottom=bottom).collect()}
    want = set()
    for rows in by_key(data).values():
        for i, v in rows:
            better = sum(1 for _, w in rows if (w < v if bottom else w > v))
            if better < 4:
                want.add(i)
    assert got == want


def test_group_stats_and_shares(skewed):
    data, df = skewed
    groups = by_key(data)
    for r in windows.with_group_stats(df, ["k"], n=F.count(F.lit(1)), top=F.max("v")).collect():
        assert (r.n, r.top) == (len(groups[r.k]), max(v for _, v in groups[r.k]))
    total = windows.share_of(df, "v", ["k"]).groupBy("k").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in total)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-5, 5)), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, data):
    df = spark.createDataFrame(data, "k string, v int")
    got = {r.k: (r.a, r.b) for r in aggregates.exact_quantiles(df, "v", {"a": 0.5, "b": 0.9}, ["k"]).collect()}
    for k in {k for k, _ in data}:
        values = [v for j, v in data if j == k]
        assert got[k] == pytest.approx((np.quantile(values, 0.5), np.quantile(values, 0.9)))


def test_fence(skewed):
    data, df = skewed
    got = {r.i for r in aggregates.within_fence(df, "v", ["k"], 1.0).collect()}
    want = set()
    for rows in by_key(data).values():
        values = [v for _, v in rows]
        m, w = np.median(values), np.quantile(values, 0.75) - np.quantile(values, 0.25)
        want |= {i for i, v in rows if abs(v - m) <= w}
    assert got == want


def test_pairwise_phi(spark):
    rng = random.Random(5)
    sets = {f: {w for w in "abcdef" if rng.random() < 0.4} for f in range(60)}
    rows = [(f, w) for f, ws in sets.items() for w in ws for _ in range(rng.choice([1, 3]))]
    df = spark.createDataFrame(rows, "f int, w string").repartition(4)
    got = {(r.item1, r.item2): (r.n_both, r.correlation) for r in cooccurrence.pairwise_phi(df, "w", "f", complete=True, mirror=True).collect()}
    live = [ws for ws in sets.values() if ws]
    assert len(got) == 30
    for (a, b), (n, phi) in got.items():
        x, y = [a in ws for ws in live], [b in ws for ws in live]
        assert n == sum(i and j for i, j in zip(x, y))
        assert phi == pytest.approx(np.corrcoef(x, y)[0, 1])
        assert got[(b, a)][1] == pytest.approx(phi)


def test_item_in_every_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "f int, w string")
    assert {r.correlation for r in cooccurrence.pairwise_phi(df, "w", "f").collect()} == {None}


def test_distance_and_weighted_matrix(spark):
    rows = [("x", "p", 1.0), ("x", "q", 4.0), ("y", "p", 3.0), ("z", "r", 2.0)]
    df = spark.createDataFrame(rows, "i string, f string, v double")
    got = {(r.item1, r.item2): r.distance for r in cooccurrence.pairwise_distance(df, "i", "f", "v").collect()}
    assert got[("x", "y")] == pytest.approx(math.sqrt(4 + 16))
    assert ("y", "z") not in got and ("x", "z") not in got  # never meet
    every = {(r.item1, r.item2): r.distance for r in cooccurrence.pairwise_distance(df, "i", "f", "v", complete=True).collect()}
    assert every[("x", "z")] == pytest.approx(math.sqrt(1 + 16 + 4)) and len(every) == 3
    sums = {(r.item_a, r.item_b): (r.n_both, r.dot, r.a_with_b, r.b_with_a) for r in cooccurrence.item_products(
        cooccurrence.feature_rows(df, "i", ["f"], "v")).collect()}
    assert sums == {("x", "y"): (1, 3.0, 1.0, 3.0)}


def test_interactions_equal_self_join(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(3), rng.randrange(8), rng.choice("abcd"), rng.randrange(1, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "e int, s int, m string, n int")
    got = {(r.e, r["from"], r["to"]): r.weight for r in graph.interaction_edges(df, ["e"], ["s"], "m", "n").collect()}
    scenes = defaultdict(Counter)
    for e, s, m, n in rows:
        scenes[(e, s)][m] += n
    want = Counter()
    for (e, _), who in scenes.items():
        for a, b in itertools.permutations(who, 2):
            want[(e, a, b)] += who[a]
    assert got == dict(want)


def test_broadcast_messages_reach_present_senders(frame, rows):
    df = frame([(1, "a", 2), (1, "b", 3), (1, "all", 10), (2, "a", 1), (3, "all", 7)], "g int, who string, n int")
    out = graph.attribute_broadcasts(df, ["g"], "who", "n", F.col("who") == "all")
    assert rows(out) == [(1, "a", 12), (1, "b", 13), (2, "a", 1)]


def test_density_matches_direct_sum(spark):
    rng = np.random.default_rng(1)
    pts = [(int(i % 2), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(pts, "g int, x double, y double").repartition(4)
    grid = density.Grid(-3, 3, 7, -2, 2, 5)
    got = {(r.g, r.ix, r.iy): r.density for r in density.kernel_density(df, "x", "y", grid, 1.0, "g").collect()}
    gx, gy = grid.axes()
    for g in (0, 1):
        mine = [(a, b) for k, a, b in pts if k == g]
        for i, j in itertools.product(range(7), range(5)):
            z = sum(math.exp(-0.5 * (((gx[i] - a) / 0.25) ** 2 + ((gy[j] - b) / 0.25) ** 2)) for a, b in mine) / (len(mine) * 2 * math.pi * 0.25 ** 2)
            assert got[(g, i, j)] == pytest.approx(z)
    fine = density.kernel_density(df, "x", "y", density.Grid(-8, 8, 161, -8, 8, 161), 1.0)
    assert fine.agg(F.sum("density")).first()[0] * 0.1 * 0.1 == pytest.approx(1, abs=1e-3)
    assert len(got) == 70


def test_contingency_residuals(spark):
    rows = [("a", "x")] * 5 + [("a", "y")] * 3 + [("b", "y")] * 4
    out = stats.chisq_residuals(spark.createDataFrame(rows, "r string, c string"), "r", "c")
    got = {(r.r, r.c): (r.observed, r.expected, r.residual) for r in out.collect()}
    assert got[("b", "x")][0] == 0
    for o, e, z in got.values():
        assert z == pytest.approx((o - e) / math.sqrt(e))
    assert sum(o - e for o, e, _ in got.values()) == pytest.approx(0)


def test_regression_leaves_out_missing_rows(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (4.0, None)], "x double, y double")
    fit = stats.ols_fit(df, "y", "x").first()
    assert (fit.slope, fit.intercept) == pytest.approx((2, 1))
    assert [r.resid for r in stats.ols_augment(df, "y", "x").orderBy("x").collect()][-1] is None


def test_bands_abut_and_leave_gaps(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 2, 1), ("b", 1, 2), ("c", 1, 5)], "g string, i int, n int")
    for bounded in (False, True):
        rows = windows.bands(df, "n", ["g", "i"], gap_when="g", gap=3, bounded=bounded).orderBy("g", "i").collect()
        assert [(r.start, r.end) for r in rows] == [(0, 4), (4, 5), (8, 10), (13, 18)]


def test_partition_fills_the_square(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(4), rng.randrange(2), float(rng.randrange(1, 20))) for _ in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, c int, v double").withColumns({f"{k}o": F.col(k) for k in "abc"})
    for order in itertools.permutations("abc"):
        out = partition.marimekko(df, [(k, f"{k}o") for k in order], "v").collect()
        assert sum((r.xmax - r.xmin) * (r.ymax - r.ymin) for r in out) == pytest.approx(1)
    for bounded in (False, True):
        widths = {tuple(sorted({(r.a, round(r.min_1, 9), round(r.max_1, 9)) for r in partition.marimekko(df, [(k, f"{k}o") for k in o], "v", bounded).collect()}))
                  for o in ("abc", "acb")}
        assert len(widths) == 1


def count_ballots(votes):
    """Instant-runoff by hand: rankings per round."""
    papers = defaultdict(list)
    for ballot, rank, who in votes:
        papers[ballot].append((rank, who))
    out, removed = [], []
    while True:
        total = Counter()
        for paper in papers.values():
            left = sorted(p for p in paper if p[1] not in removed)
            total.update(w for r, w in left if r == left[0][0])
        board = sorted(total.items(), key=lambda t: (-t[1], t[0]))
        out.append(board + [(w, 0) for w in reversed(removed)])
        if len(board) < 2 or (len(out) > 1 and board[0][1] * 2 > sum(total.values())):
            return out
        removed.append(board[-1][0])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.permutations(list("abcde")).map(lambda p: p[:4]), min_size=1, max_size=15), st.integers(0, 3))
def test_runoff_matches_counting_by_hand(spark, papers, cut):
    votes = [(i, rank, who) for i, p in enumerate(papers) for rank, who in enumerate(p[: 4 - cut] if i % 2 else p, 1)]
    got = defaultdict(list)
    for r in ballots.instant_runoff(spark.createDataFrame(votes, "id int, rank int, who string"), "id", "rank", "who").orderBy("round", "position").collect():
        got[r.round].append((r.candidate, r.total))
    assert list(got.values()) == count_ballots(votes)
    live = [sum(n for _, n in board) for board in got.values()]
    assert live == sorted(live, reverse=True)


def test_runoff_counts_all_candidates_on_a_shared_rank(spark):
    votes = [(1, 1, "a"), (1, 1, "b"), (2, 1, "b"), (3, 1, "c"), (3, 2, "a")]
    first = ballots.instant_runoff(spark.createDataFrame(votes, "id int, rank int, who string"), "id", "rank", "who").where("round = 0")
    assert {(r.candidate, r.total) for r in first.collect()} == {("a", 1), ("b", 2), ("c", 1)}


def test_tween_starts_at_the_source_and_closes(spark):
    df = spark.createDataFrame([(c, s, float(c * 10 + s)) for c in (1, 2) for s in (5, 6, 7)], "cell int, step int, v double")
    rows = frames.tween(df, ["cell"], "step", ["v"], 20).collect()
    assert len(rows) == 2 * (2 * 20 + 1)
    at = {(r.cell, r.frame): (r.step, r.v) for r in rows}
    assert at[(1, 0)] == (5.0, 15.0) and at[(1, 20)] == (6.0, 16.0) and at[(2, 40)] == (7.0, 27.0)
    assert at[(1, 10)] == pytest.approx((5.5, 15.5))


def test_frame_hold(spark):
    rows = frames.hold(spark.range(40).withColumnRenamed("id", "f"), "f", 20, 3)
    assert rows.count() == 38 + 2 * 3


def test_centroid_of_a_square(spark):
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0)])], "id int, seq int, x double, y double")
    r = rings.centroid(df, ["id"]).first()
    assert (r.area, r.cx, r.cy) == pytest.approx((8, 1, 2))


def test_pivot_and_back(frame, rows):
    df = frame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, n string, v int")
    wide = reshape.wider(df, ["k"], "n", ["x", "y"], "v", fill=0)
    assert rows(reshape.longer(wide, ["x", "y"], "n", "v").where("v > 0")) == rows(df)


def test_expansion_by_period(frame, rows):
    df = frame([("a", 1), ("b", 3), ("c", None), ("d", 0)], "k string, y int")
    assert rows(joins.expand_until(df, "y", 1, 3).select("k", "until")) == [("a", 1), ("a", 2), ("a", 3), ("b", 3)]


def test_zip_fills_the_shorter_side(frame, rows):
    a, b = frame([(1,), (2,)], "a int"), frame([(7,)], "b int")
    assert rows(ordered.zip_rows(a, ["a"], b, ["b"])) == [(1, 7), (2, None)]


def test_colour_round_trip_and_mean(spark):
    hexes = ["#000000", "#ffffff", "#808080", "#ff0000", "#00ff00", "#0000ff", "#12ab9f", "#fe0102"]
    df = spark.createDataFrame([(h,) for h in hexes], "hex string")
    rows = colours.with_space(colours.with_space(colours.with_rgb(df, "hex"), "hls"), "lab")
    for space in ("hls", "lab"):
        out = colours.with_hex(rows, space, "back").select("hex", "back").collect()
        assert all(r.hex == r.back for r in out)
    reds = spark.createDataFrame([("#ff0011",), ("#ff1100",)], "hex string")
    near_red = colours.average_colour(reds, "hex", [], circular_hue=True).first()[0]
    assert near_red.startswith("#ff0") and near_red.endswith("00")
    assert colours.average_colour(reds, "hex", []).first()[0].startswith("#00")


def test_labels_are_upright(spark):
    pts = [(math.cos(a), math.sin(a)) for a in np.linspace(0.01, 6.2, 50)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")
    assert all(-90 < r[0] <= 90 for r in df.select(geometry.upright_angle("x", "y")).collect())


def test_vertical_links(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geometry.link_ends("a", "b", "c", "d", F.lit(0.1), F.lit(0.2))).collect()]
    assert sorted(g.direction for g in got) == [-1, -1, 1]
    up = next(g for g in got if g.direction == 1)
    assert (up.x_from, up.y_from, up.x_to, up.y_to) == pytest.approx((-0.05, 0.16, -0.05, 0.74))


def test_aggregate_of_the_user_with_hot_and_null_keys(skewed):
    from sparkverbs.operators.custom import aggregate_groups

    data, df = skewed
    out = aggregate_groups(df, ["k"], lambda v: float(v.sum()), lambda v: float(v.sum()), "v", "double", "total")
    assert {r.k: r.total for r in out.collect()} == {k: sum(v for _, v in g) for k, g in by_key(data).items()}


def test_no_items_give_no_pairs(spark):
    df = spark.createDataFrame([("x", "p", 1.0)], "i string, f string, v double")
    assert cooccurrence.pairwise_phi(df, "i", "f", []).count() == 0
    assert cooccurrence.pairwise_distance(df.where("v > 5"), "i", "f", "v").count() == 0


def test_tween_spans_gaps_in_the_steps(frame):
    from sparkverbs.operators.frames import tween

    df = frame([("a", 1, 0.0), ("a", 2, 1.0), ("a", 4, 5.0), ("a", 5, 5.0)], "c string, s int, v double")
    got = sorted(tuple(r) for r in tween(df, ["c"], "s", ["v"], 2).collect())
    assert [(r[1], r[2], r[3]) for r in got] == [(0, 1.0, 0.0), (1, 1.5, 0.5), (2, 2.0, 1.0), (3, 2.5, 2.0), (4, 3.0, 3.0), (5, 3.5, 4.0),
                                                 (6, 4.0, 5.0), (7, 4.5, 5.0), (8, 5.0, 5.0)]


def test_density_keeps_the_null_group_and_runs_the_kernel_once(frame):
    from sparkverbs.operators.density import Grid, kernel_density

    df = frame([(None, 0.0, 0.0), (None, 1.0, 1.0), ("a", 0.0, 0.0)], "g string, x double, y double")
    out = kernel_density(df, "x", "y", Grid(0, 1, 3, 0, 1, 3), 1.0, "g")
    assert out.where("g is null").count() == 9 and out.count() == 18
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_csv_keeps_line_breaks_and_blanks(frame, tmp_path):
    from sparkverbs.sources.delimited import read_csv, write_csv

    rows = [(1, 'two\nlines, "quoted"\r\nend'), (2, "  blanks  "), (3, "back\\slash\\n"), (4, None)]
    write_csv(frame(rows, "i int, t string"), f"{tmp_path}/out")
    back = read_csv(frame(rows, "i int, t string").sparkSession, f"{tmp_path}/out", "i int, t string")
    assert sorted(map(tuple, back.collect())) == rows


def test_functions_reach_executors_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from sparkverbs.session import local_session, ship\nfrom sparkverbs.plans import all_queries\n"
            "spark = local_session(2); ship(spark)\n"
            "print('rows', all_queries()['udf_aggregate'](spark, '/root/testdata/sf0.001').count())\nspark.stop()")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
