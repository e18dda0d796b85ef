"""Operators that split what one task could not hold: records over byte ranges, pairs in tiles, folds, narrowing, trees."""

import csv
import io
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkverbs.operators import aggregates, cooccurrence, density, graph, reshape, rings, stats
from sparkverbs.operators.custom import fold_groups
from sparkverbs.sources.delimited import read_csv
from sparkverbs.sources.records import ends_inside

# ------------------------------------------------------------------ records


def parsed(text, sep=","):
    return [tuple(None if v in ("", "NA") else v for v in row) for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if row]


def quoted(rows, sep=","):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator="\n").writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few bytes, so that they begin and end anywhere, inside quotes as well."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", 0)]
    for k, v in before.items():
        spark.conf.set(k, v)


def some_rows(rng, n):
    pieces = ["plain", "two\nlines", 'a "quoted" word', '""', '"', "\n\n", "x,y", "crlf\r\nend", "", "NA", " blanks ", "\n\"\n\"\n", "long " * 30]
    return [(str(i), rng.choice(pieces) + rng.choice(pieces), rng.choice(pieces)) for i in range(n)]


@pytest.mark.parametrize("size", [30, 200, 1000])
def test_records_over_any_ranges(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    want = []
    (tmp_path / "d").mkdir()
    for f in range(3):
        text = quoted([("id", "one", "two\nof header"), *some_rows(rng, 25)])
        (tmp_path / "d" / f"{f}.csv").write_text(text if f else text.rstrip("\n"), newline="")
        want += parsed(text)[1:]
    small_ranges(size)
    df = read_csv(spark, f"{tmp_path}/d", "id string, one string, two string")
    assert spark.read.text(f"{tmp_path}/d", lineSep="\n").rdd.getNumPartitions() > 1
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))


def test_a_value_over_many_ranges_and_stray_quotes(spark, tmp_path, small_ranges):
    text = 'a,b\n1,"' + "x\n" * 200 + '"\n2,5" pipe\n3,"y"\n4,say "no"\n'
    (tmp_path / "f.csv").write_text(text)
    small_ranges(16)
    got = sorted(map(tuple, read_csv(spark, f"{tmp_path}/f.csv", "a int, b string").collect()))
    assert got == [(1, "x\n" * 200), (2, '5" pipe'), (3, "y"), (4, 'say "no"')]


def test_types_follow_from_all_values(spark, tmp_path):
    (tmp_path / "f.csv").write_text("i,l,d,day,t,n,flag\n1,1,1,2024-01-02,x,NA,true\n2,9999999999,1.5,2024-01-03,\"y\nz\",NA,false\n")
    df = read_csv(spark, f"{tmp_path}/f.csv")
    assert [k for _, k in df.dtypes] == ["int", "bigint", "double", "date", "string", "string", "boolean"]
    assert df.where("i = 2").first().t == "y\nz"
    (tmp_path / "g.csv").write_text("a;b\n1;2\n")
    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/g.csv", header=False, sep=";", column_names=["p", "q"]).collect()] == [("a", "b"), ("1", "2")]


def test_line_ends(spark):
    cases = ['a,b', '"a",b', '"a', 'a"b', 'a,"b""', 'a,"b"""', '"', '""', '"""', 'x",y', 'b",c,"d', 'a""b', '"a","b']
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [tuple(r) for r in df.select(ends_inside(F.col("t"), ",", False), ends_inside(F.col("t"), ",", True)).collect()]

    def after(text, inside):
        state = "Q" if inside else "S"
        for c in text:
            if state == "S":
                state = "Q" if c == '"' else "S" if c == "," else "U"
            elif state == "U":
                state = "S" if c == "," else "U"
            elif state == "Q":
                state = "E" if c == '"' else "Q"
            else:
                state = "Q" if c == '"' else "S" if c == "," else "U"
        return state == "Q"

    assert got == [(after(c, False), after(c, True)) for c in cases]


# ------------------------------------------------------------------ levels


def test_unlisted_levels_stop_the_query(frame, rows):
    df = frame([("a", "x", 1), ("a", "y", 2), ("b", "z", 3)], "k string, n string, v int")
    for build in (reshape.wider(df, ["k"], "n", ["x", "y"], "v"), reshape.wider_multi(df, ["k"], "n", ["x", "y"], ["v"]),
                  reshape.pivot_table(df, ["k"], "n", ["x", "y"], "v")):
        with pytest.raises(PySparkException, match="not listed: z"):
            build.collect()
    assert rows(reshape.wider(df, ["k"], "n", ["x", "y"], "v", others="drop")) == [("a", 1, 2)]
    assert rows(reshape.wider(df, ["k"], "n", None, "v")) == [("a", 1, 2, None), ("b", None, None, 3)]
    assert reshape.wider_multi(df.withColumn("w", F.col("v") * 2), ["k"], "n", None, ["v", "w"]).columns == ["k", "v_x", "w_x", "v_y", "w_y", "v_z", "w_z"]


def test_contingency_with_levels_of_the_data(spark):
    rng = random.Random(2)
    data = [(f"r{rng.randrange(30)}", rng.randrange(40)) for _ in range(500)] + [(None, 1), ("r1", None)]
    out = stats.chisq_residuals(spark.createDataFrame(data, "r string, c int"), "r", "c")
    got = {(r.r, r.c): (r.observed, r.expected) for r in out.collect()}
    known = [d for d in data if None not in d]
    assert len(got) == len({r for r, _ in known}) * len({c for _, c in known})
    for (r, c), (n, e) in got.items():
        assert n == known.count((r, c))
        assert e == pytest.approx(sum(a == r for a, _ in known) * sum(b == c for _, b in known) / len(known))


# ------------------------------------------------------------------ pairs


@pytest.mark.parametrize("dense, tile", [(1024, 1 << 20), (0, 50)])
def test_pairs_of_many_items(spark, monkeypatch, dense, tile):
    rng = random.Random(3)
    monkeypatch.setattr(cooccurrence, "DENSE", dense)
    monkeypatch.setattr(cooccurrence, "TILE", tile)
    data = [(f, rng.choice("pq"), f"i{rng.randrange(60)}", float(rng.randrange(5))) for f in range(150) for _ in range(rng.randrange(12))]
    df = spark.createDataFrame(data, "f int, g string, i string, v double").repartition(3)
    for keys in ([], ["g"]):
        got = {tuple(r[:len(keys) + 2]): tuple(r[len(keys) + 2:]) for r in cooccurrence.item_products(cooccurrence.feature_rows(df, "i", [*keys, "f"], "v"), keys).collect()}
        sums = {}
        for f, g, i, v in data:
            cell = sums.setdefault((g if keys else None, f), {})
            cell[i] = cell.get(i, 0) + v
        want = {}
        for (g, _), cell in sums.items():
            for a, b in itertools.combinations(sorted(cell), 2):
                old = want.get((*([g] if keys else []), a, b), (0, 0, 0, 0))
                want[(*([g] if keys else []), a, b)] = (old[0] + 1, old[1] + cell[a] * cell[b], old[2] + cell[a], old[3] + cell[b])
        assert got == want


def test_fifty_thousand_items(spark):
    df = spark.range(100_000).select((F.col("id") / 4).cast("int").alias("f"), F.pmod(F.col("id") * 7919, F.lit(50_000)).alias("i"))
    out = cooccurrence.pairwise_phi(df, "i", "f")
    n, least = out.agg(F.count(F.lit(1)), F.min("correlation")).first()
    assert n == 75_000 and least > 0  # every pair meets twice


# ------------------------------------------------------------------ quantiles


@pytest.mark.parametrize("few", [20_000, 10])
def test_quantiles_by_narrowing(spark, monkeypatch, few):
    monkeypatch.setattr(aggregates, "FEW", few)
    monkeypatch.setattr(aggregates, "BUCKETS", 16)
    rng = np.random.default_rng(4)
    groups = {"hot": np.concatenate((rng.normal(size=3000), [1e300, -1e300])), "ties": np.repeat([1.0, 2.0, 3.0], [500, 3, 400]), "one": np.array([7.0]),
              "wide": 10.0 ** rng.uniform(-9, 9, 400), "ints": rng.integers(-50, 50, 300).astype(float)}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), (None, 5.0), (None, 6.0)]
    rng.shuffle(data)
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double").repartition(4)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.k: tuple(r[1:]) for r in aggregates.exact_quantiles(df, "v", probs, ["k"]).collect()}
    assert set(got) == {*groups, None} and got[None] == pytest.approx((5.0, 5.25, 5.5, 5.9, 6.0))
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, list(probs.values())))
    whole = aggregates.exact_quantiles(df, "v", probs).first()
    assert tuple(whole) == pytest.approx(np.quantile([v for _, v in data if v is not None], list(probs.values())))
    assert aggregates.exact_quantiles(df.where("v > 1e301"), "v", probs).count() == 0


def test_quantiles_with_infinite_values(spark):
    df = spark.createDataFrame([(float(v),) for v in ("-inf", "1", "2", "inf", "nan")], "v double")
    low, middle, high = aggregates.exact_quantiles(df, "v", {"a": 0.0, "b": 0.5, "c": 0.75}).first()
    assert (low, middle, high) == (-math.inf, 2.0, math.inf)


# ------------------------------------------------------------------ folds


def test_fold_over_a_group_in_many_partitions(spark):
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
                               F.xxhash64("id").alias("o"), (F.col("id") % 1000).alias("v"))

    def step(state, rows):
        own = (int(rows["v"].iloc[0]), int(rows["v"].iloc[-1]), len(rows), int(rows["v"].diff().abs().fillna(0).sum()))
        return own if state is None else merge(state, own)

    def merge(a, b):
        return a[0], b[1], a[2] + b[2], a[3] + b[3] + abs(b[0] - a[1])

    out = fold_groups(df, ["k"], ["o"], step, merge, lambda s: {"first": s[0], "n": s[2], "way": s[3]}, "first bigint, n bigint, way bigint")
    got = {r.k: (r.first, r.n, r.way) for r in out.collect()}
    rows = {}
    for k, o, v in sorted(map(tuple, df.collect()), key=lambda r: r[1]):
        rows.setdefault(k, []).append(v)
    assert got == {k: (vs[0], len(vs), sum(abs(a - b) for a, b in zip(vs, vs[1:]))) for k, vs in rows.items()}


def test_fold_keeps_null_groups(frame, rows):
    df = frame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    out = fold_groups(df, ["k"], ["v"], lambda s, r: (s or 0) + int(r["v"].sum()), lambda a, b: a + b, lambda s: {"total": s}, "total bigint")
    assert rows(out) == [("a", 3), (None, 3)]
    assert fold_groups(df.where("v > 9"), ["k"], ["v"], lambda s, r: 0, lambda a, b: 0, lambda s: {"total": s}, "total bigint").count() == 0


# ------------------------------------------------------------------ graphs, rings, grids


def test_spanning_tree_and_walk(spark):
    rng = random.Random(6)
    names = [f"n{i:02d}" for i in range(23)]
    weight = {(a, b): float(rng.randrange(1, 12)) for a, b in itertools.combinations(names, 2)}  # many ties
    df = spark.createDataFrame([(*(p if rng.random() < 0.5 else p[::-1]), w) for p, w in weight.items()], "item1 string, item2 string, distance double")
    part = {n: n for n in names}

    def top(n):
        while part[n] != n:
            n = part[n]
        return n

    want = []
    for (a, b), w in sorted(weight.items(), key=lambda e: (e[1], e[0])):
        if top(a) != top(b):
            part[top(a)] = top(b)
            want.append((a, b, w))
    assert sorted(map(tuple, stats.spanning_tree(df).collect())) == sorted(want)
    got = [tuple(r) for r in stats.similarity_order(df, "item").orderBy("position").collect()]
    seen, order = {names[0]}, [(names[0], 1, None)]
    while len(seen) < len(names):
        w, a, b = min((w, a, b) for (a, b), w in weight.items() if (a in seen) != (b in seen))
        new = b if a in seen else a
        seen.add(new)
        order.append((new, len(order) + 1, w))
    assert got == order


def test_walk_over_separate_pieces(spark):
    df = spark.createDataFrame([("c", "d", 1.0), ("b", "a", 2.0)], "item1 string, item2 string, distance double")
    assert [r.item for r in stats.similarity_order(df, "item").orderBy("position").collect()] == ["a", "b", "c", "d"]


def test_edges_need_vertices(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "x")], "`from` string, `to` string")
    vertices = spark.createDataFrame([("a", 1), ("b", 2)], "name string, size int")
    assert [r.name for r in graph.missing_vertices(edges, vertices).collect()] == ["x"]
    with pytest.raises(PySparkException, match="not a vertex: x"):
        graph.with_vertices(edges, vertices).collect()
    assert [tuple(r) for r in graph.with_vertices(edges.where("`to` = 'b'"), vertices).collect()] == [("a", "b", 1, 2)]


def test_main_part_of_nested_rings(spark):
    def square(ring, x, y, a, turn=False):
        points = [(x, y), (x + a, y), (x + a, y + a), (x, y + a)]
        return [(1, ring, i, float(px), float(py)) for i, (px, py) in enumerate(points[::-1] if turn else points)]

    data = [*square(0, 4, 4, 2), *square(1, 0, 0, 10, True), *square(2, 1, 1, 8), *square(3, 20, 0, 7, True), *square(4, 21, 1, 1), *square(5, 25, 4, 1, True)]
    got = rings.main_part(spark.createDataFrame(data, "id int, ring int, seq int, x double, y double"), ["id"]).first()
    # ring 2 is a hole of ring 1, ring 0 an island in that hole; ring 3 has two holes and the larger rest
    assert (got.ring, got.n_holes, got.area) == (3, 2, 47.0)
    assert (got.cx, got.cy) == pytest.approx(((49 * 23.5 - 21.5 - 25.5) / 47, (49 * 3.5 - 1.5 - 4.5) / 47))


def test_density_on_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(50, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "x double, y double")
    grid = density.Grid(-3, 3, 700, -2, 2, 900)  # more cells than a tile has
    out = density.kernel_density(df, "x", "y", grid, 1.0)
    assert out.count() == 630_000
    gx, gy = grid.axes()
    for r in out.where("ix in (0, 277, 278, 699) and iy in (0, 450, 899)").collect():
        z = sum(math.exp(-0.5 * (((gx[r.ix] - a) / 0.25) ** 2 + ((gy[r.iy] - b) / 0.25) ** 2)) for a, b in points) / (50 * 2 * math.pi * 0.0625)
        assert r.density == pytest.approx(z) and (r.x, r.y) == pytest.approx((gx[r.ix], gy[r.iy]))


def test_axes_of_a_plane(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=300)
    x = np.stack([base, -2 * base + 0.01 * rng.normal(size=300), rng.normal(size=300), np.full(300, 4.0)], axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = np.array([tuple(r) for r in stats.principal_axes(df, list("abcd")).orderBy("a").select("axis_1", "axis_2").collect()])
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    want = (z @ vt[:2].T)[np.argsort(x[:, 0])]
    for k in range(2):
        assert np.allclose(np.abs(got[:, k]), np.abs(want[:, k]), atol=1e-6)
