"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from sparkverbs.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<double>, id string, row int, score bigint, block int"


def brute(rows):
    kept = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    last = lambda i: (i is None, i or 0)
    for at, (i, label, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), last(j), j, k, l) for k, (j, l, w) in enumerate(kept) if k != at]
        scored.sort(key=lambda s: s[:2])
        for score, _, j, _, _ in [s for s in scored if s[4] == label][:5]:
            fits = [(-s, other) for s, _, other, _, l in scored if l != label and 30 * -score <= 100 * -s <= 90 * -score]
            out += [(i, j, rank + 1, other, -score, s) for rank, (s, other) in enumerate(fits[:10])]
    return sorted(map(str, out))


def mined(spark, rows, parts=5):
    full = [(i, label, v, "x", 1, 2, 3) for i, label, v in rows]
    out = negatives.mine(spark.createDataFrame(full, SCHEMA).repartition(parts))
    return sorted(str(tuple(r)) for r in out.collect())


def clusters(rng, n, dim, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(i, rng.randrange(4), [x + rng.gauss(0, spread) for x in centres[rng.randrange(8)]]) for i in range(n)]


ODD = [(100, None, [1.0, 2.0]), (200, 1, None), (300, 1, [1.0, None]), (400, 1, [math.nan, 1.0]), (500, 1, [math.inf, 1.0]),
       (600, 1, []), (700, 1, [0.0, 0.0]), (800, 1, [0.25]), (None, 1, [0.5, 0.5]), (None, 2, [0.5, 0.25]), (100, 1, [0.5, 0.5]),
       (100, 1, [0.5, 0.5]), (901, 1, [0.5, 0.5]), (902, 2, [0.5, 0.25]), (902, 2, [0.5, 0.25]), (903, 1, [0.75, 0.5])]


def test_odd_rows(spark):
    assert mined(spark, ODD) == brute(ODD) != []
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == []


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_against_brute_force(spark, monkeypatch, spread):
    rng = random.Random(3)
    rows = clusters(rng, 700, 6, spread)
    copy = rows[100][2]
    rows += [(1000 + i, rng.randrange(4), copy) for i in range(300)]  # ties decided by id
    rows += [(3000 + i, 1, [-x for x in copy]) for i in range(0, 200, 50)]  # negative scores only
    want = brute(rows)
    assert mined(spark, rows) == want
    monkeypatch.setattr(negatives, "BLOCK", 64)  # many blocks, windows, groups and shelves
    monkeypatch.setattr(negatives, "WINDOW", 8)
    monkeypatch.setattr(negatives, "GROUP", 3)
    assert mined(spark, rows, 2) == want


def test_bounds_hold_and_leave_windows_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    x = np.floor(256 * (centres[np.arange(600) % 6] + 0.05 * rng.normal(size=(600, 12))))
    references = negatives.fit_references(x)
    norms = np.linalg.norm(x, axis=1)
    angles = np.arccos(np.clip(x @ references.T / norms[:, None], -1, 1)).astype("<f4")
    order = np.argsort(np.argmin(angles, axis=1), kind="stable")
    b = negatives.Block({"n": 600, "block": 0, "ids": np.arange(600).tobytes(), "known": bytes([1] * 600), "labels": np.zeros(600, "<i8").tobytes(),
                         "vectors": x[order].astype("<i4").tobytes(), "angles": angles[order].tobytes()})
    lower, upper = negatives.limits(angles.astype(float), norms, b)
    s = x @ x[order].T
    window = np.arange(600) // negatives.WINDOW
    for w in range(len(b.low)):
        assert (lower[:, w, None] <= s[:, window == w]).all() and (s[:, window == w] <= upper[:, w, None]).all()
    assert (upper < 0.5 * (norms ** 2)[:, None]).mean() > 0.4  # far clusters are out of reach


def test_scores_without_rounding():
    a = np.array([[2.0 ** 30 - 1, 3.0]])
    assert int(negatives.scores(a, a, 2.0 ** 61)[0, 0]) == (2 ** 30 - 1) ** 2 + 9
    with pytest.raises(OverflowError):
        negatives.scores(a, a, 2.0 ** 63)
