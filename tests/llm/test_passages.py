"""Removal of repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sparkverbs.llm import passages
from tests.compare import connect, differences
from tests.llm.conftest import ODD


def brute(rows, length=50):
    least = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            w = b[p:p + length]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1 if i is not None else 0):
            if least[b[p:p + length]] < i:
                gone[p:p + length] = True
        gone = gone[:-1]
        spans = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(rng):
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = [words(rng.randint(8, 40)) for _ in range(12)]
    rows = []
    for d in rng.sample(range(10_000), 150):
        parts = [rng.choice(shared) if rng.random() < 0.4 else words(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        rows.append((d, rng.choice([" ", "", "\n"]).join(parts), "en", "s"))
    base = words(200)
    for k in range(40):  # near copies, each with changes of its own
        w = base.split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["x", "changed", ""])
        rows.append((20_000 + k, " ".join(w), "en", "s"))
    text = words(60)
    for cut in (0, 1, 49, 50, 51, 73, 74):  # ends of texts, and texts about as long as a passage
        rows += [(30_000 + cut, text[cut:], "en", "s"), (31_000 + cut, text[:50 + cut], "en", "s"), (32_000 + cut, text[:cut], "en", "s")]
    rows += [(40_000, "a" * 3000, "en", "s"), (40_001, "b" + "a" * 60 + "b", "en", "s"), (39_999, "ab" * 500, "en", "s")]
    return rows


def report(df):
    return sorted((tuple(r) for r in passages.report(df).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(docs, monkeypatch, small):
    if small:  # many slices, so that repeats lie in different ones; pieces of few groups; no ids sent about
        monkeypatch.setattr(passages, "SLICE", 700)
        monkeypatch.setattr(passages, "PIECE", 5)
        monkeypatch.setattr(passages, "SMALL", 0)
    rng = random.Random(11)
    rows = texts(rng) + ODD + [(None, "q" * 300, "en", "s"), (None, texts(rng)[0][1], "en", "s")]
    rows += [(r[0], r[1], "en", "s") for r in rows[:5]]                 # repeated rows
    rows += [(r[0], rows[9][1] + r[1], "en", "s") for r in rows[20:25]]  # one id, other texts
    want = brute(rows)
    assert report(docs(rows, 7)) == want
    assert sum(r[2] for r in want) > 5000


def test_empty(docs):
    assert report(docs([])) == []


def test_kept_bytes_and_stretches(docs):
    p = "The same sixty bytes of text stand in both of these documents"
    got = {r.doc_id: r for r in passages.remove_repeats(docs([(1, "one " + p, "en", "s"), (2, p + "é two-" + p, "en", "s")])).collect()}
    assert bytes(got[1].kept) == ("one " + p).encode() and got[1].removed_from == []
    assert bytes(got[2].kept).decode() == "é two-" and got[2].removed_from == [0, len(p) + 7]


@pytest.mark.parametrize("base", [passages.Suffixes.BASE, 0, 1])
def test_suffix_array_survives_collisions(monkeypatch, base):
    """With 0 as the base all strings with the same first byte collide; with 1, all that are permutations."""
    monkeypatch.setattr(passages.Suffixes, "BASE", base)
    rng = np.random.default_rng(2)
    letters, lengths = rng.integers(97, 100, (400, 9)).astype(np.uint8), rng.integers(1, 10, 400)
    letters[np.arange(9) >= lengths[:, None]] = 0
    group = np.sort(rng.integers(0, 12, 400))
    order, share = passages.Suffixes(letters, lengths).sort(np.unique(group, return_inverse=True)[1])
    strings = [bytes(letters[i, :lengths[i]]) for i in range(400)]
    for g in np.unique(group):
        at = np.flatnonzero(group[order] == g)
        got = [strings[i] for i in order[at]]
        assert got == sorted(strings[i] for i in np.flatnonzero(group == g))
        common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(got, got[1:])]
        assert share[at].tolist() == [-1, *common]


def test_places_are_those_of_the_passage():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    whole, h = passages.places(data, np.array([0, 1400, 3000]))
    for p in (0, 17, 900, 1350, 1400, 2950):  # the place of a passage is found from the passage alone
        alone, h1 = passages.places(data[p:p + 50], np.array([0, 50]))
        assert len(alone) == 1 and p + alone[0] in whole and h[whole == p + alone[0]][0] == h1[0]


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = passages.report(spark.read.parquet(f"{folder}/documents.parquet")).toArrow()
    assert differences(got, connect(folder).sql(passages.SQL).to_arrow_table()) == []


def test_one_place_for_each_partition(spark):
    """A task gets the rows of one place; dealt by a hash, some got four or five and others none."""
    from pyspark.sql import functions as F

    rows = passages.dealt(spark.range(400).select((F.col("id") % 40).cast("int").alias("place"), F.lit(1).cast("tinyint").alias("kind")), 40, "kind")
    held = rows.select("place", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
    assert len(held) == 40 and all(r["count"] == 1 for r in held)


def test_contexts_take_little_more_than_their_bytes():
    import tracemalloc

    rng = np.random.default_rng(4)
    data, at = rng.integers(32, 127, 1 << 20, dtype=np.uint8), np.array([0, 10, 500_000, 500_000, 1 << 20])
    found = np.sort(rng.choice(len(data), 100_000, replace=False))
    tracemalloc.start()
    text, before, after = passages.slice_contexts(data, at, found)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * text.nbytes
    for i in [0, 1, 2, 50_000, len(found) - 1]:
        a, b = max(p for p in at if p <= found[i]), min(p for p in at if p > found[i])
        first, last = max(a, found[i] - passages.BEFORE), min(b, found[i] + passages.LENGTH)
        want = np.zeros(passages.BEFORE + passages.LENGTH, np.uint8)
        want[first - found[i] + passages.BEFORE:last - found[i] + passages.BEFORE] = data[first:last]
        assert (text[i] == want).all() and (before[i], after[i]) == (found[i] - first, last - found[i])
