"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkverbs.llm import spelling
from tests.llm.conftest import ODD

LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})


def brute_words(rows):
    out = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            if i is not None:
                h = zlib.crc32(f"{i}:{run}".encode())
                if h % 31 == 0:
                    p = h % len(run)
                    run = run[:p] + run[p + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return sorted(out, key=str)


def texts(rng):
    base = ["".join(rng.choices("abcdeé", k=rng.randint(7, 11))) for _ in range(20)] + ["chaîne" * 2, "ÀÁÂÃÄÅÆ×÷", "zzzzzzzzzz", "Straßenbahn"]
    out = []
    for d in range(150):
        line = []
        for _ in range(60):
            w = rng.choice(base[:3] if rng.random() < 0.7 else base)
            if rng.random() < 0.1:
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice(["", "x", "é", w[p] * 2, "ß"]) + w[p + 1:]
            line.append(rng.choice([w, w.upper(), w.title()]))
        out.append((d, rng.choice([" ", "-", "1", "\n"]).join(line), "en", "s"))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(docs, monkeypatch, small):
    rows = texts(random.Random(5)) + ODD
    rows.append((None, "qqqqqqqa " * 2 + "qqqqqqqb " * 30 + "qqqqqqqbb " * 400, "en", "s"))  # a form that has a form
    rows += [(7000 + i, "y" * 4000 + " " + "y" * 3999 + "x ok", "en", "s") for i in range(3)]  # very long words
    if small:  # small cells and parts, so that cuts, boxes and parts of a cell are crossed
        monkeypatch.setattr(spelling, "CELL", 10)
        monkeypatch.setattr(spelling, "CELL_MOST", 6)
        monkeypatch.setattr(spelling, "SAMPLE", 120)
        monkeypatch.setattr(spelling, "LEAF", 2)
        monkeypatch.setattr(spelling, "HELD", 50)
        monkeypatch.setattr(spelling, "PAIRS", 7)
    got = sorted((tuple(r) for r in spelling.variants(docs(rows)).collect()), key=str)
    want = brute(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_empty(docs):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs(ODD)).count() == 0


def test_run_crcs():
    rng = random.Random(1)
    heads = [f"{rng.randrange(10**6)}:".encode() for _ in range(50)]
    tails = ["".join(rng.choices("abcé", k=rng.choice([1, 2, 7, 8, 300]))).encode() for _ in range(50)]
    got = spelling.run_crcs(np.array([zlib.crc32(h) for h in heads], np.uint32), np.array([zlib.crc32(t) for t in tails], np.uint32),
                            np.array([len(t) for t in tails]))
    assert got.tolist() == [zlib.crc32(h + t) for h, t in zip(heads, tails)]


def test_boxes_lose_no_word():
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcdefgh", k=8)) for _ in range(500)})
    loose = spelling.Tree(spelling.vectors_of(words[::5]), 8, tight=False)
    home = loose.home(spelling.vectors_of(words))
    query, node = loose.reach(spelling.vectors_of(words), 1, 1)
    reached = set(zip(query.tolist(), loose.leaf[node].tolist()))
    for i, w in enumerate(words):
        assert all((i, int(home[j])) in reached for j, v in enumerate(words) if near(w, v) or v == w)
    assert len(reached) < 0.7 * len(words) * (loose.leaf.max() + 1)  # and boxes out of range are pruned


def test_a_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(7)], "word string, form string")
    assert {tuple(r) for r in spelling.rooted(forms, 10 ** 8).collect()} == {(f"w{i}", "w7") for i in range(7)}
