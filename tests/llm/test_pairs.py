"""Jaccard join, components and decontamination against brute force."""

import random
import re
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from sparkverbs.llm import decontamination, jaccard
from sparkverbs.llm.components import components
from tests.compare import connect, differences
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, similarity):
    sets = [shingles(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((str(doc), len(sets[i]), str(least.get(find(i)))) for i, (doc, *_) in enumerate(rows))


def copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            del w[rng.randrange(len(w))]
        out.append(w)
    return out


@pytest.mark.parametrize("k, similarity", [(4, Fraction(85, 100)), (5, Fraction(80, 100))])
def test_join_against_brute_force(docs, k, similarity):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for length in (2, 5, 8, 12, 20, 35, 60, 100, 250, 600):
        base = rng.choices(vocabulary, k=length)
        texts += copies(rng, base, 14, max(1, length // 25))  # many just inside or outside of reach, and chains
    passage = rng.choices(vocabulary, k=60)
    texts += [passage + rng.choices(vocabulary, k=40) for _ in range(25)]
    rows = ODD + [(100 + i, (" " if i % 2 else "\n").join(t).title() if i % 3 else " ".join(t), "en", "s") for i, t in enumerate(texts)]
    rows.append((5000, "same word " * 30_000, "en", "s"))
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(docs(rows), k=k, similarity=similarity).collect())
    assert got == brute(rows, k, similarity)


def test_deduplicate_keeps_one_row_of_each_component(docs):
    base = [f"w{i}" for i in range(60)]
    one, near = " ".join(base), " ".join(base[:-1] + ["other"])
    rows = [(3, one, "en", "s"), (3, one, "en", "s"), (2, near, "en", "s"), (2, "quite another text of more than five words", "en", "s"),
            (9, None, "en", "s"), (9, "", "en", "s"), (None, one, "en", "s"), (11, "nothing like the other rows in this table", "en", "s")]
    out = jaccard.deduplicate(docs(rows))
    assert out.columns == docs([]).columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted(
        [("2", near), ("2", rows[3][1]), ("9", ""), ("9", ""), ("11", rows[7][1])])


def test_empty_tables(docs, spark):
    assert jaccard.join(docs([])).count() == 0 and jaccard.deduplicate(docs([])).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, None), (2, " "), (3, "a b c d e f g")], "item_id bigint, text string")
    assert decontamination.hits(docs(ODD), items).count() == 0 and decontamination.hits(docs([]), some).count() == 0


def test_tree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.poisson(3, (150, jaccard.GROUPS)), np.repeat(rng.poisson(3, (10, jaccard.GROUPS)), 15, 0)
                             + (rng.random((150, jaccard.GROUPS)) < 0.1)]).astype(np.int32)
    sizes, parts = points.sum(1).astype(np.int64), rng.integers(0, 40, 300)
    want = {(a, b) for a, b in combinations(range(300), 2) if parts[a] != parts[b]
            and 185 * np.minimum(points[a], points[b]).sum() >= 85 * (sizes[a] + sizes[b])}
    got = [tuple(sorted(p)) for i, j in jaccard.Tree(sizes, points, parts).pairs(Fraction(85, 100)) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_few_partners_are_linear(spark):
    rows = [(1, i, 64, [1] * 64, i) for i in range(300)]
    df = spark.createDataFrame(rows, "root bigint, node bigint, size bigint, point array<smallint>, component bigint")
    got = [tuple(r) for r in jaccard.tree_pairs(df, Fraction(85, 100), 8).collect()]
    assert len(got) <= 2 * 8 * 300 and {x for p in got for x in p} == set(range(300))
    assert jaccard.tree_pairs(df, Fraction(85, 100)).count() == 300 * 299 // 2


def test_near_copies_in_crowded_leaves(docs, spark):
    """Documents that share a long passage fill the same leaves; copies with a word changed are linked all the same."""
    rng = random.Random(21)
    v = [f"w{i}" for i in range(20_000)]
    passage, rows = rng.choices(v, k=70), []
    for i in range(150):
        own = rng.choices(v, k=70)
        rows.append((i, " ".join(own[:35] + passage + own[35:]), "en", "s"))
        if i % 3 == 0:
            for j in range(1, 4):
                words = rows[-1][1].split() if j == 1 else words
                words = [*words]
                words[rng.randrange(len(words))] = f"changed{i}x{j}"
                rows.append((1000 * j + i, " ".join(words), "en", "s"))
    sets = {i: {tuple(t.split()[x:x + 4]) for x in range(len(t.split()) - 3)} for i, t, *_ in rows}
    edges = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = {i: i for i in sets}
    for _ in range(10):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.doc_id: r.component_id for r in jaccard.join(docs(rows)).collect()}
    assert len(edges) > 100 and got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(200, 260)} | {7: 7, 300: 300, 301: 300}
    assert got == want


def brute_hits(rows, items):
    from collections import Counter

    out = set()
    for item, t in items:
        w = (t or "").lower().split()
        k = min(5, len(w))
        a = Counter(" ".join(w[i:i + k]) for i in range(len(w) - k + 1)) if w else None
        for doc, text, *_ in rows:
            d = (text or "").lower().split()
            for s in range(len(d) - len(w) + 1) if w else ():
                b = Counter(" ".join(d[s + i:s + i + k]) for i in range(len(w) - k + 1))
                low, high = sum((a & b).values()), sum((a | b).values())
                if any(d[s + i:s + i + k] == w[i:i + k] for i in range(len(w) - k + 1)) and 100 * low >= 80 * high:
                    out.add((str(doc), item, s, len(w), 1000 * low // high))
    return out


def test_hits_against_brute_force(docs, spark):
    rng = random.Random(3)
    v = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(v, k=n))) for i, n in enumerate([3, 5, 14, 30, 30, 59])] + [(90, None), (91, ""), (92, "Twice twice twice twice twice twice")]
    rows = list(ODD)
    for i in range(80):
        own, item = rng.choices(v, k=rng.choice([20, 90])), rng.choice(items[:6])[1].split()
        if i % 2:
            if i % 3 == 0:
                item[rng.randrange(len(item))] = "changed"
            own[7:7] = [w.upper() for w in item] if i % 5 == 0 else item
        rows.append((100 + i, " ".join(own), "en", "s"))
    rows += [(500, "twice " * 40, "en", "s"), (501, " ".join(["w"] * 40_000 + items[3][1].split()), "en", "s")]
    got = {(str(r.doc_id), r.item_id, r.start, r.n_words, r.similarity)
           for r in decontamination.hits(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute_hits(rows, items)


def best(text, item):
    """The largest similarity of an item and a window of a text, over all windows, wherever they lie."""
    from collections import Counter

    d, w = text.lower().split(), item.lower().split()
    k, size = min(5, len(w)), min(len(w), len(d))

    def count(x):
        return Counter(" ".join(x[i:i + k]) for i in range(len(x) - k + 1))

    return max((Fraction((count(d[s:s + size]) & count(w)).total(), (count(d[s:s + size]) | count(w)).total()) for s in range(len(d) - size + 1)), default=0)


def test_items_that_hang_over_an_end(docs, spark):
    """Copies that lack words at the start or the end of a text, and texts shorter than the item, against all windows."""
    rng = random.Random(8)
    v = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(v, k=n))) for i, n in enumerate([15, 24, 40, 59])]
    texts, filler = [], rng.choices(v, k=60)
    for _, t in items:
        w = t.split()
        for cut in range(0, 15):
            texts += [w[cut:] + filler, filler + w[:len(w) - cut], w[cut:], w[:len(w) - cut], w[cut // 2:len(w) - (cut - cut // 2)]]
    rows = [(100 + i, " ".join(t), "en", "s") for i, t in enumerate(texts)] + [(None, "words before " + items[2][1], "en", "s"), (None, "words", "en", "s")]
    got = {(r.doc_id, r.item_id) for r in decontamination.hits(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for doc, text, *_ in rows:
        for i, t in items:
            want[doc, i] = max(best(text, t), want.get((doc, i), 0))
    assert got == {x for x, s in want.items() if 100 * s >= 80} and (None, 2) in got


def test_no_near_copy_is_lost_at_the_radius(docs, spark):
    """Copies with so many words changed at an edge that they are just similar enough; some differ in more than RADIUS bits."""
    rng = random.Random(9)
    v = [f"w{i}" for i in range(50_000)]
    items, rows = [], []
    for i in range(300):
        size, changed = rng.choice([(24, 2), (34, 3), (44, 4), (59, 6)])
        w = rng.choices(v, k=size)
        items.append((i, " ".join(w)))
        new = rng.choices(v, k=changed)
        rows.append((i, " ".join(["before", *(new + w[changed:] if i % 2 else w[:-changed] + new), "after"]), "en", "s"))
    got = {(r.doc_id, r.item_id) for r in decontamination.hits(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i, t, *_ in rows if 100 * best(t, items[i][1]) >= 80} and len(got) > 200


def test_hits_against_sql(spark):
    tables = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    assert differences(decontamination.hits(*tables).toArrow(), connect(FOLDER).sql(decontamination.SQL).to_arrow_table()) == []


def test_blocks_meet_within_the_radius(spark):
    """Two fingerprints within the radius share a listed value, with the flips of one side only."""
    from pyspark.sql import functions as F

    rng, rows = random.Random(14), []
    for _ in range(300):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randint(0, decontamination.RADIUS)):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    same = F.arrays_overlap(decontamination.blocks(F.col("a")), decontamination.blocks(F.col("b"), decontamination.NEAR))
    assert df.where(~same).count() == 0


def near_copies(spark, docs):
    """Items, documents with a copy changed at an edge or inside, and the pairs that some window reaches."""
    rng = random.Random(15)
    v = [f"w{i}" for i in range(50_000)]
    items, rows = [], []
    for i in range(400):
        size = rng.choice([24, 34, 44, 59])
        w = rng.choices(v, k=size)
        items.append((i, " ".join(w)))
        if i % 2:
            changed = (size - 4) // 9
            w[:changed] = rng.choices(v, k=changed)
        elif size > 48:
            w[rng.randrange(6, size - 6)] = "changed"
        rows.append((i, " ".join(["before", *w, "after"]), "en", "s"))
    want = {(i, i) for i, t, *_ in rows if 100 * best(t, items[i][1]) >= 80}
    return docs(rows), spark.createDataFrame(items, "item_id bigint, text string"), want


def test_recall_of_the_search(docs, spark):
    rows, items, want = near_copies(spark, docs)
    got = {(r.doc_id, r.item_id) for r in decontamination.hits(rows, items).collect()}
    assert got <= want and len(want) > 300 and len(got) >= 0.99 * len(want)


def test_fingerprints_decide(docs, spark, monkeypatch):
    """With fingerprints that can't meet nothing is found."""
    from pyspark.sql import functions as F

    rows, items, _ = near_copies(spark, docs)
    monkeypatch.setattr(decontamination, "fingerprints", lambda df, w, k, name: df.withColumn(name, F.lit(0 if name == "bits" else -1).cast("long")))
    assert decontamination.hits(rows, items).isEmpty()


def test_sql_on_ends_repeats_and_missing_ids(docs, spark):
    import duckdb

    rng = random.Random(16)
    w = rng.choices([f"w{i}" for i in range(900)], k=30)
    rows = [(1, " ".join(w[2:]), "en", "s"), (2, " ".join(["x"] * 9 + w[:-2]), "en", "s"), (None, " ".join(w), "en", "s"), (None, " ".join(w), "en", "s"),
            (3, " ".join(w + w), "en", "s"), (3, " ".join(w + w), "en", "s"), (4, None, "en", "s"), (5, "", "en", "s")]
    items = [(1, " ".join(w)), (1, " ".join(w)), (2, None), (3, "one two"), (4, " ".join(["new", *w[:-1]]))]
    tables = docs(rows), spark.createDataFrame(items, "item_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", tables[0].toArrow())
    con.register("benchmark", tables[1].toArrow())
    got = decontamination.hits(*tables).toArrow()
    assert got.num_rows > 5 and differences(got, con.sql(decontamination.SQL).to_arrow_table()) == []


def test_items_whose_parts_changed_places(docs, spark):
    """Copies with halves or a head and a tail swapped: no window that lies in place is similar enough, others are."""
    rng = random.Random(21)
    v = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(v, k=n))) for i, n in enumerate([60, 80, 110, 300])]
    rows, filler = [], rng.choices(v, k=50)
    for i, t in items:
        w = t.split()
        for j, cut in enumerate((len(w) // 2, len(w) // 3, 20)):
            swapped = w[cut:] + w[:cut]
            rows += [(10 * i + j, " ".join(filler + swapped + filler), "en", "s"), (100 + 10 * i + j, " ".join(swapped), "en", "s")]
    rows.append((900, " ".join(filler + items[0][1].split() + filler), "en", "s"))
    got = decontamination.hits(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {(doc, i) for doc, text, *_ in rows for i, t in items if 100 * best(text, t) >= 80}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 20
    assert [(r.start, r.similarity) for r in got if r.doc_id == 900] == [(50, 1000)]  # the windows beside it are the same copy
    text = rows[0][1].split()
    near = {s: best(" ".join(text[s:s + 60]), items[0][1]) for s in range(len(text) - 59)}
    assert {(r.start, r.similarity) for r in got if r.doc_id == 0} == {(s, 1000 * x.numerator // x.denominator) for s, x in near.items() if 100 * x >= 80}


def test_clean_keeps_the_rest(docs, spark):
    item = " ".join(f"i{i}" for i in range(20))
    rows = [(1, f"before {item} after", "en", "s"), (2, "clean text", "en", "s"), (None, item, "en", "s"), (3, None, "en", "s")]
    out = decontamination.clean(docs(rows), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert out.columns == docs([]).columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "3", "None"]
