"""N-gram Jaccard join over count vectors: documents whose shingle sets reach a similarity are linked, and the links'
connected components are returned. No link is lost: every step before the exact check is a bound, not a guess.

Shingles are hashed, and the hashes fall into groups. A document is the point of its group counts, and the overlap of two
documents is at most the sum of the coordinate minima of their points.

1. *Routing, the upper levels of the tree.* Sets in reach of each other differ in at most D shingles, where D follows from
   their size band. With P > D groups, at least P - D groups hold the same shingles in both. So a document goes to one leaf
   for each of its groups, addressed by the group's number and a fingerprint of what it holds. Empty groups are passed over
   where the count of the others is enough for the guarantee. (A leaf's points agree exactly in one coordinate of the finer grid; the bounding box
   of a plain R-tree over this many coordinates excludes next to nothing at its upper levels.)
2. *Stars.* In a leaf, every document is paired with the leaf's first one, streaming over sorted rows: the pairs are as many
   as the rows, however large a group of copies is. Pairs are bounded by summed minima, then verified on the whole sets.
3. *Crowded leaves.* Leaves whose documents are not yet one component go on. Of P - D leaves that two sets in reach share, one
   is enough. Each set leaves as many of its most crowded leaves as that allows; leaves are ordered alike for all sets, so
   the least crowded one that two sets share stays with both. A passage of many documents fills few leaves of each of them.
4. *R-trees.* Leaves with the same smallest component make one tree,
   so a pair that meets in many leaves is tried about once: points are packed by size and coordinates into nodes with their
   upper corners, pairs of nodes are excluded by summed minima of the corners, by size, or if all of both lies in one
   component, and what is left is bounded by the full points, then by finer ones, and verified like above.

Equal sets are one node throughout. Sets are compared by 64-bit hashes of shingles, and told apart by a 64-bit fingerprint.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text with fewer words than ``k`` has its whole sequence as one
shingle; null, empty or blank text has none and links with nothing. Repeated rows and ids are rows of their own that share a
node; the component id is the smallest id of its rows, a null id counts only if there is no other. Empty tables give no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices, word_codes
from .common import stored
from .components import components

K, SIMILARITY = 4, Fraction(85, 100)
#: Coordinates of a point in a tree, and the growth of size bands.
GROUPS, GROWTH = 64, 1.6
#: Shingles for each coordinate of a stored point, at most (but GROUPS coordinates at least).
DENSITY = 4
#: Bits of the number of coordinates of the finer points, at least, and their shingles for each coordinate, at most.
FINE_BITS, FINE_DENSITY = 8, 1
#: Points in a node of the tree.
FANOUT = 32
#: Partners of a point that are verified before all others.
FEW = 8
#: Pairs of points that are bounded at once.
AT_ONCE = 1 << 16
#: Rows up to which the ids of linked documents are sent to every executor; beyond, they are joined by shuffling.
SMALL = 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, k: int):
    """Sorted distinct shingle hashes of each text."""
    codes, words, counts = word_codes(texts, lower=True)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)
    h = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(h) - k + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        factor = mix(_ODD[i % 8:i % 8 + 1] + np.uint64(i))[0] | np.uint64(1)
        grams += h[i:i + n] * factor
    grams = mix(grams)
    edges = np.concatenate(([0], np.cumsum(counts)))
    for a, b in pairwise(edges.tolist()):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b].tolist():
                whole = mix(np.array([np.uint64(x)]) + np.array([whole]) * _ODD[:1])[0]
            yield np.array([whole])
        else:
            yield np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """Fingerprint of a set, as a signed number."""
    with np.errstate(over="ignore"):
        total = mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))
    return int(total.view(np.int64)[0])


def point(s: np.ndarray, least: int = 6, density: int = DENSITY) -> np.ndarray:
    """Group counts; a larger set has more groups, in powers of two, so that its bound is as sharp. Groups are the leading
    bits of the hashes: adjacent ones add up to those of the next smaller number of groups."""
    bits = max(least, int(np.ceil(np.log2(max(len(s), 1) / density))))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int16)


def bands(largest: int, similarity: Fraction) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, most differing shingles, groups) of the size bands up to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * GROWTH))
        differ = int(2 * high * (1 - similarity) / (1 + similarity))
        out.append((low, high, differ, differ + 3 + differ // 4))
        low = high + 1
    return out


def leaf_keys(s: np.ndarray, band: int, differ: int, groups: int) -> tuple[np.ndarray, int]:
    """Addresses of the leaves of a set in a size band, with the band in the lowest six bits, and how many of them it can leave.

    Of ``groups - differ`` equal groups, those that are empty in one set are empty in the other. So a set with some empty groups,
    passed over, shares at least ``groups - differ`` less these leaves with any set in reach.
    """
    group = ((s * _ODD[3]) >> np.uint64(24)).astype(np.int64) % groups
    order = np.argsort(group, kind="stable")
    held = np.bincount(group, minlength=groups)
    sums = np.zeros(groups, np.uint64)
    filled = np.flatnonzero(held)
    first = np.concatenate(([0], np.cumsum(held[filled])[:-1]))
    sums[filled] = np.add.reduceat(mix(s + _ODD[1])[order], first)
    address = mix(sums + mix(np.arange(groups, dtype=np.uint64) * _ODD[4] + np.array([band], np.uint64) * _ODD[5]))
    address = address & ~np.uint64(63) | np.uint64(band)
    spare = groups - differ - 1 - (groups - len(filled))
    return (address[filled], spare) if spare >= 0 else (address, 0)


def routed(docs: DataFrame, k: int, similarity: Fraction, text: str) -> DataFrame:
    """(leaf, node, spare) for every document and leaf; spare is the number of leaves in the leaf's band that the node can leave."""

    def run(batches):
        table = bands(1 << 40, similarity)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                leaves, nodes, spares = [], [], []
                for s in shingle_sets(texts, k):
                    if not len(s):
                        continue
                    node = node_of(s)
                    for i, (low, high, differ, groups) in enumerate(table):
                        if low * similarity > len(s):
                            break
                        if len(s) <= high and differ:  # where nothing may differ, equal sets are one node already
                            address, spare = leaf_keys(s, i, differ, groups)
                            leaves.append(address)
                            nodes.append(np.full(len(address), node))
                            spares.append(np.full(len(address), spare))
                if leaves:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaves).view(np.int64)), pa.array(np.concatenate(nodes)),
                                                      pa.array(np.concatenate(spares))], names=["leaf", "node", "spare"])

    return docs.select(docs[text].alias("text")).mapInArrow(run, "leaf bigint, node bigint, spare bigint")


def _stars(batches):
    """(leaf, head, node, spare, head_spare) from rows sorted by leaf and node: the head is the leaf's first node."""
    leaf = head = last = head_spare = None
    for b in batches:
        leaves, nodes, spares = (b.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "node", "spare"))
        if not len(leaves):
            continue
        new = np.concatenate(([leaf is None or leaves[0] != leaf], leaves[1:] != leaves[:-1]))
        start = np.where(new, np.arange(len(leaves)), 0)
        np.maximum.accumulate(start, out=start)
        heads, firsts = nodes[start], spares[start]
        if not new[0]:
            run = int(np.argmax(new)) if new.any() else len(new)
            heads[:run], firsts[:run] = head, head_spare
        before = np.concatenate(([nodes[0] - 1 if last is None or new[0] else last], nodes[:-1]))
        keep = ~new & (nodes != heads) & (nodes != before)
        leaf, head, last, head_spare = leaves[-1], heads[-1], nodes[-1], firsts[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (leaves, heads, nodes, spares, firsts)],
                                             names=["leaf", "head", "node", "spare", "head_spare"])


def sets_of(docs: DataFrame, pairs: DataFrame, rows: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(node, shingles) of the nodes in ``pairs``, from one document of each; ``rows`` tells the nodes of ids."""

    def run(batches):
        for batch in batches:
            for _, texts in slices(batch, "text"):
                found = [(node_of(s), s.view(np.int64)) for s in shingle_sets(texts, k) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["node", "shingles"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = stored(rows.select("node", "id").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "members")
    few = members.select(F.col("id").alias("__id")).distinct()
    few = F.broadcast(few) if few.count() <= SMALL else few
    texts = docs.select(docs[key].alias("id"), docs[text].alias("text")).join(few, F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    found = texts.select("text").mapInArrow(run, "node bigint, shingles array<bigint>")
    return found.join(members.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _enough(common: Column, a: Column, b: Column, similarity: Fraction) -> Column:
    p, q = similarity.numerator, similarity.denominator
    return (p + q) * common.cast("long") >= p * (a + b)


def folded(name: str, groups: Column) -> Column:
    """A point with ``groups`` coordinates; the sizes of sets that may link are so close that it has as many or twice as many."""
    return F.when(F.size(name) == groups, F.col(name).cast("array<int>")).otherwise(F.transform(
        F.sequence(F.lit(0), groups - 1), lambda i: F.get(name, 2 * i).cast("int") + F.get(name, 2 * i + 1).cast("int")))


def bounded(pairs: DataFrame, points: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sum of coordinate minima lets them link."""
    a, b = (points.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "point")]) for x in "ab")
    p, q = similarity.numerator, similarity.denominator
    both = pairs.join(a, F.col("a") == F.col("node_a")).join(
        b, (F.col("b") == F.col("node_b")) & (p * F.col("size_a") <= q * F.col("size_b")) & (p * F.col("size_b") <= q * F.col("size_a")))
    finest = F.least(F.size("point_a"), F.size("point_b"))
    bound = F.aggregate(F.zip_with(folded("point_a", finest), folded("point_b", finest), lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return both.where(_enough(bound, F.col("size_a"), F.col("size_b"), similarity)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    out = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b")
    common, a, b = F.size(F.array_intersect("s_a", "s_b")), F.size("s_a").cast("long"), F.size("s_b").cast("long")
    return out.where(_enough(common, a, b, similarity)).select("a", "b")


# ------------------------------------------------------------------ the trees

class Tree:
    """A packed R-tree over count vectors: sorted by size, then coordinates, and put into nodes of ``FANOUT``."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, parts: np.ndarray):
        order = np.lexsort((*points.T[:3], sizes))
        self.order, self.levels = order, []
        low, upper, part = sizes[order], points[order], parts[order]
        high, one = low, np.ones(len(order), bool)
        self.levels.append((low, high, upper, part, one))
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            least = np.minimum.reduceat(part, at)
            one = np.logical_and.reduceat(one, at) & (least == np.maximum.reduceat(part, at))
            low, high, upper, part = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(upper, at), least
            self.levels.append((low, high, upper, part, one))

    def pairs(self, similarity: Fraction):
        """Places (i < j) of the points in different components whose bound lets them link, block by block."""
        p, q = similarity.numerator, similarity.denominator
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            most = AT_ONCE // FANOUT ** 2 if level else AT_ONCE  # a pair of nodes opens into FANOUT ** 2 pairs
            if len(i) > most:
                stack += [(level, i[most:], j[most:]), (level, i[:most], j[:most])]
                continue
            low, high, upper, part, one = self.levels[level]
            apart = ~(one[i] & one[j] & (part[i] == part[j]))
            near = (p * low[i] <= q * high[j]) & (p * low[j] <= q * high[i])
            if level == 0:
                near &= i < j
            i, j = i[apart & near], j[apart & near]
            bound = np.minimum(upper[i], upper[j]).sum(1, dtype=np.int64)
            fits = (p + q) * bound >= p * (low[i] + low[j])
            i, j = i[fits], j[fits]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], self.order[j]
                continue
            n, step = len(self.levels[level - 1][0]), np.arange(FANOUT)
            a = np.repeat((i[:, None] * FANOUT + step)[:, :, None], FANOUT, 2).ravel()
            b = np.repeat((j[:, None] * FANOUT + step)[:, None, :], FANOUT, 1).ravel()
            keep = (a < n) & (b < n) & (a <= b)
            stack.append((level - 1, a[keep], b[keep]))


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    return p.reshape(groups, -1).sum(1, dtype=np.int32)


class Full:
    """The points of a tree in full, folded to each number of coordinates once."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray):
        self.points, self.sizes, self.tables = points, sizes, {}
        self.widths = np.array([len(p) for p in points])

    def _table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.tables:
            some = np.flatnonzero((self.widths >= width) & (self.widths <= 2 * width))
            place = np.zeros(len(self.points), np.int64)
            place[some] = np.arange(len(some))
            self.tables[width] = place, np.stack([fold(self.points[x], width) for x in some])
        return self.tables[width]

    def within(self, i: np.ndarray, j: np.ndarray, similarity: Fraction) -> np.ndarray:
        """Which of the pairs (i, j) keep within the bound on their points in full."""
        p, q = similarity.numerator, similarity.denominator
        width = np.minimum(self.widths[i], self.widths[j])
        keep = width <= GROUPS  # the tree has tried these in full
        for w in np.unique(width[~keep]).tolist():
            place, table = self._table(w)
            at = np.flatnonzero(width == w)
            for k in range(0, len(at), 1024):
                some = at[k:k + 1024]
                bound = np.minimum(table[place[i[some]]], table[place[j[some]]]).sum(1, dtype=np.int64)
                keep[some] = (p + q) * bound >= p * (self.sizes[i[some]] + self.sizes[j[some]])
        return keep


def places(x: np.ndarray) -> np.ndarray:
    """How often each entry has occurred before."""
    order = np.argsort(x, kind="stable")
    new = np.concatenate(([True], x[order][1:] != x[order][:-1]))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return out


def tree_pairs(rows: DataFrame, similarity: Fraction, few: int | None = None) -> DataFrame:
    """(a, b) that the trees leave, from (root, node, size, point, component); with ``few``, only pairs of which one has been given
    fewer partners than these, counted for both sides of a pair apart within a block, so at most twice as many pairs for each point.

    The points of a tree are held together, some hundred bytes each; they have been brought down to documents whose leaves
    the stars did not make one component.
    """

    def run(batches):
        root, held = None, []

        def flush():
            node, size, part, points = (list(chain(*c)) if isinstance(c[0], list) else np.concatenate(c) for c in zip(*held))
            coarse = np.stack([fold(x, GROUPS) for x in points])
            full, given = Full(points, size), np.zeros(len(size), np.int64)
            for i, j in Tree(size, coarse, part).pairs(similarity):
                keep = full.within(i, j, similarity)
                i, j = i[keep], j[keep]
                if few and len(i):
                    first, second = (given[x] + places(x) < few for x in (i, j))
                    np.add.at(given, i[first], 1)
                    np.add.at(given, j[second], 1)
                    i, j = i[first | second], j[first | second]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

        for b in batches:
            roots = b.column("root").to_numpy(zero_copy_only=False)
            values = b.column("point")
            cuts = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))[:-1]
            points = np.split(values.flatten().to_numpy(zero_copy_only=False), cuts) if len(roots) else []
            node, size, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "component"))
            edges = [0, *(np.flatnonzero(roots[1:] != roots[:-1]) + 1).tolist(), len(roots)]
            for x, y in pairwise(edges):
                if y > x:
                    if held and roots[x] != root:
                        yield from flush()
                        held = []
                    root = roots[x]
                    held.append((node[x:y], size[x:y], part[x:y], points[x:y]))
        if held:
            yield from flush()

    return rows.repartition("root").sortWithinPartitions("root").select("root", "node", "size", "point", "component").mapInArrow(
        run, "a bigint, b bigint").distinct()


def mixed(rows: DataFrame) -> DataFrame:
    """(leaf, root, n) of the leaves, from (leaf, node, component), that hold several components; of two nodes, the star has tried the
    only pair. The root is the smallest component."""
    out = rows.groupBy("leaf").agg(F.min("component").alias("root"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    return out.where("root <> hi").select("leaf", "root", "n")


def uncrowded(rows: DataFrame) -> DataFrame:
    """(leaf, node, component) without the ``spare`` most crowded leaves of each node in each band, from (leaf, node, spare, component,
    n). A pair of different components that the stars have not tried has all its leaves here."""
    order = Window.partitionBy("node", F.col("leaf").bitwiseAND(F.lit(63))).orderBy(F.desc("n"), "leaf")
    return rows.where("n > 2").withColumn("place", F.row_number().over(order)).where("place > spare").select("leaf", "node")


# ------------------------------------------------------------------ the join

def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component_id, node, component) of every row of ``docs``: node is the fingerprint of the row's set, and
    component the smallest node that links reach from it; both null for an empty set."""
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                got = [(len(s), node_of(s), point(s), point(s, FINE_BITS, FINE_DENSITY)) if len(s) else (0, None, None, None) for s in shingle_sets(texts, k)]
                kinds = pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int16())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*got), kinds))],
                                                 names=["id", "n_shingles", "node", "point", "fine"])

    rows = stored(docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(
        measure, f"id {kind}, n_shingles bigint, node bigint, point array<smallint>, fine array<smallint>"), "nodes")
    leaves = stored(routed(docs, k, similarity, text).repartition("leaf").sortWithinPartitions("leaf", "node").mapInArrow(
        _stars, "leaf bigint, head bigint, node bigint, spare bigint, head_spare bigint"), "leaves")
    pairs = stored(leaves.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    points = stored(rows.select("node", F.col("n_shingles").alias("size"), "point").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "points")
    near = stored(bounded(pairs, points, similarity), "near")
    edges = stored(verified(near, stored(sets_of(docs, near, rows, k, key, text), "sets"), similarity), "links")
    found = stored(components(edges, "a", "b"), "labels")

    every = leaves.select("leaf", "node", "spare").unionByName(leaves.select("leaf", F.col("head").alias("node"), F.col("head_spare").alias("spare")).distinct())
    labelled = every.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = stored(uncrowded(labelled.join(mixed(labelled), "leaf")), "open-leaves")
    # first a few partners for each point, which make one component of a near clique, then all that lie in different ones
    for few in (FEW, None):
        labelled = kept.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_rows = labelled.join(mixed(labelled), "leaf").select("root", "node", "component").distinct()
        fine = rows.select("node", F.col("n_shingles").alias("size"), F.col("fine").alias("point")).join(
            open_rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        more = stored(tree_pairs(open_rows.join(fine, "node"), similarity, few).join(pairs, ["a", "b"], "left_anti"), "tree-pairs")
        if not more.isEmpty():
            late = stored(verified(more, stored(sets_of(docs, more, rows, k, key, text), "late-sets"), similarity), "late-links")
            edges, pairs = edges.unionByName(late), pairs.unionByName(more)
            found = stored(components(edges, "a", "b"), "labels")

    found = found.withColumnRenamed("node", "__node")
    placed = rows.join(found, F.col("node") == F.col("__node"), "left").select(
        "id", "n_shingles", "node", F.coalesce("component", "node").alias("component"))
    placed = stored(placed, "placed")
    least = placed.where("component is not null").groupBy("component").agg(
        F.min("id").alias("component_id"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("component").alias("__c"), "component_id")
    return placed.join(least, F.col("component") == F.col("__c"), "left").select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), "node", "component")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, similarity: Fraction = Fraction(80, 100)) -> DataFrame:
    """One row of each component, that with the smallest id; all columns stay. Rows with empty sets all stay.

    Rows that share an id are told apart by their sets; of rows that share both, one stays. Only the rows that go, and those
    of repeated ids, are looked up, so texts aren't shuffled for the others while there are few of these.
    """
    rows = stored(join(docs, key, text, k, similarity).select(F.col(key).alias("id"), "component_id", "node", "component"), "joined")
    stays = rows.where(F.col("id").eqNullSafe(F.col("component_id")) & F.col("node").isNotNull())
    stays = stays.groupBy("component").agg(F.min_by("id", "node").alias("__id"), F.min("node").alias("__node")).select("__id", "__node")
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id"))
    goes = rows.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"))
    out = stored(goes.unionByName(twice).distinct(), "leaving")
    few = F.broadcast(out) if out.count() <= SMALL else out
    single = docs.join(few, docs[key].eqNullSafe(F.col("__id")), "left_anti")
    twice = stored(twice, "repeated")
    if twice.isEmpty():
        return single
    names = [f"__{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text)

    def add_node(batches):
        for batch in batches:
            for part, texts in slices(batch, names[place]):
                nodes = [node_of(s) if len(s) else None for s in shingle_sets(texts, k)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, pa.int64())], names=[*names, "__node"])

    same = docs.join(twice, docs[key].eqNullSafe(F.col("__id")), "left_semi").toDF(*names)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    same = stored(same.mapInArrow(add_node, kinds + ", __node bigint"), "same-id")
    id_name = names[docs.columns.index(key)]
    stays = stays.withColumnsRenamed({"__id": "__s", "__node": "__n"})
    kept = same.join(stays, same[id_name].eqNullSafe(stays["__s"]) & (same["__node"] == stays["__n"]), "left_semi").dropDuplicates([id_name, "__node"])
    return single.unionByName(kept.unionByName(same.where("__node is null")).drop("__node").toDF(*docs.columns))
