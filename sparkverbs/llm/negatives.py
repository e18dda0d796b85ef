"""Hard negatives by angular triangle filtering: integer scores are computed only where the bound of a window of rows leaves
room for a wanted score.

1. *Index.* Every row keeps its angles to a few reference directions and its norm. Rows are sorted by their nearest two
   directions and the angle to the nearest, and packed into blocks; 64 neighbours in this order are a window. For a window
   only the smallest and largest angle to each direction and the extreme norms are looked at.
2. *Bounds.* The angle between two vectors is at least the difference of their angles to any direction, and at most their sum
   (or what is missing from a whole turn). The cosines of these limits, times the norms, bound the integer score. Angles are
   stored in single precision, so limits are widened by ``SLACK`` and one whole score before they are compared.
3. *Search.* Anchors are a stated query set (``vec_id`` divisible by 100). They travel in groups to every shelf, a set of
   blocks, as an equi-join on the shelf's number; pairs of groups and blocks whose bounds can't meet are left out of the join.
   A task holds a few groups and one block at a time. First the positives are found, then the negatives: an anchor starts with
   the scores that its own block guarantees, and its limits rise as better rows are found.

A vector's components become floor(256 * x). Rows with a null label, a null vector or a component that is null, NaN or infinite
take no part. A row without id takes part as a positive or negative and comes last among equal scores; its label is not
shifted. Rows that share an id are rows of their own. Vectors of unequal length are filled up with zeros; an empty or zero
vector scores 0 with all. Components must stay within 2**31 and scores within 2**62; beyond, an error says so. Other
columns of the table are not read. An empty table gives no rows.

The reference directions are fitted to a sample of ``SAMPLE`` rows (those with the smallest hashes); every row is indexed, and
the result is exact whatever the directions are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Reference directions, and rows that they are fitted to.
REFERENCES, SAMPLE, ROUNDS = 16, 4096, 6
#: Rows of a block and of a window, anchors of a group, blocks of a shelf, groups that a task keeps open.
BLOCK, WINDOW, GROUP, SHELF, OPEN = 4096, 64, 1024, 64, 16
#: Positives of an anchor, negatives of a positive, and the rows of its own block whose scores an anchor remembers.
POSITIVES, NEGATIVES, KNOWN = 5, 10, 256
ANCHOR = 100
SLACK = 1e-5
NEVER, EVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Integer sums of products below this are exact in double precision, whatever their order.
EXACT = 2.0 ** 53


# ------------------------------------------------------------------ the index

def whole_vectors(batch: pa.RecordBatch, least_width: int = 0) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows that take part, their components as a matrix of whole numbers, and how long each vector is."""
    batch = batch.filter(pc.and_(pc.is_valid(batch.column("vector")), pc.is_valid(batch.column("label"))))
    lists = batch.column("vector")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.ones(len(sizes), bool)
    good[row[~np.isfinite(flat)]] = False
    place = np.cumsum(good) - 1
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = good[row]
    out = np.zeros((int(good.sum()), max(int(sizes.max(initial=0)), least_width)))
    out[place[row[keep]], column[keep]] = np.floor(flat[keep] * 256)
    if np.abs(out).max(initial=0) >= 2 ** 31:
        raise OverflowError("a component of a vector is beyond 2**31 after scaling")
    return batch.filter(pa.array(good)), out, sizes[good]


def fit_references(sample: np.ndarray) -> np.ndarray:
    """Unit directions: centres of a few rounds of spherical k-means, from the first rows of the sample."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((1, max(1, sample.shape[1])))
    centres = unit[:REFERENCES].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ centres.T, axis=1)
        for c in range(len(centres)):
            total = unit[nearest == c].sum(0)
            size = np.linalg.norm(total)
            if size > 1e-9:
                centres[c] = total / size
    return centres


def _indexer(references: np.ndarray):
    def run(batches):
        for batch in batches:
            rows, x, _ = whole_vectors(batch, references.shape[1])
            if not rows.num_rows:
                continue
            r = np.zeros((len(references), x.shape[1]))
            r[:, :references.shape[1]] = references
            norms = np.linalg.norm(x, axis=1)
            angles = np.arccos(np.clip(x @ r.T / np.maximum(norms, 1e-300)[:, None], -1, 1)).astype("<f4")
            near = np.argsort(angles, axis=1, kind="stable")
            ints = np.ascontiguousarray(x.astype("<i4"))
            yield pa.RecordBatch.from_arrays([
                rows.column("id"), rows.column("label"), pa.array([v.tobytes() for v in ints], pa.binary()),
                pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(near[:, 0], pa.int32()),
                pa.array(near[:, min(1, near.shape[1] - 1)], pa.int32()), pa.array(angles[np.arange(len(near)), near[:, 0]])],
                names=["id", "label", "vector", "angles", "first", "second", "angle"])

    return run


def _matrix(parts: list[bytes], kind: str) -> np.ndarray:
    """Binary rows as a matrix; shorter ones are filled up with zeros."""
    rows = [np.frombuffer(p, kind) for p in parts]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), kind)
    if len({len(r) for r in rows}) == 1:
        out[:] = np.stack(rows)
    else:
        for at, r in enumerate(rows):
            out[at, :len(r)] = r
    return out


_BLOCK = ("block bigint, n int, ids binary, known binary, labels binary, vectors binary, angles binary, "
          "low array<float>, high array<float>, least double, most double")


def _corners(angles: np.ndarray, norms: np.ndarray) -> list:
    return [angles.min(0).tolist(), angles.max(0).tolist(), float(norms.min()), float(norms.max())]


def _chunks(batches, names: list[str], size: int) -> Iterator[list[list]]:
    """The columns of ``size`` consecutive rows at a time, as Python lists."""
    held: list[list] = [[] for _ in names]
    for batch in batches:
        for h, n in zip(held, names):
            h.extend(batch.column(n).to_pylist())
        while len(held[0]) >= size:
            yield [h[:size] for h in held]
            held = [h[size:] for h in held]
    if held[0]:
        yield held


def _pack(batches):
    part = TaskContext.get().partitionId()
    for k, (ids, labels, vectors, angles) in enumerate(_chunks(batches, ["id", "label", "vector", "angles"], BLOCK)):
        v, a = _matrix(vectors, "<i4"), _matrix(angles, "<f4")
        norms = np.linalg.norm(v.astype(float), axis=1)
        known = np.array([i is not None for i in ids], np.uint8)
        row = [part << 24 | k, len(ids), np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes(), np.array(labels, "<i8").tobytes(),
               v.tobytes(), a.tobytes(), *_corners(a, norms)]
        yield pa.RecordBatch.from_pylist([dict(zip(_names(_BLOCK), row))], schema=_arrow(_BLOCK))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


class Block:
    """Rows in the order of their angles, with the corners of their windows."""

    def __init__(self, r: dict):
        n = r["n"]
        self.rows = (r["block"] << 12) + np.arange(n)
        self.ids, self.known, self.labels = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["known"], np.uint8) > 0, np.frombuffer(r["labels"], "<i8")
        self.vectors = np.frombuffer(r["vectors"], "<i4").reshape(n, -1).astype(float)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        angles = np.frombuffer(r["angles"], "<f4").reshape(n, -1).astype(float)
        self.angles, at = angles, np.arange(0, n, WINDOW)
        self.low, self.high = np.minimum.reduceat(angles, at), np.maximum.reduceat(angles, at)
        self.least, self.most = np.minimum.reduceat(self.norms, at), np.maximum.reduceat(self.norms, at)


def limits(angles: np.ndarray, norms: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score that each vector can have with a row of each window; what is returned holds all of them."""
    near = np.zeros((len(angles), len(block.low)))
    far = np.full_like(near, math.pi)
    for k in range(angles.shape[1]):
        a, low, high = angles[:, k, None], block.low[None, :, k], block.high[None, :, k]
        np.maximum(near, np.maximum(low - a, a - high), out=near)
        reach = np.where(a + high <= math.pi, a + high, np.where(a + low >= math.pi, 2 * math.pi - a - low, math.pi))
        np.minimum(far, reach, out=far)
    best, worst = np.cos(np.maximum(near - SLACK, 0)), np.cos(np.minimum(far + SLACK, math.pi))
    n, least, most = norms[:, None], block.least[None], block.most[None]
    margin = 1 + 1e-9 * n * most
    upper = n * np.where(best >= 0, most, least) * best + margin
    lower = n * np.where(worst >= 0, least, most) * worst - margin
    return np.floor(lower), np.ceil(upper)


def scores(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Inner products of whole numbers, without rounding. ``reach`` bounds them: the product of the largest norms."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    if reach < EXACT:
        return a @ b.T
    if reach >= 2.0 ** 62:
        raise OverflowError("a score is beyond 2**62")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _anchors(batches):
    """The anchors of each block with what the block guarantees them: their fifth positive and their best other rows."""
    for batch in batches:
        for r in batch.to_pylist():
            b = Block(r)
            at = np.flatnonzero(b.known & (b.ids % ANCHOR == 0))
            if not len(at):
                continue
            s = scores(b.vectors[at], b.vectors, b.norms[at].max() * b.norms.max()).astype(np.int64)
            fifth, others = [], []
            for k, i in enumerate(at):
                same = b.labels == b.labels[i]
                others.append(np.sort(s[k][~same])[::-1][:KNOWN].astype("<i8").tobytes())
                same[i] = False
                mine = np.sort(s[k][same])
                fifth.append(int(mine[-POSITIVES]) if len(mine) >= POSITIVES else None)
            yield pa.RecordBatch.from_arrays([
                pa.array(b.rows[at]), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array([v.astype("<i4").tobytes() for v in b.vectors[at]], pa.binary()),
                pa.array([a.astype("<f4").tobytes() for a in b.angles[at]], pa.binary()), pa.array(fifth, pa.int64()), pa.array(others, pa.binary())],
                names=_names(_ANCHORS))


_ANCHORS = "row bigint, id bigint, label bigint, vector binary, angles binary, fifth bigint, others binary"

# ------------------------------------------------------------------ the search

_GROUP = ("group bigint, size int, a_rows binary, a_ids binary, a_labels binary, a_vectors binary, a_angles binary, a_low array<float>, "
          "a_high array<float>, a_least double, a_most double, floor bigint, of binary, place binary, lowest binary, highest binary, "
          "start binary, pos_id binary, pos_known binary, pos_score binary")


def within(score: int) -> tuple[int, int]:
    """Smallest and largest score s with 30 * score <= 100 * s <= 90 * score."""
    return -(-3 * score // 10), 9 * score // 10


def _group(with_positives: bool):
    """Groups of anchors, and their queries: one for each anchor, or one for each of its positives."""
    names = ["row", "id", "label", "vector", "angles", *(["others", "positives"] if with_positives else ["fifth"])]

    def queries(rest):
        if not with_positives:
            for k, fifth in enumerate(rest[0]):
                yield k, 0, NEVER, EVER, NEVER if fifth is None else fifth, 0, 0, 0
            return
        for k, (others, positives) in enumerate(zip(*rest)):
            best = np.frombuffer(others, "<i8")
            for p in positives:
                low, high = within(p["score"])
                if low > high:
                    continue  # a positive with a negative score has no such rows
                at = int(np.searchsorted(-best, -high)) + NEGATIVES - 1
                yield k, p["place"] - 1, low, high, int(best[at]) if at < len(best) else NEVER, p["other"] or 0, p["other"] is not None, p["score"]

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, (rows, ids, labels, vectors, angles, *rest) in enumerate(_chunks(batches, names, GROUP)):
            asked = list(queries(rest))
            if not asked:
                continue
            of, place, low, high, start, pos, known, score = (np.array(c, "<i8") for c in zip(*asked))
            v, a = _matrix(vectors, "<i4"), _matrix(angles, "<f4")
            norms = np.linalg.norm(v.astype(float), axis=1)
            row = [part << 24 | number, len(rows), *(np.array(c, "<i8").tobytes() for c in (rows, ids, labels)), v.tobytes(), a.tobytes(),
                   *_corners(a, norms), int(np.maximum(low, start).min()), *(c.tobytes() for c in (of, place, low, high, start, pos, known, score))]
            yield pa.RecordBatch.from_pylist([dict(zip(_names(_GROUP), row))], schema=_arrow(_GROUP))

    return run


class Search:
    """The best rows of the queries of one group so far: highest score first, then smallest id, rows without id last."""

    def __init__(self, r: dict, most: int, same: bool):
        self.most, self.same, n = most, same, r["size"]
        self.rows, self.ids, self.labels = (np.frombuffer(r[c], "<i8") for c in ("a_rows", "a_ids", "a_labels"))
        self.vectors = np.frombuffer(r["a_vectors"], "<i4").reshape(n, -1).astype(float)
        self.angles = np.frombuffer(r["a_angles"], "<f4").reshape(n, -1).astype(float)
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.of, self.place, self.low, self.high, start, self.pos, known, self.score = (np.frombuffer(r[c], "<i8") for c in (
            "of", "place", "lowest", "highest", "start", "pos_id", "pos_known", "pos_score"))
        self.pos_known, self.limit = known > 0, np.maximum(self.low, start)
        self.found = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]  # query, score, id, row, known

    def see(self, b: Block) -> None:
        floor, ceiling = np.full(len(self.rows), EVER), np.full(len(self.rows), NEVER)
        np.minimum.at(floor, self.of, self.limit)
        np.maximum.at(ceiling, self.of, self.high)
        lower, upper = limits(self.angles, self.norms, b)
        overlap = (upper >= floor[:, None]) & (lower <= ceiling[:, None])
        windows, anchors = np.flatnonzero(overlap.any(0)), np.flatnonzero(overlap.any(1))
        if not len(windows):
            return
        inside = np.zeros(len(b.rows), bool)
        for w in windows:
            inside[w * WINDOW:(w + 1) * WINDOW] = True
        rows = np.flatnonzero(inside)
        index = np.full(len(self.rows), -1)
        index[anchors] = np.arange(len(anchors))
        for k in range(0, len(rows), GROUP):
            some = rows[k:k + GROUP]
            s = scores(self.vectors[anchors], b.vectors[some], self.norms.max() * b.norms.max())
            fits = (self.labels[anchors, None] == b.labels[None, some]) == self.same
            if self.same:
                fits &= self.rows[anchors, None] != b.rows[None, some]
            got = []
            for p in range(int(self.place.max()) + 1):
                q = np.flatnonzero((self.place == p) & (index[self.of] >= 0))
                at = index[self.of[q]]
                i, j = np.nonzero(fits[at] & (s[at] >= self.limit[q, None]) & (s[at] <= self.high[q, None]))
                got.append((q[i], s[at[i], j].astype(np.int64), b.ids[some[j]], b.rows[some[j]], b.known[some[j]]))
            self.add([np.concatenate(c) for c in zip(*got)])

    def add(self, more: list[np.ndarray]) -> None:
        if not len(more[0]):
            return
        q, s, ids, rows, known = (np.concatenate(c) for c in zip(self.found, more))
        order = np.lexsort((rows, ids, ~known, -s, q))
        first = np.flatnonzero(np.diff(q[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[place < self.most]
        self.found = [x[kept] for x in (q, s, ids, rows, known)]
        full = order[place == self.most - 1]
        limit = self.limit.copy()
        limit[q[full]] = np.maximum(limit[q[full]], s[full])
        self.limit = limit

    def out(self) -> pa.RecordBatch:
        q, s, ids, rows, known = self.found
        of = self.of[q]
        return pa.RecordBatch.from_arrays([
            pa.array(self.rows[of]), pa.array(self.ids[of]), pa.array(self.place[q]), pa.array(self.pos[q], mask=~self.pos_known[q]),
            pa.array(self.score[q]), pa.array(ids, mask=~known), pa.array(s), pa.array(rows)], names=_names(_FOUND))


_FOUND = "row bigint, id bigint, place bigint, positive bigint, positive_score bigint, other bigint, score bigint, other_row bigint"


def _searcher(most: int, same: bool):
    def run(batches):
        held: dict[int, Search] = {}  # whichever side of the join comes in order, a few groups are kept open
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["group"] not in held:
                    if len(held) == OPEN:
                        yield held.pop(next(iter(held))).out()
                    held[r["group"]] = Search(r, most, same)
                held[r["group"]].see(Block(r))
        for search in held.values():
            yield search.out()

    return run


def _search(groups: DataFrame, blocks: DataFrame, shelves: int, most: int, same: bool) -> DataFrame:
    """The best ``most`` rows of each query, by (row, place)."""
    spread = groups.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    laid = blocks.withColumn("b_shelf", F.pmod(F.xxhash64("block"), F.lit(shelves)).cast("int"))
    gaps = F.zip_with(F.zip_with("low", "a_high", lambda x, y: x - y), F.zip_with("a_low", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    near = F.cos(F.greatest(F.array_max(gaps).cast("double") - 2 * SLACK, F.lit(0.0)))
    upper = F.when(near >= 0, F.col("a_most") * F.col("most")).otherwise(F.col("a_least") * F.col("least")) * near
    can = upper + 2 + 2e-9 * F.col("a_most") * F.col("most") >= F.col("floor")
    pairs = spread.join(laid.hint("merge"), (F.col("shelf") == F.col("b_shelf")) & can)
    found = pairs.drop("shelf", "b_shelf", "low", "high", "least", "most", "a_low", "a_high", "a_least", "a_most").mapInArrow(_searcher(most, same), _FOUND)
    order = Window.partitionBy("row", "place").orderBy(F.col("score").desc(), F.col("other").asc_nulls_last(), "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``POSITIVES`` rows of the same label, the best ``NEGATIVES`` rows of another label with 30 to 90 hundredths of the
    positive's score."""
    shifted = F.when(vectors[key] % 7 == 0, (vectors[label].cast("bigint") + 1) % 10).otherwise(vectors[label].cast("bigint"))
    rows = vectors.select(vectors[key].cast("bigint").alias("id"), shifted.alias("label"), vectors[vector].alias("vector"))
    sample = rows.where("label is not null and vector is not null").orderBy(F.xxhash64("id", "vector"), "id").limit(SAMPLE).toArrow()
    parts = [whole_vectors(b)[1] for b in sample.combine_chunks().to_batches()]
    references = fit_references(parts[0] if parts else np.zeros((0, 1)))

    indexed = rows.mapInArrow(_indexer(references), "id bigint, label bigint, vector binary, angles binary, first int, second int, angle float")
    order = ["first", "second", "angle", "id"]
    blocks = stored(indexed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, _BLOCK), "blocks")
    n_blocks = blocks.count()
    shelves = max(1, min(n_blocks, max(3 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n_blocks // SHELF))))
    anchors = stored(blocks.mapInArrow(_anchors, _ANCHORS), "anchors")
    n_groups = max(1, -(-anchors.count() // GROUP))

    groups = anchors.repartitionByRange(n_groups, "row").sortWithinPartitions("row").mapInArrow(_group(False), _GROUP)
    positives = _search(groups, blocks, shelves, POSITIVES, True).select("row", F.struct(F.col("rank").alias("place"), "other", "score").alias("p"))
    positives = positives.groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("positives"))  # of POSITIVES at most
    asked = anchors.join(positives.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row")).drop("__row")
    asked = stored(asked, "queries")
    groups = asked.repartitionByRange(n_groups, "row").sortWithinPartitions("row").mapInArrow(_group(True), _GROUP)
    found = _search(groups, blocks, shelves, NEGATIVES, False)
    return found.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""
