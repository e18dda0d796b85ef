"""Benchmark decontamination: SimHash fingerprints of item-sized windows, Hamming search by several indexes, exact check.

1. *Windows.* A window has as many words as a benchmark item, or is the whole text if that has fewer. It is in place where a
   text shares a shingle with an item that lies at the same place in both; where the item would hang over an end of the text,
   the window is the first or the last of the text. All other positions are looked at too: a window whose similarity suffices
   shares so many of its shingles with items of its size (``least_shared``) that a count of these, taken along the text for
   every start, leaves out none; so an item is found whose parts have changed places. Windows are addressed by size and start
   only, whatever the number of items that share the shingle.
2. *Fingerprints.* 64 bits, each the sign of a sum over the weighted shingles of the window, that is its shingles numbered by
   occurrence. So the similarity of the check is that of two plain sets, and similar windows agree in at least 2s / (1 + s) of
   their shingles, wherever words were changed.
3. *Search.* With that share c, a bit differs with probability acos(c) / pi. ``RADIUS`` is the smallest number of bits that at
   most ``LOSS`` of the pairs at the least similarity exceed. Fingerprints are cut into ``BLOCKS`` blocks; two within the radius
   differ in at most ``NEAR`` bits of one block at least. Items are listed under all values so near to theirs, windows
   under their own, and they meet by an equi-join on size, block and value; then differing bits are counted. Only pairs within
   the radius go on.
4. *Check.* Weighted shingle similarity, sum of the least over sum of the largest counts of ``K``-word shingles (an item of
   fewer words is one shingle), of the window and the item, at least ``SIMILARITY``.
5. *Hits.* Every window in place is stated, and every other window, unless it overlaps one in place that reproduces the same
   item: that is the same copy, read a few words too early or too late.

Everything is built from DataFrame functions. Words are split at space and the controls 9 to 13, and lower-cased. The
benchmark's shingles and the ids of documents with windows are broadcast only below ``SMALL`` rows, which is counted first;
beyond, Spark joins by shuffling.

Null or empty text or items have no words and no hits. Repeated rows and ids: hits are stated once for each id, and rows without
id share the null one. Empty tables give no rows; further columns aren't read by ``hits``, and ``clean`` keeps them.

The SQL text makes the windows in place only and compares each with all items of its size, without fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

K = 5
SIMILARITY = (80, 100)
#: Share of the pairs at the least similarity that may lie outside the radius.
LOSS = 0.001
BLOCKS = 5
SMALL = 500_000


def radius(similarity: tuple[int, int], loss: float) -> int:
    """Differing bits of 64 that pairs at this similarity exceed with a probability of at most ``loss``."""
    p, q = similarity
    bit = math.acos(2 * p / (p + q)) / math.pi
    tail, r = 1.0, -1
    while tail > loss:
        r += 1
        tail -= math.comb(64, r) * bit ** r * (1 - bit) ** (64 - r)
    return r


RADIUS = radius(SIMILARITY, LOSS)
#: Differing bits of the nearest block of two fingerprints within the radius, at most.
NEAR = RADIUS // BLOCKS


def shingle_hashes(w: Column, k: int) -> Column:
    """64-bit hash of every shingle, in order. The words are bound once, or each step would split the text again."""
    return F.get(F.transform(F.array(w), lambda a: F.when(F.size(a) < k, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(a) - k), lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(k)])))), F.lit(0))


def shingles(w: Column, k: Column) -> Column:
    """The shingles of a window as text."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))


def fingerprints(rows: DataFrame, w: str, k: str, name: str) -> DataFrame:
    """Add the SimHash of the weighted shingles of ``w``: a bit is set if more than half of their hashes have it."""
    numbered = F.get(F.transform(F.array(shingles(F.col(w), F.col(k))), lambda s: F.transform(s, lambda x, i: F.xxhash64(
        x, F.size(F.filter(F.slice(s, F.lit(1), i + 1), lambda y: y == x))))), F.lit(0))
    bits = F.expr("aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * size(filter(__hashes, h -> "
                  "(shiftrightunsigned(h, b) & 1L) = 1L)) > size(__hashes), shiftleft(1L, b), 0L))")
    return rows.withColumn("__hashes", numbered).withColumn(name, bits).drop("__hashes")


def blocks(bits: Column, near: int = 0) -> Column:
    """(block, value) of the blocks of a fingerprint, with all values that differ from them in at most ``near`` bits."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]

    def block(i: int) -> Column:
        top = F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("long")
        value, none = F.shiftrightunsigned(bits, edges[i]).bitwiseAND(top), F.lit(0).cast("long")
        flips = F.filter(F.sequence(none, top), lambda m: F.bit_count(m) <= near) if near else F.array(none)
        return F.transform(flips, lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*[block(i) for i in range(BLOCKS)])


def similarity(w: str, item: str, k: str) -> Column:
    """(low, high): sums of the least and of the largest counts of the shingles of two windows. Values are bound by
    transforming arrays of one element, so that each is worked out once."""
    def bound(value, f):
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def count(some, x):
        return F.size(F.filter(some, lambda y: y == x))

    def sums(v):
        counts = F.transform(F.array_distinct(F.concat(v["a"], v["b"])), lambda x: F.struct(
            count(v["a"], x).alias("a"), count(v["b"], x).alias("b")))
        return bound(counts, lambda c: F.struct(*[
            F.aggregate(F.transform(c, pick), F.lit(0), lambda t, x: t + x).alias(name)
            for name, pick in (("low", lambda x: F.least(x["a"], x["b"])), ("high", lambda x: F.greatest(x["a"], x["b"])))]))

    return bound(F.struct(shingles(F.col(w), F.col(k)).alias("a"), shingles(F.col(item), F.col(k)).alias("b")), sums)


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast a table that has been counted and is small; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.count() <= SMALL else df


def least_shared(size: str, k: int) -> Column:
    """Shingles that two windows of ``size`` words share at least if they reach ``SIMILARITY``: they have equally many."""
    p, q = SIMILARITY
    return F.expr(f"int((2 * {p} * ({size} - {k - 1}) + {p + q - 1}) div {p + q})")


def moved(shared: DataFrame, k: int) -> DataFrame:
    """(id, of, size, start) of all windows with at least ``least_shared`` shingles of items of their size, from (id, of, n, size, p):
    the places p of these shingles in a text of n words."""
    at = shared.where("n >= size").withColumn("least", least_shared("size", k))
    at = at.groupBy("id", "of", "n", "size", "least").agg(F.sort_array(F.collect_set("p")).alias("at")).where(F.size("at") >= F.col("least"))
    # the i-th place and the least - 1 that follow lie in one window: it starts at the first of them at the latest
    ends = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("least")), lambda i: F.struct(
        F.greatest(F.get("at", i + F.col("least") - 1) - F.col("size") + k, F.lit(0)).alias("low"),
        F.least(F.get("at", i), F.col("n") - F.col("size")).alias("high")))
    ranges = at.select("id", "of", "size", F.explode(ends).alias("x")).where("x.low <= x.high")
    return ranges.select("id", "of", "size", F.explode(F.sequence("x.low", "x.high")).alias("start")).distinct()


def windows(docs: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """(id, of, size, start, placed, w), the windows of the documents for items of a size, see above. ``of`` is a hash of the text,
    which tells rows of the same id or without id apart; ``placed`` says that the window is in place."""
    found = None
    for k in sorted(r[0] for r in items.select("k").distinct().collect()):  # at most K values
        grams = items.where(F.col("k") == k).select("size", F.posexplode(shingle_hashes(F.col("w"), k)).alias("q", "h")).distinct()
        grams = _checked(stored(grams, "item-shingles"))
        rows = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("of"), words(F.lower(docs[text])).alias("w"))
        rows = rows.select("id", "of", F.size("w").alias("n"), shingle_hashes(F.col("w"), k).alias("hs"))
        hit = rows.select("id", "of", "n", F.posexplode("hs").alias("p", "h")).join(grams, "h")
        hit = stored(hit.select("id", "of", "n", "size", "p", F.expr("greatest(0, least(p - q, n - size))").alias("start")).distinct(), "shared")
        hit = hit.select("id", "of", "size", "start", F.lit(True).alias("placed")).unionByName(moved(hit, k).withColumn("placed", F.lit(False)))
        found = hit if found is None else found.unionByName(hit)
    found = stored(found.groupBy("id", "of", "size", "start").agg(F.max("placed").alias("placed")), "windows")
    ids = found.groupBy(F.col("id").alias("__id"), F.col("of").alias("__of")).agg(F.collect_set(F.struct("size", "start", "placed")).alias("at"))
    ids = _checked(stored(ids, "window-ids"))
    rows = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("of"), docs[text].alias("t"))
    rows = rows.join(ids, F.col("id").eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of")))
    rows = rows.select("id", "of", words(F.lower("t")).alias("w"), "at")
    rows = rows.select("id", "of", F.explode(F.transform("at", lambda x: F.struct(
        x["size"].alias("size"), x["start"].alias("start"), x["placed"].alias("placed"), F.slice("w", x["start"] + 1, x["size"]).alias("w")))).alias("x"))
    return rows.select("id", "of", "x.*").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """(key, item, start, n_words, similarity) of every window that reproduces an item, but for those beside one in place, see
    above; similarity in thousandths, rounded down, start counted in words from 0."""
    items = benchmark.select(benchmark[item_key].alias("item"), words(F.lower(benchmark[item_text])).alias("w")).distinct()
    items = items.where(F.size("w") > 0).select("item", "w", F.size("w").alias("size"), F.least(F.size("w"), F.lit(K)).alias("k"),
                                                F.xxhash64("w").alias("item_of"))
    items = stored(items, "items")
    if items.isEmpty():
        return _result(docs, benchmark, key, item_key)
    found = windows(docs, items, key, text).withColumn("k", F.least("size", F.lit(K)))
    found = stored(fingerprints(found, "w", "k", "bits").drop("k"), "fingerprints")
    known = stored(fingerprints(items, "w", "k", "item_bits"), "item-fingerprints").withColumnRenamed("w", "item_w")
    left = found.select("id", "of", "start", "size", "bits", F.explode(blocks(F.col("bits"))).alias("at")).select("*", "at.*").drop("at")
    right = known.select("item_of", "size", "item_bits", F.explode(blocks(F.col("item_bits"), NEAR)).alias("at")).select("*", "at.*").drop("at").distinct()
    near = left.join(right, ["size", "block", "value"]).where(F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits"))) <= RADIUS)
    near = stored(near.select("id", "of", "start", "size", "item_of").distinct(), "near")
    pair = near.join(found, near["id"].eqNullSafe(found["id"]) & (near["of"] == found["of"]) & (near["start"] == found["start"])
                     & (near["size"] == found["size"])).select(
        near["id"], near["of"], near["start"], F.size("w").alias("size"), "placed", "item_of", "w")
    pair = pair.join(known.select("item", "item_of", "item_w", "k"), "item_of")
    # stored before the filter, which would otherwise work out the shingles anew for each of its parts
    pair = stored(pair.select("id", "of", "start", "size", "item", "placed", similarity("w", "item_w", "k").alias("s")), "compared")
    pair = stored(pair.select("id", "of", "start", "size", "item", "placed", "s.*").where(
        SIMILARITY[1] * F.col("low") >= SIMILARITY[0] * F.col("high")).distinct(), "reproduced")
    other = pair.where("placed").select(*[F.col(c).alias(f"__{c}") for c in ("id", "of", "start", "size", "item")])
    beside = pair["id"].eqNullSafe(F.col("__id")) & (pair["of"] == F.col("__of")) & pair["item"].eqNullSafe(F.col("__item"))
    beside = beside & (pair["start"] < F.col("__start") + F.col("__size")) & (F.col("__start") < pair["start"] + pair["size"])
    alone = pair.where("not placed").join(other, beside, "left_anti")
    pair = pair.where("placed").unionByName(alone).drop("of", "placed").distinct()
    return pair.select(F.col("id").alias(key), F.col("item").alias(item_key), F.col("start").cast("long").alias("start"),
                       F.col("size").cast("long").alias("n_words"), F.expr("1000L * low div high").alias("similarity"))


def _result(docs: DataFrame, benchmark: DataFrame, key: str, item_key: str) -> DataFrame:
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    return docs.sparkSession.createDataFrame(
        [], f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, start bigint, n_words bigint, similarity bigint")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id has no hit; rows without id stay."""
    bad = stored(hits(docs, benchmark, key, text).select(F.col(key).alias("__id")).distinct(), "contaminated")
    return docs.join(_checked(bad), docs[key] == F.col("__id"), "left_anti")


SQL = rf"""
with b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
i as (select distinct item_id, w, len(w) as size, least(len(w), {K}) as k from b where len(w) > 0),
d as (select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
        from documents),
ig as (select distinct size, k, unnest(range(0, size - k + 1)) as q, unnest(list_transform(range(0, size - k + 1),
        lambda p: array_to_string(w[p + 1:p + k], ' '))) as g from i),
ks as (select distinct k from i),
dg as (select row, len(w) as n, k, unnest(range(0, greatest(len(w) - k + 1, 0))) as p, unnest(list_transform(range(0, greatest(len(w) - k + 1, 0)),
        lambda p: array_to_string(w[p + 1:p + k], ' '))) as g from d, ks),
hit as (select distinct dg.row, size, ig.k, greatest(0, least(p - q, n - size)) as start from dg join ig on dg.g = ig.g and dg.k = ig.k),
win as (select hit.*, doc_id, w[start + 1:start + size] as v from hit join d using (row)),
x as (select doc_id, item_id, start, len(v) as n_words, list_transform(range(0, len(v) - win.k + 1), lambda p: array_to_string(v[p + 1:p + win.k], ' ')) as a,
        list_transform(range(0, i.size - i.k + 1), lambda p: array_to_string(i.w[p + 1:p + i.k], ' ')) as b
        from win join i on i.size = win.size),
y as (select doc_id, item_id, start, n_words,
        list_sum(list_transform(list_distinct(list_concat(a, b)), lambda s: least(len(list_filter(a, lambda z: z = s)), len(list_filter(b, lambda z: z = s))))) as low,
        list_sum(list_transform(list_distinct(list_concat(a, b)), lambda s: greatest(len(list_filter(a, lambda z: z = s)), len(list_filter(b, lambda z: z = s))))) as high from x)
select distinct doc_id, item_id, start::bigint as start, n_words::bigint as n_words, (1000 * low // high)::bigint as similarity from y
where {SIMILARITY[1]} * low >= {SIMILARITY[0]} * high
"""
