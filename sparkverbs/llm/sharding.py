"""Shards by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split on one more bit.

A bucket with local depth d holds the rows whose keys share the first d bits of their hash. Starting from one bucket, a
bucket that exceeds the byte limit splits on its next bit. So the bucket of a row is the shortest prefix of its hash
whose rows fit the limit, which is found for all rows at once from the byte sums of prefixes. The hash has ``BITS`` bits.
Sums start at a depth at which buckets are small, so the prefix table is far smaller than the rows; only the prefixes
that are still oversized there go deeper.

Rows whose hashes agree in all bits (repeated keys) can't be told apart by more bits. If they exceed the limit together,
they go to overflow pages of their bucket, as in the textbook structure: row sizes are added up along a second hash, and
every half limit starts a page. A single row above half the limit has a page of its own, above the limit an oversized one.

Nulls: a null key counts as the empty string, null text as zero bytes. Empty tables give no rows. Other columns of the
input, whatever their names, aren't read by ``assign``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_sum
from .common import stored

BITS = 60
LIMIT = 1 << 20
#: Bits that prefixes beyond the first table get in one go.
STEP = 8


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _leaves(hashes: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows) of every bucket of the directory."""
    total = hashes.agg(F.sum("bytes")).first()[0] or 0
    base, done, open_rows = 0, None, hashes
    depth = min(BITS, max(1, math.ceil(math.log2(total / limit + 1)) + 4))
    while True:
        fine = open_rows.groupBy(F.shiftright("h", BITS - depth).alias("p")).agg(
            F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        steps = fine.select("p", "bytes", "n", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"))
        sums = steps.groupBy("depth", F.expr(f"shiftright(p, {depth} - depth)").alias("prefix")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        sums = stored(sums, "prefixes")
        over = sums.where(F.col("shard_bytes") > limit)
        fits = sums.where(F.col("shard_bytes") <= limit)
        # a bucket exists if it is the first, or its parent was split
        parents = over.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(
            F.shiftleft("prefix", 1), F.shiftleft("prefix", 1) + 1)).alias("prefix"))
        first = fits.where(F.col("depth") == 0) if base == 0 else fits.where("false")
        above = first.unionByName(fits.join(parents, ["depth", "prefix"], "left_semi"))
        done = above if done is None else done.unionByName(above)
        deep = over.where(F.col("depth") == depth).select("prefix")
        if depth == BITS or deep.isEmpty():
            return done.unionByName(over.where(F.col("depth") == BITS)) if depth == BITS else done
        narrowed = open_rows.withColumn("prefix", F.shiftright("h", BITS - depth)).join(deep, "prefix", "left_semi").drop("prefix")
        open_rows, base, depth = stored(narrowed, "deep"), depth, min(BITS, depth + STEP)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """The buckets for rows of (h, bytes)."""
    return _leaves(rows.withColumn("n", F.lit(1)), limit)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, carry: bool = False) -> DataFrame:
    """(key, n_bytes, shard, depth, page, shard_bytes) for every row, and the row itself as ``row`` if ``carry``.

    ``shard`` shows the prefix bits. ``page`` is 0 but in a bucket of equal hashes above the limit, whose ``shard_bytes``
    are those of the bucket.
    """
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = stored(docs.select(docs[key].alias("key"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("bytes"),
                              hash_bits(docs[key]).alias("h"), F.xxhash64(docs[text]).alias("twin"), *row), "hashed")
    leaves = stored(directory(rows.select("h", "bytes"), limit), "directory")
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most BITS + 1 values
    pick = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths or [0]])
    placed = rows.withColumn("at", F.explode(pick)).select(*rows.columns, "at.*").join(leaves, ["depth", "prefix"])
    shard = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    out = placed.select(*rows.columns, shard.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes")
    chained = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit)
    paged = out.where(~chained).withColumn("page", F.lit(0).cast("long"))
    if BITS in depths:
        paged = paged.unionByName(_pages(out.where(chained), limit))
    return paged.select(F.col("key").alias(key), F.col("bytes").alias("n_bytes"), "shard", "depth", "page", "shard_bytes",
                        *["row"] * carry)


def _pages(over: DataFrame, limit: int) -> DataFrame:
    """Overflow pages: sizes are added up over the whole table in (hash, twin) order, without a task for each hash."""
    half = limit // 2
    sums = running_sum(over, "bytes", ["h", "twin", "bytes"], name="__upto")
    first = sums.groupBy("h").agg(F.min(F.col("__upto") - F.col("bytes")).alias("__from"))
    page = F.expr(f"(__upto - bytes - __from) div {half}")
    return sums.join(first, "h").withColumn("page", F.when(F.col("bytes") > half, -1 - page).otherwise(page)).drop("__upto", "__from")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Write the rows into one folder for each shard and page."""
    rows = assign(docs, key, text, limit, carry=True).select("shard", "page", "row")
    rows.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)


SQL = f"""
with d as (select doc_id, coalesce(strlen(text), 0) as b,
        ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (select k.depth, h >> ({BITS} - k.depth) as p, sum(b) as shard_bytes from d, range(0, {BITS} + 1) k(depth) group by all),
l as (select doc_id, b, h, min(s.depth) as depth from d, s where s.p = d.h >> ({BITS} - s.depth) and s.shard_bytes <= {LIMIT} group by all)
select doc_id, b::bigint as n_bytes, case when l.depth = 0 then '' else lpad(bin(h >> ({BITS} - l.depth)), l.depth::int, '0') end as shard,
        l.depth::int as depth, 0::bigint as page, shard_bytes::bigint as shard_bytes
from l join s on s.depth = l.depth and s.p = l.h >> ({BITS} - l.depth)
"""
