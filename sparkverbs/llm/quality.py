"""Quality rules with thresholds that the data set: quantile sketches per language and source, then a joined filter.

The sketch of a measure is a table of (bucket, count). A bucket holds the values that agree in their leading six bits, so
a quantile is off by less than one part in thirty-two, two sketches merge by adding counts, and the result does not
depend on how rows are spread. A group's fence lies three spreads outside its middle half; it is averaged with the fence
of its language, which counts as ``PRIOR`` rows, so that a small source is not judged by a few rows of its own.

Nulls: null text has no words and fails the base rule; null language or source is a group of its own. Empty text, repeated
rows and empty tables need no special care. Columns other than doc_id, text, lang and source are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows that the fence of the language weighs in the fence of a source.
PRIOR = 100
#: Rejected rows up to which their list is sent to every executor.
SMALL = 1_000_000
#: Spreads between the middle half and a fence.
REACH = 3
#: Measure -> (least spread, whether there is a lower fence too). All measures are whole numbers in thousandths.
MEASURES = {"m_symbols": (50, False), "m_word": (500, True), "m_repeat": (100, False), "m_lines": (100, False),
            "m_upper": (60, False)}


def _repeated(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice. Hashes only tell that no window repeats; the count is
    taken on the words themselves."""
    last = F.size(w) - 3

    def count(_):
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        windows = F.sort_array(F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))

        def covered(s):
            pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(
                a["t"] == b["t"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
            return F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

        return F.when(F.size(F.array_distinct(hashes)) == last + 1, 0).otherwise(
            F.get(F.transform(F.array(windows), covered), F.lit(0)))

    return F.when(F.size(w) < 4, 0).otherwise(count(w))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of every row and the measures that have fences, beside doc_id, lang, source and the columns named."""
    named = ["doc_id", "lang", "source", *keep]
    base = docs.select(*named, F.coalesce(docs["text"], F.lit("")).alias("__t"))
    base = base.select(*named, "__t", words(F.col("__t")).alias("__w"),
                       F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    n, long = F.size("__w"), "long"
    out = base.select(
        *named, n.cast(long).alias("n_words"), F.length(F.array_join("__w", "")).cast(long).alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast(long).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast(long).alias("n_dup_lines"),
        _repeated(F.col("__w")).cast(long).alias("n_repeat_words"), F.size("__l").cast(long).alias("__n_lines"),
        F.length(F.regexp_replace("__t", "[^A-Z]+", "")).cast(long).alias("__n_upper"))

    def share(a, b):
        return F.expr(f"(1000 * {a}) div greatest({b}, 1)")

    return out.select(
        *named, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .alias("base_failed"),
        share("n_symbols", "n_words").alias("m_symbols"), share("word_chars", "n_words").alias("m_word"),
        share("n_repeat_words", "n_words").alias("m_repeat"), share("n_dup_lines", "__n_lines").alias("m_lines"),
        share("__n_upper", "word_chars").alias("m_upper"))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over the rows that pass the base rule."""
    values = rows.where(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x"))
    cut = "greatest(length(bin(x.v)) - 6, 0)"
    return values.groupBy("lang", "source", "x.measure", F.expr(
        f"shiftleft(shiftright(x.v, {cut}), {cut})").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches into those of fewer keys."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """Lower and upper fence of each measure and group, and the number of rows behind them."""
    group = Window.partitionBy(*keys, "measure")
    run = sketch.withColumn("cum", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    q = run.groupBy(*keys, "measure").agg(
        F.max("total").alias("rows"), F.min(F.when(4 * F.col("cum") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("cum") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"))
    least = F.create_map(*[F.lit(x) for m, (s, _) in MEASURES.items() for x in (m, s)])[F.col("measure")]
    spread = REACH * F.greatest(F.col("q3") - F.col("q1"), least)
    return q.select(*keys, "measure", "rows", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row for each language and source: low_<measure> and high_<measure>."""
    sketch = stored(sketches(rows), "sketches")
    own, lang = fences(sketch, "lang", "source"), fences(merged(sketch, "lang"), "lang")
    lang = lang.select(F.col("lang").alias("__lang"), F.col("measure").alias("__measure"), F.col("low").alias("__low"),
                       F.col("high").alias("__high"))
    both = own.join(lang, own["lang"].eqNullSafe(lang["__lang"]) & (own["measure"] == lang["__measure"]))
    mixed = both.select("lang", "source", "measure", *[
        F.expr(f"(rows * {x} + {PRIOR} * __{x}) div (rows + {PRIOR})").alias(x) for x in ("low", "high")])
    return mixed.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{x}_{m}") for m in MEASURES for x in ("low", "high")])


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``kept``: the base rule holds and every measure lies within the fences of its language and source."""
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"),
                           *[c for c in limits.columns if c not in ("lang", "source")])
    met = ~F.col("base_failed")
    for m, (_, lower) in MEASURES.items():
        met = met & F.coalesce(F.col(m) <= F.col(f"high_{m}"), F.lit(True))
        if lower:
            met = met & F.coalesce(F.col(m) >= F.col(f"low_{m}"), F.lit(True))
    return rows.join(limits, rows["lang"].eqNullSafe(limits["__lang"]) & rows["source"].eqNullSafe(limits["__source"]), "left").select(
        *rows.columns, met.alias("kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts, base rule, verdict."""
    rows = stored(measured(docs), "measures")
    return judged(rows, stored(thresholds(rows), "thresholds")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``. Rejected rows are known by id, language, source and a hash of the
    text; their list is broadcast only below ``SMALL`` rows, which is counted first."""
    rows = stored(measured(docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("__hash")), "__hash"), "measures")
    out = judged(rows, stored(thresholds(rows), "thresholds")).where("not kept").select(
        F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("source").alias("__source"), "__hash").distinct()
    out = stored(out, "rejected")
    few = F.broadcast(out) if out.count() <= SMALL else out
    return docs.join(few, docs["doc_id"].eqNullSafe(few["__id"]) & docs["lang"].eqNullSafe(few["__lang"])
                     & docs["source"].eqNullSafe(few["__source"]) & (F.xxhash64(docs["text"]) == few["__hash"]), "left_anti")


SQL = rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
b as (select *, case when len(w) < 3 then [] else list_transform(range(1, len(w) - 1),
        lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end as g from w),
id as materialized (select row_number() over () as r, * from b),
g as (select r, unnest(g) as g, unnest(range(1, len(g) + 1)) as i from id),
dup as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
rep as (select r, count(distinct i + k.k) as n from dup, (values (0), (1), (2)) k(k) group by r),
m as (select r, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
        len(l) as nl, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as up from id left join rep using (r)),
f as materialized (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
        map {{'m_symbols': (1000 * n_symbols) // greatest(n_words, 1), 'm_word': (1000 * word_chars) // greatest(n_words, 1),
        'm_repeat': (1000 * n_repeat_words) // greatest(n_words, 1), 'm_lines': (1000 * n_dup_lines) // greatest(nl, 1),
        'm_upper': (1000 * up) // greatest(word_chars, 1)}} as v from m),
x as (select lang, source, unnest(map_entries(v), recursive := true) from f where not base_failed),
s as (select lang, source, key as measure, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) as bucket,
        count(*) as n from x group by all),
lim as (select * from (values {', '.join(f"('{m}', {s}, {str(lo).lower()})" for m, (s, lo) in MEASURES.items())}) p(measure, least, lower)),
own as (select lang, source, measure, max(total) as total, min(bucket) filter (4 * cum >= total) as q1,
        min(bucket) filter (4 * cum >= 3 * total) as q3 from (select *, sum(n) over (partition by lang, source, measure order by bucket) as cum,
        sum(n) over (partition by lang, source, measure) as total from s) group by all),
al as (select lang, measure, bucket, sum(n) as n from s group by all),
lg as (select lang, measure, min(bucket) filter (4 * cum >= total) as q1, min(bucket) filter (4 * cum >= 3 * total) as q3 from
        (select *, sum(n) over (partition by lang, measure order by bucket) as cum, sum(n) over (partition by lang, measure) as total from al)
        group by all),
th as (select o.lang, o.source, p.measure, p.lower,
        trunc((o.total * (o.q1 - {REACH} * greatest(o.q3 - o.q1, least)) + {PRIOR} * (g.q1 - {REACH} * greatest(g.q3 - g.q1, least))) / (o.total + {PRIOR})) as low,
        trunc((o.total * (o.q3 + {REACH} * greatest(o.q3 - o.q1, least)) + {PRIOR} * (g.q3 + {REACH} * greatest(g.q3 - g.q1, least))) / (o.total + {PRIOR})) as high
        from own o join lg g on o.lang is not distinct from g.lang and o.measure = g.measure join lim p on p.measure = o.measure),
bad as (select f.r from f join th on th.lang is not distinct from f.lang and th.source is not distinct from f.source
        where f.v[th.measure] > th.high or (th.lower and f.v[th.measure] < th.low))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and r not in (select r from bad) as kept from f
"""
