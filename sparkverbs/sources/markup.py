"""Rows from HTML text by pattern, whole documents at a time and without a UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def extract_attribute(df: DataFrame, html: str, attribute: str, name: str | None = None, tag: str = "[a-zA-Z]+") -> DataFrame:
    """One row per quoted value of an attribute, with its position in the document, in place of the HTML."""
    pattern = rf"<{tag}\s[^>]*?{attribute}=\"([^\"]*)\""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return df.select(*[c for c in df.columns if c != html], F.posexplode(found).alias("position", name or attribute))


def with_tag(df: DataFrame, json: str, key: str, values: list, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows whose JSON property ``key`` is one of the values, inside the bounds of other columns."""
    test = F.get_json_object(F.col(json), f"$.{key}").isin([str(v) for v in values])
    for column, (low, high) in (bounds or {}).items():
        test = test & F.col(column).between(low, high)
    return df.where(test)
