"""Text functions: first-match edits, title case, padding, tokens, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .nulls import ColumnOrName, as_col

WORD = r"([\p{L}\p{M}\p{N}]+(?:['’.][\p{L}\p{M}\p{N}]+)*)"
LETTER_RUNS = r"([\p{L}\p{M}\p{N}'’]+|[^\p{L}\p{M}\p{N}'’]+)"
CELL_SEPARATOR = r"[^\p{L}\p{M}\p{N}.]+"


def title_case(c: ColumnOrName) -> Column:
    """Capitalise every word, where hyphens and other marks also end a word."""
    runs = F.regexp_extract_all(as_col(c), F.lit(LETTER_RUNS), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def replace_first(c: ColumnOrName, pattern: str, replacement: str = "") -> Column:
    """Replace only the first match. ``$n`` in the replacement refers to group n of ``pattern``."""
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m.group(1)) + 1}", replacement)
    return F.regexp_replace(as_col(c), rf"^([\s\S]*?)(?:{pattern})", "$1" + shifted)


def remove_first(c: ColumnOrName, pattern: str) -> Column:
    return replace_first(c, pattern)


def replace_all(c: ColumnOrName, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(as_col(c), pattern, replacement)


def extract_first(c: ColumnOrName, pattern: str) -> Column:
    """First match, or null if there is none."""
    return F.regexp_substr(as_col(c), F.lit(pattern))


def pad_left(c: ColumnOrName, width: int, pad: str = " ") -> Column:
    """Left pad that never cuts longer text."""
    c = as_col(c).cast("string")
    return F.when(F.char_length(c) >= width, c).otherwise(F.lpad(c, width, pad))


def split_first(c: ColumnOrName, separator: str = " ") -> Column:
    return F.split(as_col(c), re.escape(separator))[0]


def paste(*parts: ColumnOrName, sep: str = "", na: str | None = "NA") -> Column:
    """Join parts as text. Null becomes the text ``na``; with ``na=None`` the result is null."""
    cols = [as_col(p).cast("string") for p in parts]
    if na is not None:
        cols = [F.coalesce(c, F.lit(na)) for c in cols]
    if sep:
        cols = [x for c in cols for x in (F.lit(sep), c)][1:]
    return F.concat(*cols)


def words(c: ColumnOrName) -> Column:
    """Lower-case words of a text as an array; ``don't`` and ``3.5`` stay whole."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(WORD), F.lit(1))


def cells(c: ColumnOrName, separator: str = CELL_SEPARATOR) -> Column:
    """Pieces of a delimited cell as an array."""
    return F.split(as_col(c), separator)


def classify(c: ColumnOrName, rules: list[tuple[str, str]], default: Column | str | None = None) -> Column:
    """Label of the first regular expression that is found in the text."""
    c, chain = as_col(c), F
    for pattern, label in rules:
        chain = chain.when(c.rlike(pattern), F.lit(label))
    return chain.otherwise(c if default is None else default)


def format_count(c: ColumnOrName, digits: int = 0) -> Column:
    """Number with thousands marks."""
    return F.format_number(as_col(c), digits)


def format_fixed(c: ColumnOrName, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", as_col(c).cast("double"))


def format_percent(c: ColumnOrName, digits: int = 0) -> Column:
    """Share in 0..1 as percent text."""
    return F.concat(format_fixed(F.bround(as_col(c) * 100, digits), digits), F.lit("%"))


def hex_byte(c: ColumnOrName) -> Column:
    """Integer 0..255 as two lower-case hex digits."""
    return F.lpad(F.lower(F.hex(as_col(c).cast("int"))), 2, "0")


def format_kg(grams: ColumnOrName) -> Column:
    """Mass label in kilograms: one decimal below 100 kg, none from there on; half-even."""
    kg = as_col(grams) / 1000
    light, heavy = F.format_string("%.1fkg", F.bround(kg, 1)), F.format_string("%dkg", F.bround(kg, 0).cast("long"))
    return F.when(kg < 100, light).otherwise(heavy)
