"""Missing-value rules for predicates, conditionals, aggregates and casts.

Spark follows SQL three-valued logic and runs in ANSI mode. Exploratory data work expects
other defaults: membership is never null, a conditional with a null test is null, an aggregate
over a null is null unless told otherwise, and a failed cast is null. These helpers state
those rules as plain expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c: ColumnOrName, values: Iterable) -> Column:
    """Membership that is never null; a null value matches only if ``None`` is listed."""
    c, values = as_col(c), list(values)
    listed = [v for v in values if v is not None]
    hit = F.coalesce(c.isin(listed), F.lit(False)) if listed else F.lit(False)
    return hit | c.isNull() if len(listed) < len(values) else hit


def not_in_set(c: ColumnOrName, values: Iterable) -> Column:
    """Complement of :func:`in_set`: rows with a null value are kept."""
    return ~in_set(c, values)


def if_else(test: Column, yes, no) -> Column:
    """Two-way conditional; a null test gives null instead of the ``no`` branch."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(test, yes).when(~test, no)


def case_when(*branches: tuple[Column, object], default=None) -> Column:
    """First branch whose test is true; a null test does not match; no match gives ``default``."""
    chain = F
    for test, value in branches:
        chain = chain.when(test, value if isinstance(value, Column) else F.lit(value))
    return chain if default is None else chain.otherwise(default)


def strict(c: ColumnOrName, aggregate: Column) -> Column:
    """Null if any input of the group is null, else ``aggregate``."""
    return F.when(F.count(as_col(c)) == F.count(F.lit(1)), aggregate)


def sum_of(c: ColumnOrName, na_rm: bool = False) -> Column:
    return F.sum(as_col(c)) if na_rm else strict(c, F.sum(as_col(c)))


def mean_of(c: ColumnOrName, na_rm: bool = False) -> Column:
    return F.avg(as_col(c)) if na_rm else strict(c, F.avg(as_col(c)))


def min_of(c: ColumnOrName, na_rm: bool = False) -> Column:
    return F.min(as_col(c)) if na_rm else strict(c, F.min(as_col(c)))


def max_of(c: ColumnOrName, na_rm: bool = False) -> Column:
    return F.max(as_col(c)) if na_rm else strict(c, F.max(as_col(c)))


def n_distinct(c: ColumnOrName) -> Column:
    """Distinct count in which null counts as one value."""
    c = as_col(c)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def any_present(*cols: ColumnOrName) -> Column:
    return F.coalesce(*[as_col(c) for c in cols]).isNotNull()


def fill(c: ColumnOrName, value, floating: bool = True) -> Column:
    """Replace null, and NaN for floating columns, by a constant."""
    c = as_col(c)
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")) if floating else c, F.lit(value))


def safe_cast(c: ColumnOrName, data_type: str) -> Column:
    return as_col(c).try_cast(data_type)


def same(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Equality in which null equals null."""
    return as_col(a).eqNullSafe(as_col(b))


def same_text(c: ColumnOrName, value) -> Column:
    """Compare a text column with a number the way dynamic languages do: as text."""
    return as_col(c).cast("string") == F.lit(str(value))
