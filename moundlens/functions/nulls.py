"""Missing-value rules that plain Spark operators do not give by themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def if_known(cond: Column, yes, no) -> Column:
    """Two-way choice that stays NULL when the condition is unknown."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def in_set(col: Column, values: Iterable[str]) -> Column:
    """Membership that is FALSE, not unknown, for NULL."""
    return F.coalesce(col.isin(*values), F.lit(False))


def flag(cond: Column) -> Column:
    """1, 0 or NULL from a condition."""
    return cond.cast("int")


def within(col: Column, low: float, high: float) -> Column:
    return col.between(F.lit(float(low)), F.lit(float(high)))


def in_box(box: tuple[float, float, float, float]) -> Column:
    """Plate location inside a (height low, high, side low, high) box; NULL when not decidable."""
    low, high, left, right = box
    return within(F.col("PlateLocHeight"), low, high) & within(F.col("PlateLocSide"), left, right)
