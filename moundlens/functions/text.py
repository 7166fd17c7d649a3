"""Labels built from text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def _or_na(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("NA"))


def count_label(balls: str = "Balls", strikes: str = "Strikes") -> Column:
    """'2-1'; a missing side is written as NA."""
    return F.concat(_or_na(balls), F.lit("-"), _or_na(strikes))


def name_parts(name: str = "Pitcher") -> tuple[Column, Column]:
    """(first, last) of 'Last, First'; cut at the first comma only."""
    parts = F.split(F.col(name), ",", 2)
    first = F.when(F.col(name).isNotNull(), F.coalesce(F.trim(F.get(parts, 1)), F.lit("")))
    return first, F.get(parts, 0)


def keep_levels(col: Column, levels: tuple[str, ...]) -> Column:
    """The label itself when it is listed, else NULL."""
    return F.when(col.isin(*levels), col)


def level_rank(col: Column, levels: tuple[str, ...]) -> Column:
    """Position of a label in its fixed order; NULL when not listed."""
    first, *rest = levels
    return reduce(
        lambda chain, item: chain.when(col == item[1], F.lit(item[0])),
        enumerate(rest, start=1),
        F.when(col == first, F.lit(0)),
    )


def group_label(col: Column, groups: dict[str, tuple[str, ...]], default: str) -> Column:
    """Name of the group a value belongs to; `default` for the others, NULL included."""
    (head, members), *rest = groups.items()
    chain = F.when(col.isin(*members), F.lit(head))
    for label, values in rest:
        chain = chain.when(col.isin(*values), F.lit(label))
    return chain.otherwise(F.lit(default))
