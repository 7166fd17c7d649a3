"""Rounding, exact sums and means, percent text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Measures are summed as whole multiples of 1 / SUM_SCALE, in two parts of 64 bits that are put
# together as a decimal: exact for any number of rows, so no order of merging changes the result.
SUM_SCALE = 1e9
_LOW = float(1 << 30)


def round_half_up(col: Column, digits: int) -> Column:
    """Round to `digits` places, halves of the binary value upward, the same in every engine.

    The built-in `round` goes through decimal text and decides near-ties differently elsewhere.
    """
    scale = F.lit(float(10**digits))
    return F.floor(col * scale + F.lit(0.5)) / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL for an empty whole."""
    return F.try_divide(part, whole)


def not_nan(col: Column) -> Column:
    """The value, or NULL for NaN: a measurement that is not a number was not made."""
    return F.when(~F.isnan(col.cast("double")), col.cast("double"))


def scaled_sum(col: Column) -> Column:
    """Sum in units of 1 / SUM_SCALE, as a decimal without fraction."""
    units = F.rint(not_nan(col) * F.lit(SUM_SCALE))
    high = F.floor(units / F.lit(_LOW))
    low = (units - high * F.lit(_LOW)).cast("long")
    high_sum, low_sum = F.sum(high.cast("long")).cast("decimal(19,0)"), F.sum(low)
    return (high_sum * F.lit(1 << 30).cast("decimal(10,0)") + low_sum.cast("decimal(19,0)")).cast("decimal(38,0)")


def unscaled(total: Column) -> Column:
    return total.cast("double") / F.lit(SUM_SCALE)


def exact_sum(col: Column) -> Column:
    return unscaled(scaled_sum(col))


def exact_mean(col: Column) -> Column:
    return unscaled(ratio(scaled_sum(col).cast("double"), F.count(not_nan(col))))


def strict_mean(value: Column, where: Column) -> Column:
    """Mean over the rows chosen by `where`; NULL as soon as the choice or a chosen value is unknown."""
    unknown = F.count_if(where.isNull() | (where & value.isNull()))
    return F.when(unknown == 0, F.avg(F.when(where, value)))


def percent_text(share: Column) -> Column:
    """0.1234 -> '12.3%'."""
    tenths = F.floor(share * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)
    return F.when(share.isNotNull(), F.format_string("%.1f%%", tenths))
