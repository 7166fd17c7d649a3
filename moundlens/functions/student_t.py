"""Two-sided p-value of Student's t as a column expression."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

_STEPS = 2000  # Simpson intervals, even


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|): one minus the density integrated over [-|t|, |t|].

    With u = sqrt(df) * tan(a) the density becomes cos(a)**(df - 1) up to a constant, a bounded
    integrand whose full integral over (-pi/2, pi/2) supplies the constant, so no gamma function
    is needed. Meant for result rows, a handful per fit.
    """
    limit = F.atan(F.abs(t) / F.sqrt(df))
    half = F.lit(pi / 2)
    # beyond `reach` the integrand is below exp(-50), so the grid stays on the visible part
    reach = F.least(half, F.sqrt(F.lit(100.0) / F.greatest(df - 1, F.lit(1.0))))
    return F.when(
        t.isNotNull(),
        F.greatest(
            F.lit(0.0),
            F.lit(1.0) - _cosine_power(F.least(limit, reach), df) / _cosine_power(reach, df),
        ),
    )


def _cosine_power(upper: Column, df: Column) -> Column:
    step = upper / F.lit(float(_STEPS))

    def term(k: Column) -> Column:
        weight = (
            F.when((k == 0) | (k == _STEPS), F.lit(1.0))
            .when(k % 2 == 1, F.lit(4.0))
            .otherwise(F.lit(2.0))
        )
        return weight * F.pow(F.cos(k.cast("double") * step), df - 1)

    grid = F.sequence(F.lit(0), F.lit(_STEPS))
    total = F.aggregate(grid, F.lit(0.0), lambda acc, k: acc + term(k))
    return total * step / F.lit(3.0)
