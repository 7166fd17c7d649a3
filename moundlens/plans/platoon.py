"""Platoon study: sample, split wOBA, pairs, linear and random-intercept models."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log, nan, pi, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from moundlens.functions.numbers import exact_mean
from moundlens.functions.student_t import two_sided_p
from moundlens.operators.filters import by_level, by_membership
from moundlens.operators.flags import platoon_side
from moundlens.operators.joins import BROADCAST_BYTES, join_group_table
from moundlens.operators.ranking import exact_quantiles
from moundlens.sources.keyed_store import GROUP, PART, PARTS, KeyedStore
from moundlens.sources.scratch import materialize

BATTER = ["Batter", "BatterTeam"]
# What `final_pitches` reads.
FINAL_INPUTS = ["PitchUID", *BATTER, "BatterSide", "PitcherThrows", "Level", "woba_value", "woba_denom"]
LARGEST_PSI = 1e16
QUARTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def final_pitches(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Last pitch of each plate appearance between batters and pitchers of known hand."""
    kept = by_membership(by_level(df), "PitcherThrows", ("Left", "Right"))
    kept = by_membership(kept, "BatterSide", ("Left", "Right")).where(F.col("woba_denom") == 1)
    return kept.select(
        "PitchUID", *BATTER, platoon_side().alias("Platoon_Advantage"), "woba_value", "woba_denom",
        *extra,
    )


def _appearance_measures() -> list[Column]:
    side = F.col("Platoon_Advantage")

    def on(label: str):
        return F.coalesce(F.sum(F.when(side == label, F.col("woba_denom"))), F.lit(0))

    return [
        F.count(F.lit(1)).alias("PA"),
        on("Same Side").alias("Same_Side_PA"),
        on("Oppo Side").alias("Oppo_Side_PA"),
    ]


def appearance_counts(finals: DataFrame) -> DataFrame:
    return finals.groupBy(*BATTER).agg(*_appearance_measures())


def join_stored_counts(store: KeyedStore, having: Column | None = None) -> DataFrame:
    """`join_pa_counts` out of a store keyed by BATTER, without moving a pitch."""
    if store.keys != tuple(BATTER):
        raise ValueError(f"the store is keyed by {store.keys}, not by {BATTER}")
    finals = final_pitches(store.rows, (GROUP, PART, PARTS))
    counts = store.summarize(finals, *_appearance_measures(), having=having)
    return store.join(finals, store.repeated(counts))


def platoon_sample(
    df: DataFrame | KeyedStore, min_pa: int = 150, min_side: int = 35, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Plate appearances of batters with enough of them, overall and on each side.

    A store keyed by BATTER in place of the log gives the same rows and shuffles no pitch.
    """
    frequent = (
        (F.col("PA") >= min_pa)
        & (F.col("Same_Side_PA") >= min_side)
        & (F.col("Oppo_Side_PA") >= min_side)
    )
    if isinstance(df, KeyedStore):
        return join_stored_counts(df, frequent)
    finals = final_pitches(df)
    enough = appearance_counts(finals).where(frequent)
    return join_group_table(
        finals, enough.withColumn("group_rows", F.col("PA")), BATTER, F.xxhash64("PitchUID"),
        broadcast_bytes=broadcast_bytes,
    )


def split_woba(sample: DataFrame) -> DataFrame:
    return sample.groupBy(*BATTER, "Platoon_Advantage").agg(
        F.count(F.lit(1)).alias("PA"), exact_mean(F.col("woba_value")).alias("wOBA")
    )


def paired_splits(splits: DataFrame) -> DataFrame:
    """Both sides of a batter in one row. One aggregate instead of a self-join."""
    side = F.col("Platoon_Advantage")

    def of(label: str, column: str):
        return F.max(F.when(side == label, F.col(column)))

    pairs = (
        splits.groupBy(*BATTER)
        .agg(
            of("Oppo Side", "PA").alias("oppo_pa"),
            of("Oppo Side", "wOBA").alias("oppo_woba"),
            of("Same Side", "PA").alias("same_pa"),
            of("Same Side", "wOBA").alias("same_woba"),
        )
        .where(F.col("oppo_pa").isNotNull() & F.col("same_pa").isNotNull())
    )
    oppo, same = F.col("oppo_woba"), F.col("same_woba")
    return pairs.withColumns(
        {
            "diff": oppo - same,
            "same_higher": same > oppo,
            "oppo_higher": oppo > same,
            "which_side": F.when(same > oppo, "Same Higher").when(oppo > same, "Oppo Higher"),
        }
    )


def paired_split_join(splits: DataFrame) -> DataFrame:
    """The same pairs as a join of the two halves; one row per batter, team and side comes in."""
    sides = {}
    for label, short in (("Oppo Side", "oppo"), ("Same Side", "same")):
        half = splits.where(F.col("Platoon_Advantage") == label)
        sides[short] = half.select(
            *BATTER, F.col("PA").alias(f"{short}_pa"), F.col("wOBA").alias(f"{short}_woba")
        )
    return sides["oppo"].join(sides["same"], BATTER)


def join_pa_counts(finals: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every plate appearance with its batter's counts."""
    counts = appearance_counts(finals).withColumn("group_rows", F.col("PA"))
    return join_group_table(
        finals, counts, BATTER, F.xxhash64("PitchUID"), broadcast_bytes=broadcast_bytes
    )


def side_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("which_side").agg(F.count(F.lit(1)).alias("batters"))


def split_difference(pairs: DataFrame) -> DataFrame:
    """Split mean against split difference, largest difference first."""
    oppo, same = F.col("oppo_woba"), F.col("same_woba")
    return pairs.select(
        *BATTER, ((oppo + same) / F.lit(2.0)).alias("split_mean"), (oppo - same).alias("split_diff")
    ).orderBy(F.col("split_diff").desc_nulls_last(), *BATTER)


def with_platoon_effect(sample: DataFrame) -> DataFrame:
    effect = F.when(F.col("Platoon_Advantage") == "Oppo Side", 1.0).otherwise(0.0)
    return sample.withColumn("platoon_effect", effect)


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """Simple regression with standard errors, t and p values, R2: one aggregate, two rows."""
    yc, xc = F.col(y).cast("double"), F.col(x).cast("double")
    fit = df.agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_avgx(yc, xc).alias("mean_x"),
        F.regr_avgy(yc, xc).alias("mean_y"),
        F.regr_sxx(yc, xc).alias("sxx"),
        F.regr_sxy(yc, xc).alias("sxy"),
        F.regr_syy(yc, xc).alias("syy"),
    )
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    fit = fit.withColumn("slope", slope).withColumns(
        {
            "intercept": F.col("mean_y") - F.col("slope") * F.col("mean_x"),
            "rss": F.col("syy") - F.col("slope") * F.col("sxy"),
            "df": (F.col("n") - 2).cast("double"),
        }
    )
    fit = fit.withColumn("sigma2", F.try_divide(F.col("rss"), F.col("df")))
    slope_error = F.sqrt(F.try_divide(F.col("sigma2"), F.col("sxx")))
    intercept_error = F.sqrt(
        F.col("sigma2")
        * (
            F.try_divide(F.lit(1.0), F.col("n"))
            + F.try_divide(F.col("mean_x") * F.col("mean_x"), F.col("sxx"))
        )
    )

    def term(name: str, estimate, error):
        return F.struct(
            F.lit(name).alias("term"), estimate.alias("estimate"), error.alias("std_error")
        )

    terms = F.array(
        term("(Intercept)", F.col("intercept"), intercept_error),
        term(x, F.col("slope"), slope_error),
    )
    rows = fit.select(
        F.explode(terms).alias("row"),
        F.sqrt("sigma2").alias("sigma"),
        (F.lit(1.0) - F.try_divide(F.col("rss"), F.col("syy"))).alias("r_squared"),
        "df",
        "n",
    ).select("row.*", "sigma", "r_squared", "df", "n")
    rows = rows.withColumn("t_value", F.try_divide(F.col("estimate"), F.col("std_error")))
    return rows.withColumn("p_value", two_sided_p(F.col("t_value"), F.col("df")))


def _residual_quartiles(cells: DataFrame) -> DataFrame:
    """One row of QUARTILES from rows of `residual` and how often it occurs, `n`."""
    ends = cells.agg(F.min("residual").alias("low"), F.max("residual").alias("high")).first()
    low, high = (0.0, 1.0) if ends["low"] is None else (ends["low"], ends["high"])
    limits = (low, high) if low < high else (low, low + 1.0)
    return exact_quantiles(cells, [], "residual", QUARTILES, limits, weight="n")


def ols_summary(df: DataFrame, y: str, x: str) -> DataFrame:
    """The lines under a regression's coefficients, in one row: quartiles of the residuals, residual
    error, R2 plain and adjusted, F statistic with its degrees of freedom and p-value.

    Rows without y or x are left out. A fit that two values of x do not determine has NULL figures.
    """
    known = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    cells = materialize(
        known.where(F.col("y").isNotNull() & F.col("x").isNotNull())
        .groupBy("y", "x")
        .agg(F.count(F.lit(1)).alias("n")),
        "values",
    )
    lines = {row["term"]: row for row in ols(df, y, x).collect()}
    (slope,), b0 = (row for term, row in lines.items() if term != "(Intercept)"), lines["(Intercept)"]
    error = F.lit(b0["estimate"]).cast("double") + F.lit(slope["estimate"]).cast("double") * F.col("x")
    quartiles = _residual_quartiles(cells.select((F.col("y") - error).alias("residual"), "n"))

    def figure(value):
        return F.lit(value).cast("double")

    adjusted = None
    if slope["r_squared"] is not None and slope["df"] > 0:
        adjusted = 1.0 - (1.0 - slope["r_squared"]) * (slope["n"] - 1) / slope["df"]
    f_value = None if slope["t_value"] is None else slope["t_value"] ** 2  # one regressor
    return quartiles.select(
        *[F.col(name).alias(f"residual_{name}") for name in QUARTILES],
        figure(slope["sigma"]).alias("sigma"),
        figure(slope["r_squared"]).alias("r_squared"),
        figure(adjusted).alias("adj_r_squared"),
        figure(f_value).alias("f_value"),
        F.lit(1.0).alias("df1"),
        figure(slope["df"]).alias("df2"),
        figure(slope["p_value"]).alias("p_value"),
    )


def ols_predictions(fit: DataFrame, coding: str = "half") -> DataFrame:
    """Predicted wOBA per side.

    `half` moves half the slope to each side of the intercept, as the study's chart does;
    `indicator` gives the fitted means of the 0/1 coding.
    """
    if coding not in ("half", "indicator"):
        raise ValueError("coding is 'half' or 'indicator'")
    is_intercept = F.col("term") == "(Intercept)"
    coef = fit.agg(
        F.max(F.when(is_intercept, F.col("estimate"))).alias("b0"),
        F.max(F.when(~is_intercept, F.col("estimate"))).alias("b1"),
    )
    low, high = (-0.5, 0.5) if coding == "half" else (0.0, 1.0)
    sides = F.array(
        F.struct(F.lit("Same Side").alias("side"), F.lit(low).alias("at")),
        F.struct(F.lit("Oppo Side").alias("side"), F.lit(high).alias("at")),
    )
    return coef.select("b0", "b1", F.explode(sides).alias("s")).select(
        F.col("s.side").alias("Platoon_Advantage"),
        (F.col("b0") + F.col("b1") * F.col("s.at")).alias("pred"),
        F.lit("Linear").alias("Group"),
    )


@dataclass(frozen=True)
class RandomIntercept:
    """REML fit of y = beta0 + beta1 x + u_group + e.

    `information` is X' V^-1 X at the optimum, for variances in units of sigma2: (a00, a01, a11).
    """

    beta0: float
    beta1: float
    psi: float  # var(u) / var(e)
    sigma2: float
    criterion: float
    coefficients: DataFrame  # group, beta0 (own intercept), beta1
    information: tuple[float, float, float] = (nan, nan, nan)
    observations: int = 0
    groups: int = 0

    @property
    def group_variance(self) -> float:
        return self.psi * self.sigma2

    @property
    def std_errors(self) -> tuple[float, float]:
        """Of beta0 and beta1: roots of the diagonal of the inverse information."""
        a00, a01, a11 = self.information
        det = a00 * a11 - a01 * a01
        return sqrt(self.sigma2 * a11 / det), sqrt(self.sigma2 * a00 / det)

    @property
    def t_values(self) -> tuple[float, float]:
        errors = self.std_errors
        return tuple(b / e if e else nan for b, e in zip((self.beta0, self.beta1), errors, strict=True))

    @property
    def correlation(self) -> float:
        """Of the two fixed effects' estimates."""
        a00, a01, a11 = self.information
        return -a01 / sqrt(a00 * a11)


@dataclass(frozen=True)
class _Point:
    """The criterion and the estimates at one psi."""

    value: float
    beta0: float
    beta1: float
    sigma2: float
    information: tuple[float, float, float]
    observations: int
    groups: int


def _criterion(sums) -> _Point:
    det = sums["a00"] * sums["a11"] - sums["a01"] ** 2
    if sums["total"] <= 2 or det <= 0:
        raise ValueError("the model needs more than two observations and two values of x")
    beta0 = (sums["a11"] * sums["b0"] - sums["a01"] * sums["b1"]) / det
    beta1 = (sums["a00"] * sums["b1"] - sums["a01"] * sums["b0"]) / det
    rss = sums["q"] - beta0 * sums["b0"] - beta1 * sums["b1"]
    if rss <= 0:
        raise ValueError("the groups explain every observation, so no variance is left to estimate")
    rest = sums["total"] - 2
    value = rest * (1 + log(2 * pi * rss / rest)) + sums["ld"] + log(det)
    information = (sums["a00"], sums["a01"], sums["a11"])
    return _Point(value, beta0, beta1, rss / rest, information, int(sums["total"]), sums["groups"])


def _scan(stats: DataFrame, grid: list[float]) -> dict[float, _Point]:
    """Criterion at every psi of a small grid, one job over the per-group rows."""
    n, sx, t = F.col("n"), F.col("sx"), F.col("t")
    c = F.col("psi") / (F.lit(1.0) + n * F.col("psi"))
    sums = (
        stats.withColumn("psi", F.explode(F.array(*[F.lit(float(p)) for p in grid])))
        .groupBy("psi")
        .agg(
            F.sum("n").alias("total"),
            F.count(F.lit(1)).alias("groups"),
            F.sum(n - c * n * n).alias("a00"),
            F.sum(sx - c * n * sx).alias("a01"),
            F.sum(F.col("sxx") - c * sx * sx).alias("a11"),
            F.sum(t - c * n * t).alias("b0"),
            F.sum(F.col("sxy") - c * sx * t).alias("b1"),
            F.sum(F.col("syy") - c * t * t).alias("q"),
            F.sum(F.log1p(n * F.col("psi"))).alias("ld"),
        )
    )
    return {row["psi"]: _criterion(row) for row in sums.collect()}


def random_intercept(
    df: DataFrame, y: str, x: str, group: str, rounds: int = 6, points: int = 25
) -> RandomIntercept:
    """Profile REML over psi on grids that close in on the minimum.

    The observations are read once, into a written table of sums per group; each round is a job
    over those rows, and only the grid's totals (one row per psi) come back to the driver. The first
    grid spans 1e-8 to 1e4, and 0 is tried too. A minimum at its upper end moves the grid up by four
    decades at a time; without one below LARGEST_PSI, ValueError.
    """
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    known = df.where(xc.isNotNull() & yc.isNotNull() & F.col(group).isNotNull())
    stats = materialize(
        known.groupBy(group).agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(xc).alias("sx"),
            F.sum(yc).alias("t"),
            F.sum(xc * xc).alias("sxx"),
            F.sum(xc * yc).alias("sxy"),
            F.sum(yc * yc).alias("syy"),
        ),
        "group_sums",
    )
    low, high = log(1e-8), log(1e4)
    found: dict[float, _Point] = {}
    step = 0
    while step < rounds:
        grid = [exp(low + (high - low) * i / (points - 1)) for i in range(points)]
        scanned = _scan(stats, grid if found else [0.0, *grid])
        if not scanned:  # no observation at all
            unknown = F.lit(None).cast("double")
            nobody = stats.select(group, unknown.alias("beta0"), unknown.alias("beta1"))
            return RandomIntercept(nan, nan, nan, nan, nan, nobody)
        found.update(scanned)
        best = min(grid, key=lambda psi: scanned[psi].value)
        place = grid.index(best)
        if step == 0 and place == points - 1:
            if best > LARGEST_PSI:
                raise ValueError("the variance between groups has no bound beside that within them")
            low, high = log(grid[place - 1]), high + log(1e4)
            continue
        low, high = log(grid[max(place - 1, 0)]), log(grid[min(place + 1, points - 1)])
        step += 1
    psi = min(found, key=lambda p: (found[p].value, p))
    at = found[psi]
    beta0, beta1 = at.beta0, at.beta1
    shrink = F.lit(psi) / (F.lit(1.0) + F.col("n") * F.lit(psi))
    effect = shrink * (F.col("t") - F.lit(beta0) * F.col("n") - F.lit(beta1) * F.col("sx"))
    coefficients = stats.select(
        group, (F.lit(beta0) + effect).alias("beta0"), F.lit(beta1).alias("beta1")
    )
    return RandomIntercept(
        beta0, beta1, psi, at.sigma2, at.value, coefficients, at.information, at.observations, at.groups
    )


def mixed_summary(
    df: DataFrame, fit: RandomIntercept, y: str, x: str, group: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The numbers of the model's summary in long form (part, name, value).

    `fixed`: estimate, standard error and t value of both effects, and their `correlation`.
    `random`: variance and deviation between groups and within. `scaled_residual`: exact quartiles
    of (y - beta0_group - beta1 x) / sigma, the random effect removed. `fit`: REML criterion, numbers
    of observations and groups. `fit` is a model of the same `df`; without observations, no rows.
    """
    empty = df.sparkSession.createDataFrame([], "part string, name string, value double")
    if not fit.observations:
        return empty
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    known = df.select(F.col(group).alias("g"), yc.alias("y"), xc.alias("x"))
    known = known.where(F.col("g").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull())
    cells = known.groupBy("g", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    own = fit.coefficients.select(
        F.col(group).alias("g"), F.col("beta0").alias("own0"), F.lit(1).alias("group_rows")
    )
    joined = join_group_table(cells, own, ["g"], F.xxhash64("y", "x"), broadcast_bytes=broadcast_bytes)
    rest = F.col("y") - F.col("own0") - F.lit(fit.beta1) * F.col("x")
    residuals = joined.select((rest / F.lit(sqrt(fit.sigma2))).alias("residual"), "n")
    quartiles = _residual_quartiles(materialize(residuals, "residuals"))
    named = F.array(
        *[F.struct(F.lit(q).alias("name"), F.col(q).alias("value")) for q in QUARTILES]
    )
    quartiles = quartiles.select(F.explode(named).alias("row")).select(
        F.lit("scaled_residual").alias("part"), "row.name", "row.value"
    )
    rows = []
    effects = zip(("(Intercept)", x), (fit.beta0, fit.beta1), fit.std_errors, fit.t_values, strict=True)
    for name, estimate, error, t_value in effects:
        rows += [
            ("fixed", f"{name} estimate", estimate),
            ("fixed", f"{name} std_error", error),
            ("fixed", f"{name} t_value", t_value),
        ]
    rows += [
        ("fixed", "correlation", fit.correlation),
        ("random", f"{group} variance", fit.group_variance),
        ("random", f"{group} std_dev", sqrt(fit.group_variance)),
        ("random", "residual variance", fit.sigma2),
        ("random", "residual std_dev", sqrt(fit.sigma2)),
        ("fit", "reml_criterion", fit.criterion),
        ("fit", "observations", float(fit.observations)),
        ("fit", "groups", float(fit.groups)),
    ]
    return df.sparkSession.createDataFrame(rows, empty.schema).unionByName(quartiles)


def batter_splits(coefficients: DataFrame, group: str = "Batter") -> DataFrame:
    """Predicted split per batter, long form."""
    half = F.col("beta1") / F.lit(2.0)
    wide = coefficients.select(
        group,
        (F.col("beta0") - half).alias("Same Side"),
        (F.col("beta0") + half).alias("Oppo Side"),
    )
    return unpivot_splits(wide, group)


def unpivot_splits(wide: DataFrame, group: str = "Batter") -> DataFrame:
    return wide.unpivot(group, ["Same Side", "Oppo Side"], "Platoon_Advantage", "wOBA")
