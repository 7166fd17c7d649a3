"""The metric bundle of the pitcher reports, as sums that can be merged across grains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from moundlens.functions.numbers import not_nan, ratio, round_half_up, scaled_sum, unscaled


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def report_sums() -> dict[str, Column]:
    """Numerators and denominators over flagged pitches. Each one is additive."""
    zone, swing, whiff = F.col("is_Zone"), F.col("is_Swing"), F.col("is_Whiff")
    first = F.col("PitchofPA") == 1
    two_strikes = F.col("Strikes") == 2
    zone_swing = zone & swing
    bbe, pa = F.col("is_BBE"), F.col("is_PA") == 1
    run_value = F.col("Run_Value")

    def total(value: Column, where: Column) -> Column:
        return scaled_sum(F.when(where, value))

    def known(value: Column, where: Column) -> Column:
        return F.count(F.when(where, not_nan(value)))

    return {
        "pitches": F.count(F.lit(1)),
        "strikes": _count(F.col("is_Strike")),
        "first_pitches": _count(first),
        "first_strikes": _count(first & F.col("is_Strike")),
        "first_unknown": _count(first.isNull()),
        "csw": _count(F.col("is_CSW")),
        "two_strike_pitches": _count(two_strikes),
        "two_strike_csw": _count(two_strikes & F.col("is_CSW")),
        "swings": _count(swing),
        "whiffs": _count(swing & whiff),
        "located": F.count(zone),
        "zone_pitches": _count(zone),
        "zone_swings": _count(zone_swing),
        "zone_whiffs": _count(zone_swing & whiff),
        "zone_swing_unknown": _count(zone_swing.isNull()),
        "out_pitches": _count(~zone),
        "out_swings": _count(~zone & swing),
        "bbe": _count(bbe),
        "woba_rows": known(F.col("woba_value"), pa),
        "woba_sum": total(F.col("woba_value"), pa),
        "wobacon_rows": known(F.col("woba_value"), bbe),
        "wobacon_sum": total(F.col("woba_value"), bbe),
        "xwobacon_rows": known(F.col("xwOBACON_value"), bbe),
        "xwobacon_sum": total(F.col("xwOBACON_value"), bbe),
        "xwoba_rows": known(F.col("xwOBA_weights"), pa),
        "xwoba_sum": total(F.col("xwOBA_weights"), pa),
        "run_value_rows": F.count(not_nan(run_value)),
        "run_value_sum": scaled_sum(run_value),
    }


SUM_COLUMNS = (
    "pitches strikes first_pitches first_strikes first_unknown csw two_strike_pitches "
    "two_strike_csw swings whiffs located zone_pitches zone_swings zone_whiffs "
    "zone_swing_unknown out_pitches out_swings bbe woba_rows woba_sum wobacon_rows wobacon_sum "
    "xwobacon_rows xwobacon_sum xwoba_rows xwoba_sum run_value_rows run_value_sum"
).split()


def _rate(part: str, whole: str) -> Column:
    return round_half_up(ratio(F.col(part), F.col(whole)), 5)


def _woba(name: str) -> Column:
    return round_half_up(unscaled(ratio(F.col(f"{name}_sum").cast("double"), F.col(f"{name}_rows"))), 3)


def _metrics() -> dict[str, Column]:
    run_value = F.col("run_value_sum").cast("double")
    return {
        "pitches": F.col("pitches"),
        "strike_pct": _rate("strikes", "pitches"),
        "fps_pct": F.when(F.col("first_unknown") == 0, _rate("first_strikes", "first_pitches")),
        "csw_pct": _rate("csw", "pitches"),
        "whiff_pct": _rate("whiffs", "swings"),
        "put_away_pct": _rate("two_strike_csw", "two_strike_pitches"),
        "zone_pct": _rate("zone_pitches", "located"),
        "swing_pct": _rate("swings", "pitches"),
        "chase_pct": _rate("out_swings", "out_pitches"),
        "z_swing_pct": _rate("zone_swings", "zone_pitches"),
        "z_whiff_pct": F.when(
            F.col("zone_swing_unknown") == 0, _rate("zone_whiffs", "zone_swings")
        ),
        "rv_per_100": round_half_up(
            unscaled(ratio(run_value, F.col("run_value_rows"))) * F.lit(100.0), 2
        ),
        "rv": round_half_up(unscaled(F.coalesce(run_value, F.lit(0.0))), 2),
        "bbe": F.col("bbe"),
        "wobacon": _woba("wobacon"),
        "woba": _woba("woba"),
        "xwobacon": _woba("xwobacon"),
        "xwoba": _woba("xwoba"),
    }


def summarize(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of sums per key. Aggregates map-side, so a hot key costs one row per task."""
    return flagged.groupBy(*keys).agg(*[col.alias(name) for name, col in report_sums().items()])


def summarize_sets(flagged: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Sums for several key sets in one pass; `_set` is the number of the set a row belongs to."""
    keys = list(dict.fromkeys(key for kept in sets for key in kept))
    ids = [int("".join("0" if key in kept else "1" for key in keys), 2) for kept in sets]
    summary = flagged.groupingSets([[F.col(k) for k in kept] for kept in sets], *keys).agg(
        F.grouping_id().alias("_id"), *[col.alias(name) for name, col in report_sums().items()]
    )
    number = F.lit(None).cast("int")
    for position, grouping in enumerate(ids):
        number = F.when(F.col("_id") == grouping, F.lit(position)).otherwise(number)
    return summary.withColumn("_set", number).drop("_id")


def merge_grains(
    summary: DataFrame, keys: Sequence[str], grains: dict[str, tuple[int, Sequence[str]]]
) -> DataFrame:
    """Merge the rows of `summarize_sets` into coarser reports at once, named in `report`.

    Each grain names the set it is merged from and the keys it keeps. A key that a report leaves
    out and one that is NULL in the data stay apart, because `report` is part of the grouping. A key
    that all of them keep is passed on as it is, so rows that lie by it already are not moved.
    """
    names = F.lit(None).cast("array<string>")
    for number in {source for source, _ in grains.values()}:
        fed = [F.lit(name) for name, (source, _) in grains.items() if source == number]
        names = F.when(F.col("_set") == number, F.array(*fed)).otherwise(names)
    expanded = summary.withColumn("report", F.explode(names))
    kept = {
        key: F.when(
            F.col("report").isin(*[name for name, (_, held) in grains.items() if key in held]),
            F.col(key),
        )
        for key in keys
        if not all(key in held for _, held in grains.values())
    }
    return expanded.withColumns(kept).groupBy("report", *keys).agg(
        *[F.sum(name).alias(name) for name in SUM_COLUMNS]
    )


def finish(summary: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rates and averages from sums."""
    columns = _metrics()
    return summary.select(*keys, *[columns[name].alias(name) for name in metrics])
