"""Swing against expected swing. Each board covers every team, or one when it is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from moundlens.functions.numbers import exact_mean, exact_sum, ratio, round_half_up
from moundlens.functions.text import count_label
from moundlens.operators.filters import in_heart, in_year, min_sample, out_of_zone
from moundlens.operators.joins import null_safe_join
from moundlens.operators.ranking import exact_quantiles
from moundlens.sources.scratch import materialize

QUANTILES = 14


def _of_team(df: DataFrame, column: str, team: str | None) -> DataFrame:
    return df if team is None else df.where(F.col(column) == team)


def top_swing_diff(
    scored: DataFrame, team: str | None = None, side: str = "Batter", k: int = 10
) -> DataFrame:
    """The k pitches of each team on which swing and expected swing differ most.

    The row-number filter lets every task keep its own k rows per team before the shuffle.
    """
    team_column = {"Batter": "BatterTeam", "Pitcher": "PitcherTeam"}[side]
    pitches = _of_team(scored, team_column, team).select(
        "PitchUID", "Date", "Pitcher", "PitcherTeam", "Batter", "BatterTeam", "Inning",
        count_label().alias("Count"), "PitchCall", "is_Swing",
        round_half_up(F.col("xSwing_Pred") * F.lit(100.0), 2).alias("xswing_pct"),
        (F.col("is_Swing") - F.col("xSwing_Pred")).alias("xswing_diff"),
    )
    order = [F.col("xswing_diff").desc_nulls_last(), F.col("PitchUID")]
    place = F.row_number().over(Window.partitionBy(team_column).orderBy(*order))
    best = pitches.withColumn("place", place).where(F.col("place") <= k)
    return best.orderBy(team_column, "place").drop("place")


def _rate(column: str, rows: Column) -> Column:
    return ratio(F.sum(column), rows)


def pitcher_swing_diff(
    scored: DataFrame, team: str | None = None, year: int = 2023, min_n: int = 100
) -> DataFrame:
    chosen = in_year(_of_team(scored, "PitcherTeam", team), year)
    rows = F.count(F.lit(1))
    board = chosen.groupBy("PitcherTeam", "Pitcher").agg(
        rows.alias("pitches"),
        round_half_up(_rate("is_Swing", rows) * F.lit(100.0), 2).alias("swing_pct"),
        round_half_up(ratio(exact_sum(F.col("xSwing_Pred")), rows) * F.lit(100.0), 2).alias(
            "xswing_pct"
        ),
    )
    board = board.withColumn(
        "swing_diff", round_half_up(F.col("swing_pct") - F.col("xswing_pct"), 2)
    )
    return min_sample(board, "pitches", min_n).orderBy(
        "PitcherTeam", F.col("swing_diff").desc_nulls_last(), "Pitcher"
    )

# What a store of the chase boards needs: the columns that they read, and those that lay it out.
CHASE_INPUTS = [
    "PitchUID", "Date", "Pitcher", "Batter", "BatterTeam", "PlateLocSide", "PlateLocHeight", "is_Swing", "xSwing_Pred",
]


def chase_diff(
    scored: DataFrame,
    team: str | None = None,
    year: int = 2023,
    min_n: int = 100,
    k: int | None = None,
) -> DataFrame:
    """Chase rate against expected, most disciplined first; the first k over all teams if given."""
    chosen = out_of_zone(in_year(_of_team(scored, "BatterTeam", team), year))
    rows = F.count(F.lit(1))
    board = chosen.groupBy("Batter", "BatterTeam").agg(
        rows.alias("ooz_pitches"),
        _rate("is_Swing", rows).alias("chase_pct"),
        ratio(exact_sum(F.col("xSwing_Pred")), rows).alias("xchase_pct"),
    )
    board = board.withColumn("chase_diff", F.col("chase_pct") - F.col("xchase_pct"))
    ranked = min_sample(board, "ooz_pitches", min_n).orderBy(
        F.col("chase_diff").asc_nulls_last(), "Batter", "BatterTeam"
    )
    return ranked if k is None else ranked.limit(k)


def heart_diff(
    scored: DataFrame, year: int = 2023, min_n: int = 150, k: int | None = 15
) -> DataFrame:
    """Swing rate against expected in the heart of the zone, most aggressive first."""
    chosen = in_heart(in_year(scored, year))
    board = chosen.groupBy("Batter", "BatterTeam").agg(
        F.count(F.lit(1)).alias("heart_pitches"),
        F.avg("is_Swing").alias("heart_swing_pct"),
        exact_mean(F.col("xSwing_Pred")).alias("heart_xswing_pct"),
    )
    board = board.withColumn("swing_diff", F.col("heart_swing_pct") - F.col("heart_xswing_pct"))
    ranked = min_sample(board, "heart_pitches", min_n).orderBy(
        F.col("swing_diff").desc_nulls_last(), "Batter", "BatterTeam"
    )
    return ranked if k is None else ranked.limit(k)


def add_quantile_bins(
    board: DataFrame,
    bins: dict[str, str],
    groups: list[str] | None = None,
    quantiles: int = QUANTILES,
    limits: tuple[float, float] = (-1.0, 1.0),
) -> DataFrame:
    """Bin 1..quantiles of board columns (column -> bin name): cut points at equal shares, lower
    end included.

    Equal cut points count once, so a board with few distinct values has fewer bins. The board is
    written first, because the cut points of all columns and the bins read it again.
    """
    keys = groups or ["_all"]
    board = materialize(board if groups else board.withColumn("_all", F.lit(1)), "board")
    shares = {f"_q{i}": i / quantiles for i in range(quantiles + 1)}
    values = F.array(
        *[F.struct(F.lit(name).alias("bin"), F.col(c).alias("value")) for c, name in bins.items()]
    )
    long_form = board.select(*keys, F.explode(values).alias("v")).select(*keys, "v.*")
    cuts = exact_quantiles(long_form, [*keys, "bin"], "value", shares, limits)
    cuts = cuts.withColumn("cuts", F.array_distinct(F.array(*shares)))
    per_group = cuts.groupBy(*keys).agg(
        *[
            F.first(F.when(F.col("bin") == name, F.col("cuts")), ignorenulls=True).alias(f"_{name}")
            for name in bins.values()
        ]
    )

    def bin_of(value: str, cut_points: str) -> Column:
        reached = F.size(F.filter(cut_points, lambda cut: cut <= F.col(value)))
        top = F.greatest(F.size(cut_points) - 1, F.lit(1))
        return F.when(F.col(value).isNotNull(), F.least(reached, top))

    binned = null_safe_join(board, per_group, keys, "left")
    return binned.withColumns(
        {name: bin_of(value, f"_{name}") for value, name in bins.items()}
    ).drop("_all", *[f"_{name}" for name in bins.values()])


def team_chase_board(
    scored: DataFrame, team: str | None = None, year: int = 2023, min_n: int = 15
) -> DataFrame:
    """Chase board per team with the quantile bins that colour it."""
    board = chase_diff(scored, team, year, min_n)
    binned = add_quantile_bins(
        board, {"chase_pct": "chase_bin", "chase_diff": "diff_bin"}, ["BatterTeam"]
    )
    return binned.orderBy("BatterTeam", F.col("chase_diff").asc_nulls_last(), "Batter")
