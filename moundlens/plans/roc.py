"""ROC curve and its exact area, without sorting all rows in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from moundlens.functions.numbers import not_nan
from moundlens.operators.ranking import running_totals, with_sampled_bucket
from moundlens.sources.scratch import materialize


def _score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, with those below it and in total.

    Rows without a label or with a score that is no number do not count; no rows give no scores.
    """
    counted = materialize(
        df.where(F.col(label).isNotNull() & not_nan(F.col(score)).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
        ),
        "score_counts",
    )
    return running_totals(with_sampled_bucket(counted, "score"), [], "score", ["pos", "neg"])


def roc_curve(df: DataFrame, label: str = "is_Swing", score: str = "xSwing_Pred") -> DataFrame:
    """One row per distinct score, taken as the threshold from which a pitch counts as a swing."""
    pos, neg = F.col("total_pos"), F.col("total_neg")
    return _score_table(df, label, score).select(
        F.col("score").alias("threshold"),
        F.try_divide(pos - F.col("before_pos"), pos).alias("sensitivity"),
        F.try_divide(F.col("before_neg"), neg).alias("specificity"),
    )


def auc(df: DataFrame, label: str = "is_Swing", score: str = "xSwing_Pred") -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half. One row."""
    below = F.col("before_neg").cast("double") + F.col("neg") / F.lit(2.0)
    return (
        _score_table(df, label, score)
        .agg(
            F.sum("pos").alias("positives"),
            F.sum("neg").alias("negatives"),
            F.sum(F.col("pos") * below).alias("wins"),
        )
        .select(
            "positives",
            "negatives",
            F.try_divide(
                F.col("wins"), F.col("positives").cast("double") * F.col("negatives")
            ).alias("auc"),
        )
    )
