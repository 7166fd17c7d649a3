"""Joins, ranking and sampling against brute force, on hot and missing keys too."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_set
from moundlens.functions.numbers import exact_mean, exact_sum
from moundlens.operators.joins import frequent_keys, join_group_table, null_safe_join
from moundlens.operators.ranking import exact_quantiles, running_totals, with_sampled_bucket
from moundlens.operators.sampling import sample_n, stratified_split
from moundlens.plans import roc
from moundlens.plans.swing import add_event_weights


def _skewed(spark):
    """A third of the rows on one key, a NULL key, many small keys."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))
    )
    return spark.range(3000).select("id", key.alias("k"), (F.col("id") % 97).alias("v"))


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "hot_share": 0.1, "splits": 16}])
def test_group_join_matches_plain_join(spark, options):
    fact = _skewed(spark)
    groups = fact.groupBy("k").agg(
        F.count(F.lit(1)).alias("group_rows"), F.sum("v").alias("total")
    )
    joined = join_group_table(fact, groups, ["k"], F.xxhash64("id"), **options)
    totals = {r["k"]: r["total"] for r in groups.collect()}
    rows = joined.collect()
    assert len(rows) == 3000 and joined.columns == ["id", "k", "v", "total"]
    assert all(r["total"] == totals[r["k"]] for r in rows)


def test_hot_key_is_spread(spark):
    fact = _skewed(spark)
    groups = fact.groupBy("k").agg(F.count(F.lit(1)).alias("group_rows"))
    plan = join_group_table(
        fact, groups.withColumn("total", F.lit(1)), ["k"], F.xxhash64("id"), broadcast_bytes=0,
        hot_share=0.1, splits=16,
    )._jdf.queryExecution().toString()
    assert "_split" in plan and "pmod" in plan


def test_null_matches_null(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, y int")
    assert as_set(null_safe_join(left, right, ["k"])) == {(None, 1, 10)}
    assert null_safe_join(left, right, ["k"], "left").count() == 2


@pytest.mark.parametrize("limits", [(0.0, 1.0), (0.4, 0.5), (5.0, 6.0)])
def test_quantiles_equal_numpy(spark, limits):
    rng = np.random.default_rng(3)
    values = {"hot": rng.random(4000), "ties": rng.integers(0, 4, 300) / 4, "one": np.array([0.3])}
    rows = [(None if k == "ties" else k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame([*rows, ("hot", None)], "k string, v double")
    shares = {"a": 0.0, "b": 0.25, "c": 1 / 14, "d": 0.75, "e": 1.0}
    found = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", shares, limits).collect()}
    shuffled = exact_quantiles(df, ["k"], "v", shares, limits, broadcast_bytes=0).collect()
    assert {r["k"]: r for r in shuffled} == found
    twice = exact_quantiles(df.withColumn("w", F.lit(1)), ["k"], "v", shares, limits, weight="w").collect()
    assert {r["k"]: r for r in twice} == found
    for key, vs in values.items():
        row = found[None if key == "ties" else key]
        for name, share in shares.items():
            assert row[name] == pytest.approx(np.quantile(vs, share), abs=1e-12)


def test_running_totals_equal_a_sort(spark):
    rng = np.random.default_rng(4)
    values = rng.permutation(5000) / 5000
    rows = [(float(v), int(i % 7)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s double, n int")
    found = running_totals(with_sampled_bucket(df, "s", 50), [], "s", ["n"]).orderBy("s").collect()
    ordered = np.array([n for _, n in sorted(rows)])
    assert [r["before_n"] for r in found] == list(np.cumsum(ordered) - ordered)
    assert {r["total_n"] for r in found} == {int(ordered.sum())}


def test_sample_has_exact_size_and_ignores_partitioning(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("PitchUID"))
    first = as_set(sample_n(df.repartition(3), 700, 1))
    assert len(first) == 700
    assert first == as_set(sample_n(df.repartition(11), 700, 1))
    assert first != as_set(sample_n(df, 700, 2))
    assert sample_n(df, 9000, 1).count() == 5000


def test_split_is_exact_in_every_label(spark):
    df = spark.range(4001).select(
        F.col("id").cast("string").alias("PitchUID"),
        F.when(F.col("id") % 9 == 0, None).otherwise((F.col("id") % 3 == 0).cast("int")).alias("y"),
    )
    split = stratified_split(df, "y", 0.75, 5)
    for row in split.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("train")
    ).collect():
        assert row["train"] == -(-3 * row["n"] // 4)
    again = stratified_split(df.repartition(7), "y", 0.75, 5)
    assert as_set(split) == as_set(again)


def test_hot_key_that_no_group_keeps_is_spread(spark):
    fact = spark.range(40_000).select("id", F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    groups = spark.range(1, 40_000).select(F.col("id").alias("k"), F.lit(1).alias("group_rows"), F.lit("x").alias("v"))
    joined = join_group_table(fact, groups, ["k"], F.xxhash64("id"), broadcast_bytes=0, hot_share=0.01, splits=64)
    assert joined.count() == 3_999
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_split" in plan and "_hot" in plan


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.range(300_000).select((F.rand(3) * 3000 + 1e7).alias("x"))
    values = [r[0] for r in df.collect()]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    found = {table.repartition(n).agg(exact_sum(F.col("x"))).first()[0] for n in (1, 3, 8, 13)}
    assert len(found) == 1
    assert found.pop() == sum(round(v * 1e9) for v in values) / 1e9
    odd = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "x double")
    assert odd.agg(exact_mean(F.col("x"))).first()[0] == 1.5


def test_roc_of_nothing_and_of_nan(spark):
    empty = spark.createDataFrame([], "is_Swing int, xSwing_Pred double")
    assert roc.auc(empty).first()["auc"] is None and roc.roc_curve(empty).count() == 0
    rows = [(1, 0.9), (0, 0.1), (1, float("nan")), (None, 0.5), (0, None)]
    some = spark.createDataFrame(rows, "is_Swing int, xSwing_Pred double")
    assert roc.auc(some).first()["auc"] == 1.0


def test_split_takes_any_number_of_labels(spark):
    df = spark.range(4_500).select(F.col("id").cast("string").alias("PitchUID"), (F.col("id") % 1_500).alias("label"))
    sizes = stratified_split(df, "label", 0.5).groupBy("label").agg(F.count_if("is_train").alias("n"))
    assert {r.n for r in sizes.collect()} == {2}


def test_lookup_with_two_rows_for_a_key_is_refused(spark):
    events = spark.createDataFrame([("single", 0.9, 1), ("single", 0.8, 1)], "event string, woba_weight double, is_pa int")
    runs = spark.createDataFrame([], "balls int, strikes int, event string, run_value double")
    with pytest.raises(ValueError, match="single"):
        add_event_weights(spark.range(1).toDF("x"), events, runs)


def test_frequent_keys_are_exact_and_rare_ones_stay(spark):
    fact = _skewed(spark)
    total, found = frequent_keys(fact, ["k"], lambda rows: rows / 10)
    assert total == 3000 and {(r["k"], r["_rows"]) for r in found.collect()} == {("hot", 1000)}
    sizes = {(r["k"], r["count"]) for r in fact.groupBy("k").count().collect()}
    for least in (0, 39):
        found = frequent_keys(fact, ["k"], lambda rows: least)[1].collect()
        assert {(r["k"], r["_rows"]) for r in found} == {(k, n) for k, n in sizes if n > least}
    assert frequent_keys(fact, ["k"], lambda rows: rows)[1] is None
    assert frequent_keys(fact.limit(0), ["k"], lambda rows: rows / 10) == (0, None)


def test_groups_by_day_are_broadcast_as_lists(spark):
    """Up to some four times `broadcast_bytes` no fact is moved; NULL keys, days and values included."""
    day = F.when(F.col("id") % 11 > 0, F.date_add(F.lit("1969-12-25").cast("date"), (F.col("id") % 11).cast("int")))
    fact = _skewed(spark).withColumn("d", day)
    groups = fact.where("v > 20").groupBy("k", "d").agg(
        F.sum(F.when(F.col("v") > 60, F.col("v"))).alias("total"), F.avg("v").alias("mean")
    ).where("total IS NULL OR total % 5 > 0")
    args = (fact, groups, ["k", "d"], F.xxhash64("id"))
    plain = join_group_table(*args)
    rows = as_set(plain)
    some = plain.collect()
    assert 0 < len(some) < 3000 and all(None in {r[name] for r in some} for name in ("k", "d", "total"))
    listed = join_group_table(*args, broadcast_bytes=16_000, nested="d")
    assert listed.columns == plain.columns and listed.dtypes == plain.dtypes and as_set(listed) == rows
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "_all_total" in plan
    shuffled = join_group_table(*args, broadcast_bytes=2_000, nested="d")
    assert "_all_total" not in shuffled._jdf.queryExecution().toString() and as_set(shuffled) == rows
