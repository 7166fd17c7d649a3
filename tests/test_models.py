from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SMALL, as_set
from moundlens.plans import roc, selection, swing, swing_models
from moundlens.schema import SWING_CLASSES


@pytest.fixture(scope="module")
def planted(log):
    """Model-ready pitches whose swings depend on location and velocity."""
    ready = swing.model_ready(log)
    near = F.abs(F.col("PlateLocSide")) < 0.9
    fast = F.col("RelSpeed") > 85
    label = F.when(near & fast, 1).when(F.pmod(F.xxhash64("PitchUID"), F.lit(10)) == 0, 1).otherwise(0)
    return ready.withColumn("is_Swing", label)


def test_models_find_a_planted_signal(planted):
    models, held_out = swing_models.train_all(planted, rounds=5)
    assert set(models) == set(SWING_CLASSES)
    for name in SWING_CLASSES:
        own = held_out.where(F.col("swing_class") == name)
        assert roc.auc(own).first()["auc"] > 0.7
    scored = swing_models.score_swing(planted, models)
    assert scored.count() == planted.count()
    assert scored.where("xSwing_Pred IS NULL OR xSwing_Pred NOT BETWEEN 0 AND 1").count() == 0
    # a natural join on the shared columns gives the same scores back
    keyed = as_set(scored.select("PitchUID", "xSwing_Pred"))
    parts = [scored.where(F.col("TaggedPitchType").isin(*types)) for types, _ in SWING_CLASSES.values()]
    joined = swing.natural_join(swing.stack_scored(parts), planted)
    assert as_set(joined.select("PitchUID", "xSwing_Pred")) == keyed


def test_saved_model_scores_the_same(planted, tmp_path):
    model = swing_models.train_swing(planted, "Offspeed", rounds=2)
    swing_models.save_model(model, str(tmp_path / "m"))
    again = swing_models.load_model(str(tmp_path / "m"))
    first = swing_models.score_class(planted, model, "Offspeed").select("PitchUID", "xSwing_Pred")
    second = swing_models.score_class(planted, again, "Offspeed").select("PitchUID", "xSwing_Pred")
    assert as_set(first) == as_set(second)


def test_area_equals_the_library(log, spark):
    tied = log.select("is_Swing", F.round("xSwing_Pred", 1).alias("xSwing_Pred"))
    for df in (log, tied):
        mine = roc.auc(df).first()["auc"]
        vectors = df.select(F.col("is_Swing").cast("double").alias("label"), "xSwing_Pred")
        library = BinaryClassificationEvaluator(rawPredictionCol="xSwing_Pred", numBins=0)
        assert mine == pytest.approx(library.evaluate(vectors), abs=1e-12)


def test_curve_on_hand_made_scores(spark):
    df = spark.createDataFrame(
        [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (None, 0.5), (1, None)],
        "is_Swing int, xSwing_Pred double",
    )
    rows = roc.roc_curve(df).orderBy("threshold").collect()
    assert [tuple(r) for r in rows] == [(0.1, 1.0, 0.0), (0.8, 1.0, 0.5), (0.9, 0.5, 1.0)]
    assert roc.auc(df).first()["auc"] == pytest.approx(0.875)


def test_selection_confirms_signal_and_rejects_noise(planted):
    features = ["PlateLocSide", "RelSpeed", "Inning", "SpinAxis", "Outs"]
    chosen = selection.select_features(
        planted.where("TaggedPitchType = 'Fastball'"), "is_Swing", features, max_runs=14,
        trees=10, depth=4, sample_rows=1500,
    ).collect()
    decision = {r["feature"]: r["decision"] for r in chosen}
    assert decision["PlateLocSide"] == decision["RelSpeed"] == "Confirmed"
    assert "Confirmed" not in {decision["Inning"], decision["SpinAxis"], decision["Outs"]}
    assert {chosen[0]["feature"], chosen[1]["feature"]} == {"PlateLocSide", "RelSpeed"}


def test_shadow_copies_keep_values_and_move_rows():
    codes = np.arange(100, dtype=np.uint8).reshape(50, 2)
    wide = selection.with_shadows(codes, [1, 0, 1], (1, 2))
    assert np.array_equal(wide[:, :2], codes)
    for j, c in enumerate([1, 0, 1]):
        assert sorted(wide[:, 2 + j]) == sorted(codes[:, c]) and (wide[:, 2 + j] != codes[:, c]).sum() > 40
    assert not np.array_equal(wide[:, 2], wide[:, 4])


def test_bins_rise_with_the_values():
    values = np.array([5.0, 1.0, 1.0, 3.0] * 100 + list(range(10, 500)))
    codes = selection.binned(values)
    order = np.argsort(values, kind="stable")
    assert (np.diff(codes[order].astype(int)) >= 0).all() and len({codes[1], codes[2]}) == 1
    assert codes.max() < selection.BINS and np.bincount(codes).max() <= 200 and codes[0] > codes[3] > codes[1]


def plain_tree(codes, label, weight, depth, choose):
    """Votes of all rows by a tree that tries every cut, node by node."""
    votes = np.zeros(len(label), bool)

    def gini(rows):
        n, p = weight[rows].sum(), (weight * label)[rows].sum()
        return (p**2 + (n - p) ** 2) / n if n else -1.0

    def build(rows, level):
        best = (gini(rows) + 1e-9, None)
        n, p = weight[rows].sum(), (weight * label)[rows].sum()
        if level < depth and 0 < p < n:
            for f in choose:
                for c in range(255):
                    left = codes[rows, f] <= c
                    a, b = rows[left], rows[~left]
                    if weight[a].sum() and weight[b].sum() and gini(a) + gini(b) > best[0]:
                        best = (gini(a) + gini(b), (a, b))
        if best[1] is None:
            votes[rows] = 2 * p > n
        else:
            for part in best[1]:
                build(part, level + 1)

    build(np.arange(len(label)), 0)
    return votes


def test_tree_equals_one_that_tries_every_cut():
    rng = np.random.default_rng(5)
    for _ in range(5):
        codes = rng.integers(0, 40, (120, 3)).astype(np.uint8)
        label = ((codes[:, 0] > 20) ^ (rng.random(120) < 0.2)).astype(np.uint8)
        weight = np.bincount(rng.integers(0, 120, 120), minlength=120)
        # one feature to try leaves no ties between features
        one = codes[:, :1]
        tree = selection.grow_tree(one, label, weight, 4, 1, rng)
        assert np.array_equal(tree[2][selection._paths(tree, one, 4)[0]], plain_tree(one, label, weight, 4, [0]))


def test_losses_name_the_feature_that_matters():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 64, (800, 4)).astype(np.uint8)
    label = (codes[:, 2] > 32).astype(np.uint8)
    mean = np.zeros(4)
    for seed in range(20):
        for f, x in selection.losses(codes, label, 6, np.random.default_rng(seed)).items():
            mean[f] += x / 20
    assert mean[2] > 0.2 and (np.abs(np.delete(mean, 2)) < 0.05).all()


def test_losses_are_those_of_walks_row_by_row():
    data = np.random.default_rng(3)
    codes = data.integers(0, 64, (300, 5)).astype(np.uint8)
    label = ((codes[:, 1] > 30) ^ (data.random(300) < 0.2)).astype(np.uint8)

    def vote(tree, row):
        node, asked = 0, set()
        for _ in range(5):
            if (f := tree[0][node]) >= 0:
                asked.add(int(f))
                node = 2 * node + 1 + int(row[f] > tree[1][node])
        return tree[2][node], asked

    for seed in range(5):
        rng = np.random.default_rng(seed)
        weight = np.bincount(rng.integers(0, 300, 300), minlength=300)
        tree = selection.grow_tree(codes, label, weight, 5, 2, rng)
        held, truth = codes[weight == 0], label[weight == 0] == 1
        used = sorted(set().union(*(vote(tree, row)[1] for row in held)))
        want = {}
        for f in used:
            mixed = held.copy()
            mixed[:, f] = rng.permutation(held[:, f])
            right = [sum(vote(tree, r)[0] == t for r, t in zip(rows, truth, strict=True)) for rows in (held, mixed)]
            want[f] = (right[0] - right[1]) / len(held)
        assert selection.losses(codes, label, 5, np.random.default_rng(seed)) == pytest.approx(want)
        walk = list(selection._walk(tree, 5, lambda f: held[np.arange(len(held)), f], len(held)))  # noqa: B023
        assert np.array_equal(walk[-1][1], selection._paths(tree, held, 5)[0])


def noisy(spark, n):
    """Rows whose label follows `a`, and not `b`; values in steps, keys in no order."""
    spot = F.pmod(F.xxhash64("id"), F.lit(1000))
    other = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500))
    flip = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)) == 0
    label = ((spot > 500) != flip).cast("int")
    key = F.concat(F.lit("k"), F.xxhash64("id", F.lit(3)).cast("string"))
    return spark.range(n).select(key.alias("PitchUID"), (spot / 10).alias("a"), other.alias("b"), label.alias("is_Swing"))


def test_selection_works_on_all_rows(spark, monkeypatch):
    seen = []
    plain = selection.binned
    monkeypatch.setattr(selection, "binned", lambda values: (seen.append(len(values)), plain(values))[1])
    rows = noisy(spark, 31_000)
    selection.select_features(rows, "is_Swing", ["a", "b"], max_runs=1, trees=1, depth=1)
    assert seen == [31_000, 31_000]
    selection.select_features(rows, "is_Swing", ["a", "b"], max_runs=1, trees=1, depth=1, sample_rows=500)
    assert seen[2:] == [500, 500]


def test_rows_in_blocks_have_the_same_codes(spark):
    rows = noisy(spark, 3_000)
    made = selection.to_blocks(rows, "is_Swing", ["a", "b"], 3_000, block_rows=500)
    held = made.orderBy("number").collect()
    assert len(held) == 6 and sum(r.n for r in held) == 3_000
    codes = np.concatenate([np.frombuffer(r.codes, np.uint8).reshape(-1, 2) for r in held])
    label = np.concatenate([np.frombuffer(r.label, np.uint8) for r in held])
    plain = rows.select("a", "b", "is_Swing").toPandas()
    want = np.column_stack([selection.binned(plain["a"].to_numpy()), selection.binned(plain["b"].to_numpy()), plain["is_Swing"]])
    assert sorted(map(tuple, np.column_stack([codes, label]))) == sorted(map(tuple, want))
    again = selection.to_blocks(rows.repartition(5), "is_Swing", ["a", "b"], 3_000, block_rows=500)
    assert held == again.orderBy("number").collect()


def test_trees_over_blocks_equal_ones_that_try_every_cut(spark, monkeypatch):
    monkeypatch.setattr(selection, "SUMS_BYTES", 1 << 12)  # several passes a level
    made = selection.to_blocks(noisy(spark, 400), "is_Swing", ["a", "b"], 400, block_rows=100)
    held = [r.asDict() for r in made.orderBy("number").collect()]
    forest = selection.Forest([0], [], 1, 3, 4, 7)  # one feature to try leaves no ties between features
    codes, label = (np.concatenate(x) for x in zip(*map(forest.block, held), strict=True))
    for number, tree in enumerate(selection.grow_forest(made, forest)):
        weight = np.concatenate([forest.weight(number, r) for r in held])
        votes = tree[2][selection._paths(tree, codes, 4)[0]]
        own = weight > 0  # codes that only other rows have can lie on either side
        assert np.array_equal(votes[own], plain_tree(codes, label, weight, 4, [0])[own])


def test_selection_over_blocks_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK_ROWS", 1_000)
    options = {"max_runs": 12, "trees": 8, "depth": 3}
    ways = [selection.select_features(noisy(spark, 3_000), "is_Swing", ["a", "b"], whole_rows=n, **options).collect() for n in (0, 3_000)]
    for rows in ways:
        assert [(r.feature, r.decision == "Confirmed") for r in rows] == [("a", True), ("b", False)]
    assert ways[0][0].mean_imp == pytest.approx(ways[1][0].mean_imp, rel=0.5)


class Called(Exception):
    pass


def test_registered_queries_run_the_defaults(spark, monkeypatch):
    from moundlens.checks import queries

    def caught(name, module, function):
        seen = []

        def run(*args, **options):
            seen.append((args[1:], options))
            raise Called

        with monkeypatch.context() as patch:
            patch.setattr(module, function, run)
            with pytest.raises(Called):
                queries.all_queries()[name](spark, SMALL)
        return seen[0][1]

    assert set(caught("train_swing_model", swing_models, "train_all")) == {"seed"}
    assert set(caught("score_swing", swing_models, "train_swing")) == {"seed"}
    assert set(caught("model_roundtrip", swing_models, "train_swing")) == {"seed"}
    assert set(caught("feature_selection", selection, "select_features")) == {"seed"}


def test_roundtrip_saves_all_classes(spark, monkeypatch):
    from moundlens.checks import queries

    train, saved = swing_models.train_swing, []
    monkeypatch.setattr(swing_models, "train_swing", lambda df, name, seed: saved.append(name) or train(df, name, rounds=1, seed=seed))
    row = queries.all_queries()["model_roundtrip"](spark, SMALL).first()
    assert saved == list(swing_models.SWING_CLASSES) and row.scored > 0 and row.max_change == 0
