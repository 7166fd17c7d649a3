from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_set
from moundlens.plans import density, leaderboards, platoon, swing


def test_density_equals_a_dense_sum(log):
    cells = density.location_density(log, ["Last1, First1"], n=23)
    points = {}
    for r in log.where("Pitcher = 'Last1, First1'").collect():
        x, y, kind = r["PlateLocSide"], r["PlateLocHeight"], r["TaggedPitchType"]
        if kind not in (None, "Other", "Undefined") and x is not None and y is not None:
            if abs(x) <= 1.7 and 0 <= y <= 4.5:
                points.setdefault(kind, []).append((x, y))
    gx, gy = np.linspace(-1.7, 1.7, 23), np.linspace(0, 4.5, 23)
    found: dict = {}
    for r in cells.collect():
        found.setdefault(r["TaggedPitchType"], np.zeros((23, 23)))[r["ix"], r["iy"]] = r["density"]
        assert r["side"] == pytest.approx(gx[r["ix"]]) and r["height"] == pytest.approx(gy[r["iy"]])
    assert found
    for kind, pts in points.items():
        pts = np.array(pts)
        widths = []
        for axis in pts.T:
            q25, q75 = np.quantile(axis, [0.25, 0.75])
            sd = axis.std(ddof=1) if len(axis) > 1 else 0
            widths.append(1.06 * min(sd, (q75 - q25) / 1.34) * len(axis) ** -0.2)
        if min(widths) <= 0:
            assert kind not in found
            continue
        kx = np.exp(-0.5 * ((gx[:, None] - pts[:, 0]) / widths[0]) ** 2)
        ky = np.exp(-0.5 * ((gy[:, None] - pts[:, 1]) / widths[1]) ** 2)
        dense = kx @ ky.T / (2 * np.pi * len(pts) * widths[0] * widths[1])
        np.testing.assert_allclose(found[kind], dense, rtol=1e-9, atol=1e-15)


def test_regions_hold_their_mass_with_the_fewest_cells(log):
    groups = ["Pitcher", "BatterSide", "TaggedPitchType"]
    one = log.where("Pitcher = 'Last2, First2' AND TaggedPitchType = 'Fastball'")
    cells = density.density_grid(one.where("BatterSide = 'Left'"), groups, 15).collect()
    total = sum(c["density"] for c in cells)
    ordered = sorted((c["density"] for c in cells), reverse=True)
    regions = density.location_regions(one, n=15).where("BatterSide = 'Left'").collect()
    for prob in density.REGION_PROBS:
        inside = [r["density"] for r in regions if r["region"] <= prob]
        assert sum(inside) >= prob * total
        assert sum(ordered[: len(inside) - 1]) < prob * total
        assert sorted(inside, reverse=True) == ordered[: len(inside)]


def test_snapped_points_near_the_exact_density(log):
    # locations of the derived log are multiples of 0.01 already, so counting them changes nothing
    one = ["Last1, First1"]
    exact = location_cells(density.location_density(log, one, n=9))
    assert location_cells(density.location_density(log, one, n=9, snap=0.01)) == pytest.approx(exact)
    coarse = location_cells(density.location_density(log, one, n=9, snap=0.05))
    assert coarse == pytest.approx(exact, abs=0.05) and coarse != exact


def location_cells(df) -> dict:
    return {(r["TaggedPitchType"], r["ix"], r["iy"]): r["ndensity"] for r in df.collect()}


def test_density_without_broadcast_is_the_same(log):
    plain = density.location_density(log, n=5).select("Pitcher", "TaggedPitchType", "ix", "iy", F.round("ndensity", 9))
    spread = density.location_density(log, n=5, broadcast_bytes=0).select(
        "Pitcher", "TaggedPitchType", "ix", "iy", F.round("ndensity", 9)
    )
    assert as_set(plain) == as_set(spread)


def _error_bound(width, step):
    return step**2 / (8 * width**2) + 0.61 * step / (2048 * width)


@pytest.mark.parametrize(("n", "fine"), [(100, density.FINE), (13, 3)])
def test_convolved_density_within_its_bound(spark, n, fine):
    rng = np.random.default_rng(3)
    spots = np.r_[rng.normal([0.3, 2.4], [0.5, 0.8], (400, 2)), [[1.7, 4.5], [-1.7, 0.0], [1.71, 2.0]]]
    rows = [("a", float(x), float(y)) for x, y in spots] + [(None, float(x) / 9, float(y) / 3) for x, y in spots[:40]]
    rows += [("flat", 0.5, float(y)) for y in rng.uniform(1, 4, 30)] + [("a", None, 1.0), ("a", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, PlateLocSide double, PlateLocHeight double").repartition(5)
    found = {}
    for r in density.convolved_grid(df, ["g"], n, fine).collect():
        grids = found.setdefault(r["g"], np.full((4, n, n), np.nan))
        grids[:, r["ix"], r["iy"]] = r["density"], r["ndensity"], r["region"] or np.nan, r["side"]
    assert set(found) == {"a", None}  # no spread, no density
    grid = np.linspace(-1.7, 1.7, n), np.linspace(0, 4.5, n)
    for name, (got, scaled, region, side) in found.items():
        pts = np.array([(x, y) for g, x, y in rows if g == name and x is not None and abs(x) <= 1.7 and 0 <= y <= 4.5])
        parts, bound, widths = [], 0, []
        for axis, at in zip(pts.T, grid, strict=True):
            q25, q75 = np.quantile(axis, [0.25, 0.75])
            width = 1.06 * min(axis.std(ddof=1), (q75 - q25) / 1.34) * len(axis) ** -0.2
            parts.append(np.exp(-0.5 * ((at[:, None] - axis) / width) ** 2))
            bound += _error_bound(width, (at[1] - at[0]) / fine)
            widths.append(width)
        peak = 1 / (2 * np.pi * widths[0] * widths[1])
        dense = parts[0] @ parts[1].T * peak / len(pts)
        assert np.abs(got - dense).max() <= bound * peak
        assert scaled == pytest.approx(got / got.max()) and side[:, 0] == pytest.approx(grid[0])
        for prob in density.REGION_PROBS:
            inside = got[region <= prob]
            assert inside.sum() >= prob * got.sum() > inside.sum() - inside.min() * np.sum(inside == inside.min()) - 1e-12
            assert inside.min() > np.max(got[~(region <= prob)], initial=-1)


def test_convolved_density_near_the_exact_one(log):
    one = ["Last1, First1"]
    exact = location_cells(density.location_density(log, one, n=9))
    binned = location_cells(density.location_density(log, one, n=9, convolve=True, fine=88))
    assert binned == pytest.approx(exact, abs=2e-3)
    wide = density.location_regions(log, one, n=9).count()
    assert abs(density.location_regions(log, one, n=9, convolve=True, fine=88).count() - wide) <= wide // 50


def test_convolved_density_without_pitches(log):
    assert density.location_density(log.where("false"), convolve=True).collect() == []


def _sample(log):
    return platoon.platoon_sample(log, min_pa=30, min_side=5)


def test_pairs_join_and_aggregate_agree(log):
    splits = platoon.split_woba(platoon.final_pitches(log))
    joined = platoon.paired_split_join(splits)
    paired = platoon.paired_splits(splits).select(*joined.columns)
    assert as_set(joined) == as_set(paired) != set()


def test_sample_thresholds_and_salted_join(log):
    sample = _sample(log)
    low = sample.agg(F.min("PA"), F.min("Same_Side_PA"), F.min("Oppo_Side_PA")).first()
    assert low[0] >= 30 and low[1] >= 5 and low[2] >= 5
    spread = platoon.platoon_sample(log, 30, 5, broadcast_bytes=0)
    assert as_set(sample) == as_set(spread)


def test_tied_split_has_no_side(spark):
    splits = spark.createDataFrame(
        [("a", "T", "Same Side", 9, 0.3), ("a", "T", "Oppo Side", 8, 0.3),
         ("b", "T", "Same Side", 9, 0.4), ("b", "T", "Oppo Side", 8, 0.3),
         ("c", "T", "Oppo Side", 8, 0.3)],
        "Batter string, BatterTeam string, Platoon_Advantage string, PA long, wOBA double",
    )
    pairs = platoon.paired_splits(splits)
    assert {r["Batter"]: r["which_side"] for r in pairs.collect()} == {"a": None, "b": "Same Higher"}
    counts = {r["which_side"]: r["batters"] for r in platoon.side_counts(pairs).collect()}
    assert counts == {None: 1, "Same Higher": 1}


def test_prediction_codings(spark):
    fit = spark.createDataFrame([("(Intercept)", 0.3), ("x", 0.02)], "term string, estimate double")
    half = {r[0]: r[1] for r in platoon.ols_predictions(fit).collect()}
    assert half == pytest.approx({"Same Side": 0.29, "Oppo Side": 0.31})
    both = {r[0]: r[1] for r in platoon.ols_predictions(fit, "indicator").collect()}
    assert both == pytest.approx({"Same Side": 0.3, "Oppo Side": 0.32})


def _dense_reml(y, x, g, psi):
    n = len(y)
    z = (g[:, None] == np.unique(g)[None, :]).astype(float)
    v = np.eye(n) + psi * z @ z.T
    design = np.column_stack([np.ones(n), x])
    vi = np.linalg.inv(v)
    a = design.T @ vi @ design
    beta = np.linalg.solve(a, design.T @ vi @ y)
    rest = y - design @ beta
    rss = rest @ vi @ rest
    crit = (n - 2) * (1 + np.log(2 * np.pi * rss / (n - 2))) + np.linalg.slogdet(v)[1]
    return crit + np.linalg.slogdet(a)[1], beta, psi * z.T @ vi @ rest


@pytest.mark.parametrize("spread", [0.6, 0.0])
def test_random_intercept_equals_dense_matrices(spark, spread):
    rng = np.random.default_rng(11)
    g = rng.integers(0, 12, 240)
    x = rng.integers(0, 2, 240).astype(float)
    y = 0.3 + 0.1 * x + spread * rng.normal(size=12)[g] + rng.normal(size=240)
    rows = [(f"b{i:02d}", float(a), float(b)) for i, a, b in zip(g, x, y, strict=True)]
    fit = platoon.random_intercept(
        spark.createDataFrame(rows, "g string, x double, y double"), "y", "x", "g"
    )
    crit, beta, effects = _dense_reml(y, x, g, fit.psi)
    assert fit.criterion == pytest.approx(crit, rel=1e-10)
    assert (fit.beta0, fit.beta1) == pytest.approx(tuple(beta), rel=1e-8)
    around = [fit.psi * f for f in (0.9, 0.99, 1.01, 1.1)] or [0.0]
    assert all(_dense_reml(y, x, g, p)[0] >= fit.criterion - 1e-9 for p in [*around, 0.0, 1e-4, 1.0])
    own = [r["beta0"] for r in fit.coefficients.orderBy("g").collect()]
    np.testing.assert_allclose(own, beta[0] + effects, atol=1e-8)


def test_summary_of_the_random_intercept_equals_dense_matrices(spark):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 9, 150)
    x = rng.integers(0, 2, 150).astype(float)
    y = 0.3 + 0.1 * x + 0.7 * rng.normal(size=9)[g] + rng.normal(size=150)
    rows = [(f"b{i}", float(a), float(b)) for i, a, b in zip(g, x, y, strict=True)]
    df = spark.createDataFrame(rows + rows[:7] + [(None, 1.0, 1.0), ("b1", None, 1.0)], "g string, x double, y double")
    g, x, y = (np.r_[v, v[:7]] for v in (g, x, y))
    fit = platoon.random_intercept(df, "y", "x", "g")
    got = {(r["part"], r["name"]): r["value"] for r in platoon.mixed_summary(df, fit, "y", "x", "g").collect()}
    z = (g[:, None] == np.unique(g)[None, :]).astype(float)
    design = np.column_stack([np.ones(len(y)), x])
    vi = np.linalg.inv(np.eye(len(y)) + fit.psi * z @ z.T)
    cov = np.linalg.inv(design.T @ vi @ design) * fit.sigma2
    _, beta, effects = _dense_reml(y, x, g, fit.psi)
    errors = np.sqrt(np.diag(cov))
    for k, name in enumerate(("(Intercept)", "x")):
        assert got["fixed", f"{name} std_error"] == pytest.approx(errors[k])
        assert got["fixed", f"{name} t_value"] == pytest.approx(beta[k] / errors[k])
    assert got["fixed", "correlation"] == pytest.approx(cov[0, 1] / errors.prod())
    assert got["random", "g variance"] == pytest.approx(fit.psi * fit.sigma2)
    scaled = (y - design @ beta - z @ effects) / np.sqrt(fit.sigma2)
    want = np.quantile(scaled, list(platoon.QUARTILES.values()))
    assert [got["scaled_residual", q] for q in platoon.QUARTILES] == pytest.approx(list(want))
    assert (got["fit", "observations"], got["fit", "groups"]) == (157, 9)
    spread = platoon.mixed_summary(df, fit, "y", "x", "g", broadcast_bytes=0).collect()
    assert {(r["part"], r["name"]): r["value"] for r in spread} == pytest.approx(got)


def test_groups_far_apart_are_not_clipped(spark):
    rng = np.random.default_rng(8)
    g = np.repeat(np.arange(6), 5)
    x = np.tile([0.0, 1.0, 0.0, 1.0, 1.0], 6)
    y = 1e4 * g + x + rng.normal(size=30)
    rows = [(f"b{i}", float(a), float(b)) for i, a, b in zip(g, x, y, strict=True)]
    fit = platoon.random_intercept(spark.createDataFrame(rows, "g string, x double, y double"), "y", "x", "g")
    between = np.var([(y - x)[g == k].mean() for k in range(6)], ddof=1)
    assert fit.psi > 1e7 and fit.group_variance == pytest.approx(between, rel=0.01)


def test_ols_summary_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3, 90).astype(float), rng.normal(size=90).round(1)
    rows = [*zip(x.tolist(), y.tolist(), strict=True), (None, 1.0), (1.0, None)]
    row = platoon.ols_summary(spark.createDataFrame(rows, "x double, y double"), "y", "x").first()
    slope, start = np.polyfit(x, y, 1)
    rest = y - start - slope * x
    want = np.quantile(rest, list(platoon.QUARTILES.values()))
    assert [row[f"residual_{q}"] for q in platoon.QUARTILES] == pytest.approx(list(want))
    explained = 1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum()
    assert row["adj_r_squared"] == pytest.approx(1 - (1 - explained) * 89 / 88)
    assert row["f_value"] == pytest.approx(explained / (1 - explained) * 88)
    assert (row["df1"], row["df2"]) == (1.0, 88.0)


def test_ols_summary_without_rows(spark):
    assert platoon.ols_summary(spark.createDataFrame([], "x double, y double"), "y", "x").first()["f_value"] is None


def test_random_intercept_without_data(spark):
    schema = "g string, x double, y double"
    empty = platoon.random_intercept(spark.createDataFrame([], schema), "y", "x", "g")
    assert empty.coefficients.collect() == []
    nothing = spark.createDataFrame([], schema)
    assert platoon.mixed_summary(nothing, empty, "y", "x", "g").collect() == []
    flat = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 3.0)], schema)
    with pytest.raises(ValueError, match="two values"):
        platoon.random_intercept(flat, "y", "x", "g")


def test_batter_splits_are_half_a_slope_apart(spark):
    coef = spark.createDataFrame([("a", 0.3, 0.02)], "Batter string, beta0 double, beta1 double")
    rows = {r[1]: r[2] for r in platoon.batter_splits(coef).collect()}
    assert rows == pytest.approx({"Same Side": 0.29, "Oppo Side": 0.31})


def test_days_without_a_fastball_drop_out(make):
    df = make(
        {"RelSpeed": 90.0}, {"TaggedPitchType": "Sinker", "RelSpeed": 92.0},
        {"TaggedPitchType": "Slider", "RelSpeed": 80.0},
        {"TaggedPitchType": "Slider", "PitcherTeam": "ZZZ"},
        {"TaggedPitchType": "Splitter", "PitcherThrows": None},
        {"TaggedPitchType": "Fastball", "PitcherThrows": None, "RelSpeed": 70.0},
    )
    joined = swing.join_fastball_baseline(swing.pipeline_pitches(df))
    found = {r["PitchUID"]: r["Fastball_Velo"] for r in joined.collect()}
    assert found == {"u0": 91.0, "u1": 91.0, "u2": 91.0, "u4": 70.0, "u5": 70.0}
    ready = {r["PitchUID"]: r for r in swing.model_ready(df).collect()}
    assert ready["u2"]["FB_Velo_Diff"] == -11.0 and ready["u0"]["FB_Velo_Diff"] is None
    assert "u4" not in ready  # mirrored break is unknown


def test_play_labels(make):
    df = make(
        {"PitchCall": "FoulBall", "Strikes": 2, "Balls": 1}, {"PitchCall": "BallCalled", "Balls": 3},
        {"PitchCall": "StrikeSwinging", "Strikes": 2}, {"PitchCall": "InPlay", "PlayResult": "Double"},
        {"PitchCall": "StrikeCalled"}, {"PitchCall": "HitByPitch"}, {"PitchCall": None},
    )
    rows = swing.play_labels(df).orderBy("PitchUID").collect()
    assert [(r["Event"], r["Type"], r["new_Count"]) for r in rows] == [
        (None, "S", "1-2"), ("walk", "B", None), ("strikeout", "S", None), ("Double", "X", None),
        (None, "S", "0-1"), ("hit_by_pitch", "B", None), (None, None, None),
    ]


def test_natural_join_multiplies_equal_pitches(make):
    ready = swing.model_ready(make({}, {"PlateLocSide": None}, {"PlateLocSide": None}, {"RelSpeed": 91.0}))
    scored = swing.stack_scored([ready.withColumn("xSwing_Pred", F.lit(0.5))])
    weighted = swing.natural_join(scored, ready)
    assert {r["PitchUID"]: r["copies"] for r in weighted.collect()} == {
        "u0": 1, "u1": 2, "u2": 2, "u3": 1,
    }
    joined = swing.natural_join(scored, ready, expand=True)
    counts = {r["PitchUID"]: r["count"] for r in joined.groupBy("PitchUID").count().collect()}
    assert counts == {"u0": 1, "u1": 2, "u2": 2, "u3": 1}


def test_boards_are_sorted_and_named_team_equals_all_teams(log):
    everyone = leaderboards.top_swing_diff(log, k=4)
    one = leaderboards.top_swing_diff(log, "TM_3", k=4)
    rows = one.collect()
    assert [r["xswing_diff"] for r in rows] == sorted((r["xswing_diff"] for r in rows), reverse=True)
    assert as_set(one) == as_set(everyone.where("BatterTeam = 'TM_3'"))
    plan = everyone._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    board = leaderboards.chase_diff(log, min_n=10).collect()
    assert [r["chase_diff"] for r in board] == sorted(r["chase_diff"] for r in board)
    heart = leaderboards.heart_diff(log, min_n=2, k=None).collect()
    assert [r["swing_diff"] for r in heart] == sorted((r["swing_diff"] for r in heart), reverse=True)
    team = leaderboards.chase_diff(log, "TM_3", min_n=10)
    assert {r["BatterTeam"] for r in team.collect()} == {"TM_3"}


def test_quantile_bins_close_the_top(spark):
    board = spark.createDataFrame([(float(i) / 100,) for i in range(29)] + [(None,)], "v double")
    rows = leaderboards.add_quantile_bins(board, {"v": "b"}).orderBy("v").collect()
    assert rows[0]["b"] is None
    assert [r["b"] for r in rows[1:]] == [min(i // 2 + 1, 14) for i in range(29)]
    flat = spark.createDataFrame([(0.2,), (0.2,)], "v double")
    assert [r["b"] for r in leaderboards.add_quantile_bins(flat, {"v": "b"}).collect()] == [1, 1]


def test_a_pitcher_with_a_third_of_all_pitches(log):
    hot = F.pmod(F.xxhash64("PitchUID"), F.lit(3)) == 0
    fixed = {"Pitcher": "Hot, One", "PitcherTeam": "HOT", "PitcherThrows": "Right"}
    skewed = log.withColumns(
        {name: F.when(hot, F.lit(v)).otherwise(F.col(name)) for name, v in fixed.items()}
    ).withColumn("Date", F.when(hot, F.to_date(F.lit("2023-03-10"))).otherwise(F.col("Date")))
    pitches = swing.pipeline_pitches(skewed)
    names = ["PitchUID", "Fastball_Velo", "Fastball_HB", "Fastball_IVB"]
    small = swing.join_fastball_baseline(pitches).select(*names)
    spread = swing.join_fastball_baseline(pitches, broadcast_bytes=0).select(*names)
    assert as_set(small) == as_set(spread)
    # the hot key's rows end in many tasks, not in one
    tasks = (
        swing.join_fastball_baseline(pitches, broadcast_bytes=0)
        .where("Pitcher = 'Hot, One'")
        .select(F.spark_partition_id().alias("task"))
        .distinct()
    )
    spark = log.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tasks.count() >= 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("convolve", [False, True])
@pytest.mark.parametrize("made", [density.location_density, density.location_regions])
def test_groups_that_fit_a_task_move_once(log, capsys, made, convolve):
    whole = made(log, n=7, convolve=convolve)
    whole.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Window" not in plan
    value = "ndensity" if made is density.location_density else "region"
    keys = [c for c in ("Pitcher", "BatterSide", "TaggedPitchType") if c in whole.columns]

    def cells(df):
        return {tuple(r[k] for k in (*keys, "ix", "iy")): (r["density"], r[value]) for r in df.collect()}

    found, spread = cells(whole), cells(made(log, n=7, convolve=convolve, whole_rows=0))
    mixed = cells(made(log, n=7, convolve=convolve, whole_rows=40))
    assert found and found.keys() == spread.keys() == mixed.keys()
    for key, value_ in found.items():
        assert value_ == pytest.approx(spread[key]) and value_ == pytest.approx(mixed[key])
