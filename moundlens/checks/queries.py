"""Registered queries: name -> f(spark, sf_dir) -> DataFrame, each over the whole derived log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from moundlens.checks.fixture import event_weights, pitches
from moundlens.functions.nulls import flag, if_known, in_set, within
from moundlens.functions.numbers import (
    exact_mean, exact_sum, percent_text, ratio, round_half_up, strict_mean,
)
from moundlens.functions.text import count_label, level_rank, name_parts
from moundlens.operators import filters, flags
from moundlens.operators.sampling import sample_n, stratified_split
from moundlens.plans import (
    daily, density, leaderboards, mix, platoon, reports, roc, selection, swing, swing_models,
)
from moundlens.schema import (
    PIPELINE_TYPES, PITCH_COLUMNS, PITCH_TYPE_ORDER, REPORT_SWINGS,
    SCORED_COLUMNS, STORE_SEASON, SWING_CLASSES,
)
from moundlens.sources.keyed_store import KeyedStore
from moundlens.sources.pitch_log import align_schema, read_season_csv, read_store, union_seasons, write_csv
from moundlens.sources.pruned_store import write_pruned_store
from moundlens.sources.scratch import fresh_path, materialize
from moundlens.sources.season_load import load_games
from moundlens.sources.typed_scan import infer_types, scan_season

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

DATE_FROM, DATE_TO = "2022-03-03", "2023-04-10"
GRID = 20  # the default of 100 makes 8 million result rows at the scale of the SQL check
SAMPLE = 30_000
SEED = 2004


def _query(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a function of the pitch log under its name, without a trailing underscore."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(pitches(spark, sf_dir))

    _QUERIES[function.__name__.rstrip("_")] = run
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- sources and sinks


@_query
def scan_csv(log):
    path = fresh_path(log.sparkSession, "csv")
    write_csv(log.select(*PITCH_COLUMNS), path)
    return read_season_csv(log.sparkSession, path)


@_query
def inferred_types(log):
    spark, path = log.sparkSession, fresh_path(log.sparkSession, "csv")
    write_csv(log.select(*PITCH_COLUMNS), path, "gzip")
    found = [(f.name, f.dataType.simpleString()) for f in infer_types(spark, path)]
    return spark.createDataFrame(found, "name string, kind string")


@_query
def quarantined_records(log):
    """Records with planted faults, by the column that they are found in."""
    spark, path = log.sparkSession, fresh_path(log.sparkSession, "csv")
    sort = F.substring(F.md5("PitchUID"), 1, 1)
    spoilt = {
        "Balls": F.when(sort == "0", F.lit("two")).otherwise(F.col("Balls").cast("string")),
        "Date": F.when(sort == "1", F.lit("2023-02-30")).otherwise(F.col("Date").cast("string")),
        "RelSpeed": F.when(sort.isin("1", "2"), F.lit("9o.1")).otherwise(F.col("RelSpeed").cast("string")),
    }
    write_csv(log.select("PitchUID", "Balls", "Date", "RelSpeed").withColumns(spoilt), path)
    scan = scan_season(spark, path, log.select("PitchUID", "Balls", "Date", "RelSpeed").schema)
    bad = scan.quarantine.select(
        F.split_part("text", F.lit(","), F.lit(1)).alias("PitchUID"), F.array_join("problems", ",").alias("problems")
    )
    return bad.unionByName(scan.rows.select("PitchUID", F.lit("").alias("problems")))


@_query
def season_loads(log):
    """The log by way of a wrong early delivery, a correction, and the same files once more."""
    path, pitches_ = fresh_path(log.sparkSession, "loaded"), log.drop(STORE_SEASON)
    wrong = pitches_.where((F.col("Inning") > 2) | (F.year("Date") != 2023))
    late = wrong.withColumn("Date", F.when(F.month("Date") == 3, F.date_add("Date", 400)).otherwise(F.col("Date")))
    stray = late.withColumn("gameID", F.concat(F.lit("stray"), F.pmod(F.xxhash64("PitchUID"), F.lit(9))))
    load_games(late.unionByName(stray), path)
    names = stray.select("gameID").distinct()
    first, again = load_games(pitches_, path, names), load_games(pitches_, path)
    if (again.inserted, again.replaced, again.deleted) != (0, 0, 0) or not first.deleted:
        raise RuntimeError("a second load of the same games changed the store")
    return read_store(log.sparkSession, path).select(*PITCH_COLUMNS)


@_query
def align_schema_(log):
    wider = log.select(
        *reversed(PITCH_COLUMNS), F.lit("x").alias("Extra Col."), F.lit(1).alias("wExtra+")
    )
    return align_schema(wider)



@_query
def sink_csv(log):
    spark, path = log.sparkSession, fresh_path(log.sparkSession, "csv")
    scored = log.select(*PITCH_COLUMNS, *[c for c in ("is_Swing", "xSwing_Pred") if c not in PITCH_COLUMNS])
    write_csv(scored, path, "gzip")
    return align_schema(
        spark.read.option("header", True).option("nullValue", "NA").csv(path), scored.schema
    )


@_query
def model_roundtrip(log):
    ready = _ready(log)
    parts = []
    for name in SWING_CLASSES:
        model = swing_models.train_swing(ready, name, seed=SEED)
        path = fresh_path(log.sparkSession, "model")
        swing_models.save_model(model, path)
        first = swing_models.score_class(ready, model, name)
        again = swing_models.score_class(
            first.withColumnRenamed("xSwing_Pred", "before"), swing_models.load_model(path), name
        )
        parts.append(again.select("before", "xSwing_Pred", F.lit(name).alias("swing_class")))
    # all three classes count for the change; `scored` has always been the offspeed pitches
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(
        F.count(F.when(F.col("swing_class") == "Offspeed", 1)).alias("scored"),
        F.max(F.abs(F.col("xSwing_Pred") - F.col("before"))).alias("max_change"),
    )


# --- projections and filters


@_query
def project_cols(log):
    return log.select("PitchUID", "Batter", "BatterTeam", "woba_value", "woba_denom")


@_query
def drop_cols(log):
    return log.select("PitchUID", "RelSpeed", "SpinRate", "PlateLocSide", "is_Swing").drop(
        "is_Swing"
    )


@_query
def pitch_flags(log):
    added = flags.pitch_flags(log.select("PitchUID", *_FLAG_INPUTS))
    # is_Swing of the derived log belongs to the model profile, so only the inputs go in
    return added.drop(*_FLAG_INPUTS)


_FLAG_INPUTS = [
    "PitchCall", "PlayResult", "TaggedHitType", "Angle", "ExitSpeed", "PlateLocSide",
    "PlateLocHeight", "Balls", "Strikes", "xwOBACON_value",
]


@_query
def recode_pitch_type(log):
    return flags.recode_splitter(log.select("PitchUID", "TaggedPitchType"))


@_query
def filter_level(log):
    return filters.by_level(log).select("PitchUID", "Level")


@_query
def filter_membership(log):
    kept = filters.by_membership(log, "TaggedPitchType", PIPELINE_TYPES)
    return kept.select("PitchUID", "TaggedPitchType")


@_query
def filter_valid_pitches(log):
    return filters.valid_pitches(log).select("PitchUID", "PitchCall", "TaggedPitchType")


@_query
def filter_pitcher_dates(log):
    kept = filters.pitcher_dates(log, None, DATE_FROM, DATE_TO)
    return kept.select("PitchUID", "Pitcher", "Date")


@_query
def filter_excluded_date(log):
    return filters.exclude_date(log).select("PitchUID", "Date")


@_query
def filter_not_null(log):
    kept = filters.not_null(log, ["RelSpeed", "InducedVertBreak", "HorzBreak", "SpinAxis"])
    return kept.select("PitchUID", "RelSpeed", "InducedVertBreak", "HorzBreak", "SpinAxis")


@_query
def drop_any_null(log):
    return filters.no_nulls(
        log.select("PitchUID", "RelSpeed", "SpinRate", "PlateLocSide", "PlateLocHeight", "PitchCall")
    )


@_query
def filter_year(log):
    return filters.in_year(log, 2023).select("PitchUID", "Date")


@_query
def zone_filter(log):
    inside = filters.in_zone(log).select("PitchUID", F.lit("in").alias("zone"))
    outside = filters.out_of_zone(log).select("PitchUID", F.lit("out").alias("zone"))
    return inside.unionByName(outside)


@_query
def heart_filter(log):
    return filters.in_heart(log).select("PitchUID", "PlateLocSide", "PlateLocHeight")


@_query
def zone_bands(log):
    both = flags.movement_bands(flags.pitch_flags(log))
    return both.select("PitchUID", "TopZoneCheck", "BotZoneCheck", "TopZone", "BotZone")


@_query
def having_min_sample(log):
    counted = log.groupBy("Pitcher").agg(F.count(F.lit(1)).alias("pitches"))
    return filters.min_sample(counted, "pitches", 100)


# --- joins


@_query
def join_fastball_baseline(log):
    joined = swing.join_fastball_baseline(swing.pipeline_pitches(log))
    return joined.select(
        "PitchUID", "Pitcher", "Date", "Fastball_Velo", "Fastball_HB", "Fastball_IVB"
    )


@_query
def join_pa_counts(log):
    return platoon.join_pa_counts(platoon.final_pitches(log))


def _keyed(log: DataFrame, keys: list[str]) -> KeyedStore:
    return KeyedStore.write(log, fresh_path(log.sparkSession, "keyed"), keys)


@_query
def join_stored_baseline(log):
    """`join_fastball_baseline` bucket by bucket."""
    joined = swing.join_stored_baseline(_keyed(log, swing.BASELINE_KEYS))
    return joined.select(
        "PitchUID", "Pitcher", "Date", "Fastball_Velo", "Fastball_HB", "Fastball_IVB"
    )


@_query
def join_stored_counts(log):
    """`join_pa_counts` bucket by bucket."""
    return platoon.join_stored_counts(_keyed(log.select(*platoon.FINAL_INPUTS), platoon.BATTER))


@_query
def paired_split_join(log):
    return platoon.paired_split_join(platoon.split_woba(platoon.final_pitches(log)))


@_query
def left_join_totals(log):
    return mix.totals_with_detail(log)


def _ready(log: DataFrame, *extra: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Model-ready pitches, written once because several classes and models read them; only
    `columns` of them where these are all that is read."""
    ready = swing.model_ready(log, extra=extra)
    return materialize(ready if columns is None else ready.select(*columns), "model_ready")


def _scored_classes(ready: DataFrame) -> DataFrame:
    return swing.stack_scored([swing.class_pitches(ready, name) for name in SWING_CLASSES])


@_query
def natural_join_nullsafe(log):
    ready = _ready(log, "xSwing_Pred")
    joined = swing.natural_join(_scored_classes(ready), ready.drop("xSwing_Pred"))
    return joined.select(
        "PitchUID", "Pitcher", "Batter", "SpinRate", "is_Swing", "xSwing_Pred", "copies"
    )


@_query
def event_weights_join(log):
    weighted = swing.add_event_weights(swing.play_labels(log), *event_weights(log))
    return weighted.select(
        "PitchUID", "Event", "Type", "Count", "new_Count", "woba_value", "woba_denom", "Run_Value"
    )


# --- aggregations


def _flagged(log: DataFrame) -> DataFrame:
    return flags.pitch_type(flags.pitch_flags(filters.valid_pitches(log)))


@_query
def agg_count(log):
    return log.groupBy("Balls", "Strikes").agg(F.count(F.lit(1)).alias("pitches"))


@_query
def agg_mean(log):
    return log.groupBy("Pitcher").agg(
        *[
            round_half_up(exact_mean(F.col(name)), 6).alias(alias)
            for name, alias in (("RelSpeed", "velo"), ("HorzBreak", "hb"), ("SpinRate", "spin"))
        ]
    )


@_query
def agg_mean_filtered(log):
    return (
        _flagged(log)
        .groupBy("Pitcher")
        .agg(
            F.avg(F.when(F.col("Strikes") == 2, flag(F.col("is_CSW")))).alias("put_away"),
            F.avg(F.when(F.col("is_Swing"), flag(F.col("is_Whiff")))).alias("whiff"),
            F.avg(F.when(~F.col("is_Zone"), flag(F.col("is_Swing")))).alias("chase"),
        )
    )


@_query
def agg_mean_strict(log):
    zone_swing = F.col("is_Zone") & F.col("is_Swing")
    return (
        _flagged(log)
        .groupBy("Pitcher", "pitch_type")
        .agg(
            strict_mean(flag(F.col("is_Strike")), F.col("PitchofPA") == 1).alias("fps"),
            strict_mean(flag(F.col("is_Whiff")), zone_swing).alias("z_whiff"),
        )
    )


@_query
def agg_sum_flag(log):
    flagged = _flagged(log).groupBy("Pitcher")
    return flagged.agg(F.sum(flag(F.col("is_BBE"))).alias("bbe"))


@_query
def agg_sum_filtered(log):
    counts = platoon.appearance_counts(platoon.final_pitches(log))
    return counts.select("Batter", "BatterTeam", "Same_Side_PA", "Oppo_Side_PA")


@_query
def agg_sum_measure(log):
    return log.groupBy("pitchzone").agg(
        round_half_up(exact_sum(F.col("Run_Value")), 2).alias("run_value")
    )


@_query
def agg_max(log):
    return log.groupBy("Pitcher").agg(F.max("RelSpeed").alias("max_velo"))


@_query
def agg_rv_per_100(log):
    return log.groupBy("Pitcher").agg(
        round_half_up(exact_mean(F.col("Run_Value")) * F.lit(100.0), 2).alias("rv_per_100")
    )


@_query
def agg_ratio(log):
    rows = F.count(F.lit(1))
    return log.groupBy("Pitcher").agg(
        ratio(F.sum("is_Swing"), rows).alias("swing"),
        ratio(exact_sum(F.col("xSwing_Pred")), rows).alias("xswing"),
    )


@_query
def agg_group_widths(log):
    keys = ["Pitcher", "PitcherThrows", "PitcherTeam", "Date"]
    sets = [keys[:0], keys[:1], keys[:2], keys]
    return log.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        (F.lit(4) - F.bit_count(F.grouping_id())).cast("int").alias("width"),
        F.count(F.lit(1)).alias("pitches"),
        round_half_up(exact_mean(F.col("RelSpeed")), 6).alias("velo"),
    )


@_query
def distinct_values(log):
    names = ["PitchCall", "TaggedPitchType", "BatterSide", "PitcherThrows"]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
    return log.select(F.explode(pairs).alias("pair")).select("pair.*").distinct()


@_query
def agg_centroids(log):
    return mix.movement_centroids(log)


def _pairs(log: DataFrame, min_pa: int = 150, min_side: int = 35) -> DataFrame:
    sample = platoon.platoon_sample(log, min_pa, min_side)
    return platoon.paired_splits(platoon.split_woba(sample))


@_query
def agg_global_mean(log):
    return _pairs(log).agg(round_half_up(exact_mean(F.col("diff")), 6).alias("mean_diff"))


# --- windows


def _type_counts(log: DataFrame, *extra: str) -> DataFrame:
    return (
        _flagged(log).groupBy("Pitcher", *extra, "pitch_type").agg(F.count(F.lit(1)).alias("pitches"))
    )


@_query
def share_of_total(log):
    return reports.add_mix(_type_counts(log), ["Pitcher"])


@_query
def share_within_side(log):
    return reports.add_mix(_type_counts(log, "BatterSide"), ["Pitcher", "BatterSide"])


@_query
def running_midpoint(log):
    return mix.by_side(log).select("Pitcher", "BatterSide", "TaggedPitchType", "pcts", "text_y")


@_query
def quantile_bins(log):
    board = leaderboards.chase_diff(log, min_n=100)
    bins = {"chase_pct": "chase_bin", "chase_diff": "diff_bin"}
    binned = leaderboards.add_quantile_bins(board, bins)
    return binned.select("Batter", "BatterTeam", "chase_bin", "diff_bin")


# --- sorts and limits


@_query
def sort_desc(log):
    return _type_counts(log).orderBy(
        F.col("pitches").desc_nulls_last(),
        level_rank(F.col("pitch_type"), PITCH_TYPE_ORDER).asc_nulls_last(),
        "Pitcher",
    )


@_query
def sort_asc(log):
    return log.groupBy("Pitcher").agg(F.max("RelSpeed").alias("max_velo")).orderBy(
        F.col("max_velo").asc_nulls_last(), "Pitcher"
    )


@_query
def sort_mixed(log):
    return _type_counts(log, "BatterSide").orderBy(
        F.col("BatterSide").asc_nulls_last(), F.col("pitches").desc_nulls_last(), "Pitcher",
        level_rank(F.col("pitch_type"), PITCH_TYPE_ORDER).asc_nulls_last(),
    )


@_query
def top_k(log):
    diff = (F.col("is_Swing") - F.col("xSwing_Pred")).alias("xswing_diff")
    return (
        log.select("PitchUID", "Batter", diff)
        .orderBy(F.col("xswing_diff").desc_nulls_last(), "PitchUID")
        .limit(15)
    )


@_query
def sort_by_level(log):
    rank = level_rank(F.col("TaggedPitchType"), PITCH_TYPE_ORDER)
    counted = log.groupBy("TaggedPitchType").agg(F.count(F.lit(1)).alias("pitches"))
    return counted.withColumn("level_rank", rank).orderBy(F.col("level_rank").asc_nulls_last())


# --- set operations and reshape


@_query
def union_seasons_(log):
    first, second = (filters.in_year(log, year) for year in (2022, 2023))
    return union_seasons(align_schema(first), align_schema(second))



@_query
def union_scored(log):
    return _scored_classes(_ready(log, "xSwing_Pred", columns=["TaggedPitchType", *SCORED_COLUMNS]))


@_query
def unpivot_splits(log):
    wide = _pairs(log).select(
        "Batter", F.col("same_woba").alias("Same Side"), F.col("oppo_woba").alias("Oppo Side")
    )
    return platoon.unpivot_splits(wide)


# --- scalar functions


@_query
def scalar_conditionals(log):
    call = F.col("PitchCall")
    return log.select(
        "PitchUID",
        if_known(call == "StrikeSwinging", True, False).alias("is_whiff"),
        F.when(call == "StrikeSwinging", 1).when(call.isin("InPlay", "FoulBall"), 0).alias("whiff"),
        flags.count_type_v1().alias("count_type"),
        F.when(F.col("Angle") < 10, True).otherwise(False).alias("low_angle"),
    )


@_query
def scalar_predicates(log):
    call = F.col("PitchCall")
    return log.select(
        "PitchUID",
        in_set(call, REPORT_SWINGS).alias("in_swings"),
        within(F.col("Angle"), 8, 32).alias("sweet_angle"),
        ((call == "InPlay") & (F.col("ExitSpeed") >= 95)).alias("hard_hit"),
        F.col("SpinRate").isNull().alias("no_spin"),
    )


@_query
def scalar_round(log):
    return log.select(
        "PitchUID",
        round_half_up(F.col("RelSpeed"), 0).alias("r0"),
        round_half_up(F.col("HorzBreak") / F.lit(4.0), 1).alias("r1"),
        round_half_up(F.col("VertApprAngle") / F.lit(8.0), 2).alias("r2"),
        round_half_up(F.col("SpinRate") / F.lit(7.0), 3).alias("r3"),
        round_half_up(F.col("Run_Value") / F.lit(3.0), 5).alias("r5"),
    )


@_query
def scalar_percent(log):
    rows = F.count(F.lit(1))
    return (
        log.groupBy("Pitcher", "BatterSide")
        .agg(percent_text(ratio(F.sum("is_Swing"), rows)).alias("swing_text"))
    )


@_query
def scalar_count_label(log):
    return log.select("PitchUID", count_label().alias("Count"))


@_query
def scalar_name_split(log):
    first, last = name_parts("Pitcher")
    return log.select("Pitcher", first.alias("first_name"), last.alias("last_name")).distinct()


@_query
def scalar_mirror_diff(log):
    return flags.model_flags(log).select(
        "PitchUID",
        "HB_adjusted",
        "RelSide_adjusted",
        (F.col("HorzBreak") - F.col("InducedVertBreak")).alias("break_gap"),
        ((F.col("HorzBreak") + F.col("InducedVertBreak")) / F.lit(2.0)).alias("break_mid"),
    )


@_query
def scalar_casts(log):
    return log.select(
        "PitchUID",
        F.col("Balls").cast("string").alias("balls_text"),
        F.col("Strikes").cast("double").alias("strikes_number"),
        F.to_date(F.date_format("Date", "yyyy-MM-dd")).alias("day"),
        F.substring(F.col("Date").cast("string"), 1, 4).alias("year_text"),
        F.col("is_Swing").cast("boolean").alias("swung"),
    )


# --- flags and classes


@_query
def pitch_class(log):
    return log.select("PitchUID", flags.pitch_class().alias("PitchClass"))


@_query
def count_type_v1(log):
    return log.select("PitchUID", flags.count_type_v1().alias("CountType"))


@_query
def count_type_v2(log):
    return log.select("PitchUID", flags.count_type_v2().alias("CountType"))


@_query
def platoon_side(log):
    return log.select("PitchUID", flags.platoon_side().alias("Platoon_Advantage"))


@_query
def model_flags(log):
    return flags.model_flags(log).select(
        "PitchUID", "is_Swing", "is_Whiff", "is_Foul", "is_BBE", "is_CalledStrike",
        "is_Groundball", "is_Linedrive", "is_Flyball", "is_Popup", "is_HardHit", "is_SweetSpot",
        "is_CSW", "BatterLoR", "PitcherLoR", "PlatoonAdv", "HB_adjusted", "RelSide_adjusted",
    )


# --- reports


@_query
def report_overall(log):
    return reports.overall(log)


@_query
def report_pitch_type(log):
    return reports.by_pitch_type(log)


@_query
def report_attack_zone(log):
    return reports.by_attack_zone(log)


@_query
def report_count(log):
    return reports.by_count(log)


@_query
def report_count_type(log):
    return reports.by_count_type(log)


@_query
def report_platoon(log):
    return reports.platoon(log)


@_query
def report_platoon_pitch_type(log):
    return reports.platoon_by_pitch_type(log)


@_query
def report_movement(log):
    return reports.movement(log)


@_query
def report_all_grains(log):
    return reports.all_grains(log)


def _sums_after_changes(log: DataFrame) -> daily.DailySums:
    """Daily sums that were built early, then had days added, corrected and deleted."""
    spark, path = log.sparkSession, fresh_path(log.sparkSession, "daily")
    early = log.where(F.col("Date") < F.lit(DATE_TO).cast("date"))
    wrong = early.where((F.dayofmonth("Date") != 5) | (F.col("Inning") > 3))
    extra = early.where(F.dayofmonth("Date") == 6).withColumn("Date", F.lit("2021-12-31").cast("date"))
    sums = daily.DailySums.build(wrong.unionByName(extra), path)
    days = [row[0] for row in log.select("Date").distinct().collect()]  # one row a day
    late = [d for d in days if d is not None and str(d) >= DATE_TO]
    sums.update(log, [*late, *(d for d in days if d is not None and d.day == 5), "2021-12-31"])
    return daily.DailySums(spark, path)


@_query
def report_from_daily_sums(log):
    return reports.all_grains(_sums_after_changes(log), None, DATE_FROM, DATE_TO)


@_query
def movement_from_daily_sums(log):
    return reports.movement(_sums_after_changes(log), None, DATE_FROM, DATE_TO)


@_query
def mix_by_count(log):
    return mix.by_count(log)


@_query
def mix_by_count_type(log):
    return mix.by_count_type(log)


@_query
def mix_by_side(log):
    return mix.by_side(log)


@_query
def pitcher_names(log):
    inside = reports.pitcher_names(log, None, DATE_FROM, DATE_TO)
    always = reports.pitcher_names(log, None, DATE_FROM, DATE_TO, dated=False)
    return inside.join(always.select("Pitcher", F.col("pitches").alias("all_pitches")), "Pitcher")


@_query
def league_avg_compare(log):
    return reports.league_comparison(log)


# --- data behind the charts


@_query
def location_density(log):
    cells = density.location_density(log, n=GRID)
    return cells.select(
        "Pitcher", "TaggedPitchType", "ix", "iy",
        round_half_up(F.col("side"), 6).alias("side"),
        round_half_up(F.col("height"), 6).alias("height"),
        round_half_up(F.col("ndensity"), 6).alias("ndensity"),
    )


@_query
def location_hdr(log):
    cells = density.location_regions(log, n=GRID)
    return cells.select("Pitcher", "BatterSide", "TaggedPitchType", "ix", "iy", "region")


@_query
def location_density_full(log):
    """The default grid of 100 x 100, binned and convolved."""
    return density.location_density(log, convolve=True)


@_query
def location_hdr_full(log):
    return density.location_regions(log, convolve=True)


@_query
def movement_centroids(log):
    return mix.movement_centroids(log)


@_query
def release_points(log):
    return mix.release_points(log)


@_query
def spin_centroids(log):
    return mix.spin_centroids(log)


@_query
def movement_points(log):
    return mix.movement_points(log)


@_query
def spin_points(log):
    return mix.spin_points(log)


@_query
def split_difference(log):
    return platoon.split_difference(_pairs(log))


# --- platoon study


@_query
def platoon_sample(log):
    return platoon.platoon_sample(log)


@_query
def platoon_split_woba(log):
    return platoon.split_woba(platoon.platoon_sample(log))


@_query
def platoon_pairs(log):
    return _pairs(log)


@_query
def platoon_side_counts(log):
    return platoon.side_counts(_pairs(log))


def _effect_sample(log: DataFrame) -> DataFrame:
    return platoon.with_platoon_effect(platoon.platoon_sample(log))


@_query
def ols_platoon(log):
    fit = platoon.ols(_effect_sample(log), "woba_value", "platoon_effect")
    rounded = ["estimate", "std_error", "t_value", "p_value", "sigma", "r_squared"]
    return fit.select(
        "term", *[round_half_up(F.col(name), 6).alias(name) for name in rounded], "df", "n"
    )


@_query
def ols_predictions(log):
    fit = platoon.ols(_effect_sample(log), "woba_value", "platoon_effect")
    both = [
        platoon.ols_predictions(fit, coding).withColumn("coding", F.lit(coding))
        for coding in ("half", "indicator")
    ]
    return both[0].unionByName(both[1]).withColumn("pred", round_half_up(F.col("pred"), 6))


def _multilevel(log: DataFrame) -> platoon.RandomIntercept:
    return platoon.random_intercept(_effect_sample(log), "woba_value", "platoon_effect", "Batter")


@_query
def mixed_model_coef(log):
    coefficients = _multilevel(log).coefficients
    return coefficients.select(
        "Batter", *[round_half_up(F.col(b), 4).alias(b) for b in ("beta0", "beta1")]
    )


@_query
def mixed_model_splits(log):
    splits = platoon.batter_splits(_multilevel(log).coefficients)
    return splits.withColumn("wOBA", round_half_up(F.col("wOBA"), 4))


@_query
def ols_summary(log):
    row = platoon.ols_summary(_effect_sample(log), "woba_value", "platoon_effect")
    return row.select(*[round_half_up(F.col(name), 6).alias(name) for name in row.columns])


@_query
def mixed_model_summary(log):
    sample = _effect_sample(log)
    names = ("woba_value", "platoon_effect", "Batter")
    rows = platoon.mixed_summary(sample, platoon.random_intercept(sample, *names), *names)
    return rows.withColumn("value", round_half_up(F.col("value"), 4))


# --- swing pipeline


@_query
def fastball_baseline(log):
    return swing.fastball_baseline(log)


@_query
def model_ready(log):
    return swing.model_ready(log, event_weights(log))


@_query
def model_ready_stored(log):
    """`model_ready` bucket by bucket."""
    stored = _keyed(log.select(*swing.MODEL_INPUTS), swing.BASELINE_KEYS)
    return swing.model_ready(stored, event_weights(log))


@_query
def feature_sets(log):
    features = dict.fromkeys(name for _, names in SWING_CLASSES.values() for name in names)
    ready = _ready(log, columns=["PitchUID", "TaggedPitchType", *features, "is_Swing"])
    parts = [
        swing.feature_set(ready, name).withColumn("swing_class", F.lit(name))
        for name in SWING_CLASSES
    ]
    return (
        parts[0]
        .unionByName(parts[1], allowMissingColumns=True)
        .unionByName(parts[2], allowMissingColumns=True)
    )


@_query
def top_swing_diff_batter(log):
    return leaderboards.top_swing_diff(log, side="Batter")


@_query
def top_swing_diff_pitcher(log):
    return leaderboards.top_swing_diff(log, side="Pitcher")


@_query
def pitcher_swing_diff(log):
    return leaderboards.pitcher_swing_diff(log)


@_query
def team_chase_diff(log):
    return leaderboards.team_chase_board(log)


@_query
def team_chase_diff_pruned(log):
    """`team_chase_diff` out of a store that is laid out by pitcher, batter and date."""
    path = fresh_path(log.sparkSession, "pruned")
    write_pruned_store(log.select(*leaderboards.CHASE_INPUTS), path)
    return leaderboards.team_chase_board(read_store(log.sparkSession, path))


@_query
def overall_chase_diff(log):
    return leaderboards.chase_diff(log, min_n=200, k=15)


@_query
def heart_swing_diff(log):
    return leaderboards.heart_diff(log)


@_query
def heart_swing_board(log):
    """The whole board, which has rows at any scale."""
    return leaderboards.heart_diff(log, min_n=1, k=None)


# --- models


@_query
def sample_n_(log):
    return sample_n(log.select("PitchUID", "Pitcher", "TaggedPitchType"), SAMPLE, SEED)



@_query
def stratified_split_(log):
    return stratified_split(log.select("PitchUID", "is_Swing"), "is_Swing", 0.75, SEED)



@_query
def auc_exact(log):
    return roc.auc(log).withColumn("auc", round_half_up(F.col("auc"), 9))


@_query
def roc_curve(log):
    return roc.roc_curve(log)


@_query
def train_swing_model(log):
    _, held_out = swing_models.train_all(swing.model_ready(log), seed=SEED)
    held_out = held_out.select("swing_class", "is_Swing", "xSwing_Pred")
    parts = [
        roc.auc(held_out.where(F.col("swing_class") == name)).withColumn("swing_class", F.lit(name))
        for name in SWING_CLASSES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query
def score_swing(log):
    ready = _ready(log)
    models = {
        name: swing_models.train_swing(ready, name, seed=SEED) for name in SWING_CLASSES
    }
    scored = swing_models.score_swing(ready, models)
    return scored.select("PitchUID", "TaggedPitchType", "is_Swing", "xSwing_Pred")


@_query
def feature_selection(log):
    ready = _ready(log)
    parts = []
    for name, (_, features) in SWING_CLASSES.items():
        chosen = selection.select_features(
            swing.feature_set(ready, name), "is_Swing", features, seed=SEED
        )
        parts.append(chosen.withColumn("swing_class", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
