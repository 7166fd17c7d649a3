"""Swing-probability models, one boosted-tree model per pitch class."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from moundlens.operators.sampling import stratified_split
from moundlens.plans import boosting
from moundlens.plans.boosting import BoostedModel, Settings, Task
from moundlens.plans.swing import class_pitches
from moundlens.schema import SWING_CLASSES, SWING_DEPTHS
from moundlens.sources.scratch import materialize


def _task(train: DataFrame, swing_class: str, depth: int | None = None) -> Task:
    _, features = SWING_CLASSES[swing_class]
    return Task(_own_pitches(train, swing_class), tuple(features), depth or SWING_DEPTHS[swing_class], "is_Swing")


def train_swing(
    train: DataFrame,
    swing_class: str,
    depth: int | None = None,
    rate: float = 0.1,
    rounds: int = 300,
    subsample: float = 1.0,
    seed: int = 2004,
) -> BoostedModel:
    """Boosted trees on the class's features; missing measurements take the side learnt for them."""
    settings = Settings(rounds, rate, subsample=subsample, seed=seed)
    return boosting.train({swing_class: _task(train, swing_class, depth)}, settings)[swing_class]


def train_classes(
    train: DataFrame, names: Iterable[str] = tuple(SWING_CLASSES), rounds: int = 300, rate: float = 0.1, seed: int = 2004
) -> dict[str, BoostedModel]:
    """The models of `train_swing`, grown side by side."""
    return boosting.train({name: _task(train, name) for name in names}, Settings(rounds, rate, seed=seed))


def _own_pitches(df: DataFrame, swing_class: str) -> DataFrame:
    return class_pitches(df, swing_class) if "TaggedPitchType" in df.columns else df


def score_class(df: DataFrame, model: BoostedModel, swing_class: str) -> DataFrame:
    """Add xSwing_Pred to the pitches of one class."""
    return model.score(_own_pitches(df, swing_class), "xSwing_Pred")


def score_swing(ready: DataFrame, models: dict[str, BoostedModel]) -> DataFrame:
    """Every class scored by its model and stacked; pitch columns stay on the row, so no join."""
    parts = [score_class(ready, model, name) for name, model in models.items()]
    return reduce(DataFrame.unionByName, parts)


def train_all(
    ready: DataFrame, p: float = 0.75, rounds: int = 300, rate: float = 0.1, seed: int = 2004
) -> tuple[dict[str, BoostedModel], DataFrame]:
    """All three models, and the held-out pitches with their scores and class."""
    ready = materialize(ready, "model_ready")
    splits = {name: stratified_split(class_pitches(ready, name), "is_Swing", p, seed) for name in SWING_CLASSES}
    tasks = {name: _task(split.where("is_train"), name) for name, split in splits.items()}
    models = boosting.train(tasks, Settings(rounds, rate, seed=seed))
    held_out = [
        score_class(split.where("NOT is_train"), models[name], name).withColumn("swing_class", F.lit(name))
        for name, split in splits.items()
    ]
    return models, reduce(DataFrame.unionByName, held_out)


def save_model(model: BoostedModel, path: str) -> None:
    model.save(SparkSession.active(), path)


def load_model(path: str) -> BoostedModel:
    return BoostedModel.load(SparkSession.active(), path)
