from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from moundlens.checks.fixture import pitches  # noqa: E402
from moundlens.schema import PITCH_SCHEMA  # noqa: E402
from moundlens.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"

_TYPICAL = {
    "Date": dt.date(2023, 4, 1), "gameID": "G1", "Inning": 1, "Outs": 0, "Level": "D1",
    "Pitcher": "Doe, Jo", "PitcherTeam": "AAA", "PitcherThrows": "Right", "Batter": "Roe, Al",
    "BatterTeam": "BBB", "BatterSide": "Left", "Catcher": "C1", "Balls": 0, "Strikes": 0,
    "PitchofPA": 1, "PitchCall": "BallCalled", "TaggedPitchType": "Fastball",
    "PlayResult": "Undefined", "RelSpeed": 90.0, "HorzBreak": 10.0, "InducedVertBreak": 15.0,
    "SpinRate": 2200.0, "SpinAxis": 210.0, "RelHeight": 5.5, "RelSide": 1.5, "Extension": 6.0,
    "VertApprAngle": -5.0, "PlateLocSide": 0.0, "PlateLocHeight": 2.5, "Run_Value": 0.0,
    "xwOBACON_value": 0.0, "woba_value": 0.0, "woba_denom": 0,
}


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def log(spark):
    return pitches(spark, SMALL)


@pytest.fixture(scope="session")
def make(spark):
    """Pitch log from rows that name only what differs from a typical pitch."""

    def build(*rows: dict):
        full = [{"PitchUID": f"u{i}", **_TYPICAL, **row} for i, row in enumerate(rows)]
        table = [tuple(row.get(name) for name in PITCH_SCHEMA.names) for row in full]
        return spark.createDataFrame(table, PITCH_SCHEMA)

    return build


def column(df, name: str, order: str = "PitchUID") -> list:
    return [row[name] for row in df.orderBy(order).select(name).collect()]


def as_set(df) -> set:
    names = sorted(df.columns)
    return {tuple(row) for row in df.select(*names).collect()}
