"""How much a user is drawn to a recording, from its plays and the user's play quantiles.

Column expressions only: they stay in generated code.  ``register`` offers them to SQL as well.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cadenza import schema as S


def room(low: Column, high: Column) -> Column:
    """How far above a single trial adoption must lie."""
    return F.least(F.lit(log(S.ROOM_RATIO)), (high - low) / S.SPAN_PER_ROOM)


def adopt(center: Column, low: Column, high: Column) -> Column:
    """The log plays from which a recording counts as adopted."""
    usual = F.least(F.greatest(center, F.lit(log(S.ADOPT_MIN_PLAYS))), F.lit(log(S.ADOPT_MAX_PLAYS)))
    return F.least(F.greatest(usual, F.lit(log(S.TRIAL_PLAYS)) + room(low, high)), high - room(low, high))


def value(plays: Column, center: Column, low: Column, high: Column) -> Column:
    """0 to 100, 50 is neutral; a flat library is neutral throughout."""
    x, turn, span = F.log(F.greatest(plays, F.lit(1))), adopt(center, low, high), high - low
    up = S.REACH * F.least((x - turn) / F.greatest(high - turn, F.lit(S.EPSILON)), F.lit(1.0))
    down = S.REPEL * F.greatest((x - turn) / F.greatest(turn - log(S.TRIAL_PLAYS), F.lit(S.EPSILON)), F.lit(-1.0))
    return S.NEUTRAL + F.when(x >= turn, up).otherwise(down) * span / (span + log(S.SPAN_HALF_RATIO))


def weight(plays: Column, center: Column, low: Column, high: Column) -> Column:
    """The value as -1 to 1."""
    return (value(plays, center, low, high) - S.NEUTRAL) / S.NEUTRAL


def register(spark: SparkSession) -> None:
    """SQL functions attraction_room, attraction_adopt, attraction_value and attraction_weight."""
    usual = f"least(greatest(center, ln({S.ADOPT_MIN_PLAYS})), ln({S.ADOPT_MAX_PLAYS}))"
    up = f"{S.REACH}D * least((ln(greatest(plays, 1)) - turn) / greatest(high - turn, {S.EPSILON}D), 1D)"
    down = f"{S.REPEL}D * greatest((ln(greatest(plays, 1)) - turn) / greatest(turn - ln({S.TRIAL_PLAYS}), {S.EPSILON}D), -1D)"
    for name, arguments, body in (
        ("room", "low DOUBLE, high DOUBLE", f"least(ln({S.ROOM_RATIO}D), (high - low) / {S.SPAN_PER_ROOM}D)"),
        ("adopt", "center DOUBLE, low DOUBLE, high DOUBLE", f"least(greatest({usual}, ln({S.TRIAL_PLAYS}) + attraction_room(low, high)), high - attraction_room(low, high))"),
        ("side", "plays BIGINT, turn DOUBLE, high DOUBLE", f"CASE WHEN ln(greatest(plays, 1)) >= turn THEN {up} ELSE {down} END"),
        ("value", "plays BIGINT, center DOUBLE, low DOUBLE, high DOUBLE", f"{S.NEUTRAL} + attraction_side(plays, attraction_adopt(center, low, high), high) * (high - low) / (high - low + ln({S.SPAN_HALF_RATIO}D))"),
        ("weight", "plays BIGINT, center DOUBLE, low DOUBLE, high DOUBLE", f"(attraction_value(plays, center, low, high) - {S.NEUTRAL}) / {S.NEUTRAL}D"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION attraction_{name}({arguments}) RETURNS DOUBLE RETURN {body}")
