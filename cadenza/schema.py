"""Schemas and the constants that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import types as T

BUCKETS = 8
PLAY_CEILING = 65_535
MIN_PLAYS, MIN_REPEATED = 3, 20
OWN_COVERAGE_PERCENT, OWN_MARGIN_PERCENT = 50, 150
LOW, CENTER, HIGH = 0.05, 0.5, 0.99
ROOM_RATIO, SPAN_PER_ROOM, SPAN_HALF_RATIO, REACH, REPEL, EPSILON = 2.0, 3.0, 3.0, 50.0, 25.0, 1e-6
TRIAL_PLAYS, ADOPT_MIN_PLAYS, ADOPT_MAX_PLAYS = 1, 4, 12
SIMILARITY, MIN_COMMUNITY = 0.15, 10
COHORT_SIZE = 500
MIN_BACKERS, PER_ISLAND = 5, 200
POPULARITY_DAMP, GRANULARITY = 1 / 3, 1.5
#: What a declared q of 0 to 4 is worth, and the neutral value.
Q_VALUES, NEUTRAL = (5, 50, 70, 90, 100), 50
NAME_TOKENS, MIN_TOKEN_COUNT, MIN_TOKEN_SHARE = 3, 2, 0.05
MIN_AGE_DAYS = 21
RATING_CHUNK = 200
DURATION_TOLERANCE = 1
SHOWN_LIMIT = 4

_long, _string = T.LongType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LISTENED = _struct(user_id=_long, recording_mbid=_string, artist_credit_mbids=T.ArrayType(_string))
LIBRARY = _struct(user_id=_long, mbid=_string, plays=T.IntegerType())
DECLARATION = _struct(s=_string, q=T.IntegerType(), playlist=T.ArrayType(_string))
RECORDING = _struct(recording_id=_long, mbid=_string)
RECORDING_ARTIST = _struct(recording_id=_long, artist_mbid=_string)
USER_PLAYS = _struct(user_id=_long, recording_id=_long, plays=T.IntegerType())
USER_STAT = _struct(user_id=_long, center=T.DoubleType(), low=T.DoubleType(), high=T.DoubleType(), recording=_long)
RECORDING_LISTENER = _struct(recording_id=_long, listener=_long, plays=_long)
ARTIST_LINK = _struct(artist_mbid=_string, related_mbid=_string)
