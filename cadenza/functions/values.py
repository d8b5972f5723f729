"""Times, numbers and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza import schema as S


def reach_key(timestamp: Column) -> Column:
    """A timestamp's text as a 14-digit number; sub-seconds and zone are dropped, other shapes give null."""
    digits = F.regexp_replace(F.regexp_replace(timestamp, r"[.+Z].*$", ""), "[^0-9]", "")
    return F.when(F.length(digits) == 14, digits.cast("long"))


def published(name: Column) -> Column:
    """Struct (number, reach) of a dump's name: prefix-N-YYYYMMDD-hhmmss-suffix."""
    pattern = r"-([0-9]+)-([0-9]{8})-([0-9]{6})-[a-z]+$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return F.when(name.rlike(pattern), F.struct(part(1).cast("long").alias("number"), F.concat(part(2), part(3)).cast("long").alias("reach")))


def newer(number: Column, baseline: Column) -> Column:
    """Whether a dump is newer; what cannot be told counts as newer."""
    return F.coalesce(number > baseline, F.lit(True))


def partial_date(text: Column) -> Column:
    """YYYY[-MM[-DD]] as a date; missing or non-numeric parts are 1, impossible dates null."""
    part = lambda i: F.get(F.split(text, "-"), F.lit(i))
    two = lambda p: F.when(p.rlike("^[0-9]{1,9}$"), F.lpad(p.cast("int").cast("string"), 2, "0")).otherwise("01")
    year = F.when(part(0).rlike("^[0-9]{4}$"), part(0))
    return F.try_to_timestamp(F.concat_ws("-", year, two(part(1)), two(part(2))), F.lit("yyyy-MM-dd")).cast("date")


def days_since(now: Column, at: Column) -> Column:
    """Whole days between two unix seconds, 0 at least."""
    return F.greatest(F.floor((now - at) / 86_400), F.lit(0))


def day(timestamp: Column) -> Column:
    return F.get(F.split(timestamp, " "), F.lit(0))


def recent(at: Column, now: Column) -> Column:
    """Within one calendar month."""
    return at >= F.add_months(now.cast("date"), -1)


def covered(reached: Column, dump: Column) -> Column:
    return F.coalesce(reached, dump)


def round_seconds(ms: Column) -> Column:
    return F.floor((ms + 500) / 1000).cast("long")


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("long")
    return F.when(seconds.isNull(), "?:??").otherwise(F.concat(minutes.cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")))


def human_number(n: Column) -> Column:
    """From a million on one truncated decimal and a unit, below groups of three digits; ``n`` is a whole number of any type."""
    digits = n.cast("string")
    out = F.regexp_replace(digits, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " ")
    for power, unit in ((6, "M"), (9, "B"), (12, "T"), (15, "P"), (18, "E")):
        # The digits are cut, not divided: a quotient may pass 64 bits.
        whole, tenth = F.substring(digits, F.lit(1), F.length(digits) - power), F.substring(digits, F.length(digits) - (power - 1), F.lit(1))
        text = F.when(tenth == "0", whole).otherwise(F.concat(whole, F.lit("."), tenth))
        out = F.when(n >= 10**power, F.concat(text, F.lit(unit))).otherwise(out)
    return out


def q_value(q: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, S.Q_VALUES)), q.cast("int") + 1)


def q_weight(q: Column) -> Column:
    return (q_value(q) - S.NEUTRAL) / S.NEUTRAL


def q_floor(mean: Column) -> Column:
    return F.floor(mean).cast("int")


def rate(listens: Column, days: Column) -> Column:
    return listens / F.greatest(days, F.lit(1))


def bucket(user_id: Column) -> Column:
    return F.pmod(user_id, F.lit(S.BUCKETS)).cast("int")


def saturated(plays: Column) -> Column:
    return F.least(plays, F.lit(S.PLAY_CEILING).cast("long")).cast("int")


def damped(weight: Column, listeners: Column, damp: float) -> Column:
    return weight / F.pow(F.greatest(listeners, F.lit(1)), F.lit(damp))


def breadth(recordings: Column, usual: Column) -> Column:
    return F.sqrt(F.greatest(recordings, F.lit(1)) / usual)


def promise(mean_q: Column, size: Column, library_q: Column, cohort: int = S.COHORT_SIZE) -> Column:
    """An island's mean q, drawn to the library's by as many members as a full cohort."""
    return (mean_q * size + library_q * cohort) / (size + cohort)
