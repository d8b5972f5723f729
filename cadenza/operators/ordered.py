"""Global orders without a global sort task: numbers, medians and running maxima over rows dealt by ranges of their key.

Rows are dealt into ranges by ``repartitionByRange`` and written down with the range they fell in.  Windows then
run inside a range; what a range takes over from those before it comes from one row per range.  Order keys
should be unique, or ties lie in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.sources.sinks import staged

_RANGE = "_range"

#: Rows that a task sorts or counts at once.
TASK_ROWS = 1 << 19


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows``, some ``count`` of them, by hash of ``keys`` in tasks of some ``TASK_ROWS`` rows: more rows are more tasks, not larger ones.

    Left to itself Spark makes about as many tasks as there are cores, whose sorts and counts grow with the input until they spill.
    Few rows stay as they are.
    """
    tasks = -(-count // TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows


def _ranged(rows: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    return staged(rows.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id()), "ranged")


def _before() -> Window:
    """All ranges above a range: one row each."""
    return Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, *order: Column | str, name: str = "index", first: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with dense numbers from ``first`` in the given order, for each value of the columns ``by`` anew.

    A key may hold any share of the rows: it spans as many ranges as it needs, and each gets one offset per key in it.
    """
    ranged = _ranged(rows, (*by, *order))
    keys = [F.col(c).alias(f"_by{n}") for n, c in enumerate(by)]
    counts = ranged.groupBy(F.col(_RANGE).alias("_at"), *keys).agg(F.count("*").alias("_n"))
    names = [f"_by{n}" for n in range(len(by))]
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(_above(names)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(_RANGE, *by).orderBy(*order))
    same = F.col(_RANGE) == F.col("_at")
    for key, c in zip(names, by, strict=True):
        same &= F.col(c).eqNullSafe(F.col(key))
    # Without keys there is one offset per range, so the rows stay where they are.
    joined = ranged.withColumn("_inside", inside).join(offsets if by else F.broadcast(offsets), same)
    return joined.withColumn(name, (F.col("_offset") + F.col("_inside") - 1 + first).cast("long")).drop(_RANGE, "_inside", "_offset", "_at", *names)


def _above(names: list[str]) -> Window:
    """All ranges above a range, of one key: a row per range and key that is in it."""
    return Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)


def median(rows: DataFrame, value: str, by: tuple[str, ...] = (), name: str = "median") -> DataFrame:
    """(*by, name): the exact median of each key's values, the mean of the middle two of an even number; nulls don't count.

    Equal values are counted first.  What is left is dealt by ranges of (key, value); the counts of the ranges say
    which of them hold a key's middle, and only those are looked into.  No task holds more than a range, whatever the
    number of keys.  Without any value there is no row, but for no keys one with null.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranged = _ranged(counted, (*by, "_value"))
    names = [f"_by{n}" for n in range(len(by))]
    sums = ranged.groupBy(F.col(_RANGE).alias("_at"), *[F.col(c).alias(n) for n, c in zip(names, by, strict=True)]).agg(F.sum("_n").alias("_in"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_in").over(_above(names)), F.lit(0)), "_all": F.sum("_in").over(Window.partitionBy(*names))})
    low, high = F.call_function("div", F.col("_all") + 1, F.lit(2).cast("long")), F.call_function("div", F.col("_all"), F.lit(2).cast("long")) + 1
    middle = sums.withColumns({"_low": low, "_high": high}).where((F.col("_before") < F.col("_high")) & (F.col("_before") + F.col("_in") >= F.col("_low")))
    same = F.col(_RANGE) == F.col("_at")
    for key, c in zip(names, by, strict=True):
        same &= F.col(c).eqNullSafe(F.col(key))
    # A key's middle lies in two ranges at most.
    inside = ranged.join(middle, same)
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(_RANGE, *by).orderBy("_value"))
    at = lambda rank: F.min(F.when(F.col("_upto") >= F.col(rank), F.col("_value")))
    found = inside.withColumn("_upto", upto).groupBy(*by).agg(at("_low").alias("_a"), at("_high").alias("_b"))
    return found.select(*by, ((F.col("_a").cast("double") + F.col("_b").cast("double")) / 2).alias(name))


def running_max(rows: DataFrame, value: Column, *order: Column | str, name: str, own: bool = True, ranges: str | None = None) -> DataFrame:
    """``rows`` with the largest ``value`` of the rows above each, and of itself if ``own``; null where there is none.

    ``ranges`` names a column by which rows lie in ranges of the order already, such as a file's; they are not dealt again.
    """
    valued = rows.withColumn("_value", value)
    ranged = valued.withColumnRenamed(ranges, _RANGE) if ranges else _ranged(valued, order)
    carried = ranged.groupBy(_RANGE).agg(F.max("_value").alias("_most")).select(_RANGE, F.max("_most").over(_before()).alias("_carried"))
    inside = F.max("_value").over(Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    largest = F.greatest("_inside", "_carried") if not _is_struct(value, ranged) else F.coalesce("_inside", "_carried")
    return ranged.withColumn("_inside", inside).join(F.broadcast(carried), _RANGE).withColumn(name, largest).drop(_RANGE, "_value", "_inside", "_carried")


def _is_struct(value: Column, ranged: DataFrame) -> bool:
    """Structs are led by the order's own key, so that what is found inside a range is above what is carried into it."""
    return ranged.schema["_value"].dataType.typeName() == "struct"
