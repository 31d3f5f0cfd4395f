"""Points and the intervals that hold them, joined by equal keys alone: no nested loop, whatever the lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths go up to 2 to this.
LEVELS = 62


def _level(length: Column) -> Column:
    """The least power of two that is no shorter: by the number of binary digits of length - 1, which is exact."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of a point and an interval of the same `on` with start <= at < end: columns of points, then those of intervals but for `on`.

    Every interval lies in one or two cells of the grid whose cells are as wide as the next power of two, so a row goes into at most two
    rows, whatever its length; a point goes into one row for each width that occurs, at most LEVELS. Cells are join keys like others, so a full one
    can be split. Null bounds or places, and empty intervals, meet nothing. Intervals may overlap; ends may be as large as a long.
    """
    length = F.col(end) - F.col(start)
    kept = intervals.where(length > 0).withColumn("__level", _level(length).cast("int"))
    levels = sorted(r[0] for r in kept.select("__level").distinct().collect())  # LEVELS + 1 at the most
    first, last = _cell(F.col(start)), _cell(F.col(end) - 1)
    kept = kept.withColumn("__cell", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    spread = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>"))).withColumn("__cell", _cell(F.col(at)))
    pairs = spread.join(kept, [*on, "__level", "__cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    return pairs.drop("__level", "__cell")


def _cell(place: Column) -> Column:
    """The cell of a place in the grid of its row's level, also for places below zero."""
    return F.call_function("shiftright", place.cast("long"), F.col("__level"))
