"""Interval joins as equi-joins: intervals are cut at multiples of a span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest span that is chosen, so that few long intervals are many keys.
WIDEST = 1 << 16


def fitting(intervals: DataFrame) -> int:
    """The mean length of ``intervals(first, last)``, as a span: cut at its
    multiples, disjoint ones are at most twice as many rows, and a point meets
    at most a span of them, however many there are in all."""
    mean = intervals.agg(F.avg(F.col("last") - F.col("first") + 1)).first()[0] or 1
    return int(min(max(mean, 1), WIDEST))


def containing(points: DataFrame, intervals: DataFrame, span: int | None = None, point: str = "pos") -> DataFrame:
    """Each of ``points`` with each of ``intervals(first, last, ...)`` that
    holds it. An interval takes a row for each span it touches, and a point meets
    all intervals of its span: without a ``span``, that of ``fitting``. The cut
    intervals aren't broadcast, as Spark would judge them by their size uncut."""
    span = span or fitting(intervals)
    cut = intervals.withColumn("_span_", F.explode(F.sequence(F.floor(F.col("first") / span), F.floor(F.col("last") / span))))
    return points.withColumn("_span_", F.floor(F.col(point) / span)).join(cut.hint("merge"), "_span_").where(F.col(point).between(F.col("first"), F.col("last"))).drop("_span_")
