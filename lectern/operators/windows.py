"""Positions, spans, intervals, number allocation and text windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocated(df: DataFrame, keys: list[str], order: list[Column], last: Column, name: str = "number") -> DataFrame:
    """Numbers after ``last`` for the rows of each key, without gaps."""
    return df.withColumn(name, last + F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def reclaimed(counter: Column, largest: Column) -> Column:
    """The last number in use: a counter above the largest stored number falls back to it; without a counter the largest."""
    return F.least(F.coalesce(counter, largest), largest)


def spans(df: DataFrame, keys: list[str], order: str, end: Column | None = None) -> DataFrame:
    """From each boundary to the next one, or to ``end``."""
    after = F.lead(order).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("span_end", after if end is None else F.coalesce(after, end))


def next_boundary(df: DataFrame, keys: list[str], order: str, is_boundary: Column, end: Column) -> DataFrame:
    """For each row the position of the first boundary after it, or ``end``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("next_boundary", F.coalesce(F.min(F.when(is_boundary, F.col(order))).over(w), end))


def last_before(df: DataFrame, keys: list[str], order: str, is_mark: Column) -> DataFrame:
    """For each row the position of the last mark at or before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("last_mark", F.max(F.when(is_mark, F.col(order))).over(w))


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that touch or overlap as one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    grouped = opens.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def outside(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points that lie in no interval [start, end): one pass over both in order, with the largest end of the intervals begun so far."""
    marked = points.withColumn("_end", F.lit(None).cast(intervals.schema[end].dataType)).withColumn("_point", F.lit(1))
    begun = intervals.select(*keys, F.col(start).alias(at), F.col(end).alias("_end"), F.lit(0).alias("_point"))
    w = Window.partitionBy(*keys).orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, 0)
    every = marked.unionByName(begun, allowMissingColumns=True).withColumn("_reach", F.max("_end").over(w))
    return every.filter((F.col("_point") == 1) & ~F.coalesce(F.col("_reach") > F.col(at), F.lit(False))).select(points.columns)


def text_windows(df: DataFrame, text: str, count: Column, size: int) -> DataFrame:
    """Equal slices of a text: of ``size`` characters, or larger ones where more than ``count`` would be needed."""
    n = F.length(text)
    wide = F.when((count > 0) & (n > F.lit(size) * count), F.floor(n / count).cast("int") + 1).otherwise(F.lit(size))
    sized = df.withColumn("_wide", wide).withColumn("window_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / F.col("_wide")).cast("int") - 1, F.lit(0)))))
    return sized.withColumn("window_text", F.substring(F.col(text), F.col("window_no") * F.col("_wide") + 1, F.col("_wide"))).drop("_wide")


def split_count(total: Column, parts: Column) -> Column:
    """A total in ``parts`` shares; the first ones get one more."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.floor(total / parts) + F.when(i < total % parts, 1).otherwise(0))


def chunks_of(total: Column, size: int) -> Column:
    """A total in chunks of ``size`` and a rest; none for a total of 0."""
    full = F.when(total > 0, F.sequence(F.lit(0), F.ceil(total / size).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(full, lambda i: F.least(F.lit(size), total - i * size))


def round_robin(position: Column, n: int = 14) -> Column:
    """1..n by turns; positions count from 0."""
    return F.pmod(position, F.lit(n)) + 1


def sixty_forty(position: Column, first: str = "numeric", second: str = "theory") -> Column:
    """Three of five positions (from 0) get the first kind."""
    return F.when(F.pmod(position, F.lit(5)) < 3, first).otherwise(second)


def kept_apart(values: Column, least: int) -> Column:
    """A fold over the sorted positions of a short list: keeps a position only if it is ``least`` after the last one kept. For many positions there is ``rows_apart``."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(
        F.transform(values, lambda v: v.cast("bigint")), none,
        lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) >= least), F.concat(acc, F.array(v))).otherwise(acc),
    )


def rows_apart(df: DataFrame, keys: list[str], position: str, least: int) -> DataFrame:
    """The rows whose position (a whole number) is ``least`` after that of the last row kept of their key; rows without a position go.

    The rows of a key are one sorted stream, of which only the last position kept is held. Of rows of one position any one stays.
    """
    rows = df.filter(F.col(position).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, position)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            stay = []
            for key, at in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(position).to_pylist(), strict=True):
                fresh = last is None or key != now or at - last >= least
                now, last = (key, at) if fresh else (now, last)
                stay.append(fresh)
            yield batch.filter(pa.array(stay, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def changes(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before them."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_prev", F.lag(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("_prev"))).drop("_prev")
