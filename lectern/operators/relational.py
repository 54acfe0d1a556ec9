"""Filters, existence joins, lookups and orderings over the bank's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each column whose wanted value is truthy; None and '' mean no filter."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v), df)


def null_safe(column: str, value) -> Column:
    """Equality where a missing value matches only null."""
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def same(columns: list[str], prefix: str) -> Column:
    """Null-safe equality of columns with those of the same names behind a prefix."""
    return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in columns))


def in_keys(df: DataFrame, column: str, keys: list | DataFrame, few: int = 1000) -> DataFrame:
    """Rows whose key is in a short list (IN), or in a longer list or a table of keys (semi join); Spark chooses the side to send by its size."""
    if not isinstance(keys, DataFrame) and len(keys) <= few:
        return df.filter(F.col(column).isin(keys))
    if not isinstance(keys, DataFrame):
        keys = df.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("_key", df.schema[column].dataType)]))
    return df.join(keys.select(F.col(keys.columns[0]).alias("_key")), F.col(column) == F.col("_key"), "left_semi")


def first_row(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, at most one."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def flagged(df: DataFrame, chosen: DataFrame, left: str, right: str, flag: str) -> DataFrame:
    """All rows with a boolean: whether the key occurs in ``chosen``."""
    keys = chosen.select(F.col(right).alias("_key")).distinct()
    return df.join(keys, F.col(left) == F.col("_key"), "left").withColumn(flag, F.col("_key").isNotNull()).drop("_key")


def not_in(df: DataFrame, done: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose key does not occur in ``done``; a null key stays."""
    return df.join(done.select(F.col(right).alias("_key")), F.col(left) == F.col("_key"), "left_anti")


def ranked(df: DataFrame, name: str, by: list[Column], partition: list[str] | None = None) -> DataFrame:
    """The position of each row in an order within its partition, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(*by)))


def top_k(df: DataFrame, partition: list[str], by: list[Column], k: int) -> DataFrame:
    """The first k rows of each partition; Spark prunes by rank before the shuffle."""
    return ranked(df, "_rank", by, partition).filter(F.col("_rank") <= k).drop("_rank")


def zipped(left: DataFrame, right: DataFrame, keys: list[str], order_left: list[Column], order_right: list[Column]) -> DataFrame:
    """Pairs rows of two tables by their position within each key; the longer side's rest is left out."""
    return ranked(left, "_pos", order_left, keys).join(ranked(right, "_pos", order_right, keys), [*keys, "_pos"]).drop("_pos")
