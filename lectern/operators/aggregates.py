"""Grouping operators: frequencies, first-wins distinct, ordered concatenation, shares, arg-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def report(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Rows and flagged rows of each group (null is a group); only groups with a finding."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(c).alias(n) for n, c in flags.items()))
    return counts.filter(" + ".join(flags) + " > 0")


def frequent(df: DataFrame, keys: list[str], value: str, total: str, least: int = 2, share: float = 0.35, floor: int = 4) -> DataFrame:
    """Values that occur at least ``least`` times but not on more than max(floor, share * total) rows of their group.

    ``total`` names the column with the group's number of rows.
    """
    counts = df.filter(F.col(value) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.max(total).alias("total"))
    return counts.filter((F.col("n") >= least) & (F.col("n") <= F.greatest(F.lit(float(floor)), F.col("total") * share))).drop("total")


def most_frequent(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each group; on ties the one that came first. Two partial aggregations, no window."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("top")).select(*keys, f"top.{value}", "top.n")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Where each key comes first."""
    return df.groupBy(*keys).agg(F.min(order).alias("first"))


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def joined_in_order(df: DataFrame, keys: list[str], order: str, text: str, between: str = "\n") -> DataFrame:
    """Texts of each group joined by their order; groups are as bounded as the documents they make."""
    own = F.sort_array(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x[text]), between).alias(text))


def max_digits(text: Column) -> Column:
    """The largest value among texts of digits only, 0 without one."""
    return F.coalesce(F.max(F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))), F.lit(0))
