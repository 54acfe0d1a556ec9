"""Audit of a document bank: exact duplicates and foreign-script rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import dedup as D
from lectern.operators import dml as K
from lectern.sources.tables import table


def audit(bank: DataFrame, key: Column, corrupt: Column, scope: list[str]) -> DataFrame:
    """Counts per scope: rows, corrupted rows, and repeats of a key among the rows that are not corrupted.

    Groups without a finding are left out; a null scope value is a group of its own; an empty key is never a repeat. Keys are compared by their
    128-bit digests, and both aggregations sum up before they shuffle.
    """
    digest = F.when(key != "", F.unhex(F.md5(key.cast("binary"))))
    flagged = bank.select(*scope, digest.alias("_key"), F.coalesce(corrupt, F.lit(False)).alias("_bad"))
    each = flagged.groupBy(*scope, "_bad", "_key").agg(F.count(F.lit(1)).alias("_n"))
    counts = each.groupBy(*scope).agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.when(F.col("_bad"), F.col("_n")).otherwise(0)).alias("n_corrupted"),
        F.sum(F.when(~F.col("_bad") & F.col("_key").isNotNull(), F.col("_n") - 1).otherwise(0)).alias("n_duplicates"),
    )
    return counts.filter("n_corrupted + n_duplicates > 0")


def flagged(bank: DataFrame, key: Column, corrupt: Column, scope: list[str], order: str) -> DataFrame:
    """order and kind (corrupted or duplicate) of the rows a clean-up takes away.

    Corrupted rows are set aside; of the others, each is held against those kept before it in its scope by the near-duplicate ratio.
    """
    own = bank.select(*scope, order, key.alias("_key"), F.coalesce(corrupt, F.lit(False)).alias("_bad"))
    same = D.greedy(own.filter("NOT _bad"), scope, order, "_key").filter("status = 'duplicate'")
    return own.filter("_bad").select(order, F.lit("corrupted").alias("kind")).unionByName(same.select(order, F.lit("duplicate").alias("kind")))


def cleaned(bank: DataFrame, selections: DataFrame, found: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Bank and selections without the rows found by ``flagged``."""
    return K.cascade_delete(bank, selections, found.select(key).distinct(), key, child_key)


def _bank(spark: SparkSession, sf_dir: str, scope: list[str]) -> DataFrame:
    bank = table(spark, sf_dir, "documents")
    return audit(bank, T.normal_key(F.col("text")), F.col("text").rlike("[À-ÿ]"), scope)


def _clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a bank: those that go, and why; turns with a letter beyond ASCII count as corrupted."""
    said = table(spark, sf_dir, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    said = said.withColumn("id", F.format_string("%012d.%06d", "conv_id", "turn"))
    return flagged(said, T.normal_key(F.col("text")), F.col("text").rlike("[^\\x00-\\x7F]"), ["conv_id"], "id")


_SQL = r"""
WITH keyed AS (
  SELECT {scope}, doc_id,
         trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS k,
         coalesce(regexp_matches(text, '[À-ÿ]'), false) AS bad
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {scope}, bad, k ORDER BY doc_id) AS rn FROM keyed)
SELECT {scope}, count(*) AS n_rows, count(*) FILTER (WHERE bad) AS n_corrupted,
       count(*) FILTER (WHERE NOT bad AND k <> '' AND rn > 1) AS n_duplicates
FROM ranked GROUP BY {scope}
HAVING count(*) FILTER (WHERE bad) + count(*) FILTER (WHERE NOT bad AND k <> '' AND rn > 1) > 0
"""

QUERIES = {
    "audit_bank": lambda spark, d: _bank(spark, d, ["source", "lang"]),
    "audit_by_lang": lambda spark, d: _bank(spark, d, ["lang"]),
    "k14_clean_up": _clean_up,
}
ORACLES = {"audit_bank": _SQL.format(scope="source, lang"), "audit_by_lang": _SQL.format(scope="lang")}
