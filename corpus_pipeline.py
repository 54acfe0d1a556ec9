"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the
columns of ``docs``. Models are fitted on the labelled part of the folder's documents.

Defined results of every stage: an empty table gives no rows; extra columns, whatever their names, go through all stages but the last; very long
texts are read whole; rows that are repeated are judged alike. Null and empty texts have no words: they are never toxic, near copies or
contaminated, have the quality of the average labelled text, and no tokens. What a stage does with ties is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, decontaminate, neardup, quality, toxicity
from lectern.llm.common import prepared, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Without labels of both kinds none goes."""
    return toxicity.keep_clean(docs, toxicity.trained(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score under 0.5 go. Without labels none goes."""
    return quality.keep_good(docs, quality.trained(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least doc_id: five-word shingles, likeness 0.8 or more.

    Of several rows with that doc_id one stays for each text; rows without a doc_id can't be told apart and stay.
    """
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go. An empty benchmark, or one without words, has none."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text; one row for each row."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", to_tokens),
]
#: The classifiers and the tokenizer are not SQL; the tests compare the stages with brute force (test_pipeline_stages_match_brute_force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are a table in the shared folder."""
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
