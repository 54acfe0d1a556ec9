"""Printed summaries by job, by batch or by choice: which lessons are printed, and under which name.

All documents asked for are printed by one plan; what can't be found is a row without a file. Lessons print in the order of their numbers, then of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.operators.relational import same
from lectern.sources import printing

FACTS = ("source_filename", "board", "standard", "subject", "difficulty")


def file_name(source: Column, only: Column | None = None) -> Column:
    """``<source>_summary.pdf`` without the source's extension; ``<source>_Lesson_<number>_summary.pdf`` where only that lesson is printed."""
    base = F.regexp_replace(F.coalesce(F.nullif(source, F.lit("")), F.lit("lesson_summary")), r"^(\.*[^./][^/]*?)\.[^./]*$", "$1")
    return F.concat(base, F.coalesce(F.concat(F.lit("_Lesson_"), only), F.lit("")) if only is not None else F.lit(""), F.lit("_summary.pdf"))


def stored_lessons(summaries: DataFrame) -> DataFrame:
    """Lessons of stored summaries as they are printed, without overall rows: bullets read from their JSON, the facts of the row with the least id for all of a batch."""
    rows = summaries.filter(F.coalesce(F.col("lesson_number") != "OVERALL", F.lit(False)))
    first = Window.partitionBy("batch_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({c: F.first(c).over(first) for c in FACTS}).withColumn("difficulty", F.coalesce("difficulty", F.lit("moderate")))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy(N.natural_key(F.col("lesson_number")), "id"))
    bullets = F.coalesce(F.from_json("bullets", "array<string>"), F.array().cast("array<string>"))
    return rows.select("batch_id", place.alias("place"), "lesson_number", "lesson_name", "start_page", "end_page", bullets.alias("bullets"), *FACTS)


def chosen(lessons: DataFrame) -> DataFrame:
    """batch_id, name, pages and content of chosen lessons (as ``stored_lessons`` gives them); a batch of one lesson is named after it."""
    made = lessons.withColumn("difficulty", F.coalesce(F.nullif("difficulty", F.lit("")), F.lit("moderate")))
    facts = made.groupBy(F.col("batch_id").alias("_b_batch_id")).agg(F.count(F.lit(1)).alias("n"), F.min_by("source_filename", "place").alias("source"), F.min_by("lesson_number", "place").alias("number"))
    name = F.when(F.col("n") == 1, file_name(F.col("source"), F.coalesce("number", F.lit("1")))).otherwise(file_name(F.col("source")))
    files = printing.printed_files(made)
    return files.join(facts, same(["batch_id"], "_b_")).select("batch_id", name.alias("name"), "pages", "content")


def by_batch(summaries: DataFrame, wanted: DataFrame) -> DataFrame:
    """batch_id, name, pages and content for each wanted batch_id; nulls where nothing is stored."""
    ids = wanted.select("batch_id").distinct()
    lessons = stored_lessons(summaries.join(ids, "batch_id", "left_semi"))
    facts = lessons.groupBy(F.col("batch_id").alias("_b_batch_id")).agg(F.min_by("source_filename", "place").alias("source"))
    files = printing.printed_files(lessons).join(facts, same(["batch_id"], "_b_")).select("batch_id", file_name(F.col("source")).alias("name"), "pages", "content")
    return ids.join(files, "batch_id", "left")


def by_job(jobs: DataFrame, printed: DataFrame, summaries: DataFrame) -> DataFrame:
    """job_id, route, name, pages and content for each job (job_id, batch_id): the file printed when it ran (printed: batch_id, pages, content), else one of its stored summaries.

    A job that is not known any more is looked up as a batch of that id. The route is ``file``, ``stored`` or ``missing``.
    """
    own = jobs.select("job_id", F.coalesce("batch_id", "job_id").alias("batch_id"))
    ready = own.join(printed, "batch_id", "left_semi").select("batch_id").distinct()
    made = by_batch(summaries, own.join(ready, "batch_id", "left_anti")).filter("content IS NOT NULL").withColumn("route", F.lit("stored"))
    facts = stored_lessons(summaries.join(ready, "batch_id", "left_semi")).groupBy(F.col("batch_id").alias("_b_batch_id")).agg(F.min_by("source_filename", "place").alias("source"))
    kept = printed.join(ready, "batch_id", "left_semi").join(facts, same(["batch_id"], "_b_"), "left").select("batch_id", file_name(F.col("source")).alias("name"), "pages", "content", F.lit("file").alias("route"))
    found = kept.unionByName(made)
    return own.join(found, "batch_id", "left").select("job_id", F.coalesce("route", F.lit("missing")).alias("route"), "name", "pages", "content")
