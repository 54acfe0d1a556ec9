"""Summaries of whole documents as one flow: lessons, replies, a second request, coverage, tables to save, files to print and their validation.

All documents and lessons go through each step at once; what a model answers is asked for once and checkpointed. ``ask`` turns prompts (lesson, chunk_no, prompt) into
replies (lesson, chunk_no, reply), as ``adapters.replies`` does; an empty or null reply is a failed call. Lessons without bullets after the second request are failed: they are counted and not saved.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import scripts
from lectern.functions import text as T
from lectern.operators import segment as G
from lectern.operators.chunks import chunked
from lectern.operators.relational import same
from lectern.plans import prompts, summaries
from lectern.sources import files, printing, readers
from lectern.sources.tables import shared

Ask = Callable[[DataFrame], DataFrame]
#: Lessons with fewer bullets are asked for what they leave out.
SPARSE = 22
#: So many Tamil letters make a document's summary Tamil.
TAMIL_LETTERS = 50


class Summaries(NamedTuple):
    """Rows to append to the summaries, files (batch_id, pages, content), their validation, and the state of each document's job."""

    saved: DataFrame
    files: DataFrame
    validation: DataFrame
    jobs: DataFrame


def language_of(docs: DataFrame) -> Column:
    """Tamil by letters, board or subject; else the language that most letters are of."""
    told = F.lit(False)
    if "board" in docs.columns:
        told = told | F.coalesce(F.contains(F.col("board"), F.lit("Tamil Medium")), F.lit(False))
    if "subject" in docs.columns:
        told = told | (F.lower(T.strip(F.coalesce("subject", F.lit("")))) == "tamil")
    return F.when((F.regexp_count("text", F.lit("[஀-௿]")) >= TAMIL_LETTERS) | told, "Tamil").otherwise(T.language_of(F.col("text")))


def _clean(bullets: str) -> Column:
    return scripts.clean_each(F.col(bullets), T.clean_math)


def bullets_of(lessons: DataFrame, ask: Ask, most: int, overlap: int) -> DataFrame:
    """(lesson, bullets) of lessons (lesson, lesson_number, lesson_name, language, subsections, text): chunk by chunk, again where nothing came, and more where sections are left out."""
    c = F.col
    parts = lessons.select("*", F.size(chunked(c("text"), most, overlap)).alias("chunks"), F.posexplode(chunked(c("text"), most, overlap)).alias("chunk_no", "chunk"))
    asked = prompts.summary(c("chunk"), c("lesson_number"), c("lesson_name"), c("language"), c("subsections"), c("chunk_no") + 1, c("chunks"))
    first = parts.select("lesson", "chunk_no", "chunks", asked.alias("prompt")).checkpoint()
    answers = ask(first.drop("chunks")).checkpoint()
    found = summaries.replies_to_bullets(answers, "lesson").checkpoint()
    missing = first.filter("chunks = 1").drop("chunks").join(found, "lesson", "left_anti")
    if not missing.isEmpty():
        again = ask(missing.withColumn("prompt", prompts.summary_again(c("prompt")))).checkpoint()
        found = found.unionByName(summaries.replies_to_bullets(again, "lesson")).checkpoint()
    sparse = found.filter(F.size("bullets") < SPARSE)
    left_out = summaries.uncovered(lessons, sparse, "lesson").join(sparse, "lesson").join(lessons.select("lesson", "lesson_name"), "lesson")
    more = left_out.select("lesson", F.lit(0).alias("chunk_no"), prompts.coverage(c("missing"), c("bullets"), c("lesson_name")).alias("prompt"))
    if not more.isEmpty():
        extra = summaries.replies_to_bullets(ask(more).checkpoint(), "lesson", "additional_bullets")
        found = summaries.with_more(found, extra.withColumn("bullets", _clean("bullets")), "lesson")
    return found.select("lesson", _clean("bullets").alias("bullets"))


def summarised(docs: DataFrame, ask: Ask, old: DataFrame, model: str = "", now: Column | None = None, most: int = 60_000, overlap: int = 400) -> Summaries:
    """Summaries of documents (batch_id, text, name, and board, standard, subject, difficulty if there are any); ``old`` is the table they are appended to."""
    shared(docs.sparkSession)
    c = F.col
    docs = docs.withColumn("text", scripts.clean_extraction(c("text")))
    docs = docs.withColumns({x: F.lit(None).cast("string") for x in ("board", "standard", "subject", "difficulty") if x not in docs.columns}).withColumn("language", language_of(docs)).checkpoint()
    own = docs.select(c("batch_id").alias("doc"), "text", "name", "board", "subject")
    lessons = G.split_lessons(own).checkpoint()
    for column, kind in (("subsections", "array<struct<code:string,title:string>>"), ("lesson_number", "string")):
        if column not in lessons.columns:
            lessons = lessons.withColumn(column, F.lit(None).cast(kind))
    facts = docs.select(c("batch_id").alias("_b_doc"), "language", "board", "standard", "subject", "difficulty", c("name").alias("source_filename"))
    lessons = lessons.join(facts, same(["doc"], "_b_"), "left").drop("_b_doc").withColumn("lesson", F.struct("doc", "lesson_no"))
    lessons = lessons.withColumn("lesson_name", F.when(G.nameless(c("lesson_name")), G.document_title(c("text"), F.coalesce("source_filename", F.lit("")))).otherwise(c("lesson_name")))
    lessons = lessons.withColumn("lesson_number", F.coalesce("lesson_number", c("lesson_no").cast("string"))).checkpoint()
    bullets = bullets_of(lessons, ask, most, overlap).checkpoint()
    done = lessons.drop("text").join(bullets, "lesson").withColumn("batch_id", c("doc").cast("string")).withColumn("difficulty", F.coalesce("difficulty", F.lit("moderate"))).withColumn("model", F.lit(model))
    saved = summaries.stored_rows(done, old, [c("doc"), c("lesson_no")], now).checkpoint()
    printed = printing.printed_files(done.withColumn("place", c("lesson_no"))).checkpoint()
    found = printed.select(c("batch_id").alias("path"), F.lit(".pdf").alias("kind"), F.sha2("content", 256).alias("key"), "content")
    pages = files.read_pages(found, readers.READERS).select(c("path").alias("batch_id"), "num", "text")
    checked = printing.validated(pages, done.withColumn("place", c("lesson_no"))).checkpoint()
    return Summaries(saved, printed, checked, job_states(docs, lessons, done, checked))


def job_states(docs: DataFrame, lessons: DataFrame, done: DataFrame, checked: DataFrame) -> DataFrame:
    """batch_id, status, total_lessons, completed_lessons, error and validation_warning of each document."""
    c = F.col
    total = lessons.groupBy(c("doc").cast("string").alias("_t")).agg(F.count(F.lit(1)).alias("total_lessons"))
    made = done.groupBy(c("batch_id").alias("_m")).agg(F.count(F.lit(1)).alias("completed_lessons"))
    rows = docs.select(c("batch_id").cast("string").alias("batch_id"), T.strip(F.coalesce("text", F.lit(""))).alias("_text"))
    rows = rows.join(total, c("batch_id") == c("_t"), "left").join(made, c("batch_id") == c("_m"), "left").join(checked.select(c("batch_id").alias("_c"), c("status").alias("_valid")), c("batch_id") == c("_c"), "left")
    total, made = F.coalesce("total_lessons", F.lit(0)), F.coalesce("completed_lessons", F.lit(0))
    short = F.when(made < total, F.concat(F.lit("Generated "), made.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" lessons")))
    note = F.when(F.coalesce("_valid", F.lit("PASS")) != "PASS", F.concat(F.lit("PDF validation: "), c("_valid")))
    empty = c("_text") == ""
    return rows.select(
        "batch_id", F.when(empty, "error").otherwise("done").alias("status"), total.alias("total_lessons"), made.alias("completed_lessons"),
        F.when(empty, "No text could be extracted from this file.").alias("error"), F.nullif(F.concat_ws("; ", note, short), F.lit("")).alias("validation_warning"),
    )
