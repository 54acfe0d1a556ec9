"""Lesson summaries: rows to store and to show, coverage of topics, and files of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import jsonio as J
from lectern.functions import numbers as N
from lectern.functions import rules as R
from lectern.functions import text as T
from lectern.operators import dml as K
from lectern.operators import sections as S
from lectern.operators import segment as G

KEPT = ("batch_id", "board", "standard", "subject", "lesson_number", "lesson_name", "start_page", "end_page", "language", "bullets", "difficulty", "source_filename", "model")


def stored(lessons: DataFrame, old: DataFrame, given: dict[str, str | None], now: Column | None = None) -> DataFrame:
    """Rows of ``old``'s layout for lessons (lesson_no, lesson_number, lesson_name, start_page, end_page, bullets): ids go on from the largest one,
    bullets become JSON text, and the fields in ``given`` are the same for all; no difficulty is 'moderate'."""
    own = {k: F.lit(v).cast("string") for k, v in given.items()} | {"difficulty": F.lit(given.get("difficulty") or "moderate")}
    return stored_rows(lessons.withColumns(own), old, [F.col("lesson_no")], now)


def stored_rows(lessons: DataFrame, old: DataFrame, order: list[Column], now: Column | None = None) -> DataFrame:
    """The same where the lessons have all fields as columns; ids follow ``order``."""
    rows = lessons.withColumn("bullets", F.to_json("bullets"))
    rows = K.append_with_ids(old, rows.withColumn("created_at", N.utc_now() if now is None else now), "id", order)
    return rows.select("id", *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in KEPT), "created_at")


def shown(summaries: DataFrame, **wanted) -> DataFrame:
    """Stored summaries of lessons as the service shows them, filtered by equality where a value is wanted; newest first is the caller's order."""
    from lectern.operators.relational import optional_filters

    rows = optional_filters(summaries.filter(F.coalesce(F.col("lesson_number") != "OVERALL", F.lit(False))), **wanted)
    return rows.withColumn("bullets", F.coalesce(F.from_json("bullets", "array<string>"), F.array().cast("array<string>"))).withColumn("created_at", N.iso(F.col("created_at")))


def replies_to_bullets(replies: DataFrame, key: str = "lesson_no", field: str = "bullets") -> DataFrame:
    """The bullets of model replies (key, reply, and chunk_no if a key has several): the list ``field`` of a JSON reply, else the lines of a plain one; each comparison key once, in order."""
    chunk = F.col("chunk_no") if "chunk_no" in replies.columns else F.lit(0)
    own = replies.select(F.struct(F.col(key).alias("key"), chunk.alias("chunk_no")).alias("_at"), "reply")
    listed = F.coalesce(F.from_json(F.get_json_object(J.parsed(F.col("reply")), f"$.{field}"), "array<string>"), F.array().cast("array<string>"))
    rows = own.withColumn("listed", listed)
    good = rows.filter(F.size("listed") > 0).select("_at", F.posexplode("listed").alias("line_no", "bullet"))
    plain = S.bullets(rows.filter(F.size("listed") == 0), "_at", "reply")
    every = good.unionByName(plain).withColumn("bullet", T.strip(F.col("bullet"))).filter("bullet <> ''")
    first = every.groupBy(F.col("_at.key").alias(key), T.normal_key(F.col("bullet")).alias("_k")).agg(F.min(F.struct("_at.chunk_no", "line_no", "bullet")).alias("b"))
    ordered = F.transform(F.sort_array(F.collect_list("b")), lambda x: x["bullet"])
    return first.groupBy(key).agg(ordered.alias("bullets"))


def uncovered(lessons: DataFrame, bullets: DataFrame, key: str = "lesson_no") -> DataFrame:
    """Up to fifteen sections of each lesson that its bullets leave out; lessons without bullets or sections are left out themselves."""
    blob = bullets.select(key, F.lower(F.array_join("bullets", " ")).alias("blob")).filter("blob <> ''")
    found = lessons.filter(F.size("subsections") > 0).join(blob, key)
    return found.select(key, G.missing_topics(F.col("subsections"), F.col("blob")).alias("missing")).filter(F.size("missing") > 0)


def with_more(bullets: DataFrame, more: DataFrame, key: str = "lesson_no") -> DataFrame:
    """Bullets with those of a second round behind them that are new, ignoring case and white space at the ends."""
    extra = more.select(key, F.col("bullets").alias("_more"))
    plain = lambda x: F.lower(T.strip(x))
    new = F.filter(F.coalesce("_more", F.array().cast("array<string>")), lambda x: ~F.array_contains(F.transform("bullets", plain), plain(x)))
    both = F.concat("bullets", new)
    return bullets.join(extra, key, "left").select(key, both.alias("bullets"))


def exported(summaries: DataFrame, batch: str | None = None) -> DataFrame:
    """Lessons of a batch as they are printed: without the overall row, in the order of their numbers, then of their ids."""
    rows = summaries.filter(F.coalesce(F.col("lesson_number") != "OVERALL", F.lit(False)))
    rows = rows if batch is None else rows.filter(F.col("batch_id") == batch)
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy(N.natural_key(F.col("lesson_number")), "id"))
    return rows.withColumn("place", place)


def question_lines(questions: DataFrame) -> DataFrame:
    """Lines (level_no, number, line_no, line) of a text file of questions (level, position, question, options, answer), by level; the caller writes them in this order."""
    level = F.array_position(F.array(*map(F.lit, R.LEVELS)), F.col("level")).cast("int")
    rows = questions.withColumn("level_no", level).filter("level_no > 0").withColumn("number", F.row_number().over(Window.partitionBy("level").orderBy("position")))
    options = F.transform(F.map_entries("options"), lambda e: F.concat(F.lit("  "), e["key"], F.lit(". "), e["value"]))
    head = F.array(F.lit(""), F.concat(F.lit("Q"), F.col("number").cast("string"), F.lit("."), F.col("question")))
    body = F.concat(head, options, F.array(F.concat(F.lit("   correct Answer: "), F.col("answer"))))
    titles = questions.sparkSession.createDataFrame([(n, 0, x) for n, name in enumerate(R.LEVELS, 1) for x in [["", f"{'=' * 15} {name.upper()} {'=' * 15}"]]], "level_no int, number int, lines array<string>")
    every = titles.unionByName(rows.select("level_no", "number", body.alias("lines")))
    return every.select("level_no", "number", F.posexplode("lines").alias("line_no", "line"))


def next_name(taken: DataFrame, base: str = "generated_questions", extension: str = "txt") -> str:
    """The first free numbered file name; ``taken`` has the names that exist (column name)."""
    number = F.regexp_extract("name", rf"^{base}([1-9]\d*)\.{extension}$", 1).try_cast("long")
    numbers = taken.select(number.alias("n")).filter("n IS NOT NULL").distinct()
    free = numbers.join(numbers.select((F.col("n") - 1).alias("n")), "n", "left_anti").agg(F.min("n")).first()[0]
    first = not numbers.filter("n = 1").isEmpty()
    return f"{base}{free + 1 if first else 1}.{extension}"
