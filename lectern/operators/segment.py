"""Lessons from pages: running headers, line headings and Tamil units.

Pages are rows (doc, page_no from 0, num, text, lines). Header statistics and boundaries are native; what depends on the last boundary
that was taken is a fold over a document's pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lectern.functions import numbers as N
from lectern.functions import rules as R
from lectern.functions import text as T
from lectern.operators import aggregates as A
from lectern.operators import windows as W
from lectern.sources.tables import kept

TRIM = " -:."


def trimmed(text: Column, signs: str = r" \-:.") -> Column:
    return F.regexp_replace(text, f"^[{signs}]+|[{signs}]+$", "")


def running_header(lines: Column) -> Column:
    """The first line that is no number and no book title, if it has 3 to 100 characters."""
    skip = lambda x: x.rlike(R.BOOK_TITLE_LINE)
    head = trimmed(F.get(F.filter(lines, lambda x: ~skip(x)), F.lit(0)))
    return F.coalesce(F.when(F.length(head).between(3, 100), head), F.lit(""))


def intro_page(lines: Column, text: Column) -> Column:
    first = F.upper(F.array_join(F.slice(lines, 1, 8), " "))
    return first.rlike("|".join(R.INTRO_WORDS)) | text.rlike(R.SECTION_LINE)


def lesson_number(text: Column, fallback: Column) -> Column:
    """The number of a first section n.1, else of a unit or lesson heading near the start, else a line of 1 to 50 alone among the first five, else the fallback."""
    section = F.regexp_extract(text, R.FIRST_SECTION, 1)
    unit = F.regexp_extract(F.substring(text, 1, 2500), R.NUMBER_NEAR_START, 1)
    lines = F.filter(F.transform(F.split(F.substring(text, 1, 1000), "\r\n|[\n\r]"), lambda x: T.strip(x)), lambda x: x != "")
    alone = F.get(F.filter(F.slice(lines, 1, 5), lambda x: x.rlike("^[0-9]+$") & F.coalesce(x.try_cast("int").between(1, 50), F.lit(False))), F.lit(0))
    return F.coalesce(F.when((section != "") & ~section.try_cast("int").cast("string").isin(*R.NOT_SECTIONS), section), F.nullif(unit, F.lit("")), alone, fallback)


def nameless(name: Column) -> Column:
    """Whether a lesson's name says nothing."""
    return F.lower(F.coalesce(name, F.lit(""))).isin(*R.NO_NAMES)


def subsections(number: Column, text: Column, title: str = R.SECTION_TITLE) -> Column:
    """Sections number.x of a lesson with their titles."""
    pattern = F.concat(F.lit(r"(?m)^\s*("), number, F.lit(r"(?:\.\d+)+)" + title))
    codes, titles = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.transform(F.arrays_zip(codes.alias("code"), titles.alias("title")), lambda x: F.struct(T.strip(x["code"]).alias("code"), T.strip(x["title"]).alias("title")))


def missing_topics(sections: Column, blob: Column, most: int | None = 15) -> Column:
    """Sections (code, title) of which neither the code nor any Latin title word of four letters or more is inside the lower-cased text; the first ``most``."""
    named = lambda x: F.exists(F.regexp_extract_all(F.lower(x["title"]), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: F.contains(blob, w))
    missing = F.filter(sections, lambda x: ~named(x) & ~F.contains(blob, x["code"]))
    return missing if most is None else F.slice(missing, 1, most)


def by_running_headers(pages: DataFrame) -> DataFrame:
    """Lessons of documents whose running headers name at least two: (doc, lesson_no, lesson_name, start_page, end_page, text)."""
    w = Window.partitionBy("doc")
    own = pages.withColumn("h", running_header(F.col("lines"))).withColumn("intro", intro_page(F.col("lines"), F.col("text")) | (F.col("page_no") == 0)).withColumn("total", F.count(F.lit(1)).over(w))
    names = A.frequent(own, ["doc"], "h", "total").filter(~T.generic_header(F.col("h"))).select("doc", "h")
    firsts = A.first_seen(own.join(names, ["doc", "h"]), ["doc", "h"], "page_no")
    firsts = firsts.withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= 2")
    order = Window.partitionBy("doc").orderBy("first")
    firsts = firsts.withColumn("lesson_no", F.row_number().over(order)).withColumn("back_to", F.coalesce(F.lag("first").over(order), F.lit(0)))
    marks = own.filter("intro").select(F.col("doc").alias("d2"), F.col("page_no").alias("mark"))
    back = firsts.join(marks, (F.col("doc") == F.col("d2")) & (F.col("mark") <= F.col("first")) & (F.col("mark") >= F.col("back_to")), "left")
    starts = back.groupBy("doc", "h", "lesson_no").agg(F.when(F.first("lesson_no") == 1, 0).otherwise(F.coalesce(F.max("mark"), F.first("first"))).alias("start"))
    total = own.groupBy("doc").agg((F.max("page_no") + 1).alias("n_pages"))
    spans = W.spans(starts.join(total, "doc"), ["doc"], "lesson_no").drop("span_end")
    spans = spans.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("doc").orderBy("lesson_no")), F.col("n_pages")))
    return lessons_of(spans, pages, least=50)


def lessons_of(spans: DataFrame, pages: DataFrame, least: int) -> DataFrame:
    """Spans [start, end) of pages with their joined text; shorter texts than ``least`` are left out.

    A span that has a ``unit`` has that number and its name as it is; others take the number from their text and a name without unit words.
    """
    spans = spans if "unit" in spans.columns else spans.withColumn("unit", F.lit(None).cast("string"))
    inside = spans.select("doc", "lesson_no", "unit", F.col("h").alias("lesson_name"), F.explode(F.when(F.col("end") > F.col("start"), F.sequence(F.col("start"), F.col("end") - 1))).alias("page_no")).join(
        pages.select("doc", "page_no", "num", "text"), ["doc", "page_no"]
    )
    own = F.sort_array(F.collect_list(F.struct("page_no", "num", "text")))
    made = inside.groupBy("doc", "lesson_no", "unit", "lesson_name").agg(own.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    made = made.select("doc", "lesson_no", "unit", "lesson_name", F.get("p", F.lit(0))["num"].alias("start_page"), F.element_at("p", -1)["num"].alias("end_page"), text.alias("text"))
    made = made.filter(F.length(T.strip(F.col("text"))) > least)
    number = F.coalesce("unit", lesson_number(F.col("text"), F.col("lesson_no").cast("string")))
    name = trimmed(F.regexp_replace(trimmed(F.regexp_replace("lesson_name", R.NAME_JOINS, " ")), R.NAME_UNIT, ""))
    name = F.when(F.col("unit").isNotNull(), F.col("lesson_name")).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.col("lesson_name")))
    return made.withColumn("lesson_number", number).select(
        "doc", "lesson_no", N.lesson_id(F.col("lesson_number")).alias("lesson_id"), "lesson_number", name.alias("lesson_name"),
        "start_page", "end_page", subsections(F.col("lesson_number"), F.col("text")).alias("subsections"), T.strip(F.col("text")).alias("text"),
    )


def by_line_headings(df: DataFrame, key: str, text: str, heading: str = R.LESSON_HEADING, least: int = 30) -> DataFrame:
    """Lessons from heading lines: the text from a heading's end to the next one, if longer than ``least``.

    ``heading`` has pairs of groups, number and name, one of which takes part in a match. All are on page 1, as page marks are not read.
    """
    pairs = range(1, 9, 2) if heading == R.LESSON_HEADING else range(1, 3, 2)
    groups = [F.regexp_extract_all(text, F.lit(heading), F.lit(n + k)).alias(f"{kind}{n}") for n in pairs for k, kind in enumerate(("number", "name"))]
    counted = F.size(F.regexp_extract_all(text, F.lit(heading), F.lit(0)))
    parts = F.slice(F.split(text, heading), F.lit(2), counted)
    rows = df.select(key, F.posexplode(F.arrays_zip(*groups, parts.alias("text"))).alias("at", "l"))
    first = lambda kind: F.coalesce(*(F.nullif(F.col(f"l.{kind}{n}"), F.lit("")) for n in pairs))
    number = F.coalesce(first("number"), (F.col("at") + 1).cast("string"))
    out = rows.select(key, (F.col("at") + 1).alias("lesson_no"), number.alias("lesson_number"), trimmed(F.coalesce(first("name"), F.lit("")), r" \-–—:.").alias("name"), T.strip(F.col("l.text")).alias("text"))
    out = out.filter(F.length("text") > least).withColumn("lesson_name", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Lesson "), "lesson_number")))
    return out.select(
        key, "lesson_no", N.lesson_id(F.col("lesson_number")).alias("lesson_id"), "lesson_number", "lesson_name", F.lit(1).alias("start_page"), F.lit(1).alias("end_page"),
        subsections(F.col("lesson_number"), F.col("text"), r"\s+([A-Za-z\s,\-]{3,80})").alias("subsections"), "text",
    )


def taken(candidates: DataFrame, apart: int, weak_apart: int | None = None) -> DataFrame:
    """Candidates (doc, page_no, unit, title, strong) that are taken, with lesson_no: the unit differs from the last one taken and lies ``apart`` pages after it.

    With ``weak_apart`` only candidates that are not strong have to lie apart. The candidates of a document are one sorted stream, of which only the last one taken is held.
    """
    rows = candidates.select("doc", "page_no", "unit", "title", "strong").repartition("doc").sortWithinPartitions("doc", "page_no")
    schema = S.StructType([*rows.schema.fields[:4], S.StructField("lesson_no", S.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, n = None, None, 0
        for batch in batches:
            stay, numbers = [], []
            for doc, page, unit, strong in zip(*(batch.column(c).to_pylist() for c in ("doc", "page_no", "unit", "strong")), strict=True):
                if last is None or doc != now:
                    now, last, n = doc, None, 0
                least = apart if weak_apart is None else 0 if strong else weak_apart
                fresh = last is None or unit != last[1] and page - last[0] >= least
                if fresh:
                    last, n = (page, unit), n + 1
                    numbers.append(n)
                stay.append(fresh)
            own = batch.filter(pa.array(stay, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(numbers, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def spans_of(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """Starts (doc, lesson_no, start, ...) with ``end``: the next start or the number of pages."""
    total = pages.groupBy("doc").agg((F.max("page_no") + 1).alias("n_pages"))
    return starts.join(total, "doc").withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("doc").orderBy("lesson_no")), F.col("n_pages")))


def by_unit_headings(pages: DataFrame, least: int = 30) -> DataFrame:
    """Lessons that begin at pages with a unit heading, or with a unit in the footer at two pages from the last one; for documents with two or more.

    Pages that begin with an exercise or a back-matter heading start none. A unit without a title takes the first plausible line after its heading, else
    the commonest running header of its pages that is not on 35 % of all pages, else its number.
    """
    text = F.col("text")
    skipped = F.substring(text, 1, 200).rlike(R.EXERCISE_HEADING) | F.coalesce(F.get("lines", F.lit(0)).rlike(R.BACK_MATTER_LINE), F.lit(False))
    unit, footer = F.regexp_extract(text, R.UNIT_HEADING, 1), F.regexp_extract(text, R.UNIT_IN_FOOTER, 1)
    after = F.transform(F.split(F.element_at(F.split(text, R.UNIT_HEADING, 2), -1), "\r\n|[\n\r]"), lambda x: trimmed(x))
    line = F.get(F.filter(after, lambda x: F.length(x).between(3, 79) & ~x.rlike(R.NO_TITLE_LINE)), F.lit(0))
    title = F.coalesce(F.nullif(T.strip(F.regexp_extract(text, R.UNIT_HEADING, 2)), F.lit("")), line)
    found = pages.filter(~skipped).select("doc", "page_no", F.coalesce(F.nullif(unit, F.lit("")), F.nullif(footer, F.lit(""))).alias("unit"), F.when(unit != "", title).alias("title"), (unit != "").alias("strong")).filter("unit IS NOT NULL")
    starts = taken(found, 0, weak_apart=2).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc"))).filter("n >= 2")
    spans = spans_of(starts.select("doc", "lesson_no", "unit", "title", F.col("page_no").alias("start")), pages)
    heads = pages.filter((F.col("header") != "") & (F.length("header") < 70)).withColumn("total", F.lit(1))
    size = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n_all"))
    rare = heads.groupBy("doc", "header").agg(F.count(F.lit(1)).alias("n")).join(size, "doc").filter("n < 0.35 * n_all").select("doc", "header")
    plain = heads.filter(~F.col("header").rlike("^[0-9]+$") & (F.length("header") > 3) & ~F.col("header").rlike(R.NO_TITLE_LINE)).join(rare, ["doc", "header"], "left_semi")
    owner = spans.select("doc", "lesson_no", F.explode(F.when(F.col("end") > F.col("start"), F.sequence("start", F.col("end") - 1))).alias("page_no"))
    common = A.most_frequent(plain.join(owner, ["doc", "page_no"]), ["doc", "lesson_no"], "header", "page_no").select("doc", "lesson_no", "header")
    named = spans.join(common, ["doc", "lesson_no"], "left").withColumn("h", F.coalesce("title", "header", F.concat(F.lit("Lesson "), "unit")))
    return lessons_of(named.drop("title", "header"), pages, least)


def unit_numbers(text: Column) -> Column:
    """The unit number that a page begins, as text: 'unit n', 'n.1 Title', or a Tamil number word."""
    direct, words = F.regexp_extract(text, R.UNIT_NUMBER, 1), F.regexp_extract(text, R.UNIT_NUMBER_WORD, 1)
    table = F.create_map(*(F.lit(x) for pair in R.TAMIL_NUMBERS.items() for x in pair))
    return F.coalesce(F.nullif(direct, F.lit("")), F.try_element_at(table, words))


def by_units(pages: DataFrame, apart: int = 3, title: Column | None = None, least: int = 30) -> DataFrame:
    """Lessons that begin where the unit number differs from the last unit taken and lies ``apart`` pages after it; the first snaps to page 0 within three pages."""
    own = pages.select("doc", "page_no", unit_numbers(F.col("text")).alias("unit"), (title if title is not None else running_header(F.col("lines"))).alias("title")).filter("unit IS NOT NULL")
    starts = taken(own.withColumn("strong", F.lit(True)), apart)
    start = F.when((F.col("lesson_no") == 1) & (F.col("page_no") <= 3), 0).otherwise(F.col("page_no"))
    spans = spans_of(starts.select("doc", "lesson_no", F.coalesce(F.nullif("title", F.lit("")), F.col("unit")).alias("h"), start.alias("start")), pages)
    return lessons_of(spans, pages, least)


def whole_documents(docs: DataFrame) -> DataFrame:
    """Each document (doc, text, name) as one lesson, without its page marks."""
    plain = F.regexp_replace("text", r"\n=== PAGE \d+ ===\n", "\n")
    return docs.select(
        "doc", F.lit(1).alias("lesson_no"), F.lit("lesson_01").alias("lesson_id"), F.lit("1").alias("lesson_number"), document_title(plain, F.coalesce("name", F.lit(""))).alias("lesson_name"),
        F.lit(1).alias("start_page"), F.greatest(F.lit(1), F.regexp_count("text", F.lit(R.PAGE_MARK))).alias("end_page"),
        F.array().cast("array<struct<code:string,title:string>>").alias("subsections"), T.strip(plain).alias("text"),
    )


def tamil_documents(docs: DataFrame) -> Column:
    """Whether a document is Tamil: twenty Tamil letters, or so named by file, board or subject."""
    told = F.concat_ws(" ", *(F.lower(c) for c in ("name", "board", "subject") if c in docs.columns))
    return (F.regexp_count("text", F.lit("[\u0b80-\u0bff]")) >= 20) | F.contains(told, F.lit("tamil")) | F.contains(told, F.lit("தமிழ்"))


def split_lessons(docs: DataFrame) -> DataFrame:
    """Lessons of documents (doc, text, name, and board and subject if there are any): by Tamil units for Tamil documents, then by running headers,
    by unit headings, by heading lines, and the whole document as the last resort; blank documents have none.

    The first method that finds anything in a document counts, and a method sees only the documents that those before it have not settled.
    Documents, pages and lessons are compressed tables in the shared folder; pages are written once, and only for documents that are not settled by Tamil units.
    """
    from lectern.operators import sections, tamil_units

    own = kept(docs.filter(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("_tamil", tamil_documents(docs)).withColumn("_paged", F.col("text").rlike(R.PAGE_MARK)), "documents")
    out, settled, pages = None, None, None
    left = lambda rows: rows if settled is None else rows.join(settled, "doc", "left_anti")
    plain = own.select("doc", F.regexp_replace("text", r"\n=== PAGE \d+ ===\n", "\n").alias("text"))
    methods = [
        (own.filter("_tamil AND _paged"), tamil_units.lessons), (None, by_running_headers), (None, by_unit_headings),
        (plain, lambda p: by_line_headings(p, "doc", "text")), (own.drop("_tamil", "_paged"), whole_documents),
    ]
    for n, (rows, method) in enumerate(methods):
        if left(own.filter("_paged") if rows is None else rows).isEmpty() and (out is not None or n < len(methods) - 1):
            continue
        if rows is None:
            pages = rows = kept(sections.pages(left(own.filter("_paged")), "doc", "text"), "pages") if pages is None else pages
        found = kept(method(left(rows)), "lessons")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        names = found.select("doc").distinct()
        settled = names if settled is None else settled.unionByName(names)
    return out


def routed(*candidates: DataFrame) -> DataFrame:
    """For each document the lessons of the first method that found any."""
    every = None
    for rank, found in enumerate(candidates):
        rows = found.withColumn("_rank", F.lit(rank))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    best = every.groupBy("doc").agg(F.min("_rank").alias("_best"))
    return every.join(best, "doc").filter("_rank = _best").drop("_rank", "_best")


def _plausible(title: Column, least: int, most: int) -> Column:
    named = ~title.rlike("|".join(R.NOT_LESSONS)) & ~title.rlike(r"^(?:\d|" + "|".join(R.UNIT_WORDS) + ")+$")
    return F.length(title).between(least, most) & named


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once; an expression used at several places of a lambda is worked out anew at each, for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def doubled_heading(lines: Column) -> Column:
    """A heading that stands twice in a row, as printed shadows do: one line, or two lines together; null without one."""

    def found(lines: Column) -> Column:
        last = F.size(lines)
        at = lambda n: F.when(last > n, F.sequence(F.lit(1), last - n)).otherwise(F.array().cast("array<int>"))
        twice = lambda n, far: lambda x: F.get(F.transform(F.filter(at(n), lambda i: (F.element_at(x, i) == F.element_at(x, i + far)) & _plausible(F.element_at(x, i), 3, 45)), lambda i: F.element_at(x, i)), F.lit(0))
        pairs = F.transform(at(1), lambda i: trimmed(F.concat(F.element_at(lines, i), F.element_at(lines, i + 1)), R.TITLE_SIGNS))
        return F.coalesce(bound(F.transform(lines, lambda x: trimmed(x, R.TITLE_SIGNS)), twice(1, 1)), bound(pairs, twice(3, 2)))

    return bound(lines, found)


def unit_title(lines: Column) -> Column:
    """The title of a Tamil unit: a doubled heading, else the first plausible of twelve lines."""
    bare = F.transform(F.slice(lines, 1, 12), lambda x: trimmed(x, R.TITLE_SIGNS))
    return F.coalesce(doubled_heading(lines), F.get(F.filter(bare, lambda x: _plausible(x, 3, 40)), F.lit(0)), F.lit(""))


def document_title(text: Column, name: Column) -> Column:
    """A document's title: Tamil heading, labelled line, first plausible line, cleaned file name, or 'Lesson 1'."""
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: T.strip(x)), lambda x: (x != "") & ~x.startswith("=== PAGE"))
    tamil = (F.regexp_count(text, F.lit("[஀-௿]")) >= 20) | F.lower(name).contains("tamil")
    heads = F.filter(F.transform(F.slice(lines, 1, 15), lambda x: trimmed(x, R.TITLE_SIGNS)), lambda x: _plausible(x, 3, 50))
    labelled = F.filter(F.transform(F.slice(lines, 1, 15), lambda x: F.regexp_extract(x, R.TITLE_LABEL, 1)), lambda x: x != "")
    plain = F.filter(F.slice(lines, 1, 8), lambda x: (F.length(x) > 4) & (F.length(x) < 80) & ~x.rlike(R.NOT_TITLE_START))
    cleaned = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), R.NAME_JOINS, " "), R.FILE_WORDS, "")))
    first = lambda a: F.get(a, F.lit(0))
    return F.coalesce(F.when(tamil, first(heads)), trimmed(first(labelled)), trimmed(first(plain)), F.nullif(cleaned, F.lit("")), F.lit("Lesson 1"))
