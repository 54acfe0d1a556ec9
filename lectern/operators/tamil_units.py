"""Units of Tamil textbooks: where they begin, their numbers, titles and parts.

A page begins a unit by the word for it with a number, by another unit word with one, or by its learning goals. Goals without a number continue from the unit taken last, so
numbers are settled by a fold over a document's candidate pages; titles come from the page's own lines or, where it has none, from the next page. A document without any unit is one lesson.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions import rules as R
from lectern.functions import scripts
from lectern.functions import text as T
from lectern.operators import sections
from lectern.operators import segment as G

#: Pages that two units are apart at least, lines of a page that can begin one, and pages before the first unit that belong to it.
APART, TOP, LEAD_IN = 3, 15, 3
PARTS = 15


def _bare(line: Column) -> Column:
    return G.trimmed(line, R.TITLE_SIGNS)


def title(lines: Column) -> Column:
    """A doubled heading, else the first plausible of twelve lines, joined with a short next line that is not a heading of a part; null without one."""

    def of(bare: Column, at: Column) -> Column:
        own, after = F.get(bare, at), F.get(bare, at + 1)
        joined = scripts.repaired_tamil(F.concat(own, after))
        goes_on = (after != own) & F.length(after).between(2, 15) & ~after.rlike("|".join(R.NOT_LESSONS)) & F.length(joined).between(3, 40)
        return F.when(F.coalesce(goes_on, F.lit(False)), joined).otherwise(own)

    first = lambda bare: F.get(F.filter(F.transform(F.slice(bare, 1, 12), lambda x, i: F.when(G._plausible(x, 3, 40), i)), lambda i: i.isNotNull()), F.lit(0))
    plain = lambda own: G.bound(F.transform(F.slice(own, 1, 13), _bare), lambda bare: G.bound(first(bare), lambda at: of(bare, at)))
    return G.bound(lines, lambda own: F.coalesce(G.doubled_heading(own), plain(own)))


def _number(digits: Column, roman: Column, word: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in R.TAMIL_NUMBERS.items() for x in pair))
    return F.coalesce(digits.try_cast("int").cast("string"), F.nullif(roman, F.lit("")), F.try_element_at(table, word))


def _after(lines: Column, words: tuple[str, ...]) -> Column:
    """The lines behind the first one that has one of the words; all of them if none has."""
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("|".join(words)), i + 1)), lambda i: i.isNotNull()), F.lit(0))
    return F.slice(lines, F.coalesce(at, F.lit(0)) + 1, F.size(lines))


def candidates(pages: DataFrame) -> DataFrame:
    """(doc, page_no, unit, first, title) of pages (with the lines of the next one) that may begin a unit; ``unit`` is null where it has to be inferred, ``first`` what it is if no unit was taken before."""
    group = lambda text, pattern, n: F.regexp_extract(text, pattern, n)
    own = pages.withColumn("top", F.slice("lines", 1, TOP)).withColumn("blob", F.array_join("top", " "))
    blob = F.col("blob")
    iyal, other, goals = blob.rlike(R.IYAL), blob.rlike(R.OTHER_UNIT), blob.rlike(R.TAMIL_GOALS)
    own = own.withColumn("kind", F.when(iyal, "iyal").when(other, "other").when(goals, "goals")).filter("kind IS NOT NULL")
    kind, text = F.col("kind"), F.col("text")
    named = _number(*(group(blob, R.IYAL, n) for n in (1, 2, 3)))
    plain = group(blob, R.OTHER_UNIT, 1)
    near = F.when(text.rlike(R.IYAL_NEAR), _number(*(group(text, R.IYAL_NEAR, n) for n in (1, 2, 3))))
    unit = F.when(kind == "iyal", named).when(kind == "other", F.coalesce(plain.try_cast("int").cast("string"), plain)).otherwise(near)
    table = F.create_map(*(F.lit(x) for pair in R.TAMIL_NUMBERS.items() for x in pair))
    first = F.coalesce(F.try_element_at(table, group(blob, f"(?U)\\b({R.TAMIL_TEN})\\b", 1)), F.lit("1"))
    after = F.when(kind == "iyal", title(_after(F.col("top"), (R.IYAL_WORD,)))).otherwise(title(_after(F.col("top"), R.OTHER_UNIT_WORDS)))
    doubled = lambda c: G.doubled_heading(F.col(c))
    from_goals = F.coalesce(doubled("lines"), doubled("next_lines"), title(F.col("lines")))
    found = F.when(kind == "goals", from_goals).otherwise(F.coalesce(after, F.when(kind == "iyal", doubled("next_lines"))))
    return own.select("doc", "page_no", unit.alias("unit"), first.alias("first"), F.coalesce(found, title(F.col("next_lines"))).alias("title"))


def taken(found: DataFrame) -> DataFrame:
    """Candidates that begin a unit (doc, lesson_no, page_no, unit, title): the number differs from the last one's and the page lies APART pages after it. A fold over a document's candidates."""
    one = F.struct(F.col("page_no").cast("int").alias("page_no"), "unit", "first", "title")
    kind = "struct<page_no:int,unit:string,taken:array<struct<page_no:int,unit:string,title:string>>>"
    zero = F.struct(F.lit(0).alias("page_no"), F.lit("").alias("unit"), F.array().alias("taken")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        none = F.size(acc["taken"]) == 0
        following = F.coalesce((acc["unit"].try_cast("int") + 1).cast("string"), (F.size(acc["taken"]) + 1).cast("string"))
        unit = F.coalesce(x["unit"], F.when(none, x["first"]).otherwise(following))
        fresh = none | ((unit != acc["unit"]) & (x["page_no"] - acc["page_no"] >= APART))
        new = F.struct(x["page_no"].alias("page_no"), unit.alias("unit"), F.concat(acc["taken"], F.array(F.struct(x["page_no"].alias("page_no"), unit.alias("unit"), x["title"].alias("title")))).alias("taken"))
        return F.when(fresh, new.cast(kind)).otherwise(acc)

    each = found.groupBy("doc").agg(F.aggregate(F.sort_array(F.collect_list(one)), zero, step, lambda acc: acc["taken"]).alias("taken"))
    return each.select("doc", F.posexplode("taken").alias("at", "t")).select("doc", (F.col("at") + 1).alias("lesson_no"), "t.*")


def parts(text: Column) -> Column:
    """Lines of a unit that name a part of it, as sections without a code; the first PARTS."""
    lines = F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: G.trimmed(x, R.PART_SIGNS))
    named = F.filter(lines, lambda x: F.length(x).between(3, 50) & x.rlike("|".join(R.UNIT_PARTS)))
    return F.transform(F.slice(named, 1, PARTS), lambda x: F.struct(F.lit("").alias("code"), x.alias("title")))


def named(title_text: Column, unit: Column) -> Column:
    """The title behind the unit's word and number, unless it begins with a unit word."""
    begins = F.lit(False)
    for word in R.UNIT_STARTS:
        begins = begins | title_text.startswith(word)
    return F.when(begins, title_text).otherwise(F.concat(F.lit(R.IYAL_WORD + " "), unit, F.lit(" – "), title_text))


def lessons(docs: DataFrame) -> DataFrame:
    """Lessons of Tamil documents (doc, text with page marks, name; the name gives a title to those without any unit).

    Units are found from pages without a shuffle of their texts; a document's text meets its units once, and its pages are put together where they stand.
    """
    starts = taken(candidates(sections.pages(docs, "doc", "text", following=True)))
    starts = starts.withColumn("start", F.when((F.col("lesson_no") == 1) & (F.col("page_no") <= LEAD_IN), 0).otherwise(F.col("page_no")))
    units = starts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lesson_no", "start", "unit", F.coalesce("title", F.concat(F.lit(R.IYAL_WORD + " "), "unit")).alias("title")))).alias("units"))
    nums, texts = sections.page_cuts("text")
    met = docs.select("doc", "text", "name").join(units, "doc", "left").select("doc", "name", "units", F.arrays_zip(nums.alias("num"), F.transform(texts, lambda x: T.strip(x)).alias("text")).alias("p"))
    joined = lambda p: F.array_join(F.transform(p, lambda x: x["text"]), "\n")
    lines = lambda n: F.coalesce(sections.page_lines(F.get("p", F.lit(n))["text"]), F.array().cast("array<string>"))
    own_title = F.coalesce(G.doubled_heading(lines(0)), G.doubled_heading(lines(1)), title(lines(0)), G.document_title(joined(F.col("p")), F.coalesce("name", F.lit(""))))
    alone = F.array(F.struct(F.lit(1).alias("lesson_no"), F.lit(0).alias("start"), F.lit("1").alias("unit"), own_title.alias("title")))
    met = met.select("doc", "p", F.col("units").isNull().alias("lone"), F.when(F.col("units").isNull(), alone).otherwise(F.col("units")).alias("units"))
    end = lambda i: F.coalesce(F.get("units", i + 1)["start"], F.size("p"))
    own = F.transform("units", lambda u, i: F.struct(u["lesson_no"].alias("lesson_no"), u["unit"].alias("unit"), u["title"].alias("title"), F.slice("p", u["start"] + 1, end(i) - u["start"]).alias("p")))
    made = met.select("doc", "lone", F.explode(own).alias("l")).select("doc", "lone", "l.*")
    made = made.withColumn("text", T.strip(joined(F.col("p")))).withColumn("name", scripts.clean_tamil(F.col("title")))
    none = F.array().cast("array<struct<code:string,title:string>>")
    return made.select(
        "doc", "lesson_no", N.lesson_id(F.col("unit")).alias("lesson_id"), F.col("unit").alias("lesson_number"), named(F.col("name"), F.col("unit")).alias("lesson_name"),
        F.get("p", F.lit(0))["num"].try_cast("int").alias("start_page"), F.element_at("p", -1)["num"].try_cast("int").alias("end_page"), F.when(F.col("lone"), none).otherwise(parts(F.col("text"))).alias("subsections"), "text",
    )
