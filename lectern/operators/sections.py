"""Line operators on texts: back-matter sections, bullets, page marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import rules as R
from lectern.functions import text as T
from lectern.operators import windows as W
from lectern.operators.aggregates import first_wins, joined_in_order


def lines(df: DataFrame, key: str, text: str, cut: str = "\n") -> DataFrame:
    """One row a line with its number."""
    return df.select(key, F.posexplode(F.split(text, cut)).alias("line_no", "line"))


def back_matter(rows: DataFrame, key: str, heading: str = R.BACK_MATTER_LINE, chapter: str = R.CHAPTER_LINE) -> DataFrame:
    """Spans [line_no, until) that begin at a back-matter heading and end at the next chapter or the text's end, merged."""
    marked = rows.select(key, "line_no", F.col("line").rlike(heading).alias("opens"), F.col("line").rlike(chapter).alias("closes"))
    last = marked.groupBy(key).agg((F.max("line_no") + 1).alias("n_lines"), F.max("opens").alias("any")).filter("any").drop("any")
    some = marked.filter("opens OR closes").join(last, key)
    reach = W.next_boundary(some, [key], "line_no", F.col("closes"), F.col("n_lines"))
    return W.merged_intervals(reach.filter("opens").select(key, "line_no", F.col("next_boundary").alias("until")), [key], "line_no", "until")


def stripped(df: DataFrame, key: str, text: str, heading: str = R.BACK_MATTER_LINE, chapter: str = R.CHAPTER_LINE) -> DataFrame:
    """key and the text without its back matter; texts of which nothing is left are ''."""
    rows = lines(df, key, text)
    spans = back_matter(rows, key, heading, chapter)
    left = W.outside(rows, spans, [key], "line_no", "line_no", "until")
    kept = joined_in_order(left, [key], "line_no", "line").withColumnRenamed("line", text)
    return df.select(key).join(kept, key, "left").select(key, F.coalesce(text, F.lit("")).alias(text))


def harvested(df: DataFrame, key: str, text: str, most: int = 150) -> DataFrame:
    """Question-like lines of the back matter, each key once, in order; the first ``most`` of a text."""
    rows = lines(df, key, text)
    spans = back_matter(rows, key).withColumnRenamed("line_no", "from_line")
    inside = rows.join(spans, key).filter("from_line <= line_no AND line_no < until").select(key, "line_no", T.strip(F.col("line")).alias("line"))
    own = first_wins(inside.filter(F.col("line").rlike(R.QUESTION_LINE)).withColumn("_k", T.normal_key(F.col("line"))), [key, "_k"], [F.col("line_no")]).drop("_k")
    from lectern.operators.relational import top_k

    return top_k(own, [key], [F.col("line_no")], most)


def bullets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Bullets of a plain reply: list items, quoted lines, long lines; titles are skipped. A line is read by two patterns at most."""
    rows = lines(df, key, text, "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85\u2028\u2029]").withColumn("line", T.strip(F.col("line")))
    rows = rows.filter("line <> ''").withColumn("listed", F.regexp_extract("line", R.LIST_ITEM, 1))
    line, trim = F.col("line"), lambda c, signs: F.btrim(c, F.lit(signs))
    item, loose = trim(F.col("listed"), '", '), trim(line, '", ')
    quoted = line.startswith('"') & line.endswith('"') & (F.length(line) > 15)
    first = F.substring(line, 1, 1)
    plain = ~first.isin("{", "}", "[") & ~line.endswith("]") & (F.length(line) > 25)
    out = F.when(line.rlike(R.TITLE_LINE), None).when(F.col("listed") != "", F.when(F.length(item) > 10, item))
    out = out.when(quoted, trim(line, '"')).when(plain, F.when((loose != "") & ~loose.endswith("{"), loose))
    # exploded rather than filtered: a filter would be pushed below and read every line twice
    return rows.select(key, "line_no", F.explode(F.array_compact(F.array(out))).alias("bullet"))


def page_lines(text: Column) -> Column:
    """The lines of a page without outer white space; blank ones are left out."""
    return F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: T.strip(x)), lambda x: x != "")


def page_cuts(text: str) -> tuple[Column, Column]:
    """The numbers of a text's page marks, and what follows each mark up to the next one."""
    nums = F.regexp_extract_all(text, F.lit(R.PAGE_MARK), F.lit(1))
    return nums, F.slice(F.split(text, R.PAGE_MARK), F.lit(2), F.size(nums))


def pages(df: DataFrame, key: str, text: str, following: bool = False) -> DataFrame:
    """Pages of a text with page marks: number, text, lines and header (the first of two lines that is no number, if short); with ``following`` also the next page's lines."""
    nums, parts = page_cuts(text)
    cut = df.select(key, nums.alias("_nums"), parts.alias("_parts"))
    after = [F.slice("_parts", F.lit(2), F.size("_parts")).alias("next")] if following else []
    rows = cut.select(key, F.posexplode(F.arrays_zip(F.col("_nums").alias("num"), F.col("_parts").alias("text"), *after)).alias("page_no", "p"))
    more = [F.coalesce(page_lines(F.col("p.next")), F.array().cast("array<string>")).alias("next_lines")] if following else []
    rows = rows.select(key, "page_no", F.col("p.num").try_cast("int").alias("num"), T.strip(F.col("p.text")).alias("text"), page_lines(F.col("p.text")).alias("lines"), *more)
    first = F.get(F.filter(F.slice("lines", F.lit(1), F.lit(2)), lambda x: ~x.rlike("^[0-9]+$")), F.lit(0))
    return rows.withColumn("header", F.coalesce(F.when(F.length(first) < 70, first), F.lit("")))
