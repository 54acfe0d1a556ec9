"""Document ingestion: file-type dispatch, text and page rows, a content-addressed cache, uploads.

Readers are callables from bytes to pages, run per file by Arrow batches, whose bytes the session bounds (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB if not set). Text files need none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X
from lectern.sources.schemas import UPLOAD_KEYS

KINDS = (".pdf", ".docx", ".pptx", ".txt", ".jpg", ".jpeg", ".png")
#: bytes and recognition language to the texts of pages
Reader = Callable[[bytes, str], list[str]]


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, kind (lower-cased extension), supported, key (content hash) and content of each file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return raw.select("path", kind.alias("kind"), kind.isin(*KINDS).alias("supported"), F.sha2("content", 256).alias("key"), "content")


def plain_text(found: DataFrame) -> DataFrame:
    """Text files as one page; bytes that are not UTF-8 fail as they would on reading."""
    return found.filter("kind = '.txt'").select("path", "key", F.lit(1).alias("num"), F.decode("content", "UTF-8").alias("text"))


def read_pages(found: DataFrame, readers: dict[str, Reader], language: str = "eng+tam", recognise: Reader | None = None) -> DataFrame:
    """One row a page: path, key, num, text. A page whose text is unusable is replaced by recognised text where that gives any."""
    schema = "path string, key string, num int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, key, content in zip(batch["path"], batch["kind"], batch["key"], batch["content"], strict=True):
                for n, page in enumerate(readers[kind](content, language), 1):
                    rows.append((path, key, n, page))
            yield pd.DataFrame(rows, columns=["path", "key", "num", "text"])

    pages = found.filter(F.col("kind").isin(*readers)).select("path", "kind", "key", "content").mapInPandas(run, schema)
    if recognise is None:
        return pages

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, t) for k, c in zip(batch["key"], batch["content"], strict=True) for n, t in enumerate(recognise(c, language), 1)]
            yield pd.DataFrame(rows, columns=["_key", "_num", "_new"])

    bad = pages.filter(X.unusable(F.col("text"))).select("key").distinct()
    new = found.join(bad, "key", "left_semi").dropDuplicates(["key"]).select("key", "content").mapInPandas(again, "_key string, _num int, _new string")
    both = pages.join(new, (F.col("key") == F.col("_key")) & (F.col("num") == F.col("_num")), "left")
    better = X.unusable(F.col("text")) & (X.strip(F.coalesce("_new", F.lit(""))) != "")
    return both.select("path", "key", "num", F.when(better, F.col("_new")).otherwise(F.col("text")).alias("text"))


def unread(found: DataFrame, cache: DataFrame, language: str = "eng+tam") -> DataFrame:
    """Files whose content is not in the cache (key, language, text) for that language."""
    return found.join(cache.filter(F.col("language") == language).select("key"), "key", "left_anti")


def uploaded(spark: SparkSession, text: str) -> DataFrame:
    """The thirteen fields of an uploaded array of questions, or of an object with ``questions``; missing ones are null."""
    item = T.StructType([T.StructField(k, T.StringType()) for k in UPLOAD_KEYS])
    one = spark.createDataFrame([(text,)], "body string")
    bare, wrapped = F.from_json("body", T.ArrayType(item)), F.from_json("body", T.StructType([T.StructField("questions", T.ArrayType(item))]))["questions"]
    rows = one.select(F.when(F.ltrim("body").startswith("["), bare).otherwise(wrapped).alias("rows"))
    checked = rows.select(F.when(F.size("rows") > 0, F.col("rows")).otherwise(F.raise_error("a non-empty list of questions is needed")).alias("rows"))
    return checked.select(F.inline("rows"))


def marked_text(pages: DataFrame) -> DataFrame:
    """path, key and the text of each paged file with a mark before every page."""
    own = F.sort_array(F.collect_list(F.struct("num", "text")))
    text = F.array_join(F.transform(own, lambda x: F.concat(F.lit("\n=== PAGE "), x["num"].cast("string"), F.lit(" ===\n"), x["text"], F.lit("\n"))), "")
    return pages.groupBy("path", "key").agg(text.alias("text"))


def legacy_text(pages: DataFrame, most: int = 25_000) -> DataFrame:
    """path, key and the first ``most`` characters of each file without page marks, as the command line tool reads them."""
    own = F.sort_array(F.collect_list(F.struct("num", "text")))
    return pages.groupBy("path", "key").agg(F.substring(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), 1, most).alias("text"))


def read_through(found: DataFrame, cache: DataFrame, read: Callable[[DataFrame], DataFrame], language: str = "eng+tam") -> tuple[DataFrame, DataFrame]:
    """Texts (path, key, text) of files by their content, and the rows to add to the cache (key, language, text).

    ``read`` turns files into (key, text) and sees each content that is not in the cache once; the caller writes the new rows and may read again.
    """
    new = read(unread(found, cache, language).dropDuplicates(["key"])).groupBy("key").agg(F.min("text").alias("text"))
    known = cache.filter(F.col("language") == language).groupBy("key").agg(F.min("text").alias("text"))
    return found.select("path", "key").join(known.unionByName(new), "key").select("path", "key", "text"), new.select("key", F.lit(language).alias("language"), "text")
