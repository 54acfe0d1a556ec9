"""Benchmark decontamination with DataFrame functions only.

The normalised n-grams of all benchmark items form a hash table of fixed bound that every task holds
as one literal (an uncorrelated scalar subquery): buckets of (hash, words, items). Each document's
token windows are hashed and looked up in place; a hit counts only if the words are equal. So the texts are
read once, no row is exploded or shuffled, and a common passage costs no more than a rare one.
Beyond ``TABLE_BOUND`` n-grams the windows are joined with the n-grams by a shuffle on their hash instead.

Words are runs of digits, letters a-z (after lower-casing A-Z) and all characters from U+0080 on. A window is
``n`` consecutive item words; an item of fewer words (but not none) is one window.
Defined results: null or empty texts have no words and no hits; items without words are never found; a null
item_id counts as the item ''; repeated documents or items each count as they stand; extra columns are ignored, and may have any names where documents
are kept or cut (``find`` itself adds _words and _hits); very long texts are read whole; an empty benchmark hits nothing, an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import lowered, prepared, table

N = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: n-grams held in every task (about 100 bytes each).
TABLE_BOUND = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def windows_of(hashes: Column, width: Column | int) -> Column:
    """Hashes of all runs of ``width`` word hashes."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(hashes) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, width)))).otherwise(F.array().cast("array<bigint>"))


def ngrams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(h, width, gram, items): each distinct window of the benchmark with the sorted ids of the items that have it."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(n)))
    at = w.select("item", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.slice("w", i, F.col("width")))).alias("g"))
    h = F.xxhash64(F.transform("g", lambda x: F.xxhash64(x)))
    return at.select("width", h.alias("h"), F.array_join("g", " ").alias("gram"), "item").groupBy("h", "width", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _table(grams: DataFrame, slots: int) -> DataFrame:
    """One row: the hash table as an array of ``slots`` buckets."""
    spark = grams.sparkSession
    full = grams.groupBy(F.pmod("h", F.lit(slots)).alias("slot")).agg(F.collect_list(F.struct("h", "width", "gram", "items")).alias("bucket"))
    every = spark.range(slots).withColumnRenamed("id", "slot").join(full, "slot", "left")
    empty = F.array().cast(full.schema["bucket"].dataType)
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("bucket", empty).alias("bucket")))), lambda x: x["bucket"]).alias("t"))


def _finds(words: Column, buckets: Column, slots: int, widths: list[int]) -> Column:
    """Hits of a document: array of (start, width, items), in order for each width."""

    def of_width(hashes: Column, width: int) -> Column:
        def found(h: Column, i: Column) -> Column:
            cell = F.element_at(buckets, (F.pmod(h, F.lit(slots)) + 1).cast("int"))
            gram = F.array_join(F.slice(words, i + 1, F.lit(width)), " ")
            same = F.filter(F.filter(cell, lambda b: (b["h"] == h) & (b["width"] == width)), lambda b: b["gram"] == gram)
            return F.transform(same, lambda b: F.struct(i.alias("start"), F.lit(width).alias("width"), b["items"].alias("items")))

        return F.flatten(F.filter(F.transform(windows_of(hashes, width), found), lambda x: F.size(x) > 0))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.concat(*(of_width(h, w) for w in widths)))


def covered(hits: Column) -> Column:
    """How many words lie inside the hits (start, width)."""
    spans = F.sort_array(F.transform(hits, lambda x: F.struct(x["start"].alias("a"), (x["start"] + x["width"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))
        return F.struct((acc["n"] + new).cast("long").alias("n"), F.greatest(x["b"], acc["end"]).alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = TABLE_BOUND) -> DataFrame:
    """All columns of ``docs`` and _words (the document's words) and _hits: array of (start, width, items).

    One pass over the documents while the n-grams are within ``bound``.
    """
    grams = ngrams(benchmark, n)
    stats = grams.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("w")).first()
    kind = "array<struct<start:int,width:int,items:array<string>>>"
    if not stats["n"]:
        return docs.withColumn("_words", words_of(F.col("text"))).withColumn("_hits", F.array().cast(kind))
    widths = sorted(stats["w"])
    if stats["n"] > bound:
        return _joined(docs, grams, widths, kind)
    slots = 1
    while slots < 4 * stats["n"]:
        slots *= 2
    both = let(words_of(F.col("text")), lambda w: F.struct(w.alias("words"), _finds(w, F.col("_buckets"), slots, widths).cast(kind).alias("hits")))
    return docs.withColumn("_buckets", _table(grams, slots).scalar()).withColumn("_found", both).drop("_buckets").withColumn("_words", F.col("_found.words")).withColumn("_hits", F.col("_found.hits")).drop("_found")


def _joined(docs: DataFrame, grams: DataFrame, widths: list[int], kind: str) -> DataFrame:
    """The same for any number of n-grams: windows and n-grams meet by a shuffle on their hash.

    The numbered rows are checkpointed, so that a row that is made again after an executor is lost keeps its number.
    """
    prepared(docs.sparkSession)
    marked = docs.withColumn("_row", F.monotonically_increasing_id()).checkpoint().withColumn("_words", words_of(F.col("text")))
    hashes = F.transform("_words", lambda x: F.xxhash64(x))

    def placed(h: Column, width: int) -> Column:
        return F.transform(windows_of(h, width), lambda x, i: F.struct(x.alias("h"), i.alias("start"), F.lit(width).alias("width")))

    every = let(hashes, lambda h: F.concat(*(placed(h, w) for w in widths)))
    at = marked.select("_row", "_words", F.explode(every).alias("x")).select("_row", F.col("x.h"), F.col("x.start"), F.col("x.width"), F.array_join(F.slice("_words", F.col("x.start") + 1, F.col("x.width")), " ").alias("gram"))
    hits = at.join(grams, ["h", "width", "gram"]).groupBy("_row").agg(F.collect_list(F.struct("start", "width", "items")).alias("_hits"))
    out = marked.join(hits, "_row", "left").drop("_row")
    return out.withColumn("_hits", F.coalesce(F.col("_hits").cast(kind), F.array().cast(kind)))


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = TABLE_BOUND) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs.select("doc_id", "text"), benchmark, n, bound)
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("_hits", lambda x: x["items"]))))
    inner = found.select("doc_id", F.size("_words").cast("long").alias("n_words"), covered(F.col("_hits")).alias("n_hit"), items.alias("_items"))
    return inner.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = TABLE_BOUND) -> DataFrame:
    """The documents that have no window of the benchmark, with their columns as they are."""
    held = docs.select("text", F.struct("*").alias("row"))  # so that no column of docs can clash
    return find(held, benchmark, n, bound).filter(F.size("_hits") == 0).select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = TABLE_BOUND) -> DataFrame:
    """All documents; words inside hits are taken out of the text with the separators before them."""
    found = find(docs.select("text", F.struct("*").alias("row")), benchmark, n, bound)
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all("text", F.lit(gap + word), F.lit(0))
    tail = F.regexp_extract("text", f"({gap})$", 1)
    kept = let(F.col("_hits"), lambda hits: F.filter(pieces, lambda p, i: ~F.exists(hits, lambda x: (x["start"] <= i) & (i < x["start"] + x["width"]))))
    cut = F.when(F.size("_hits") == 0, F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return found.select(F.col("row").withField("text", cut).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT coalesce(item_id::varchar, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM bw WHERE len(w) > 0),
widths AS (SELECT DISTINCT k FROM grams),
places AS (
  SELECT doc_id, k, unnest(range(1, greatest(len(w) - k, -1) + 2)) AS p, unnest(list_transform(range(1, greatest(len(w) - k, -1) + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM dw, widths),
hits AS (SELECT doc_id, p, k, item FROM places JOIN grams USING (g, k)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
