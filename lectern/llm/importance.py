"""Target-distribution importance resampling over hashed n-grams.

A task reads its documents into word tries of depth ORDER: a node stands for a run of words, with the number of times the run occurs and the CRC-32 state after its
bytes, so a child's state goes on from its parent's and no run is ever joined to a string. A trie is held as numbers (one sorted table of parent and word a
level) and closed after WORDS words: its counts are added to the task's totals of BUCKETS buckets, and the next one begins. The totals of all tasks are summed by bucket.
Scoring walks the same tries: each node carries the gain of its bucket, and a document's weight is the sum of the gains along its paths.

Words are runs of digits, letters a-z (after lower-casing A-Z) and all characters from U+0080 on; features are runs of 1 to ORDER consecutive words joined by one space,
repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS.
The draw adds Gumbel noise from a hash of the id to the weight and takes the highest sums, which samples without replacement in proportion to exp(weight / 1000). Ranks come
from one range-partitioned sort of ids and numbers; no task sees all rows.

Defined results: null and empty texts have no features and weight 0; a null doc_id has the noise of the empty id and loses ties; repeated rows are drawn on their own; an empty
table gives no rows, an empty target or corpus gains over its smoothing alone; extra columns are ignored; long texts are cut into runs of words that overlap by ORDER - 1.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import arrow_schema, prepared, sliced, table
from lectern.operators.dml import numbered

ORDER, BUCKETS, SEED = 3, 10_000, 42
#: A document is in the draw from so many words on; the share drawn is a whole percentage.
LEAST_WORDS, PERCENT = 20, 5
#: Words of a trie before it is closed, and of a document's run at a time: bound of a task's memory.
WORDS = 400_000
_UPPER = bytes(range(65, 91))
#: Separators become spaces and A-Z lower case; bytes from 128 on belong to words.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if b in _UPPER else 32 for b in range(256))


@functools.cache
def _moved(length: int) -> np.ndarray:
    """Table (4, 256): what ``length`` zero bytes make of each byte of a CRC-32 state; XOR of the four gives the state moved on."""
    bits = [zlib.crc32(bytes(length), 1 << b) ^ zlib.crc32(bytes(length), 0) for b in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for value in range(256):
            for b in range(8):
                if value >> b & 1:
                    out[byte, value] ^= bits[8 * byte + b]
    return out


class Words(dict):
    """Words of a trie by number, in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


class Trie:
    """The trie of some documents' words.

    ``count`` and ``state`` hold a row for each node of a level, ``path`` the node of each level that begins at each word (-1 beyond the document's end).
    """

    def __init__(self, documents: list[list[bytes]], starts: list[int] | None = None, order: int = ORDER):
        """``starts``: how many words of each document begin a path (all); the words after them only continue paths."""
        own = Words()
        n = sum(map(len, documents))
        word = np.fromiter((own[w] for d in documents for w in d), np.int64, n)
        size = np.array([len(d) for d in documents], np.int64)
        begins = size if starts is None else np.array(starts, np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(n)  # words from here to the document's end
        self.document = np.repeat(np.arange(len(documents)), size)
        first = np.cumsum(size) - size
        self.begins = np.arange(n) - np.repeat(first, size) < np.repeat(begins, size)
        lengths = np.fromiter((len(w) + 1 for w in own), np.int64, len(own))
        alone = np.fromiter((zlib.crc32(w) for w in own), np.uint32, len(own))
        spaced = np.fromiter((zlib.crc32(b" " + w) for w in own), np.uint32, len(own))
        node = np.where(self.begins, word, -1)
        self.path, self.state = [node], [alone]
        self.count = [np.bincount(node[node >= 0], minlength=len(own))]
        for depth in range(1, order):
            at = np.flatnonzero((node >= 0) & (left > depth))
            key = node[at] * max(1, len(own)) + word[at + depth]
            keys, where, count = np.unique(key, return_inverse=True, return_counts=True)
            parent, last = np.divmod(keys, max(1, len(own)))
            node = np.full(n, -1, np.int64)
            node[at] = where
            self.path.append(node)
            self.state.append(self._after(self.state[-1][parent], lengths[last]) ^ spaced[last])
            self.count.append(count)

    @staticmethod
    def _after(state: np.ndarray, length: np.ndarray) -> np.ndarray:
        """States moved on by zero bytes, the lengths one after another."""
        which, index = np.unique(length, return_inverse=True)
        tables = np.stack([_moved(int(x)) for x in which]) if len(which) else np.zeros((0, 4, 256), np.uint32)
        out = np.zeros(len(state), np.uint32)
        for byte in range(4):
            out ^= tables[index, byte, (state >> np.uint32(8 * byte)) & np.uint32(255)]
        return out

    def buckets(self) -> np.ndarray:
        """Features in each bucket."""
        out = np.zeros(BUCKETS, np.int64)
        for state, count in zip(self.state, self.count, strict=True):
            np.add.at(out, state % BUCKETS, count)
        return out

    def walked(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, sum of gains) of each path's document, document by document."""
        n = int(self.document[-1]) + 1 if len(self.document) else 0
        features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for path, state in zip(self.path, self.state, strict=True):
            at = np.flatnonzero(path >= 0)
            own = gains[state % BUCKETS]
            features += np.bincount(self.document[at], minlength=n)
            np.add.at(weight, self.document[at], own[path[at]])
        return features, weight


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def tries(texts: Iterator[str | None], limit: int = WORDS, order: int = ORDER) -> Iterator[tuple[Trie, list[int], list[int]]]:
    """Tries of whole texts, each of about ``limit`` words: (trie, index of the text of each of its documents, words that begin there)."""
    held: list[list[bytes]] = []
    starts: list[int] = []
    of: list[int] = []
    n = 0
    for index, text in enumerate(texts):
        words = words_of(text)
        for at in range(0, len(words), limit) or (0,):
            held.append(words[at : at + limit + order - 1])
            starts.append(min(limit, len(words) - at))
            of.append(index)
            n += len(held[-1])
            if n >= limit:
                yield Trie(held, starts, order), of, starts
                held, starts, of, n = [], [], [], 0
    if held:
        yield Trie(held, starts, order), of, starts


def bucket_totals(docs: DataFrame) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any; a task sends its totals once."""
    prepared(docs.sparkSession)
    types = arrow_schema("bucket int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for trie, _, _ in tries(t for part in sliced(batches) for t in part.column("text").to_pylist()):
            total += trie.buckets()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, types[0].type), pa.array(total[some], types[1].type)], schema=types)

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain): 1000 times the log of the smoothed target share over the smoothed corpus share, rounded down; BUCKETS rows."""
    spark = corpus.sparkSession
    own = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    each = own.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = lambda c: F.sum(c).over(Window.partitionBy(F.lit(0)))  # noqa: E731  # over BUCKETS rows
    ratio = (F.col("t") + 1) * (total("s") + BUCKETS) / ((F.col("s") + 1) * (total("t") + BUCKETS))
    return each.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gain: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    spark = prepared(docs.sparkSession)
    values = np.zeros(BUCKETS, np.int64)
    for r in gain.collect():  # BUCKETS rows
        values[r["bucket"]] = r["gain"]
    sent = spark.sparkContext.broadcast(values)
    schema = "doc_id long, n_words long, n_features long, weight long"
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            out = np.zeros((3, part.num_rows), np.int64)
            for trie, of, starts in tries(iter(part.column("text").to_pylist())):
                features, weight = trie.walked(sent.value)
                np.add.at(out[0], of, starts)
                np.add.at(out[1], of[: len(features)], features)
                np.add.at(out[2], of[: len(weight)], weight)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in out)], schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null if not drawn) of every row of ``docs``, drawn to be like the texts of ``target``.

    The weights are checkpointed: counting, sorting and numbering read them again.
    """
    rows = weighed(docs, gains(bucket_totals(docs), bucket_totals(target)))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"))).withColumn("able", F.col("n_words") >= least_words).checkpoint()
    draw = rows.agg(F.floor(F.lit(percent) * F.count_if("able") / 100)).scalar()
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = numbered(rows, "rank", order, F.lit(0).cast("long"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("rank") <= draw), F.col("rank")).cast("long").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of the UTF-8 bytes of {0} by its table (DuckDB has no such function); the table is a list ``crc_table.t``.
CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), (2 * i - 1)::int, 2))::bigint)),
  lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]))"""
CRC_TABLE = """
WITH RECURSIVE crc_steps AS (
  SELECT i AS n, i::bigint AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE k = 8)"""

ORACLE = (
    CRC_TABLE
    + r""",
words AS (
  SELECT 'd' AS side, row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
  SELECT side, row_id, unnest(list_transform(range(1, greatest(len(w) - k, 0) + 1), lambda i: array_to_string(w[i:i + k], ' '))) AS f
  FROM words, (VALUES (0), (1), (2)) AS sizes(k)),
counted AS (SELECT side, row_id, f, count(*) AS n FROM runs GROUP BY ALL),
crcs AS (SELECT f, xor(__CRC__, 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table),
totals AS (SELECT bucket, sum(CASE side WHEN 'd' THEN n ELSE 0 END)::double AS s, sum(CASE side WHEN 'b' THEN n ELSE 0 END)::double AS t FROM counted JOIN crcs USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::bigint AS gain FROM totals),
weights AS (SELECT row_id, sum(n)::bigint AS n_features, sum(n * gain)::bigint AS weight FROM counted JOIN crcs USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row_id),
scores AS (
  SELECT row_id, doc_id, coalesce(n_features, 0)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight, len(w) >= 20 AS able,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5) / 4294967296::double))))::bigint AS score
  FROM words LEFT JOIN weights USING (row_id) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id NULLS LAST) AS nth, count(*) FILTER (able) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND nth <= floor(5 * n / 100) THEN nth END AS rank FROM placed
"""
).replace("__CRC__", CRC.format("f"))
