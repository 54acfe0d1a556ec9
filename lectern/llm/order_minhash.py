"""Document fingerprints by order MinHash.

The k-mers of a text (runs of ``k`` code points) are numbered by occurrence, so a repeated k-mer counts each time. For each
coordinate a hash orders all (k-mer, number) pairs; the two smallest are taken in the order in which they stand in the text, and the
hash of that tuple is the coordinate. Equal coordinates therefore need the same k-mers in the same order, which follows the
edit distance more closely than sets do. The likeness of two fingerprints is the share of equal coordinates.

For ``edited`` texts the next document in descending doc_id is needed. Documents are dealt by ranges of doc_id with
boundaries from a range shuffle of the ids alone; the first document of each range is also dealt to the range before it, and each range is
sorted and streamed, so the texts are shuffled once and a task holds two of them at a time.

Defined results: null text is ''; all texts without code points have one and the same fingerprint; texts shorter than ``k`` are one k-mer; of equal
doc_ids the smaller text comes first; a null doc_id comes last; a single document is its own next one; repeated rows each get a row;
extra columns are ignored; very long texts are read whole, in blocks of k-mers; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import arrow_schema, compact, prepared, sliced, table
from lectern.llm.neardup import mixed

KMER, COORDS = 8, 32
#: Documents in a range of doc_id, on average, and the most ranges (8 bytes each in every task): ranges are larger only beyond 4 billion documents.
RANGE_ROWS, MOST_RANGES = 4000, 1_000_000


class Sketcher:
    """Fingerprints of texts, two pairs for each coordinate."""

    def __init__(self, k: int = KMER, coords: int = COORDS):
        draw = np.random.Generator(np.random.PCG64(20190801))
        self.k, self.coords = k, coords
        self.odd = draw.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1)
        self.number = np.uint64(int(draw.integers(0, 2**64, dtype=np.uint64)) | 1)
        self.mult = (draw.integers(0, 2**32, coords, dtype=np.uint32) | np.uint32(1))[:, None]
        self.salt = draw.integers(0, 2**32, coords, dtype=np.uint32)[:, None]

    def kmers(self, chars: np.ndarray) -> np.ndarray:
        n = len(chars) - self.k + 1
        x = chars.astype(np.uint64)
        if n < 1:
            return mixed((x * self.odd[: len(x)]).sum(keepdims=True, dtype=np.uint64))
        h = x[:n] * self.odd[0]
        for j in range(1, self.k):
            h += x[j : n + j] * self.odd[j]
        return mixed(h)

    def numbered(self, h: np.ndarray) -> np.ndarray:
        """32-bit hashes of (k-mer, occurrence number), in text order."""
        n = len(h)
        low = np.uint64(max(1, (n - 1).bit_length()))
        key = np.sort((h >> low << low) | np.arange(n, dtype=np.uint64))
        at = (key & np.uint64((1 << int(low)) - 1)).astype(np.int64)
        body = key >> low
        run = np.arange(n)
        begins = np.r_[True, body[1:] != body[:-1]]
        nth = np.empty(n, np.uint64)
        nth[at] = (run - np.maximum.accumulate(np.where(begins, run, 0))).astype(np.uint64)
        return (mixed(h + nth * self.number) >> np.uint64(32)).astype(np.uint32)

    def least_two(self, x: np.ndarray) -> np.ndarray:
        """For each coordinate the two smallest hashes, each with its place in the low bits (the earlier on ties); in blocks of a fixed size."""
        best = np.full((self.coords, 2), 2**63 - 1, np.int64)
        for at in range(0, len(x), 8192):
            v = ((x[at : at + 8192] ^ self.salt) * self.mult).astype(np.uint32)
            first = v.argmin(1)
            rows = np.arange(self.coords)
            a = v[rows, first].astype(np.int64) << 31 | (at + first)
            if v.shape[1] > 1:
                v[rows, first] = 0xFFFFFFFF
                second = v.argmin(1)
                b = v[rows, second].astype(np.int64) << 31 | (at + second)
            else:
                b = np.full(self.coords, 2**63 - 1, np.int64)
            best = np.sort(np.c_[best, a, b], axis=1)[:, :2]
        return best

    def sketch(self, text: str) -> np.ndarray:
        """One 32-bit number for each coordinate."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(chars):
            return np.zeros(self.coords, np.uint32)
        x = self.numbered(self.kmers(chars))
        best = self.least_two(x)
        at = np.sort(best & (2**31 - 1), axis=1)
        at = np.where(best[:, 1:] == 2**63 - 1, at[:, :1], at)  # a single k-mer stands for both
        pair = x[at[:, 0]].astype(np.uint64) << np.uint64(32) | x[at[:, 1]].astype(np.uint64)
        return (mixed(pair) >> np.uint64(32)).astype(np.uint32)


def name_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, k: int = KMER, coords: int = COORDS) -> DataFrame:
    """doc_id, n_chars and fingerprint of each document; one pass."""
    prepared(docs.sparkSession)
    types = arrow_schema("doc_id long, n_chars long, fingerprint string")

    def run(batches):
        own = Sketcher(k, coords)
        for part in sliced(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(name_of(own.sketch(t)) for t in texts)], schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n] if n else text


def _ranges(docs: DataFrame) -> DataFrame:
    """Adds part (range of descending doc_id) and extra (a copy of the first document of the range after; the first range follows the last)."""
    ranges = max(1, min(MOST_RANGES, docs.count() // RANGE_ROWS))
    dealt = docs.filter("doc_id IS NOT NULL").select("doc_id").repartitionByRange(ranges, F.desc("doc_id"))
    tops = compact(dealt.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("top")).select("top"), ranges)
    n = tops.count()
    if not n:
        return docs.withColumn("part", F.lit(0)).withColumn("extra", F.lit(False)).unionByName(docs.limit(1).withColumn("part", F.lit(0)).withColumn("extra", F.lit(True)))
    # One row for each range, in descending order, as one value that every task holds.
    named = docs.withColumn("tops", tops.agg(F.sort_array(F.collect_list("top"), asc=False)).scalar())
    named = named.withColumn("part", F.when(F.col("doc_id").isNull(), n - 1).otherwise(F.greatest(_reached(F.col("tops"), F.col("doc_id"), n) - 1, F.lit(0))))
    leads = F.coalesce(F.col("doc_id") == F.element_at("tops", F.col("part") + 1), F.lit(False))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    copy = F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("extra"))
    places = F.when(leads, F.array(own, copy)).otherwise(F.array(own))
    return named.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", F.col("p.part").alias("part"), F.col("p.extra").alias("extra"))


def _reached(tops: Column, key: Column, n: int) -> Column:
    """How many of the ``n`` descending tops are not under a key, by binary search."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_, reached = acc["lo"] < acc["hi"], F.element_at(tops, F.least(mid, F.lit(n - 1)) + 1) >= key
        return F.struct(F.when(open_ & reached, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~reached, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.array(*(F.lit(i) for i in range(n.bit_length() + 1)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda acc: acc["lo"])


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, k: int = KMER, coords: int = COORDS) -> DataFrame:
    """Fingerprints of each document, of its edited text and their likenesses, and the likeness to the next document."""
    prepared(docs.sparkSession)
    types = arrow_schema(RESULT)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = _ranges(own)
    dealt = dealt.repartition("part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), "text").select("doc_id", "text", "part", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Sketcher(k, coords)
        last = None  # (doc_id, text, sketch, part) that waits for its next document
        done = None  # the range that has met its extra document
        for part in sliced(batches):
            out: list[tuple] = []
            for doc_id, text, place, extra in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if extra and done == place:
                    continue
                sketch = tool.sketch(text)
                if last is not None and last[3] == place:
                    new = edited(last[1], text)
                    other = last[2] if new == last[1] else tool.sketch(new)
                    out.append((last[0], len(last[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), name_of(last[2]), name_of(other), likeness(last[2], other), likeness(last[2], sketch)))
                last = (doc_id, text, sketch, place)
                if extra:
                    done, last = place, None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return dealt.mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))
