"""What the corpus operators share: table scans, label folds, Arrow mapping and shared checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows turned into Python objects at a time; bounds a worker's memory on long texts.
SLICE = 128
#: Rows of an Arrow batch where the session has Spark's own 10,000, and of a batch of the Parquet reader where it has 4,096: a batch is whole in memory (of both sides) before it is sliced.
BATCH_ROWS = 512
#: Bytes of a Parquet row group where the session names none: a task that writes holds one in the heap, and Parquet's own 128 MB for each of eight threads fill a heap of 1 GB.
GROUP_BYTES = 16 << 20
_FOLDERS: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library, bounds Arrow batches and Parquet row groups, and sets a checkpoint folder where none is named.

    Only a session whose executors are this very process may use a folder of this machine; any other has to name ``spark.checkpoint.dir``.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)
    if not spark.conf.get("parquet.block.size", "") and not spark._jsc.hadoopConfiguration().get("parquet.block.size"):
        spark.conf.set("parquet.block.size", GROUP_BYTES)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lectern-checkpoints"))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: cuts the lineage, can be read by every executor, goes when the program ends."""
    spark = prepared(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    if not _FOLDERS:
        atexit.register(swept)
    _FOLDERS.append((spark, folder))
    return spark.read.schema(df.schema).parquet(folder)


def compact(df: DataFrame, rows: int, each: int = 20_000, heavy: bool = False) -> DataFrame:
    """A checkpoint in as many files as ``rows`` need at ``each`` a file: small tables don't become many files.

    Rows that cost little are made in as many tasks as there are files; where they are ``heavy`` to make, all partitions work and the few rows that come out are shuffled into the files.
    """
    files = max(1, -(-rows // each))
    return (df.repartition(files) if heavy else df.coalesce(files)).checkpoint()


def swept() -> None:
    """Removes the tables that ``written`` has made, as far as their sessions still run."""
    while _FOLDERS:
        spark, folder = _FOLDERS.pop()
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_LAST: list = [None, None]


def sole(owner: str, clear: Callable[[], None]) -> None:
    """Only one operator keeps memos in a worker: those of the one before are cleared when another one begins."""
    if _LAST[0] not in (None, owner):
        _LAST[1]()
    _LAST[:] = owner, clear


def given_back() -> None:
    """Hands the free memory of a worker back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lowered(text: Column) -> Column:
    """A-Z in lower case and every other character as it is; null gives ''."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(key: Column, n: int) -> Column:
    """crc32 of a key as text modulo n; 'no fold' (-1) for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(n), F.lit(-1).cast("long"))


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of a task; gives the worker's free memory back at the end of the task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    given_back()


def map_slices(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = SLICE) -> DataFrame:
    """Maps slices of Arrow batches to columns by name. ``work()`` is called once a task and returns the mapper."""
    prepared(df.sparkSession)
    types = arrow_schema(schema)

    def run(batches):
        each = work()
        for part in sliced(batches, rows):
            made = each(part)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in types], schema=types)

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], per_class: int, chars: int | None = None) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) rows of each class for fitting on the driver; whole texts, or up to ``chars`` characters of each.

    Labels of the held-out fold (``held``: modulus, remainder) are never read. The rows are those of the least
    hash of doc_id, the same in every run; a label that is null, and a document without text, is left out.
    """
    modulus, rest = held
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.filter(F.col("label").isin(0, 1) & (fold(F.col("doc_id"), modulus) != rest))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    some = None
    for value in (0, 1):
        part = own.filter(F.col("label") == value).orderBy("order", "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("text") if chars is None else F.substring("text", 1, chars)).alias("text")).filter("text IS NOT NULL")
    # At most 2 * per_class ids are broadcast.
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return [(r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def scored(docs: DataFrame, held: tuple[int, int], work: Callable, rows: int = SLICE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; ``work()`` returns a mapper of texts to scores."""
    modulus, rest = held

    def make():
        scores = work()

        def each(part: pa.RecordBatch) -> dict:
            return {"doc_id": part.column("doc_id"), "score": scores(part.column("text").to_pylist())}

        return each

    out = map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double", rows)
    return out.select("doc_id", (fold(F.col("doc_id"), modulus) == rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rejected(docs: DataFrame, work: Callable, least: float, keep_high: bool, rows: int = SLICE) -> DataFrame:
    """The rows whose text scores at least ``least`` (keep_high) or below it, with all columns as they are."""
    prepared(docs.sparkSession)

    def run(batches):
        scores = work()
        for part in sliced(batches, rows):
            high = [s >= least for s in scores(part.column("text").to_pylist())]
            yield part.filter(pa.array([h == keep_high for h in high], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
