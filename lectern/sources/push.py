"""Pushes to an external service as a Spark data source: written by tasks, committed by the driver, safe to run again.

A task posts its rows in order and notes each reply as a small file named by the row's key before it posts the next; a task that is run again, or a job that is started again
with the same folder, finds the notes of what was sent and does not send it twice. Only a row whose task was lost between the reply and the note is sent again, which no
client can rule out. The results of a task are a file of its own that its commit message names; the driver's commit writes the list of them, and only listed files are results.

Folders are addresses that pyarrow can open on every executor (a shared mount, or a store such as s3, gs or hdfs).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

RESULT = "dy_ques_id string, http_status int, detail string, place long, sent boolean"
_TYPES = pa.schema([("dy_ques_id", pa.string()), ("http_status", pa.int32()), ("detail", pa.string()), ("place", pa.int64()), ("sent", pa.bool_())])


@dataclass
class Pushed(WriterCommitMessage):
    file: str
    rows: int


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def note_name(key: str | None, payload: dict) -> str:
    """One note for a key and what is sent of it."""
    return hashlib.sha256(json.dumps([key, payload], sort_keys=True, ensure_ascii=True).encode()).hexdigest()


class PushWriter(DataSourceWriter):
    def __init__(self, folder: str, post: Callable[[dict], tuple[int, str]]):
        self.folder, self.post = folder, post

    def sent(self, store: pafs.FileSystem, path: str, key: str | None, payload: dict) -> tuple[int, str]:
        """The reply to a row: that of an earlier attempt, or of a post now, which is noted. A failed connection is no reply and is tried again by the next run."""
        note = f"{path}/notes/{note_name(key, payload)}.json"
        if store.get_file_info(note).type == pafs.FileType.File:
            with store.open_input_stream(note) as f:
                return tuple(json.loads(f.read()))
        try:
            reply = self.post(payload)
        except OSError as e:
            return 0, str(e)
        with store.open_output_stream(note) as f:
            f.write(json.dumps(list(reply)).encode())
        return reply

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, path = opened(self.folder)
        store.create_dir(f"{path}/notes", recursive=True)
        store.create_dir(f"{path}/results", recursive=True)
        context = TaskContext.get()
        name, n = f"results/{context.partitionId():06d}-{context.taskAttemptId()}.parquet", 0
        with pq.ParquetWriter(f"{path}/{name}", _TYPES, filesystem=store) as out:
            for row in iterator:
                if row["missing"]:
                    made = (row["key"], 0, f"missing: {row['missing']}", row["place"], False)
                else:
                    payload = json.loads(row["payload"])
                    status, detail = self.sent(store, path, row["key"], payload)
                    made = (row["key"], status, detail, row["place"], True)
                out.write_batch(pa.RecordBatch.from_pylist([dict(zip(_TYPES.names, made, strict=True))], schema=_TYPES))
                n += 1
        return Pushed(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = opened(self.folder)
        with store.open_output_stream(f"{path}/committed.json") as out:
            out.write(json.dumps([m.file for m in messages if m is not None and m.rows]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Notes stay, so that the next run goes on from them; results that are not listed are none."""


def sink(post: Callable[[dict], tuple[int, str]], name: str = "lectern_push") -> type[DataSource]:
    """A data source whose writer posts rows (key, place, missing, payload as JSON text) with ``post``; option ``folder`` is where it keeps its notes."""

    class PushSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "key string, place long, missing string, payload string"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return PushWriter(self.options["folder"], post)

    return PushSource


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The results of the last committed push of a folder."""
    store, path = opened(folder)
    with store.open_input_stream(f"{path}/committed.json") as f:
        files = json.loads(f.read())
    return spark.read.schema(RESULT).parquet(*(f"{folder}/{x}" for x in files)) if files else spark.createDataFrame([], RESULT)


def push(rows: DataFrame, post: Callable[[dict], tuple[int, str]], folder: str, at_once: int = 1) -> DataFrame:
    """Pushes rows (key, place, missing, payload) once, in the order of place within each of ``at_once`` tasks, and returns their results as a table."""
    spark = rows.sparkSession
    spark.dataSource.register(sink(post))
    spread = rows.select("key", "place", "missing", "payload").repartition(at_once) if at_once > 1 else rows.select("key", "place", "missing", "payload").coalesce(1)
    spread.sortWithinPartitions("place").write.format("lectern_push").mode("append").option("folder", folder).save()
    return results(spark, folder)
