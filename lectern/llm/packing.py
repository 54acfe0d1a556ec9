"""Token-id output: best-fit-decreasing packing of documents into rows of a fixed length.

Each task encodes its documents (byte-level BPE unless a word-end BPE file is given), puts the end token after each, splits what is longer than a row into whole rows and a rest
(nothing is cut off), and packs groups of a bounded number of tokens: the segments of a group in order of decreasing length, each
into the row with the least room that still takes it. That row is found in O(log length) by a segment tree over capacities. A row is
written as little-endian ids of a fixed width (a row of the id matrix, padded), with cumulative segment lengths and
the offsets at which positions start again from 0.

No shuffle: packing is local to a task, groups cost less than one row of padding each on average.
Defined results: null and empty texts are one end token; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import Tokenizer, public_path, read_vocabulary
from lectern.llm.common import arrow_schema, prepared, sliced, table

LENGTH, GROUP_TOKENS = 2048, 2_000_000
END_TOKEN, RANKS = "<|endoftext|>", "byte_bpe_50k.tiktoken"
SCHEMA = "pack_id long, n_segments int, n_tokens int, doc_ids array<bigint>, parts array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"


class Rooms:
    """Open rows by the room they have left, with a segment tree over rooms 0..length that counts them."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def put(self, row: int, room: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, taken out; None if there is none."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, until a right neighbour has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of segment numbers, by best fit in order of decreasing length."""
    rooms, rows = Rooms(length), []
    for n in sorted(range(len(lengths)), key=lambda n: (-lengths[n], n)):
        found = rooms.take(lengths[n])
        if found is None:
            rows.append([n])
            left = length - lengths[n]
            row = len(rows) - 1
        else:
            row, room = found
            rows[row].append(n)
            left = room - lengths[n]
        if left:
            rooms.put(row, left)
    return rows


class ByteIds:
    """Texts to bytes of ids by a byte-level BPE rank file: lossless, so the texts can be had back from the rows."""

    def __init__(self, blob: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        self.end = max(ranks.values()) + 1  # the first free id
        self.type = np.dtype("<u2" if self.end < 65536 else "<u4")
        self.tok = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str | None) -> bytes:
        return np.array(self.tok.encode_ordinary(text or ""), self.type).tobytes()

    def text(self, ids: np.ndarray) -> str:
        return self.tok.decode_bytes([int(i) for i in ids if i < self.end]).decode()


class WordIds:
    """Texts to bytes of ids by a word-end BPE file, on the transducer."""

    def __init__(self, blob: bytes, pattern: str):
        del pattern  # the file has its own
        self.tok = Tokenizer(blob)
        self.end = self.tok.special.get(END_TOKEN, max(self.tok.names) + 1)
        self.type = np.dtype("<u2" if max(self.end, *self.tok.names) < 65536 else "<u4")

    def of(self, text: str | None) -> bytes:
        return np.array(self.tok.encode(text), self.type).tobytes()


_IDS: dict[str, ByteIds | WordIds] = {}


def ids_of(blob: bytes, pattern: str) -> ByteIds | WordIds:
    """One encoder for each file and worker process; JSON files are word-end BPE, others rank files."""
    key = hashlib.sha256(blob).hexdigest() + pattern
    if key not in _IDS:
        _IDS.clear()
        _IDS[key] = (WordIds if blob.lstrip()[:1] == b"{" else ByteIds)(blob, pattern)
    return _IDS[key]


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, pattern: str | None = None, pad: int = 0, group: int = GROUP_TOKENS) -> DataFrame:
    """One row a packed sequence: pack_id, n_segments, n_tokens (without padding), doc_ids and parts of the segments,
    cu_seqlens (from 0), position_resets (where each segment begins) and ids."""
    spark = prepared(docs.sparkSession)
    blob = spark.sparkContext.broadcast(read_vocabulary(path or public_path(RANKS)))  # under 2 MB, fixed
    split = pattern or public_pattern()
    types = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(blob.value, split)
        width, stop = ids.type.itemsize, np.array([ids.end], ids.type).tobytes()
        padding = np.array([pad], ids.type).tobytes()
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        held: list[tuple[int | None, int, bytes]] = []
        total = 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for row in best_fit([len(b) // width for _, _, b in held], length):
                sizes = [len(held[n][2]) // width for n in row]
                ends = np.cumsum([0, *sizes]).tolist()
                body = b"".join(held[n][2] for n in row)
                out.append((number, len(row), ends[-1], [held[n][0] for n in row], [held[n][1] for n in row], ends, ends[:-1], body + padding * (length - ends[-1])))
                number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

        for part in sliced(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                body = ids.of(text) + stop
                for n, at in enumerate(range(0, len(body), length * width)):
                    piece = body[at : at + length * width]
                    held.append((doc_id, n, piece))
                    total += len(piece) // width
                    if total >= group:
                        yield packed()
                        total = 0
        if held:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_packed(packs: DataFrame, path: str) -> None:
    """Writes the id matrix rows with their segment tables as Parquet in any store Spark can write."""
    packs.write.mode("errorifexists").parquet(path)


def matrix_of(rows: list, length: int = LENGTH, wide: bool = False) -> np.ndarray:
    """The id matrix of some collected rows."""
    return np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u4" if wide else "<u2").reshape(len(rows), length)


def positions_of(row, length: int = LENGTH) -> np.ndarray:
    """Position ids of a row: they start from 0 at every reset, padding stays 0."""
    out = np.zeros(length, np.int32)
    for a, b in zip(row["cu_seqlens"][:-1], row["cu_seqlens"][1:], strict=True):
        out[a:b] = np.arange(b - a)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
