"""LM scoring by a class-based bigram model (Brown classes) over all training text.

Counts of all words of the training fold are made by partial sums and one shuffle. The commonest words, at most HEAD with a count of LEAST or more, are units
of exchange clustering, which moves each unit to the class that gives the bigram likelihood most. It begins on the driver with the UNITS commonest ones, until no unit moves, and goes
on over all units: their counts with neighbouring classes are gathered from the coded training text as a distributed table, and all units of a sweep choose
against the same class table. Where all moves of a sweep together lower the likelihood, half of them are tried, then a quarter; sweeps end when no move is left that
raises it, or when one raises it by less than TOLERANCE of itself. While units are moved, all other words stand together by ENDINGS hashes of their last bytes.

Then every other word of the training text, however rare, moves to the class that its own neighbours give the likelihood most, again as a distributed table; while it chooses, neighbours beyond
the units stand for the classes of their endings. The table of classes is then counted anew with all words in their classes. A text's probability is the product of
class transitions (additive smoothing) and word emissions (count + 1) / (class tokens + class words + 1), one unseen word for each class; a word that was never seen has the class of its ending.

The driver and the broadcasts hold the units, the endings and tables of classes: at most HEAD words, whatever the size of the vocabulary. Texts are split twice, for
the counts of words and as coded rows that also hold their own other words; these meet by one shuffle of (word, coded row), where a word's counts are summed and its class is chosen, and
a second one brings counts and classes back to the coded rows, of which each gives the pairs of its other words and the scores of its texts.

Defined results: a null or blank text is its end token alone; repeated rows each get a row; a null doc_id is in the training fold; extra columns are ignored; long texts are read whole;
with no training text every token is unknown and base_score is 0; equal gains go to the class of the lower number.
"""

from __future__ import annotations

import gc
import zlib
from itertools import compress, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import arrow_schema, fold, given_back, prepared, sliced, table, written

UNITS, ENDINGS, CLASSES, HEAD = 400, 112, 24, 200_000
#: A word of this count or more may be a unit; UNITS is only the number of seeds. Sweeps go over all units, in groups of BLOCK, and end at a gain of TOLERANCE.
LEAST, BLOCK, TOLERANCE = 10, 256, 1e-3
#: Bars of the histogram of counts for each doubling.
BARS = 64
#: Neighbour pairs counted at a time, and counts a task holds before it sends them.
CHUNK, HELD_COUNTS = 1_000_000, 3_000_000
ALPHA = 0.5
HELD = (7, 2)
#: Bytes of texts split at a time (or one text), words counted at a time, words of a coded row, rows of other words that choose at a time.
LONG, COUNTED, PART, AT_ONCE = 8 << 20, 2_000_000, 1 << 16, 8192
#: A place of a word: a coded row and the word's number there.
SEAT = np.dtype([("chunk", "<i8"), ("number", "<i4")])


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def portions(batches):
    """Slices of batches, each text alone where a slice is long."""
    for part in sliced(batches):
        yield from sliced([part], 1) if part.nbytes > LONG else [part]


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``tokens_of`` of all texts behind each other, and their number in each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # before a leading blank and behind a trailing one
    if blank.any():
        n = n - np.bincount(np.repeat(np.arange(len(n)), n)[blank], minlength=len(n))
        words = words.filter(pa.array(~blank))
    return words.cast(pa.binary()), n


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` values each, as bytes."""
    stops = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def objects(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """``to_pylist`` of bytes without a scalar for each, which takes more than ten times as long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False).tolist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all documents that are given; combined in each task before the shuffle."""
    types = arrow_schema("word binary, n long")

    def counted(waiting):
        found = pc.value_counts(pa.concat_arrays(waiting))
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], schema=types)

    def run(batches):
        waiting, room = [], 0
        for part in portions(batches):
            words, _ = words_in(part.column(0))
            waiting.append(words)
            room += len(words)
            if room >= COUNTED:
                yield counted(waiting)
                waiting, room = [], 0
        if waiting:
            yield counted(waiting)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def head_of(counts: DataFrame, most: int = HEAD, least: int = 1) -> list[tuple[bytes, int]]:
    """The commonest words of count ``least`` or more, at most ``most``: those of the highest bars of a histogram with BARS bars a doubling that fit together."""
    bar = F.floor(F.log2(F.col("c").cast("double")) * BARS)
    bars = counts.filter(F.col("c") >= least).groupBy(bar.alias("bar")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect()  # at most 63 * BARS rows
    left, lowest = most, None
    for r in sorted(bars, key=lambda r: -r["bar"]):
        if r["n"] > left:
            break
        left, lowest = left - r["n"], r["low"]
    rows = counts.filter(F.col("c") >= lowest).collect() if lowest is not None else []
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-3:]) % endings


class Places:
    """Words to places: the rank of a head word, or behind the head the ending of any other."""

    def __init__(self, head: list[bytes], endings: int):
        self.rank = {w: i for i, w in enumerate(head)}
        self.head, self.endings = len(head), endings

    def of(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))
        missed = at < 0
        if missed.any():
            others = compress(words, missed)
            ends = np.fromiter((zlib.crc32(w[-3:]) for w in others), np.int64, int(missed.sum()))
            at[missed] = self.head + ends % self.endings
        return at


def coded(docs: DataFrame, head: list[bytes], endings: int) -> DataFrame:
    """All texts (doc_id, text, train) as numbers, about PART words a row, either of training texts or of others: the only time that they are split for the model.

    ``ids`` are the units (int32); the last unit is a text's end, also before the first. ``words`` are the row's different words beyond the head, and ``numbers`` (int32) tells which of
    them each token is that is one. ``chunk`` is the row's own number.
    """
    spark = prepared(docs.sparkSession)
    sent = spark.sparkContext.broadcast(head)
    schema = "chunk long, train boolean, ids binary, numbers binary, words array<binary>, doc_ids array<long>"
    types = arrow_schema(schema)

    def run(batches):
        known, places, end = len(sent.value), Places(sent.value, endings), len(sent.value) + endings
        numbers_of_rows = count(TaskContext.get().partitionId() << 33)

        def row(parts, train):
            words, doc_ids = (pa.concat_arrays(x) for x in zip(*((w, d) for w, _, d in parts), strict=True))
            n = np.concatenate([n for _, n, _ in parts])
            found = words.dictionary_encode()
            at, codes = places.of(objects(found.dictionary)), found.indices.to_numpy()
            rare = at >= known
            ids = np.full(len(codes) + len(n) + 1, end, np.int32)
            ids[np.arange(1, len(codes) + 1) + np.repeat(np.arange(len(n)), n)] = at[codes]
            numbers = (np.cumsum(rare) - 1)[codes[rare[codes]]].astype(np.int32)
            listed = lambda x, name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x, type=types.field(name).type)
            columns = [pa.array([next(numbers_of_rows)]), pa.array([train]), pa.array([ids.tobytes()], pa.binary()), pa.array([numbers.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, listed(found.dictionary.filter(pa.array(rare)), "words"), listed(doc_ids, "doc_ids")], schema=types)

        waiting, room = {True: [], False: []}, {True: 0, False: 0}
        for part in portions(batches):
            for train in (True, False):
                own = part.filter(pc.equal(part.column("train"), train))
                if own.num_rows:
                    words, n = words_in(own.column("text"))
                    waiting[train].append((words, n, own.column("doc_id")))
                    room[train] += len(words) + len(n)
                if room[train] >= PART:
                    yield row(waiting[train], train)
                    waiting[train], room[train] = [], 0
        for train, parts in waiting.items():
            if parts:
                yield row(parts, train)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train").mapInArrow(run, schema), "coded")


def _rows_of(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            yield np.frombuffer(batch.column(0)[at].as_buffer(), np.int32)
    given_back()


def label_pairs(texts: DataFrame, label: np.ndarray) -> np.ndarray:
    """Counts of neighbouring labels (rows before columns) over all coded texts."""
    size = int(label.max()) + 1
    sent = texts.sparkSession.sparkContext.broadcast(label)
    types = arrow_schema("pair int, n long")

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for ids in _rows_of(batches):
            codes = sent.value[ids].astype(np.int64)
            total += np.bincount(codes[:-1] * size + codes[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=types)

    # At most size * size rows reach the driver.
    rows = texts.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], n[0]
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys, kind="stable")  # merges what is in order already
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(n[order], starts).astype(np.int64)


def neighbour_counts(texts: DataFrame, label: np.ndarray, size: int, block: int = BLOCK, joint: np.ndarray | None = None) -> DataFrame:
    """(block, keys, n): counts of each unit with neighbouring classes, a row for each block of units. With ``joint`` (block, labels): the classes the block's units choose by them, as in ``chosen``.

    A count's key is unit * span + column: the classes after the unit, the unit itself, the classes before it. The last unit (the end) has no row of its own. Tasks send one
    row for each block, and a block's rows are summed in one group: at most block * span counts from each task.
    """
    end, span = len(label) - 1, 2 * size + 1
    sent = texts.sparkSession.sparkContext.broadcast(label if joint is None else (label, joint))
    schema = "block long, keys binary, n binary"
    types = arrow_schema(schema)
    out = schema if joint is None else CHOICES
    out_types = arrow_schema(out)

    def total(rows: pa.Table) -> pa.Table:
        table = np.zeros(block * span, np.int64)
        for keys, n in zip(rows.column("keys").to_pylist(), rows.column("n").to_pylist(), strict=True):
            table[np.frombuffer(keys, np.uint32)] += np.frombuffer(n, np.int64)  # a row's keys are distinct
        if joint is not None:
            own = choices(rows.column("block")[0].as_py(), table, *sent.value, block)
            return pa.table({"block": rows.column("block").slice(0, 1), "labels": pa.array([own], pa.binary())}, schema=out_types)
        some = np.flatnonzero(table)
        return pa.table({"block": rows.column("block").slice(0, 1), "keys": pa.array([some.astype(np.uint32).tobytes()], pa.binary()), "n": pa.array([table[some].tobytes()], pa.binary())}, schema=types)

    def packed(keys, n):
        starts = np.flatnonzero(np.diff(keys // (block * span), prepend=-1))
        stops = np.append(starts[1:], len(keys))[: len(starts)]
        blocks = keys[starts] // (block * span)
        small = (keys % (block * span)).astype(np.uint32)
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), cut(small), cut(n.astype(np.int64))], schema=types)

    def count(batches):
        label = sent.value if joint is None else sent.value[0]
        held_keys, held_n, held, waiting, room = [], [], 0, [], 0

        def counted():
            a, b = (np.concatenate(x) for x in zip(*((ids[:-1], ids[1:]) for ids in waiting), strict=True))
            same = a == b
            after = a.astype(np.int64) * span + np.where(same, size, label[b])
            before = b[~same].astype(np.int64) * span + size + 1 + label[a[~same]]
            keys = np.concatenate((after[a != end], before[b[~same] != end]))
            keys, n = np.unique(keys.astype(np.uint32) if len(label) * span < 1 << 32 else keys, return_counts=True)  # small numbers sort faster
            return keys.astype(np.int64), n

        for ids in _rows_of(batches):
            waiting.append(ids)
            room += len(ids)
            if room >= CHUNK:
                keys, n = counted()
                held_keys, held_n, held, waiting, room = [*held_keys, keys], [*held_n, n], held + len(keys), [], 0
                if held >= HELD_COUNTS:
                    yield packed(*_summed(held_keys, held_n))
                    held_keys, held_n, held = [], [], 0
        if waiting:
            keys, n = counted()
            held_keys, held_n = [*held_keys, keys], [*held_n, n]
        if held_keys:
            yield packed(*_summed(held_keys, held_n))

    return texts.mapInArrow(count, schema).groupBy("block").applyInArrow(total, out)


def class_table(counts: DataFrame, label: np.ndarray, size: int, ends: float, block: int = BLOCK) -> np.ndarray:
    """The table of neighbouring classes that the counts of all units sum to; ``ends`` are the texts without words."""
    span, end = 2 * size + 1, len(label) - 1
    sent = counts.sparkSession.sparkContext.broadcast(label)
    types = arrow_schema("pair int, n long")

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for part in batches:
            for number, keys, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                unit, column = np.divmod(np.frombuffer(keys, np.uint32).astype(np.int64), span)
                own, n = sent.value[number * block + unit].astype(np.int64), np.frombuffer(n, np.int64)
                after = column <= size
                np.add.at(total, own[after] * size + np.where(column[after] == size, own[after], column[after]), n[after])
                first = column == size + 1 + int(sent.value[end])  # what follows a text's begin
                np.add.at(total, int(sent.value[end]) * size + own[first], n[first])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=types)

    rows = counts.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most size * size rows
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    out = out.reshape(size, size)
    out[label[end], label[end]] = ends
    return out


CHOICES = "block long, labels binary"


def choices(number: int, counts: np.ndarray, label: np.ndarray, joint: np.ndarray, block: int) -> bytes:
    """The classes (int16) that the units of a block choose by their ``counts`` while all others stay."""
    size, end = len(joint), len(label) - 1
    old = label[number * block : min((number + 1) * block, end)].astype(np.int64)
    table = counts.reshape(block, 2 * size + 1)[: len(old)].astype(np.float64)
    new = best_classes(joint, old, table[:, :size], table[:, size + 1 :], table[:, size])
    return np.where(table.sum(1) > 0, new, old).astype(np.int16).tobytes()


def relabelled(rows: DataFrame, label: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The labels with the choices of all blocks; the end keeps its own."""
    out = label.copy()
    for r in rows.toArrow().to_pylist():  # two bytes for each of at most HEAD + ENDINGS units
        new = np.frombuffer(r["labels"], np.int16)
        out[r["block"] * block : r["block"] * block + len(new)] = new
    return out


def chosen(counts: DataFrame, label: np.ndarray, joint: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The class each unit chooses by its counts while all others stay; the end keeps its own."""
    span = 2 * len(joint) + 1
    sent = counts.sparkSession.sparkContext.broadcast((label, joint))
    types = arrow_schema(CHOICES)

    def run(batches):
        for part in batches:
            numbers, labels = part.column("block").to_pylist(), []
            for number, keys, n in zip(numbers, part.column("keys").to_pylist(), part.column("n").to_pylist(), strict=True):
                table = np.zeros(block * span, np.int64)
                table[np.frombuffer(keys, np.uint32)] = np.frombuffer(n, np.int64)
                labels.append(choices(number, table, *sent.value, block))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(labels, pa.binary())], schema=types)

    return relabelled(counts.mapInArrow(run, CHOICES), label, block)


def likelihood(joint: np.ndarray) -> float:
    """Log likelihood of the neighbours under the classes, but for a term that no move of a unit changes."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(0)).sum() - _xlogx(joint.sum(1)).sum())


def tidied(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffles of jobs that are over; Python's objects in cycles hold the JVM's, so they go first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clustered(texts: DataFrame, label: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Labels of all units and the table of neighbouring classes, after exchange over all units.

    A sweep reads the coded texts twice, for the units' counts and for the table after the moves, and writes no table: where Hadoop's native library is not there, each file that an executor
    makes forks its JVM for a moment.
    """
    joint = label_pairs(texts, label)
    while True:
        new = relabelled(neighbour_counts(texts, label, len(joint), joint=joint), label)
        moves = np.flatnonzero(new != label)
        before, gain = likelihood(joint), -1.0
        for share in (1, 2, 4):
            tried = label.copy()
            some = moves[:: share]
            tried[some] = new[some]
            if not len(some):
                break
            there = label_pairs(texts, tried)
            gain = likelihood(there) - before
            if gain > 0:
                label, joint = tried, there
                break
        tidied(texts.sparkSession)
        if gain <= tolerance * abs(before):
            return label, joint


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Class of each unit by exchange clustering until none moves; every move raises the likelihood. The last unit (the end) keeps a class of its own."""
    units = len(pairs) - 1
    classes = max(1, min(classes, units))
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight[:units], kind="stable")
    label = np.empty(units + 1, np.int64)
    label[order] = np.arange(units) % classes
    label[units] = classes
    member = np.eye(classes + 1)[label]
    joint = member.T @ pairs @ member
    while True:
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            old, self_ = label[u], pairs[u, u]
            out = pairs[u] @ member
            into = pairs[:, u] @ member
            out[old] -= self_
            into[old] -= self_
            joint[old, :] -= out
            joint[:, old] -= into
            joint[old, old] -= self_
            # gain of each class: its row, column, corner and margins with the unit minus without it
            c = np.arange(classes)
            row = _xlogx(joint[c] + out).sum(1) - _xlogx(joint[c]).sum(1)
            col = _xlogx(joint[:, c] + into[:, None]).sum(0) - _xlogx(joint[:, c]).sum(0)
            corner = joint[c, c]
            both = _xlogx(corner + out[c] + into[c] + self_) - _xlogx(corner) - (_xlogx(corner + out[c]) - _xlogx(corner)) - (_xlogx(corner + into[c]) - _xlogx(corner))
            left, right = joint.sum(1)[c] + into[c], joint.sum(0)[c] + out[c]  # what the class has without the unit, links with it included
            margin = _xlogx(left + out.sum() + self_) - _xlogx(left) + _xlogx(right + into.sum() + self_) - _xlogx(right)
            worth = row + col + both - margin
            new = int(np.argmax(worth))
            new = new if worth[new] > worth[old] + 1e-6 else old
            joint[new, :] += out
            joint[:, new] += into
            joint[new, new] += self_
            if new != old:
                moved += 1
                label[u] = new
                member[u, old], member[u, new] = 0, 1
        if not moved:
            return label


def best_classes(joint: np.ndarray, old: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best class of each unit while all others stay, from its counts with the classes after it, before it and with itself; as in ``exchange``."""
    rows, c = np.arange(len(old)), np.arange(len(joint) - 1)
    rest = np.repeat(joint[None], len(old), 0)
    rest[rows, old, :] -= out
    rest[rows, :, old] -= into
    rest[rows, old, old] -= own
    logs = _xlogx(rest)
    row = (_xlogx(rest + out[:, None, :]) - logs).sum(2)[:, c]
    col = (_xlogx(rest + into[:, :, None]) - logs).sum(1)[:, c]
    corner, o, i, own = rest[:, c, c], out[:, c], into[:, c], own[:, None]
    both = _xlogx(corner + o + i + own) + _xlogx(corner) - _xlogx(corner + o) - _xlogx(corner + i)
    left, right = rest.sum(2)[:, c] + i, rest.sum(1)[:, c] + o
    total_out, total_into = out.sum(1)[:, None], into.sum(1)[:, None]
    margin = _xlogx(left + total_out + own) - _xlogx(left) + _xlogx(right + total_into + own) - _xlogx(right)
    return np.argmax(row + col + both - margin, 1)


def best_classes_of_few(joint: np.ndarray, old: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``best_classes`` for words with few neighbours: only cells of the table that a word's counts touch are computed, in blocks of words at once."""
    size, classes = len(joint), len(joint) - 1
    some, c = np.arange(len(old)), np.arange(classes)
    own_class = old[:, None] == c
    worth = np.zeros((len(old), classes))
    for counts, other, cells in ((out, into, joint), (into, out, joint.T)):
        word, k = np.nonzero(counts)
        n = counts[word, k][:, None]
        rest = cells[:, k].T[:, :classes] - own_class[word] * n
        at_own = k == old[word]
        rest[at_own] -= other[word[at_own], :classes] + own_class[word[at_own]] * own[word[at_own], None]
        np.add.at(worth, word, _xlogx(rest + n) - _xlogx(rest))
    o, i, self_ = out[:, c], into[:, c], own[:, None]
    corner = np.diagonal(joint)[:classes] - own_class * (o + i + self_)
    both = _xlogx(corner + o + i + self_) + _xlogx(corner) - _xlogx(corner + o) - _xlogx(corner + i)
    total_out, total_into = out.sum(1)[:, None], into.sum(1)[:, None]
    left, right = joint.sum(1)[c] - own_class * (total_out + self_), joint.sum(0)[c] - own_class * (total_into + self_)
    margin = _xlogx(left + total_out + self_) - _xlogx(left) + _xlogx(right + total_into + self_) - _xlogx(right)
    return np.argmax(worth + both - margin, 1)


def log_transitions(joint: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    joint = joint + alpha
    return np.log10(joint / joint.sum(1, keepdims=True))


def by_chunk(others: DataFrame) -> DataFrame:
    """(chunk, numbers, c, classes): what coded rows have to know of their words beyond the head, some of a row's words at a time, from (c, class, seats) of each word."""
    schema = "chunk long, numbers binary, c binary, classes binary"
    types = arrow_schema(schema)

    def packed(waiting):
        seats, c, classes = (np.concatenate(x) for x in zip(*waiting, strict=True))
        order = np.argsort(seats["chunk"], kind="stable")
        seats = seats[order]
        chunks, n = np.unique(seats["chunk"], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(chunks), binaries(np.ascontiguousarray(seats["number"]), n), binaries(c[order], n), binaries(classes[order], n)], schema=types)

    def run(batches):
        waiting, room = [], 0
        for part in batches:
            seats = objects(part.column("seats"))
            n = np.fromiter(map(len, seats), np.int64, len(seats)) // SEAT.itemsize
            waiting.append((np.frombuffer(b"".join(seats), SEAT), np.repeat(part.column("c").to_numpy(), n), np.repeat(part.column("class").to_numpy().astype(np.int16), n)))
            room += int(n.sum())
            if room >= CHUNK:
                yield packed(waiting)
                waiting, room = [], 0
        if room:
            yield packed(waiting)
        given_back()

    return others.select("c", "class", "seats").mapInArrow(run, schema)


def _own_words(known: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and class of each of a row's ``size`` or more words beyond the head, from its rows of ``by_chunk``; 0 and -1 for a word that was never seen."""
    numbers, c, classes = (np.frombuffer(b"".join(objects(known.column(x))), t) for x, t in (("numbers", np.int32), ("c", np.int64), ("classes", np.int16)))
    size = max(size, int(numbers.max(initial=-1)) + 1)
    count, label = np.zeros(size, np.int64), np.full(size, -1, np.int16)
    count[numbers], label[numbers] = c, classes
    return count, label


def other_words(train: DataFrame, texts: DataFrame, head: list[bytes], endings: int, class_of: np.ndarray, joint: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, c, class, seats) of all training words beyond the head, and the table of neighbouring classes with them in their classes.

    ``train`` are rows of ``coded``, those of other texts too, whose words get their seats but no counts; plain texts, all for training, are coded first. A word's counts are columns: the classes
    before it (of units, then of others), the classes after it (likewise), itself. Its ``seats`` are the coded rows it stands in and its number there. Pairs of two others meet their classes
    in the coded row. Where all choices together don't raise the likelihood, every word keeps the class of its ending.
    """
    spark = train.sparkSession
    size, known = len(joint), len(head)
    end, span = known + endings, 4 * size + 1
    sent = spark.sparkContext.broadcast((class_of.astype(np.int64), joint))
    chunks = train if "chunk" in train.columns else coded(train.withColumn("train", F.lit(True)), head, endings)
    kinds = "word binary, chunk long, number int, sums binary"
    types = arrow_schema(kinds)

    def walks(part: pa.RecordBatch):
        """The units of each coded row, and beside them the numbers of its other words (-1 for units and ends)."""
        for ids, numbers in zip(objects(part.column("ids")), objects(part.column("numbers")), strict=True):
            ids = np.frombuffer(ids, np.int32)
            own = np.full(len(ids), -1, np.int64)
            own[(ids >= known) & (ids < end)] = np.frombuffer(numbers, np.int32)
            yield ids, own

    def count(batches):
        """A row for each word of a coded row, with its (column, count) there."""
        for part in sliced(batches, 1):
            (ids, own), words = next(walks(part)), part.column("words")[0].values
            counts, sums = np.zeros(len(words), np.int64), np.zeros((0, 2), np.int32)
            if part.column("train")[0].as_py():
                walk, i = sent.value[0][ids], np.flatnonzero(own >= 0)
                before = np.where(own[i - 1] == own[i], 4 * size, np.where(own[i - 1] >= 0, size, 0) + walk[i - 1])
                j = i[own[i + 1] != own[i]]
                after = np.where(own[j + 1] >= 0, 3 * size, 2 * size) + walk[j + 1]
                codes, n = np.unique(np.concatenate((own[i] * span + before, own[j] * span + after)), return_counts=True)
                counts, sums = np.bincount(codes // span, minlength=len(words)), np.stack((codes % span, n), 1).astype(np.int32)
            at = [pa.array(np.full(len(words), part.column("chunk")[0].as_py())), pa.array(np.arange(len(words), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([words, *at, binaries(sums, 2 * counts)], schema=types)

    outcome = "word binary, c long, old int, class int, seats binary, sums binary"
    fields = arrow_schema(outcome)

    def choose(batches):
        """A row for each training word, from rows in order of words; and at the end of the task one without a word, with the sums of its words' columns by class."""
        class_of, joint = sent.value
        total = np.zeros((size, span), np.int64)

        def made(rows: pa.Table, word: np.ndarray, words: pa.Array):
            n_words, entries = len(words), objects(rows.column("sums"))
            n = np.fromiter(map(len, entries), np.int64, len(entries)) // 8
            place, n_of = np.frombuffer(b"".join(entries), np.int32).reshape(-1, 2).T
            counts = np.bincount(np.repeat(word, n) * span + place, n_of, n_words * span).reshape(n_words, span)
            into, out, self_ = counts[:, :size] + counts[:, size : 2 * size], counts[:, 2 * size : 3 * size] + counts[:, 3 * size : -1], counts[:, -1]
            c = (into.sum(1) + self_).astype(np.int64)
            old = class_of[known + np.fromiter((ending(w, endings) for w in objects(words)), np.int64, n_words)]
            new = best_classes_of_few(joint, old, out, into, self_)
            np.add.at(total, new, counts.astype(np.int64))
            seats = np.empty(len(word), SEAT)
            seats["chunk"], seats["number"] = rows.column("chunk").to_numpy(), rows.column("number").to_numpy()
            columns = [words, pa.array(c), pa.array(old.astype(np.int32)), pa.array(new.astype(np.int32)), binaries(seats, np.bincount(word, minlength=n_words)), pa.nulls(n_words, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=fields).filter(pa.array(c > 0))

        waiting, room, enough = [], 0, AT_ONCE
        for part in batches:
            waiting.append(part)
            room += part.num_rows
            if room >= enough:
                # The last word may go on in the next batch.
                rows = pa.Table.from_batches(waiting).combine_chunks()
                found = rows.column("word").chunk(0).dictionary_encode()
                word, last = found.indices.to_numpy(), len(found.dictionary) - 1
                stop = int(np.searchsorted(word, last))
                if last:
                    yield made(rows.slice(0, stop), word[:stop], found.dictionary.slice(0, last))
                waiting, room = rows.slice(stop).to_batches(), len(word) - stop
                enough = AT_ONCE + 2 * room
        if room:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            found = rows.column("word").chunk(0).dictionary_encode()
            yield made(rows, found.indices.to_numpy(), found.dictionary)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, 0, 0, 0, None, total.tobytes()), fields, strict=True)], schema=fields)
        given_back()

    made = written(chunks.select("chunk", "train", "ids", "numbers", "words").mapInArrow(count, kinds).repartition("word").sortWithinPartitions("word").mapInArrow(choose, outcome), "others")
    tidied(spark)
    found = made.filter("word IS NOT NULL").drop("sums")
    # Neighbours that are both units, then those of a unit and another word, then those of two others: each at most a row for each two classes.
    apart = class_of.astype(np.int32).copy()
    apart[known : known + endings] = size
    there = label_pairs(texts, apart)[:size, :size] if known or endings else joint.copy()
    there = np.pad(there, ((0, size - there.shape[0]), (0, size - there.shape[1])))
    beside = np.zeros((size, span), np.int64)
    for r in made.filter("word IS NULL").select("sums").toLocalIterator():  # a table of classes from each task, one at a time
        beside += np.frombuffer(r["sums"], np.int64).reshape(size, span)
    there += beside[:, :size].T + beside[:, 2 * size : 3 * size]
    there[np.arange(size), np.arange(size)] += beside[:, 4 * size]

    def pairs(batches):
        for part in sliced(batches):
            both = []
            for _, own in walks(part):
                j = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0) & (own[:-1] != own[1:]))
                both.append(np.stack((own[j], own[j + 1]), 1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("chunk"), pa.array(both, pa.binary())], names=["chunk", "pairs"])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows:
            a, b = np.frombuffer(objects(left.column("pairs"))[0], np.int32).reshape(-1, 2).T
            label = _own_words(right, 0)[1].astype(np.int64)
            codes, n = np.unique(label[a] * size + label[b], return_counts=True)
        return pa.table({"pair": codes, "n": n.astype(np.int64)})

    paired = chunks.filter("train").select("chunk", "ids", "numbers").mapInArrow(pairs, "chunk long, pairs binary")
    both = paired.groupBy("chunk").cogroup(by_chunk(found).groupBy("chunk")).applyInArrow(met, "pair long, n long")
    for r in both.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        there[divmod(r["pair"], size)] += r["n"]
    if likelihood(there) <= likelihood(joint):
        return found.select("word", "c", F.col("old").alias("class"), "seats"), joint
    return found.select("word", "c", "class", "seats"), there


def score(docs: DataFrame, held: tuple[int, int] = HELD, units: int = UNITS, endings: int = ENDINGS, classes: int = CLASSES, head_size: int = HEAD, least: int = LEAST, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document."""
    spark = prepared(docs.sparkSession)
    modulus, rest = held
    train = docs.filter(fold(F.col("doc_id"), modulus) != rest)
    counts = word_counts(train).checkpoint()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = train.count()
    total, types = sums["n"] + ends, sums["v"] + (ends > 0)
    head = head_of(counts, head_size, least)
    words, often = [w for w, _ in head], np.array([c for _, c in head], np.int64)
    # Units: the head's words, then the endings, then the end.
    chunks = coded(docs.withColumn("train", fold(F.col("doc_id"), modulus) != rest), words, endings)
    texts = chunks.filter("train").select("ids")
    n_seeds = min(units, len(words))
    spots = np.concatenate([np.fromiter((ending(w, endings) for w in words), np.int64, len(words)), np.arange(endings)])
    seed_of = np.append(n_seeds + spots, n_seeds + endings).astype(np.int32)
    seed_of[:n_seeds] = np.arange(n_seeds)
    class_of, joint = clustered(texts, exchange(label_pairs(texts, seed_of), classes)[seed_of].astype(np.int16), tolerance)
    end_class, n_classes = int(class_of[-1]), len(joint)
    others, joint = other_words(chunks, texts, words, endings, class_of, joint)
    tidied(spark)
    # Tokens and words of each class.
    class_n, class_v = np.zeros(n_classes), np.zeros(n_classes)
    np.add.at(class_n, class_of[: len(words)], often)
    np.add.at(class_v, class_of[: len(words)], 1)
    for r in others.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_n[r["class"]] += r["n"]
        class_v[r["class"]] += r["v"]
    step = log_transitions(joint)
    spread = np.log10(class_n + class_v + 1)
    sent = spark.sparkContext.broadcast((class_of.astype(np.int64), np.log10(often + 1.0), step, spread))
    schema = "doc_id long, n_tokens long, n_known long, logs double, model double"
    fields, seen_ends = arrow_schema(schema), int(ends > 0)

    def texts_of(left: pa.Table, right: pa.Table) -> pa.Table:
        """A row for each text of a coded row. A seen word has its own class, any other that of its ending."""
        if not left.num_rows:
            return fields.empty_table()
        class_of, gain, step, spread = sent.value
        known, end, n = len(gain), len(class_of) - 1, len(step)
        ids, numbers = (np.frombuffer(objects(left.column(x))[0], np.int32) for x in ("ids", "numbers"))
        unit, at_end = ids < known, ids == end
        rare = ~unit & ~at_end
        count, label = _own_words(right, int(numbers.max(initial=-1)) + 1)
        own, c = label[numbers], count[numbers]
        walk = class_of[ids]
        walk[rare] = np.where(own >= 0, own, walk[rare])
        logs, seen = np.zeros(len(ids)), unit.astype(np.float64)
        logs[unit], logs[rare], seen[rare] = gain[ids[unit]], np.log10(c + 1.0), c > 0
        model = step.ravel()[walk[:-1] * n + walk[1:]] - np.where(at_end, 0.0, spread[walk])[:-1]
        doc_ids, text = left.column("doc_ids")[0].values, (np.cumsum(at_end) - 1)[:-1]
        sums = lambda x: np.bincount(text, x, len(doc_ids))
        n_tokens = np.bincount(text, minlength=len(doc_ids)).astype(np.int64)
        columns = (doc_ids, n_tokens, sums(seen[:-1]).astype(np.int64) + seen_ends, sums(logs[:-1]), sums(model))
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=fields)

    rows = chunks.select("chunk", "ids", "numbers", "doc_ids")
    sums = rows.groupBy("chunk").cogroup(by_chunk(others).groupBy("chunk")).applyInArrow(texts_of, schema)
    last = float(np.log10(ends + 1.0))
    base = F.col("logs") + F.lit(last) - F.col("n_tokens") * F.lit(float(np.log10(total + types + 1.0)))
    value = F.col("logs") + F.col("model")
    return sums.select(
        "doc_id", (fold(F.col("doc_id"), modulus) == rest).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
