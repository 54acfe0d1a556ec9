"""Near duplicates by the Ratcliff-Obershelp ratio, first come first kept.

The ratio (twice the matched characters over the sum of lengths) is computed only for pairs that survive bounds which lose nothing. The matched characters are at most
the shorter length; the overlap of the character bags; and the longest common subsequence. In a kept text of 200 characters and more the matcher starts
blocks only at its rare characters (those no more frequent than one in a hundred, plus one), except for one block at both texts' beginning. So there are at most as many blocks as shared rare characters plus one, and b blocks
of m characters share at least m - (GRAM - 1) * b runs of GRAM characters: m is at most the shared runs plus GRAM - 1 for each block. All bounds are taken of whole blocks of kept
texts at once and compared by the division that the ratio itself uses, so that a ratio right at a threshold is not lost.

No task holds a whole scope: scopes beyond BLOCK rows are dealt with in rounds or in pairs of blocks. Exact repeats are decided by key (and answer, where it counts) before any of that.
Defined results: null keys and answers are empty; empty keys are never kept nor compared; rows of one order sort by key and answer; a null scope value is a scope of its own.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.operators.relational import same
from lectern.sources.tables import shared

THRESHOLD, WITH_ANSWER = 0.8, 0.68
#: Characters and runs of GRAM characters are counted in so many bins; a bin that two of them share can only raise a bound.
BINS, GRAM, GRAM_BINS = 256, 4, 8192
#: From this length on the matcher leaves out frequent characters as starts of blocks: a fixed value of difflib.
JUNK_FROM = 200
#: Counts of runs stop here; the bound by runs is not taken of two texts longer than that.
MOST_RUNS = 65_535
#: Rows of a scope that one task holds at a time.
BLOCK = 1024
SLICE = 256


def ratio(newer: str, kept: str) -> float:
    """Similarity of a newer text to a kept one; the order of the two matters."""
    return difflib.SequenceMatcher(None, newer, kept).ratio()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def bag(text: str) -> np.ndarray:
    """Characters of a text counted in bins."""
    return np.bincount(codes(text) % BINS, minlength=BINS).astype(np.int64)


def rare_bag(text: str) -> np.ndarray:
    """Those characters of a kept text that can start a block, counted in bins."""
    found, index, count = np.unique(codes(text), return_inverse=True, return_counts=True)
    if len(text) >= JUNK_FROM:
        count = np.where(count <= len(text) // 100 + 1, count, 0)
    return np.bincount(found % BINS, weights=count, minlength=BINS).astype(np.int64)


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of a text's runs of GRAM characters."""
    own = codes(text)
    if len(own) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    mixed = np.zeros(len(own) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        mixed = mixed * np.uint32(0x9E3779B1) + own[k : len(own) - GRAM + 1 + k]
    mixed ^= mixed >> np.uint32(15)
    bins, count = np.unique(mixed * np.uint32(0x85EBCA6B) >> np.uint32(19), return_counts=True)
    return bins.astype(np.int64), np.minimum(count, MOST_RUNS).astype(np.uint16)


def possible(length: int, own: np.ndarray, lengths: np.ndarray, bags: np.ndarray, least: np.ndarray | float) -> np.ndarray:
    """For each of many texts, by length and bag (a column each): False only if the ratio with the one text is surely below ``least``."""
    total = np.maximum(lengths + length, 1)
    able = 2.0 * np.minimum(lengths, length) / total >= least
    some = np.flatnonzero(own)
    able &= 2.0 * np.minimum(bags[some], own[some, None]).sum(0) / total >= least
    return able | (lengths + length == 0)


class Subsequence:
    """Longest common subsequences of one text with others, bit by bit in whole numbers."""

    def __init__(self, text: str):
        self.length, self.at = len(text), {}
        for n, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << n

    def common(self, other: str) -> int:
        left = full = (1 << self.length) - 1
        at = self.at
        for c in other:
            hit = at.get(c)
            if hit:
                both = left & hit
                left = ((left + both) | (left - both)) & full
        return self.length - left.bit_count()


class Kept:
    """Kept texts of one scope, at most a block of them in the jobs below; bounds are taken of all at once, the ratio only of those that may be alike."""

    def __init__(self, threshold: float = THRESHOLD, with_answer: float | None = WITH_ANSWER):
        self.threshold, self.with_answer = threshold, with_answer
        self.keys: list[str] = []
        self.exact: set[str] = set()
        self.answers: dict[str, int] = {"": 0}
        self.lengths, self.of = np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.bags, self.rare, self.runs = np.zeros((BINS, 16), np.int64), np.zeros((BINS, 16), np.int64), np.zeros((GRAM_BINS, 16), np.uint16)

    def able(self, key: str, least: np.ndarray) -> np.ndarray:
        """Numbers of the kept texts that the bounds leave, the likeliest first."""
        n = len(self.keys)
        own, lengths = bag(key), self.lengths[:n]
        total = np.maximum(lengths + len(key), 1)
        left = possible(len(key), own, lengths, self.bags[:, :n], least)
        bound = np.full(n, 2.0)
        long = (lengths >= JUNK_FROM) & ((lengths <= MOST_RUNS) | (len(key) <= MOST_RUNS))
        if (left & long).any():
            some, (at, count) = np.flatnonzero(own), runs(key)
            blocks = np.minimum(self.rare[some, :n], own[some, None]).sum(0) + 1
            shared_runs = np.minimum(self.runs[at, :n], count[:, None]).sum(0, dtype=np.int64)
            bound = np.where(long, 2.0 * (shared_runs + (GRAM - 1) * blocks) / total, 2.0)
            left &= bound >= least
        found = np.flatnonzero(left)
        return found[np.argsort(-bound[found], kind="stable")]

    def match(self, key: str, answer: str = "") -> bool:
        """Whether a kept text is alike: at the threshold, or at the lower one with the same non-empty answer."""
        if key in self.exact:
            return True
        n = len(self.keys)
        least = np.full(n, self.threshold)
        if self.with_answer is not None and answer:
            least[self.of[:n] == self.answers.get(answer, -1)] = self.with_answer
        own = None
        for m in self.able(key, least):
            kept = self.keys[m]
            if len(kept) < JUNK_FROM:
                own = own or Subsequence(key)
                if 2.0 * own.common(kept) / (len(key) + len(kept) or 1) < least[m]:
                    continue
            if ratio(key, kept) >= least[m]:
                return True
        return False

    def add(self, key: str, answer: str = "") -> None:
        n = len(self.keys)
        if n == len(self.lengths):
            self.lengths, self.of = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.of))
            self.bags, self.rare, self.runs = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.bags, self.rare, self.runs))
        self.lengths[n], self.bags[:, n], self.of[n] = len(key), bag(key), self.answers.setdefault(answer, len(self.answers))
        if len(key) >= JUNK_FROM:
            self.rare[:, n] = rare_bag(key)
            at, count = runs(key)
            self.runs[at, n] = count
        self.keys.append(key)
        self.exact.add(key)


def judged(rows: DataFrame, groups: list[str], threshold: float, with_answer: float | None, adding: bool) -> DataFrame:
    """Rows of ``_kind`` 1 with ``_hit``: whether a text held before them in their group is alike.

    The rows come dealt by group and sorted. Those of ``_kind`` 0 are only held; with ``adding`` those of kind 1 that are not alike are held too. A group is a stream with at most BLOCK held rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_hit", T.BooleanType())])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                hits: list[bool | None] = []
                for group, kind, key, answer in zip(zip(*(part.column(c).to_pylist() for c in groups), strict=True), *(part.column(c).to_pylist() for c in ("_kind", "_key", "_answer")), strict=True):
                    if kept is None or group != now:
                        now, kept = group, Kept(threshold, with_answer)
                    hit = kept.match(key, answer) if kind else None
                    if not kind or adding and not hit:
                        kept.add(key, answer)
                    hits.append(hit)
                out = pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, pa.bool_())], names=types.names)
                yield out.filter(pa.array([h is not None for h in hits], pa.bool_()))

    return rows.mapInArrow(run, schema)


def _named(df: DataFrame, columns: list[str], prefix: str = "_s_") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def blocked(rows: DataFrame, scope: list[str], order: list[str], most: int) -> DataFrame:
    """Rows with ``_block``: 0 in scopes of at most ``most`` rows; in larger ones numbers that rise with the order, at most ``most`` rows each.

    Large scopes are sorted by ranges over all tasks and checkpointed, so that a number stays with its row; ``rows`` are read several times.
    """
    sizes = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    large = _named(sizes, scope)
    if large.isEmpty():
        return rows.withColumn("_block", F.lit(0).cast("long"))
    flagged = rows.join(large, same(scope, "_s_"), "left").drop(*(f"_s_{c}" for c in scope))
    few = flagged.filter("_n IS NULL").drop("_n").withColumn("_block", F.lit(0).cast("long"))
    many = flagged.filter("_n IS NOT NULL").drop("_n").repartitionByRange(*scope, *order).sortWithinPartitions(*scope, *order).withColumn("_nth", F.monotonically_increasing_id()).checkpoint()
    first = _named(many.groupBy(*scope).agg(F.min("_nth").alias("_low")), scope)
    many = many.join(first, same(scope, "_s_")).withColumn("_block", F.floor((F.col("_nth") - F.col("_low")) / most).cast("long"))
    return few.unionByName(many.select(few.columns))


def greedy(df: DataFrame, scope: list[str], order: str, key: str, answer: str | None = None, threshold: float = THRESHOLD, with_answer: float | None = None, block: int | None = None) -> DataFrame:
    """scope columns, order and status (kept, duplicate, empty) of each row, compared with the kept rows before it in its scope.

    Exact repeats of a key are marked first, so a group of copies never reaches one task. Where answers count, only rows
    of one key and one answer are repeats: a first row may be dropped for its answer alone, and its key may then stay with another answer.

    Then rounds: the first block of each scope is settled by one stream of at most BLOCK rows; all later rows of the scope are held against what it keeps, in tasks of one block each,
    and those alike go; what is left begins the next round. A scope of n rows that keeps k takes about k / BLOCK rounds and n * k cheap bounds; most scopes end with the first.
    """
    most = block or BLOCK
    shared(df.sparkSession)
    own = df.select(*scope, order, F.coalesce(key, F.lit("")).alias("_key"), (F.coalesce(answer, F.lit("")) if answer and with_answer is not None else F.lit("")).alias("_answer"))
    own = own.withColumn("_digest", F.md5(F.to_json(F.struct("_key", "_answer"))))
    first = _named(own.groupBy(*scope, "_digest").agg(F.min(order).alias("_first")), [*scope, "_digest"])
    marked = own.join(first, same([*scope, "_digest"], "_s_"), "left").select(*scope, order, "_key", "_answer", (F.col(order) > F.col("_first")).alias("_copy")).checkpoint()
    copies = marked.filter(F.col("_copy") | (F.col("_key") == "")).select(*scope, order, F.when(F.col("_key") == "", "empty").otherwise("duplicate").alias("status"))
    status = F.when(F.col("_hit"), "duplicate").otherwise("kept").alias("status")
    sorting = [*scope, order, "_key", "_answer"]
    left = blocked(marked.filter(~F.col("_copy") & (F.col("_key") != "")).select(sorting).withColumn("_kind", F.lit(1)), scope, sorting[len(scope):], most)
    while True:
        low = _named(left.groupBy(*scope).agg(F.min("_block").alias("_low"), F.max("_block").alias("_high")), scope)
        placed = left.join(low, same(scope, "_s_")).drop(*(f"_s_{c}" for c in scope))
        head = placed.filter("_block = _low").drop("_block", "_low", "_high")
        settled = judged(head.repartition(*scope).sortWithinPartitions(*sorting), scope, threshold, with_answer, adding=True).checkpoint()
        copies = copies.unionByName(settled.select(*scope, order, status))
        later = placed.filter("_block > _low").drop("_low", "_high")
        if later.isEmpty():
            return copies
        kept = settled.filter("NOT _hit").drop("_hit").withColumn("_kind", F.lit(0))
        parts = _named(later.select(*scope, "_block").distinct(), scope)
        held = kept.join(parts, same(scope, "_s_")).drop(*(f"_s_{c}" for c in scope))
        both = held.unionByName(later).repartition(*scope, "_block").sortWithinPartitions(*scope, "_block", "_kind")
        against = judged(both, [*scope, "_block"], threshold, with_answer, adding=False).checkpoint()
        copies = copies.unionByName(against.filter("_hit").select(*scope, order, F.lit("duplicate").alias("status")))
        open_rows = against.filter("NOT _hit").drop("_hit", "_block")
        if open_rows.isEmpty():
            return copies
        left = blocked(open_rows, scope, sorting[len(scope):], most)


def against_stored(new: DataFrame, stored: DataFrame, scope: list[str], key_id: str, key: str, answer: str | None = None, threshold: float = THRESHOLD, with_answer: float | None = None, block: int | None = None) -> DataFrame:
    """new's ids with duplicate: whether a stored text of the same scope (null-safe) is alike. An id counts within its scope; an empty text is like an empty one alone.

    Equal texts are settled by a join on their digests. The other rows of both sides are cut into blocks by scope and length; a task holds one stored block and streams one new block by it, and only
    blocks whose lengths can reach the threshold meet. Of a pair of blocks come the new ids that are alike, never the pairs.
    """
    most = block or BLOCK
    shared(new.sparkSession)
    least = min(threshold, with_answer or threshold)
    said = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    spoken = lambda df: df.withColumn("_length", F.length("_key")).withColumn("_digest", F.md5(F.col("_key").cast("binary")))
    a = spoken(new.select(*scope, key_id, said(key).alias("_key"), said(answer).alias("_answer")))
    b = spoken(stored.select(*scope, said(key).alias("_key"), said(answer).alias("_answer")).distinct()).checkpoint()
    equal = _named(b.select(*scope, "_digest").distinct().withColumn("_equal", F.lit(True)), [*scope, "_digest"])
    a = a.join(equal, same([*scope, "_digest"], "_s_"), "left").drop(*(f"_s_{c}" for c in [*scope, "_digest"]), "_digest").checkpoint()
    order = ["_length", "_key", "_answer"]
    a_rows = blocked(a.filter("_equal IS NULL AND _length > 0").drop("_equal").distinct(), scope, [*order, key_id], most).withColumnRenamed("_block", "_new")
    b_rows = blocked(b.filter("_length > 0").drop("_digest"), scope, order, most).withColumnRenamed("_block", "_old")
    spans = lambda df, name: df.groupBy(*scope, name).agg(F.min("_length").alias(f"{name}_low"), F.max("_length").alias(f"{name}_high"))
    reach = lambda x, y: 2.0 * F.least(x, y) / (x + y) >= least
    low, high = F.greatest("_new_low", "_old_low"), F.least("_new_high", "_old_high")
    meet = (low <= high) | reach(F.col("_new_high"), F.col("_old_low")) & (F.col("_new_high") < F.col("_old_low")) | reach(F.col("_old_high"), F.col("_new_low")) & (F.col("_old_high") < F.col("_new_low"))
    pairs = spans(a_rows, "_new").join(_named(spans(b_rows, "_old"), scope), same(scope, "_s_")).filter(meet).select(*scope, "_new", "_old")
    pairs = _named(pairs, [*scope, "_new", "_old"], "_p_").checkpoint()
    beside = lambda df, name: df.join(pairs, same([*scope, name], "_p_")).drop(name, *(f"_p_{c}" for c in scope))
    columns = [*scope, "_p__new", "_p__old", "_kind", key_id, "_key", "_answer"]
    held = beside(b_rows, "_old").withColumn("_kind", F.lit(0)).withColumn(key_id, F.lit(None).cast(new.schema[key_id].dataType)).select(columns)
    asked = beside(a_rows, "_new").withColumn("_kind", F.lit(1)).select(columns)
    groups = [*scope, "_p__new", "_p__old"]
    both = held.unionByName(asked).repartition(*groups).sortWithinPartitions(*groups, "_kind")
    alike = judged(both, groups, threshold, with_answer, adding=False).filter("_hit").select(*scope, key_id)
    found = alike.unionByName(a.filter("_equal").select(*scope, key_id)).distinct().withColumn("_alike", F.lit(True))
    rows = new.select(*scope, key_id).join(_named(found, [*scope, key_id]), same([*scope, key_id], "_s_"), "left")
    return rows.select(*scope, key_id, F.coalesce("_alike", F.lit(False)).alias("duplicate"))
