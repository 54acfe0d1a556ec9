"""Near-duplicate groups by a signature-coordinate inverted join, confirmed on full shingle sets.

1. One pass over the texts makes each document's set of word shingles, a MinHash signature
   and a 128-bit key of the set. Documents with equal sets collapse into one class.
2. Every class is posted under its (coordinate, value) tokens. Two sets of the wanted likeness
   agree on far more than ``agree`` of ``coords`` coordinates, so tokens that a single class
   has can't be among the shared ones, and a class with fewer than ``agree`` shared tokens has
   no partner. Of the rest only the rarest ``shared - agree + 1`` tokens (the prefix) are posted:
   two classes with ``agree`` collisions meet under one of them, however frequent the others are.
3. Each posting list is first joined as a star around its most typical class; collisions are counted on
   the signatures, then the likeness is confirmed on the full sets (sorted by centre and streamed, one centre's set at a
   time), and components are formed. Only lists whose members are still in different components are compared further:
   members outside the list's largest component against all members whose size allows a link, in blocks bounded by
   shingles. A block first sees the signatures alone; the full sets go only where enough coordinates collide. A large
   group of near copies thus costs a star, not its square, and no link between components is lost.
4. Components by alternating stars (large-star, small-star) until nothing changes.

With 64 coordinates and a threshold of 38 the chance to miss one pair of likeness 0.85 is about 3e-7.

Defined results: null or blank text has an empty set and is linked with nothing; fewer words than a
shingle give one shingle of the whole sequence; repeated rows each get a row; a null doc_id takes the
least doc_id of its group (null if there is none) and is kept if it is the group's only kind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import compact, map_slices, prepared, sliced, sole, table, written

WIDTH, COORDS, AGREE = 5, 64, 38
#: Members of a block at most, and shingles of a side of a block on average; links of one centre that are dealt together.
BLOCK, SHINGLES, SPOKES = 1024, 400_000, 256
#: Up to so many ids (16 bytes each) of classes with possible partners are broadcast; beyond that their texts are shuffled.
BROADCAST_IDS = 2_000_000
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Shingle sets, signatures and set keys of texts."""

    def __init__(self, width: int = WIDTH, coords: int = COORDS):
        draw = np.random.Generator(np.random.PCG64(20240229))
        self.width, self.coords = width, coords
        self.odd = draw.integers(0, 2**64, width, dtype=np.uint64) | np.uint64(1)
        self.mult = (draw.integers(0, 2**64, coords, dtype=np.uint64) | np.uint64(1))[:, None]
        self.add = draw.integers(0, 2**64, coords, dtype=np.uint64)[:, None]
        self.words = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; words end at ASCII white space, A-Z in lower case."""
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, parts), np.uint64, len(parts))
        n = len(h) - self.width + 1
        if n < 1:
            x = h * self.odd[: len(h)]
            return mixed(x.sum(keepdims=True, dtype=np.uint64) + np.array([len(h)], np.uint64) * SCRAMBLE)
        s = h[:n] * self.odd[0]
        for j in range(1, self.width):
            s += h[j : n + j] * self.odd[j]
        return np.unique(mixed(s))

    def signature(self, s: np.ndarray) -> np.ndarray:
        """The least of each coordinate's hashes, as 32-bit integers."""
        best = np.full(self.coords, 2**64 - 1, np.uint64)
        for at in range(0, len(s), 4096):
            np.minimum(best, (s[at : at + 4096] * self.mult + self.add).min(axis=1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


_MADE: dict = {}


def shingler(width: int, coords: int) -> Shingler:
    """One for each shape and worker process."""
    sole("neardup", _MADE.clear)
    if (width, coords) not in _MADE:
        _MADE[width, coords] = Shingler(width, coords)
    return _MADE[width, coords]


def signed(docs: DataFrame, width: int = WIDTH, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and the signature of each document."""

    def work():
        import xxhash

        own = shingler(width, coords)

        def each(part: pa.RecordBatch) -> dict:
            sets = [own.shingles(t) for t in part.column("text").to_pylist()]
            return {
                "doc_id": part.column("doc_id"),
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sig": [own.signature(s) if len(s) else None for s in sets],
            }

        return each

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_shingles long, set_key binary, sig array<int>")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """set_key and the full set of the texts that are given, each set once a task."""

    def work():
        import xxhash

        own, seen = shingler(width, COORDS), set()

        def each(part: pa.RecordBatch) -> dict:
            found = {}
            for text in part.column("text").to_pylist():
                s = own.shingles(text)
                key = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and key not in seen:
                    seen.add(key)
                    found[key] = s.view(np.int64)
            return {"set_key": list(found), "shingles": list(found.values())}

        return each

    return map_slices(texts.select("text"), work, "set_key binary, shingles array<bigint>")


def sets_of(docs: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """set_key (unique) and the full set of the documents whose doc_id is an ``owner``; other rows of such a doc_id come along."""
    texts = docs.select("doc_id", "text").join(owners, F.col("doc_id").cast("long").eqNullSafe(F.col("owner")), "left_semi")
    sets = written(full_sets(texts, width), "sets")
    twice = sets.groupBy("set_key").count().filter("count > 1").select("set_key")  # reads the keys alone
    if twice.isEmpty():
        return sets
    again = sets.join(twice, "set_key", "left_semi").groupBy("set_key").agg(F.first("shingles").alias("shingles"))
    return written(sets.join(twice, "set_key", "left_anti").unionByName(again), "sets")


def postings(classes: DataFrame, coords: int, agree: int) -> DataFrame:
    """(token, set_key, typical): each class under the rarest of its shared tokens, as many as the prefix needs.

    ``typical`` is how often all its shared tokens occur: among near copies, the text that the others were made from has the most.
    """
    every = classes.select("set_key", F.posexplode("sig").alias("at", "value")).select(
        "set_key", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("token")
    )
    often = every.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = every.join(often, "token")
    chosen = (
        shared.groupBy("set_key")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
        .filter(F.size("own") >= agree)
    )
    prefix = F.slice("own", F.lit(1), F.size("own") - agree + 1)
    typical = F.aggregate("own", F.lit(0).cast("long"), lambda acc, x: acc + x["df"])
    return chosen.select("set_key", typical.alias("typical"), F.explode(prefix).alias("p")).select("set_key", "typical", F.col("p.token").alias("token"))


def each_set(part: pa.RecordBatch) -> list[np.ndarray]:
    """The sets of a batch's column ``shingles``, without a copy."""
    own = part.column("shingles")
    ends, flat = own.offsets.to_numpy(), own.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), of centres and members, whose full sets are alike enough.

    A centre's members are dealt in parts of about SPOKES, each sorted behind a copy of the centre's set, so a task holds that set and one batch.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("parts"))
    hubs = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"))
    spokes = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    rows = hubs.unionByName(spokes).join(sets, F.coalesce("b", "a") == F.col("set_key"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).select("a", "part", "b", "shingles")
    types = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        hub = np.empty(0, np.uint64)
        for part in sliced(batches):
            out: list[tuple[bytes, bytes]] = []
            for a, b, own in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), each_set(part), strict=True):
                if b is None:
                    hub = own.copy()
                elif 100 * min(len(own), len(hub)) >= percent * max(len(own), len(hub)):
                    both = int((hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own).sum())
                    if 100 * both >= percent * (len(own) + len(hub) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], schema=types)

    return rows.mapInArrow(run, "a binary, b binary")


def colliding(pairs: DataFrame, classes: DataFrame, agree: int) -> DataFrame:
    """The pairs (a, b) whose signatures have at least ``agree`` equal coordinates."""
    left = classes.select(F.col("set_key").alias("a"), F.col("sig").alias("ga"))
    right = classes.select(F.col("set_key").alias("b"), F.col("sig").alias("gb"))
    hits = F.size(F.filter(F.zip_with("ga", "gb", lambda x, y: x == y), lambda x: x))
    return pairs.join(right, "b").join(left, "a").filter(hits >= agree).select("a", "b")


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(node, label): the least node reachable, for every node of at most ``rows`` edges (a, b). Alternating stars until nothing changes, one shared checkpoint a round."""
    now = compact(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), rows)
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = compact(small.filter("u <> v").distinct(), rows)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        sign, rows = seen, seen[0]


def across(posted: DataFrame, centres: DataFrame, label: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, agree: int, rows: int) -> DataFrame:
    """Links (a, b) between different components that meet in a posting list, without its star.

    Members outside a list's largest component ("strays") meet all members of a size class that allows a link, block by block. Blocks get the
    signatures first; the sets only go to the blocks and members that have a partner there with ``agree`` collisions. ``rows``: number of documents.
    """
    base = 100.001 / percent  # two sets that may be linked are at most one class apart
    named = posted.join(label, posted["set_key"] == label["node"], "left").select("token", "set_key", F.coalesce("label", "set_key").alias("label"))
    lists = (
        named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1 AND n > 2").select("token", F.col("main.label").alias("main"))
    )
    sized = classes.select("set_key", F.floor(F.log(F.col("n_shingles")) / float(np.log(base))).cast("int").alias("cls"))
    members = named.join(lists, "token").join(centres, "token").filter("set_key <> a").join(sized, "set_key").select("token", "set_key", "label", "cls", (F.col("label") != F.col("main")).alias("stray"))
    members = compact(members, rows)
    near = lambda df: df.withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    counts = members.groupBy("token", "cls").agg(F.count(F.lit(1)).alias("n"), F.count_if("stray").alias("strays"))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(SHINGLES / F.pow(F.lit(base), F.col("cls")))))
    deal = counts.filter("strays > 0").join(near(counts).groupBy("token", "cls").agg(F.sum("n").alias("every")), ["token", "cls"])
    deal = compact(deal.select("token", "cls", F.ceil(F.col("strays") / room).cast("int").alias("ks"), F.ceil(F.col("every") / room).cast("int").alias("ka")), rows)
    spot = F.xxhash64("set_key")
    i, j = F.pmod(spot, F.col("ks")).cast("int"), F.pmod(spot, F.col("ka")).cast("int")
    stray = members.filter("stray").join(deal, ["token", "cls"]).withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("side", F.lit(0))
    every = near(members).join(deal, ["token", "cls"]).withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ks") - 1))).withColumn("side", F.lit(1))
    cell, own = ["token", "cls", "i", "j"], ["side", "set_key", "label"]
    blocks = stray.select(*cell, *own).unionByName(every.select(*cell, *own))
    signed_rows = blocks.join(classes.select("set_key", "sig", "n_shingles"), "set_key").select(*cell, *own, "sig", "n_shingles")

    def sides(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = part.column("side").to_numpy()
        group = np.unique(np.array(part.column("label").to_pylist(), object), return_inverse=True)[1]
        return np.flatnonzero(side == 0), np.flatnonzero(side == 1), group

    def meet(part: pa.Table) -> pa.Table:
        """The members of a block that have a partner on the other side."""
        rows, others, group = sides(part)
        sig = part.column("sig").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        n = part.column("n_shingles").to_numpy()
        hits = np.zeros((len(rows), len(others)), np.uint8)
        for k in range(sig.shape[1]):
            hits += sig[rows, k][:, None] == sig[others, k]
        able = (hits >= agree) & (group[rows][:, None] != group[others])
        low, high = np.minimum(n[rows][:, None], n[others]), np.maximum(n[rows][:, None], n[others])
        able &= 100 * low >= percent * high
        return part.take(np.r_[rows[able.any(1)], others[able.any(0)]]).select([*cell, *own])

    def compare(part: pa.Table) -> pa.Table:
        """No more links of a block than it takes to connect what is linked in it, by counting all common shingles at once."""
        rows, others, group = sides(part)
        key = part.column("set_key").to_pylist()
        sets = part.column("shingles").combine_chunks()
        n = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        _, place, often = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = often[place] > 1
        column = np.cumsum(often > 1) - 1
        at_row, at_other = np.full(len(n), -1), np.full(len(n), -1)
        at_row[rows], at_other[others] = np.arange(len(rows)), np.arange(len(others))
        owner, col = np.repeat(np.arange(len(n)), n)[shared], column[place[shared]]
        del place, shared
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        common = np.zeros((len(rows), len(others)), np.float32)
        width = 1024
        for low in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, (low, low + width))
            o, c = owner[a:b], col[a:b] - low
            left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(others), width), np.float32)
            r = at_row[o] >= 0
            left[at_row[o][r], c[r]] = 1
            right[at_other[o][~r], c[~r]] = 1
            common += left @ right.T
        total = n[rows][:, None] + n[others][None, :]
        linked = (100 * common >= percent * (total - common)) & (group[rows][:, None] != group[others][None, :])
        out = []
        for r, o in zip(*np.nonzero(linked), strict=True):
            x, y = group[rows[r]], group[others[o]]
            if x != y:
                group[group == y] = x
                out.append(sorted((key[rows[r]], key[others[o]])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    kinds = "token long, cls int, i int, j int, side int, set_key binary, label binary"
    met = compact(signed_rows.groupBy(*cell).applyInArrow(meet, kinds), rows, 5_000, heavy=True)
    return met.join(sets, "set_key").groupBy(*cell).applyInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 85, coords: int = COORDS, agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document; ``percent`` is the least likeness of a link."""
    return grouped(docs, width, percent, coords, agree).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, width: int, percent: int, coords: int, agree: int) -> DataFrame:
    """The columns of ``near_duplicates`` with each row's set_key and the label of its group (null for an empty set)."""
    prepared(docs.sparkSession)
    marked = signed(docs, width, coords).checkpoint()
    n = marked.count()  # of documents, so that of classes at most
    classes = compact(marked.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), n, 5_000)
    posted = compact(postings(classes, coords, agree), n, 5_000)
    centres = compact(posted.groupBy("token").agg(F.max(F.struct("typical", "set_key")).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", F.col("c.set_key").alias("a")), n)
    star = posted.join(centres, "token").filter("a <> set_key").select("a", F.col("set_key").alias("b")).distinct()
    star = compact(colliding(star, classes, agree), n, heavy=True)
    wanted = posted.select("set_key").distinct()
    owners = compact(classes.join(wanted, "set_key", "left_semi").select(F.col("least").alias("owner")).distinct(), n)
    if owners.count() <= BROADCAST_IDS:
        owners = F.broadcast(owners)
    sets = sets_of(docs, owners, width)
    links = compact(confirmed(star, sets, percent), n, 5_000, heavy=True)
    label = components(links, links.count())
    more = compact(across(posted, centres, label, classes, sets, percent, agree, n), n, heavy=True)
    extra = more.count()
    if extra:
        label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), n + extra)
    named = classes.join(label, classes["set_key"] == label["node"], "left").select("set_key", "least", F.coalesce("label", "set_key").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    group = named.join(least, "label").select("set_key", "label", "component_id")
    placed = marked.drop("sig").join(group, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "set_key", "label")


def keyed_rows(held: DataFrame, width: int) -> DataFrame:
    """The rows as they are with ``_set_key`` of their ``_text``, null for an empty set."""
    prepared(held.sparkSession)

    def run(batches):
        import xxhash

        own = shingler(width, COORDS)
        for part in sliced(batches):
            sets = [own.shingles(t) for t in part.column("_text").to_pylist()]
            yield part.append_column("_set_key", pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()))

    return held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField("_set_key", T.BinaryType())]))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = 80, coords: int = COORDS, agree: int = 33) -> DataFrame:
    """One document of each near-duplicate group, with all columns as they are; the others go.

    ``agree`` is lower than for 85 %, for the same chance to miss a pair. A doc_id on several rows is judged row by row: of its rows in one
    group one stays if the group has no lower doc_id, and rows with one doc_id and the same blank text count as one; of rows that differ
    in other columns alone the one whose JSON sorts first stays.
    Documents without a doc_id cannot be told apart and stay.
    """
    marks = grouped(docs, width, percent, coords, agree).checkpoint()
    gone = compact(marks.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone_id")).distinct(), marks.count())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    # Rows go along as one column, so that no column of docs can clash.
    held = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.struct("*").alias("_row"))
    away = lambda df: df.join(gone, F.col("_id") == F.col("_gone_id"), "left_anti")
    again = held.filter("_id IS NOT NULL").groupBy(F.col("_id").alias("_again_id")).count().filter("count > 1").select("_again_id")
    if again.isEmpty():
        return away(held).select("_row.*")
    rest = away(held.join(again, F.col("_id") == F.col("_again_id"), "left_anti"))
    stays = marks.filter("kept AND doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("doc_id", "label").agg(F.min("set_key").alias("_stay_key"))
    stays = stays.select(F.col("doc_id").alias("_stay_id"), "_stay_key")
    several = keyed_rows(held.join(again, F.col("_id") == F.col("_again_id"), "left_semi"), width)
    # Of rows that count as one stays the one whose text, then whose JSON, sorts first.
    one = lambda df, keys: df.groupBy(*keys).agg(F.min_by("_row", F.struct("_text", F.to_json("_row"))).alias("_row"))
    blank = one(several.filter("_set_key IS NULL"), ["_id", "_text"])
    full = one(several.join(stays, (F.col("_id") == F.col("_stay_id")) & (F.col("_set_key") == F.col("_stay_key")), "left_semi"), ["_id", "_set_key"])
    return rest.select("_row.*").unionByName(full.select("_row.*")).unionByName(blank.select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
