"""Conversation structure repair by a forward Viterbi search.

The rows of a conversation, in order of their turn, have to become ``(s?(ua)+)?`` in the initials of their roles: nothing, or perhaps a system message and then users
and assistants in pairs. A row is kept (0), given the role user or assistant (3) or deleted (4; a must for blank rows and duplicates); a user or assistant
without text may be inserted anywhere (3); a truncated row that stays adds 3. The grammar has four states: nothing yet, after the system's, after a user's, after an
assistant's. Each row makes a layer: the least (cost, audit) of every state, closed by insert transitions, of which never more than three help. The
audit is the edits' initials in order; among the cheapest the first in ASCII order wins. It settles every role, since in each state an insert or a new role can be of one kind only.

``audits`` streams (conversation, initial, fault) rows in order through one search, without the texts; what all states' audits have in common is put away
as soon as it is long, so a conversation of any length needs the memory of its audit, which is part of its result. ``repaired`` streams the audit and then the rows. A conversation
is one stream of one task, since each layer needs the one before and the digest is sequential; nothing of it but the audit is held.

A row's fault is the first of: blank (nothing but ASCII white space), duplicate (role and text of an earlier row of the conversation), truncated (the last
character that is not white space is none of ``.!?``).
Defined results: null roles and texts are one space, so a null text is blank; rows sort by turn (null first), then role and text; a null conversation id is a
conversation of its own; repeated rows are duplicates; a role is told by its first letter, an empty one by none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import arrow_schema, prepared, table
from lectern.llm.importance import CRC, CRC_TABLE

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: State to the roles that may follow, each with the state after it: 0 nothing yet, 1 after a system, 2 after a user, 3 after an assistant.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Letters of an audit that are still open before the common start is put away.
OPEN = 256

Layer = list[tuple[int, str] | None]


def _better(layer: Layer, state: int, found: tuple[int, str]) -> bool:
    if layer[state] is None or found < layer[state]:
        layer[state] = found
        return True
    return False


def closed(layer: Layer) -> Layer:
    """The layer with inserts: at most three lead from any state to any other, and more only cost."""
    for _ in range(3):
        better = False
        for state, known in enumerate(list(layer)):
            if known is not None:
                for role in ("u", "a"):
                    after = GRAMMAR[state].get(role)
                    if after is not None:
                        better |= _better(layer, after, (known[0] + INSERT_COST, known[1] + INSERT))
        if not better:
            break
    return layer


def stepped(layer: Layer, initial: str, fault: int) -> Layer:
    """The layer after one row."""
    out: Layer = [None] * len(GRAMMAR)
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    for state, known in enumerate(layer):
        if known is None:
            continue
        cost, audit = known
        _better(out, state, (cost + DELETE_COST, audit + DELETE))
        if fault in (BLANK, DUPLICATE):
            continue
        if initial in GRAMMAR[state]:
            _better(out, GRAMMAR[state][initial], (cost + more, audit + KEEP))
        for role in ("u", "a"):
            if role in GRAMMAR[state]:
                _better(out, GRAMMAR[state][role], (cost + REROLE_COST + more, audit + REROLE))
    return closed(out)


class Search:
    """The search over one conversation and the counts of its rows."""

    def __init__(self) -> None:
        self.layer: Layer = closed([(0, ""), None, None, None])
        self.settled: list[str] = []
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = None
        self.before: str | None = None

    def take(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.faults[fault] += 1
        self.layer = stepped(self.layer, initial, fault)
        if len(self.layer[ENDS[1]][1]) > OPEN:
            common = len(os.path.commonprefix([x[1] for x in self.layer if x]))
            if common > OPEN // 2:
                self.settled.append(self.layer[ENDS[1]][1][:common])
                self.layer = [x and (x[0], x[1][common:]) for x in self.layer]

    def result(self) -> dict:
        cost, audit = min(self.layer[s] for s in ENDS if self.layer[s] is not None)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        named = {"blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED]}
        return {"gaps": gaps, **named, "illegal": self.illegal, "cost": cost, "audit": "".join([*self.settled, audit])}


#: Order of a conversation's rows; the first of rows alike comes before its duplicates.
ORDER = ["conv_id", "turn", "role", "text", "nth"]


def said(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def faulted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, nth, fault), dealt by conversation; nth counts the rows of one role and text, the fault is 0, BLANK, DUPLICATE or TRUNCATED.

    One shuffle by conversation; the first row of each role and text is found by a sort inside the partitions, which spills, and not by a set in memory.
    """
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text")).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    core = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(core == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right(core, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return own.withColumn("nth", nth).select(*ORDER, fault.alias("fault"))


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(faults: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost and audit."""
    prepared(faults.sparkSession)
    types = arrow_schema(AUDIT)
    rows = faults.sortWithinPartitions(*ORDER).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")

    def batch(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(found, schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search, out = None, None, []
        for part in batches:
            for conv, turn, initial, fault in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if search is None or conv != now:
                    if search is not None:
                        out.append({"conv_id": now, **search.result()})
                    now, search = conv, Search()
                search.take(turn, initial, fault)
            if len(out) >= 1024:
                yield batch(out)
                out = []
        if search is not None:
            out.append({"conv_id": now, **search.result()})
        yield batch(out)

    return rows.mapInArrow(run, AUDIT)


REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


def repaired(faults: DataFrame, audit: DataFrame) -> DataFrame:
    """The rows of the repaired conversations by place (from 1), with the edit (K, R or I) that each comes from; an inserted row has no turn and no text.

    The audit comes first in each conversation's stream, then its rows; nothing else is held. Rows come out by conversation and place within each partition.
    """
    prepared(faults.sparkSession)
    types = arrow_schema(REPAIRED)
    plans = audit.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = plans.unionByName(faults.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, at, state, place, conv_now = "", 0, 0, 0, None

        def put(out: list[tuple], role: str, turn: int | None, text: str, edit: str) -> None:
            nonlocal state, place
            state = GRAMMAR[state][role[:1]]
            place += 1
            out.append((conv_now, place, turn, role, text, edit))

        def inserts(out: list[tuple]) -> None:
            nonlocal at
            while at < len(plan) and plan[at] == INSERT:
                at += 1
                put(out, ROLES["a" if "a" in GRAMMAR[state] else "u"], None, "", INSERT)

        for part in batches:
            out: list[tuple] = []
            for conv, kind, turn, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if kind == 0:
                    plan, at, state, place, conv_now = text, 0, 0, 0, conv
                    inserts(out)
                    continue
                edit = plan[at]
                at += 1
                if edit == KEEP:
                    put(out, role, turn, text, KEEP)
                elif edit == REROLE:
                    put(out, ROLES["a" if "a" in GRAMMAR[state] else "u"], turn, text, REROLE)
                inserts(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return rows.mapInArrow(run, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` rows as they stream by: ``role:text`` of the rows, line feeds between."""
    types = arrow_schema("conv_id long, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, ([], [])
        for part in batches:
            for conv, place, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if place == 1:
                    if digest is not None:
                        out[0].append(now)
                        out[1].append(digest.hexdigest())
                    now, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if len(out[0]) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, types, strict=True)], schema=types)
                out = ([], [])
        if digest is not None:
            out[0].append(now)
            out[1].append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, types, strict=True)], schema=types)

    return rows.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20: 0 is dropped, 1 loses its text, 2 its sentence ends, 3 comes twice, 4 becomes a user's."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    how = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = own.withColumn("_how", how).filter("_how <> 0").withColumn("text", text).withColumn("role", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_n")).drop("_n")


def report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Audit and digest of the repaired rows of each conversation id of ``every``; one without rows has zeros, no audit and the digest of nothing.

    The faults are checkpointed, as the audits and the repair both read them.
    """
    prepared(rows.sparkSession)
    faults = faulted(rows).checkpoint()
    audit = audits(faults).checkpoint()
    digest = digests(repaired(faults, audit))
    found = audit.join(digest.withColumnRenamed("conv_id", "_d"), F.col("conv_id").eqNullSafe(F.col("_d")), "left").drop("_d").withColumnRenamed("conv_id", "_conv")
    ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)


#: A layer is a list of four states {c: cost, a: audit, t: repaired text}, 1e9 and more where a state can't be; inserts close it in three steps.
_CLOSE = "[s[1], s[2], list_min([s[3], {{c: s[1].c + 3, a: s[1].a || 'I', t: s[1].t || 'user:' || chr(10)}}, {{c: s[2].c + 3, a: s[2].a || 'I', t: s[2].t || 'user:' || chr(10)}}, {{c: s[4].c + 3, a: s[4].a || 'I', t: s[4].t || 'user:' || chr(10)}}]), list_min([s[4], {{c: s[3].c + 3, a: s[3].a || 'I', t: s[3].t || 'assistant:' || chr(10)}}])]"
_CLOSED = "list_transform([list_transform([list_transform([{0}], lambda s: " + _CLOSE + ")[1]], lambda s: " + _CLOSE + ")[1]], lambda s: " + _CLOSE + ")[1]"
_FREE = "CASE WHEN x.f IN (1, 2) THEN 1000000000 ELSE 0 END + CASE WHEN x.f = 3 THEN 3 ELSE 0 END"


def _del(n: int) -> str:
    return f"{{c: s[{n}].c + 4, a: s[{n}].a || 'D', t: s[{n}].t}}"


def _keep(n: int, initial: str) -> str:
    return f"{{c: s[{n}].c + {_FREE} + CASE WHEN x.i = '{initial}' THEN 0 ELSE 1000000000 END, a: s[{n}].a || 'K', t: s[{n}].t || x.r || ':' || x.t || chr(10)}}"


def _role(n: int, role: str) -> str:
    return f"{{c: s[{n}].c + 3 + {_FREE}, a: s[{n}].a || 'R', t: s[{n}].t || '{role}:' || x.t || chr(10)}}"


_STEP = (
    f"[{_del(1)}, list_min([{_del(2)}, {_keep(1, 's')}]), "
    f"list_min([{_del(3)}, {', '.join(f'{_keep(n, "u")}, {_role(n, "user")}' for n in (1, 2, 4))}]), "
    f"list_min([{_del(4)}, {_keep(3, 'a')}, {_role(3, 'assistant')}])]"
)
ORACLE = (
    CRC_TABLE
    + r""",
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations),
how AS (SELECT *, xor(__CRC__, 4294967295) % 20 AS h FROM raw, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS r, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS t, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS n
  FROM how WHERE h <> 0),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, r, t ORDER BY turn NULLS FIRST, n) AS nth, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t, n) AS place,
         regexp_replace(t, '[\x20\x09-\x0D]+$', '') AS core FROM hurt),
faults AS (
  SELECT *, left(r, 1) AS i, CASE WHEN core = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
         lag(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS last
  FROM faults GROUP BY conv_id),
begun AS (SELECT conv_id, last, [{c: 0::bigint, a: '', t: ''}, {c: 1000000000::bigint, a: '', t: ''}, {c: 1000000000::bigint, a: '', t: ''}, {c: 1000000000::bigint, a: '', t: ''}] AS s FROM counts),
walk AS (
  SELECT conv_id, last, 0::bigint AS place, __CLOSED_START__ AS s FROM begun
  UNION ALL
  SELECT x.conv_id, w.last, x.place, list_transform([w.s], lambda s: __CLOSED_STEP__)[1] FROM walk w JOIN faults x ON x.place = w.place + 1 AND x.conv_id IS NOT DISTINCT FROM w.conv_id),
best AS (SELECT counts.*, list_min([s[1], s[4]]) AS b FROM walk JOIN counts ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id AND walk.place = counts.last)
SELECT ids.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal,
       coalesce(b.c, 0)::bigint AS cost, coalesce(b.a, '') AS audit, sha256(CASE WHEN coalesce(b.t, '') = '' THEN '' ELSE left(b.t, length(b.t) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
"""
).replace("__CRC__", CRC.format("k")).replace("__CLOSED_STEP__", _CLOSED.format(_STEP)).replace("__CLOSED_START__", _CLOSED.format("s"))
