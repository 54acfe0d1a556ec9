"""Near-duplicate, segmentation and job queries over the stand-in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import dedup as D
from lectern.operators import segment as G
from lectern.sources.tables import shared, table
from lectern.streaming import jobs as P
from lectern.streaming import state as W


def exact_dedup(s, d):
    own = table(s, d, "documents").select("doc_id", F.sha2(T.normal_key(F.col("text")), 256).alias("k"))
    return own.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


def greedy_dedup(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn", T.normal_key(F.col("text")).alias("key"))
    return D.greedy(said, ["conv_id"], "turn", "key")


def greedy_with_answer(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn", T.normal_key(F.col("text")).alias("key"), "role")
    return D.greedy(said, ["conv_id"], "turn", "key", "role", with_answer=D.WITH_ANSWER)


def vs_stored(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn", "role", T.normal_key(F.col("text")).alias("key"))
    return D.against_stored(said.filter("role = 'user'"), said.filter("role = 'assistant'"), ["conv_id"], "turn", "key")


def _headed_pages(s, d):
    """Five books of pages: the host is the running header, every seventh page begins a section."""
    host = F.regexp_extract("url", "://([^/?#.]*)", 1)
    w = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("2.1 Start of "), host)).otherwise(F.lit("plain line"))
    own = table(s, d, "pages").select((F.col("page_id") % 5).alias("doc"), F.floor(F.col("page_id") / 5).cast("int").alias("page_no"), host.alias("host"), w.alias("body"), "html")
    return own.select("doc", "page_no", (F.col("page_no") + 1).alias("num"), F.array("host", "body").alias("lines"), F.concat_ws("\n", "host", "body", "html").alias("text"))


def running_headers(s, d):
    return G.by_running_headers(_headed_pages(s, d)).select("doc", "lesson_no", "lesson_id", "start_page", "end_page", F.size("subsections").alias("n_subsections"), F.length("text").alias("n"))


def line_headings(s, d):
    body = F.concat(F.lit("preface\nLesson 1: First\n"), F.regexp_replace("text", "\n", " "), F.lit("\nUnit IV\n"), F.regexp_replace("text", "\n", " "))
    own = G.by_line_headings(table(s, d, "documents").select("doc_id", body.alias("text")), "doc_id", "text")
    return own.select("doc_id", "lesson_no", "lesson_number", F.length("text").alias("n"))


def unit_split(s, d):
    pages = _headed_pages(s, d)
    text = F.concat(F.lit("Unit "), F.floor(F.col("page_no") / 4 + 1).cast("string"), F.lit("\n"), "text")
    return G.by_units(pages.withColumn("text", text)).select("doc", "lesson_no", "start_page", "end_page")


def latest_state(s, d):
    return P.latest_state(table(s, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value", "props"])


def ttl_evict(s, d):
    state = P.latest_state(table(s, d, "events").withColumn("status", F.when(F.col("event_type") == "click", "done").otherwise("running")), "user_id", ["ts", "event_id"], ["status"])
    return P.evicted(state, F.lit("2024-01-30 23:00:00"), 6 * 3600)


def progress(s, d):
    steps = table(s, d, "events").select("user_id", "event_id", (F.col("event_id") % 7 - 2).alias("step"))
    return P.progress(steps, "user_id", ["event_id"], "step")


def stream_state(s, d):
    source = s.readStream.schema(table(s, d, "events").schema).parquet(_folder(s, d, "events"))
    return P.run_once(P.streamed_state(source, "user_id", ["ts", "event_id"], ["event_type", "value", "props"]), f"{shared(s)}/jobs_{uuid.uuid4().hex}")


def stream_windows(s, d):
    source = s.readStream.schema(table(s, d, "events").schema).parquet(_folder(s, d, "events"))
    out = P.run_once(P.windowed_counts(source, "ts", "event_type"), f"{shared(s)}/days_{uuid.uuid4().hex}")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_jobs(s, d):
    """Events as updates of jobs, in four micro-batches; purchases and errors end a job, which is evicted six hours after its last update."""
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("running")
    own = table(s, d, "events").withColumn("status", status).withColumn("step", F.col("event_id") % 7 - 2)
    folder = f"{shared(s)}/life_{uuid.uuid4().hex}"
    changes = W.job_changes(P.in_slices(own, "ts", 4, f"{folder}.slices"), "user_id", "ts", "event_id", ["status", "event_type", "value", "props"], "step", ttl_seconds=6 * 3600)
    return W.jobs_of(P.run_all(changes, folder), "user_id")


def _folder(s, d, name):
    """A pattern that a streaming source takes for a table that is one file or a folder of files."""
    return f"{d}/{name}.parquet" if len(table(s, d, name).inputFiles()) > 1 else f"{d}/{name}.parque[t]"


QUERIES = {
    "d06_exact_dedup": exact_dedup, "d04_greedy_near_dup": greedy_dedup, "d03_greedy_with_answer": greedy_with_answer, "j06_vs_stored": vs_stored,
    "g04_running_headers": running_headers, "g06_line_headings": line_headings, "g05_unit_split": unit_split,
    "p01_latest_state": latest_state, "p03_ttl_evict": ttl_evict, "p04_progress": progress, "p01_stream_state": stream_state, "p11_stream_windows": stream_windows,
    "p03_stream_jobs": stream_jobs,
}

_LATEST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props, max(ts) AS updated_at FROM events GROUP BY user_id"
ORACLES = {
    "d06_exact_dedup": r"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))",
    "g06_line_headings": r"""
WITH b AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents),
l AS (SELECT doc_id, 1 AS lesson_no, '1' AS lesson_number, trim(t) AS t FROM b UNION ALL SELECT doc_id, 2, 'IV', trim(t) FROM b)
SELECT doc_id, lesson_no, lesson_number, length(t)::int AS n FROM l WHERE length(t) > 30""",
    "g05_unit_split": """
WITH p AS (SELECT page_id % 5 AS doc, page_id // 5 AS page_no, count(*) OVER (PARTITION BY page_id % 5) AS n FROM pages)
SELECT doc, (page_no // 4 + 1)::int AS lesson_no, (page_no + 1)::int AS start_page, least(page_no + 4, n)::int AS end_page FROM p WHERE page_no % 4 = 0""",
    "p01_latest_state": _LATEST,
    "p01_stream_state": _LATEST,
    "p03_ttl_evict": """
WITH s AS (SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN 'done' ELSE 'running' END, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY user_id)
SELECT * FROM s WHERE NOT (status = 'done' AND updated_at < TIMESTAMP '2024-01-30 17:00:00')""",
    "p03_stream_jobs": """
WITH e AS (SELECT *, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS status FROM events),
n AS (SELECT *, coalesce(lag(status) OVER w IN ('done', 'error') AND us - lag(us) OVER w > 21600000000, false)::int AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS job FROM n),
g AS (
  SELECT user_id, job, min(us) AS started, count(*) AS updates, arg_max(status, (us, event_id)) AS status, arg_max(event_type, (us, event_id)) AS event_type, arg_max(value, (us, event_id)) AS value,
         arg_max(props, (us, event_id)) AS props, sum(greatest(event_id % 7 - 2, 0))::bigint AS delivered, max(us) AS updated FROM j GROUP BY user_id, job)
SELECT user_id, started, updates, status, event_type, value, props, delivered, updated,
       job = max(job) OVER (PARTITION BY user_id) AND NOT (status IN ('done', 'error') AND (SELECT max(us) FROM e) - updated > 21600000000) AS open FROM g""",
    "p04_progress": "SELECT user_id, event_id, event_id % 7 - 2 AS step, sum(greatest(event_id % 7 - 2, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::bigint AS delivered FROM events",
    "p11_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
