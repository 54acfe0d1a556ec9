"""Side effects at the edges: model calls with repair, pushes to an external service, printed summaries.

Adapters are callables, so the deterministic core is tested with fakes. Calls run per batch on the executors; results come back as rows.
"""

from __future__ import annotations

import collections
import contextlib
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import questions as Q
from lectern.functions import text as X
from lectern.operators.dml import by_number_in_text, last_of
from lectern.operators.relational import not_in
from lectern.sources import push

_DELAY = re.compile(r"retryDelay['\"]?\s*:\s*['\"]?(\d+)")


class RateLimited(Exception):
    """The service asks to wait; the message may say how long."""


class UnknownModel(Exception):
    """The service does not know the model."""


def with_retries(call: Callable[[str, str], str], model: str, fallback: str, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A model call that falls back once for an unknown model and waits as told, or longer each time, when limited."""

    def run(prompt: str) -> str:
        used, attempt = model, 0
        while True:
            try:
                return call(prompt, used)
            except UnknownModel:
                if used == fallback:
                    raise
                used = fallback
            except RateLimited as e:
                if attempt >= retries:
                    raise
                told = _DELAY.search(str(e))
                sleep(int(told[1]) + 1 if told else 2 * (attempt + 1))
                attempt += 1

    return run


class Call(threading.Thread):
    """One call that can be given up: the thread is a daemon, and a reply after the deadline is never read."""

    def __init__(self, call: Callable[[str], str], prompt: str, seconds: float):
        super().__init__(daemon=True)
        self.call, self.prompt, self.reply = call, prompt, None
        self.until = time.monotonic() + seconds
        self.start()

    def run(self) -> None:
        with contextlib.suppress(Exception):  # an empty reply is the defined result of any failure
            self.reply = self.call(self.prompt)

    def result(self, empty: str) -> str:
        self.join(max(0.0, self.until - time.monotonic()))
        return empty if self.reply is None or self.is_alive() else self.reply


def bounded(call: Callable[[str], str], prompts: Iterable[str], at_once: int, seconds: float, until: float | None = None, empty: str = "") -> Iterator[str]:
    """Replies in the order of the prompts; at most ``at_once`` calls are waited for at a time, each for at most ``seconds`` and none beyond ``until`` (a time.time())."""
    waiting: collections.deque[Call | None] = collections.deque()
    for prompt in prompts:
        if len(waiting) == at_once:
            yield _reply(waiting.popleft(), empty)
        left = seconds if until is None else min(seconds, until - time.time())
        waiting.append(Call(call, prompt, left) if left > 0 else None)
    while waiting:
        yield _reply(waiting.popleft(), empty)


def _reply(call: Call | None, empty: str) -> str:
    return empty if call is None else call.result(empty)


def replies(prompts: DataFrame, call: Callable[[str], str], at_once: int = 2, seconds: float = 90, job_seconds: float | None = None, tasks: int = 1, empty: str = "") -> DataFrame:
    """The columns of prompts, ``prompt`` turned into ``reply``, in ``tasks`` tasks that share ``at_once`` calls at a time.

    A call that fails, takes longer than ``seconds``, or would go on after the job's ``job_seconds`` gives the empty reply; the job's time begins now. A task that is run again
    makes its calls again, so the result is to be checkpointed before it is read twice.
    """
    until = None if job_seconds is None else time.time() + job_seconds
    each = max(1, at_once // tasks)
    kept = [c for c in prompts.columns if c != "prompt"]
    schema = T.StructType([*(prompts.schema[c] for c in kept), T.StructField("reply", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[kept].assign(reply=list(bounded(call, batch["prompt"], each, seconds, until, empty)))

    return prompts.repartition(tasks).mapInPandas(run, schema)


def repaired(originals: DataFrame, fixes: DataFrame, key: str, fields: list[str], accept: Column) -> DataFrame:
    """Fixed fields where a fix exists and is accepted (``accept`` may use fixed_<field>), else the original; rows in = rows out."""
    new = fixes.select(F.col(key), F.lit(True).alias("_fixed"), *(F.col(c).alias(f"fixed_{c}") for c in fields))
    both = originals.join(new, key, "left")
    take = F.coalesce(F.col("_fixed") & accept, F.lit(False))
    return both.select(*(F.when(take, F.col(f"fixed_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in originals.columns))


def to_push(bank: DataFrame, log: DataFrame, exam_type: str, force: bool = False) -> DataFrame:
    """Rows to push: without those that were pushed with success for this exam type, unless forced."""
    if force:
        return bank
    return not_in(bank, log.filter((F.col("exam_type") == exam_type) & (F.col("status") == "success")), "dy_ques_id", "dy_ques_id")


def in_push_order(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order in which they are pushed: by the whole number in dy_order (0 without one), then as they were numbered by id."""
    return by_number_in_text(rows, "place", "dy_order", "id")


def pushed(rows: DataFrame, exam_type: str, exam_code: str, post: Callable[[dict], tuple[int, str]], folder: str, at_once: int = 1) -> DataFrame:
    """dy_ques_id, ok, detail, place of each row, pushed in push order by ``at_once`` tasks; ``folder`` (shared) keeps what was sent.

    Incomplete payloads are not sent and fail with the names of the missing fields. The push runs once, when this is called; the result is a table.
    """
    fields = Q.payload(F.lit(exam_type), F.lit(exam_code))
    ready = in_push_order(rows).select("place", *(c.alias(k) for k, c in fields.items())).withColumn("missing", F.array_join(Q.missing(), ","))
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    sent = push.push(ready.select(F.col("quesId").alias("key"), "place", "missing", payload.alias("payload")), post, folder, at_once)
    return sent.select("dy_ques_id", F.coalesce(Q.succeeded(F.col("http_status").between(200, 299), F.col("detail")), F.lit(False)).alias("ok"), "detail", "place")


def push_log(results: DataFrame, exam_type: str) -> DataFrame:
    """Log rows of push results, the last one in push order for each question."""
    last = last_of(results, ["dy_ques_id"], [F.col("place"), F.col("ok"), F.col("detail")])
    return last.select("dy_ques_id", F.lit(exam_type).alias("exam_type"), F.when(F.col("ok"), "success").otherwise("failed").alias("status"), F.col("detail").alias("response_detail"))


def push_report(results: DataFrame, skipped: int = 0) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("pushed"), F.count_if(~F.col("ok")).alias("failed")).withColumn("skipped", F.lit(skipped))


def printed_bullets(summaries: DataFrame) -> DataFrame:
    """(lesson_number, lesson_name, bullet_no, bullet) as a printed summary lists them: escaped, in lesson order."""
    own = summaries.filter(F.col("lesson_number") != "OVERALL").select("id", "lesson_number", "lesson_name", F.posexplode(F.from_json("bullets", "array<string>")).alias("at", "b"))
    return own.select("id", "lesson_number", "lesson_name", (F.col("at") + 1).alias("bullet_no"), X.escape_html(X.print_math(F.col("b"))).alias("bullet"))


def coverage(bullets: DataFrame, printed: Column) -> DataFrame:
    """Share of bullets whose first 30 characters occur in the printed text, ignoring case."""
    found = F.contains(F.lower(printed), F.lower(F.substring("bullet", 1, 30)))
    counts = bullets.agg(F.count(F.lit(1)).alias("total"), F.count_if(found).alias("found"))
    return counts.withColumn("coverage_ratio", F.round(F.col("found") / F.greatest(F.lit(1), F.col("total")), 4))
