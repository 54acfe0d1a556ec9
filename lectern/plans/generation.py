"""From model replies to numbered question rows, as one deterministic plan.

Order is (window, chunk, position), so which of two near duplicates stays does not depend on arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import jsonio as J
from lectern.functions import numbers as N
from lectern.functions import questions as Q
from lectern.functions import scripts as S
from lectern.functions import text as T
from lectern.operators import dedup as D
from lectern.operators import dml as K
from lectern.operators.relational import same


def questions_of(replies: DataFrame) -> DataFrame:
    """Questions of replies (window_no, chunk_no, reply and any others): an array, or an object with ``questions``; unreadable replies give none."""
    kind = "array<struct<question:string,options:map<string,string>,answer:string,correct_answer_text:string,explanation:string,pattern:int>>"
    text = J.parsed(F.col("reply"))
    inner = F.when(text.startswith("["), text).otherwise(F.get_json_object(text, "$.questions"))
    others = [c for c in replies.columns if c != "reply"]
    return replies.select(*others, F.posexplode(F.from_json(inner, kind)).alias("position", "q")).select(*others, "position", "q.*")


def sifted(questions: DataFrame, language: str, scope: tuple[str, ...] = (), kept: DataFrame | None = None) -> DataFrame:
    """Questions with status ok, duplicate or malformed; the ok ones cleaned, with an explanation.

    Of each scope (all rows without one) the first by place stay, and none that is alike one of ``kept`` (key, answer_text and the scope). ``place`` is made of window, chunk and position where it is not there.
    """
    q, o, e = F.col("question"), F.col("options"), F.col("explanation")
    bad = ~Q.valid(q, o, F.col("answer")) | Q.corrupted(q, e, o, language) | F.exists(Q.fields(q, e, o), lambda x: T.names_source(x))
    clean = lambda c: T.clean_math(S.clean_extraction(c))
    options = F.map_from_arrays(F.array(*map(F.lit, Q.LETTERS)), F.array(*(clean(F.try_element_at(o, F.lit(x))) for x in Q.LETTERS)))
    rows = questions.withColumn("bad", bad).withColumns({"question": F.when(~bad, clean(q)).otherwise(q), "options": F.when(~bad, options).otherwise(o)})
    rows = rows.withColumn("explanation", F.when(F.trim(F.coalesce(e, F.lit(""))) != "", clean(e)).otherwise(Q.with_default_explanation(e, F.col("options"), F.col("answer"))))
    if "place" not in questions.columns:
        rows = rows.withColumn("place", F.format_string("%010d.%010d.%010d", "window_no", "chunk_no", "position"))
    rows = rows.withColumn("key", T.normal_key(F.col("question"))).withColumn("answer_text", Q.answer_text(F.col("options"), F.col("answer")))
    names = list(scope) or ["_all"]
    own = rows.filter("NOT bad").select(*scope, *([] if scope else [F.lit(0).alias("_all")]), "place", "key", "answer_text")
    before = None
    if kept is not None:
        stored = kept if scope else kept.withColumn("_all", F.lit(0))
        before = D.against_stored(own, stored, names, "place", "key", "answer_text", with_answer=D.WITH_ANSWER).filter("duplicate").select(*names, "place").checkpoint()
        own = own.join(before.withColumnsRenamed({c: f"_b_{c}" for c in before.columns}), same([*names, "place"], "_b_"), "left_anti")
    status = D.greedy(own, names, "place", "key", "answer_text", with_answer=D.WITH_ANSWER)
    if before is not None:
        status = status.unionByName(before.withColumn("status", F.lit("duplicate")))
    columns = [*scope, "place"]
    both = rows.join(status.select(*(F.col(c).alias(f"_s_{c}") for c in columns), "status"), same(columns, "_s_"), "left")
    named = F.when(F.col("bad") | (F.col("status") == "empty"), "malformed").when(F.col("status") == "kept", "ok").otherwise("duplicate")
    return both.withColumn("status", named).drop(*(f"_s_{c}" for c in columns), "bad", "position")


def bank_rows(kept: DataFrame, prefix: str, dy_code: str, last: int = 0) -> DataFrame:
    """Numbered rows for the bank: ids, order, language code and constants."""
    numbered = K.numbered(kept, "order", [F.col("place")], F.lit(last))
    option = lambda x: F.try_element_at(F.col("options"), F.lit(x))
    return numbered.select(
        F.concat(F.lit(prefix), N.padded(F.col("order"))).alias("dy_ques_id"), F.lit(dy_code).alias("dy_code"),
        F.when(F.col("question").rlike("[஀-௿]"), "LN01").otherwise("LN02").alias("ln_code"), F.col("order").cast("string").alias("dy_order"),
        F.lit("1").alias("dy_pattern"), F.lit("18").alias("dy_seconds"), F.col("question").alias("dy_question"),
        *(option(x).alias(f"dy_ans_{n}") for n, x in enumerate(Q.LETTERS, 1)), N.letter_number(F.col("answer")).cast("string").alias("dy_correct_ans"), F.col("explanation").alias("dy_explain"),
    )


def generated(replies: DataFrame, language: str, prefix: str, dy_code: str, count: int, last: int = 0) -> DataFrame:
    """The first ``count`` kept questions of all replies as bank rows."""
    kept = sifted(questions_of(replies), language).filter("status = 'ok'").orderBy("place").limit(count)
    kept = kept.withColumn("answer", Q.consistent_answer(F.col("options"), F.col("answer"), F.col("correct_answer_text")))
    return bank_rows(kept, prefix, dy_code, last)
