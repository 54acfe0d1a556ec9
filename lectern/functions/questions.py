"""Predicates and projections of questions, payloads and push replies, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions import rules as R
from lectern.functions import scripts as S
from lectern.functions import text as T

LETTERS = ("A", "B", "C", "D")


def valid(question: Column, options: Column, answer: Column) -> Column:
    """A question text, four non-empty options A-D and an answer among them."""
    full = reduce(lambda a, b: a & b, (F.coalesce(F.try_element_at(options, F.lit(x)), F.lit("")) != "" for x in LETTERS))
    return (F.coalesce(question, F.lit("")) != "") & full & F.coalesce(answer.isin(*LETTERS), F.lit(False))


def fields(question: Column, explanation: Column, options: Column) -> Column:
    return F.filter(F.concat(F.array(question, explanation), F.coalesce(F.map_values(options), F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))


def corrupted(question: Column, explanation: Column, options: Column, language: str) -> Column:
    """Wrong script in any field; for Tamil stray Latin words too."""
    allowed = R.SCRIPTS.get(language, "")
    bad = (lambda x: T.wrong_script(x, allowed) | T.stray_latin(x)) if language == "Tamil" else (lambda x: T.wrong_script(x, allowed))
    return F.exists(fields(question, explanation, options), bad)


def record_corrupted(*texts: Column) -> Column:
    """Stored rows: the language is that of all fields together; only Tamil rows can be corrupted."""
    own = F.filter(F.array(*texts), lambda x: x.isNotNull() & (x != ""))
    tamil = T.language_of(F.array_join(own, " ")) == "Tamil"
    return tamil & F.exists(own, lambda x: T.wrong_script(x, R.SCRIPTS["Tamil"]))


def answer_text(options: Column, answer: Column) -> Column:
    """The comparison key of the chosen option, '' without one."""
    return T.normal_key(F.try_element_at(options, answer))


def consistent_answer(options: Column, answer: Column, stated: Column) -> Column:
    """The first letter whose option equals the stated answer text, where the chosen one doesn't; else the answer as it is."""
    same = F.filter(F.map_entries(options), lambda e: T.normal_key(e["value"]) == T.normal_key(stated))
    wrong = (F.coalesce(stated, F.lit("")) != "") & F.coalesce(F.map_contains_key(options, answer), F.lit(False)) & (answer_text(options, answer) != T.normal_key(stated))
    return F.coalesce(F.when(wrong, F.get(same, F.lit(0))["key"]), answer)


def with_default_explanation(explanation: Column, options: Column, answer: Column) -> Column:
    return F.when(F.trim(F.coalesce(explanation, F.lit(""))) != "", explanation).otherwise(F.concat(F.lit("The correct answer is "), F.try_element_at(options, answer), F.lit(".")))


def payload(exam_type: Column, exam_code: Column) -> dict[str, Column]:
    """The fourteen fields of a pushed question, from the bank's columns."""
    c = F.col
    whole = lambda x: F.when(x.rlike("^[0-9]+$"), F.coalesce(x.try_cast("bigint").cast("string"), x)).otherwise(x)
    return {
        "examType": exam_type, "examCode": F.coalesce(F.nullif(exam_code, F.lit("")), c("dy_code")), "quesId": c("dy_ques_id"), "lnCode": c("ln_code"),
        "qsOrder": whole(c("dy_order")), "qsPattern": F.coalesce(F.nullif(whole(c("dy_pattern")), F.lit("")), F.lit("1")), "qsSeconds": N.first_number(c("dy_seconds")),
        "qsQuestion": c("dy_question"), "option1": c("dy_ans_1"), "option2": c("dy_ans_2"), "option3": c("dy_ans_3"), "option4": c("dy_ans_4"),
        "crtAns": N.letter_number(c("dy_correct_ans")), "qsExplain": c("dy_explain"),
    }


def missing(required: tuple[str, ...] = R.REQUIRED_PAYLOAD) -> Column:
    """Names of the required fields that are null or empty."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) == "", k) for k in required)))


def succeeded(http_ok: Column, body: Column) -> Column:
    """Whether a push reply counts as success; ``body`` is its JSON text. Keys and their types are those of the outermost object.

    The first known success key with a boolean or a known word decides; else any failure key with a value means failure. Of keys that differ in
    case alone the last one counts.
    """
    entries = F.map_entries(F.from_json(body, "map<string,variant>"))
    known = F.filter(entries, lambda e: F.lower(e["key"]).isin(*R.SUCCESS_KEYS, *R.FAILURE_KEYS))
    facts = F.transform(known, lambda e: F.struct(F.lower(e["key"]).alias("key"), F.schema_of_variant(e["value"]).alias("kind"), e["value"].cast("string").alias("text")))

    def says(fact: Column) -> Column:
        kind, text, word = fact["kind"], fact["text"], F.lower(T.strip(fact["text"]))
        return F.when(kind == "BOOLEAN", text == "true").when((kind == "STRING") & word.isin(*R.SUCCESS_WORDS), True).when((kind == "STRING") & word.isin(*R.FAILURE_WORDS), False)

    def filled(fact: Column) -> Column:
        kind, text = fact["kind"], fact["text"]
        number = F.coalesce(text.try_cast("double") != 0, F.lit(True))
        full = F.when(kind == "VOID", False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.startswith("ARRAY"), text != "[]").when(kind.startswith("OBJECT"), text != "{}")
        return full.otherwise(number)

    def last(own: Column, key: str) -> Column:
        """The last of the facts of a key; null without one."""
        same = F.filter(own, lambda f: f["key"] == key)
        return F.get(same, F.size(same) - 1)

    def judged(own: Column) -> Column:
        """``own`` are the known facts of a reply, read once; null for a reply that is no object."""
        said = F.coalesce(*(T.let(last(own, key), says) for key in R.SUCCESS_KEYS))
        failed = reduce(lambda a, b: a | b, (T.let(last(own, key), lambda f: f.isNotNull() & F.coalesce(filled(f), F.lit(False))) for key in R.FAILURE_KEYS))
        return F.when(own.isNull(), True).otherwise(F.coalesce(said, ~failed))

    return F.when(~http_ok, False).otherwise(T.let(facts, judged))


def cleaned(question: Column) -> Column:
    """A question (struct) with its texts repaired: extraction first, then formulas; options A to D one by one, fields that are null or absent as they are."""
    clean = lambda c: T.clean_math(S.clean_extraction(c))
    own = question["options"]
    lettered = F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.array(*(clean(F.try_element_at(own, F.lit(x))) for x in LETTERS)))
    options = F.map_concat(F.map_filter(lettered, lambda k, _: F.map_contains_key(own, k)), F.map_filter(own, lambda k, _: ~k.isin(*LETTERS)))
    out = question
    for field in ("question", "explanation", "correct_answer_text"):
        out = out.withField(field, F.when(question[field].isNotNull(), clean(question[field])))
    return out.withField("options", options)


def api_row(selected: Column) -> dict[str, Column]:
    """The fields of a stored question as the service shows them."""
    c = F.col
    plain = "id source_filename dy_ques_id dy_code ln_code dy_order dy_question dy_ans_1 dy_ans_2 dy_ans_3 dy_ans_4 dy_correct_ans dy_explain difficulty batch_id board standard group_name subject".split()
    shown = {name: c(name) for name in plain}
    shown |= {"dy_pattern": N.digits_or(c("dy_pattern"), 1), "dy_seconds": N.digits_or(c("dy_seconds"), 18)}
    shown |= {name: F.coalesce(c(name), F.lit("")) for name in ("dy_image_name", "dy_explain_image_name")}
    return shown | {name: N.iso(c(name)) for name in ("created_at", "updated_at")} | {"selected": selected}
