"""Text, question and JSON queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import jsonio as J
from lectern.functions import numbers as N
from lectern.functions import questions as Q
from lectern.functions import text as T
from lectern.operators import sections as S
from lectern.operators import segment as G
from lectern.operators.relational import top_k
from lectern.sources.tables import table


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def normal_key(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.normal_key(F.col("text")).cast("binary")).alias("key_digest"))


def significant_words(s, d):
    return _docs(s, d).select("doc_id", F.size(T.significant_words(F.col("text"))).alias("n_words"))


def _asked(s, d):
    """Questions made of whole documents: the options are the quarters of the words, the answer goes by the id, and the second quarter is stated."""
    docs = _docs(s, d).select("doc_id", "text", F.split("text", r"\s+").alias("w"))
    docs = docs.withColumn("q", F.ceil(F.size("w") / 4).cast("int"))
    part = lambda i: F.array_join(F.slice("w", i * F.col("q") + 1, F.col("q")), " ")
    options = F.map_from_arrays(F.array(*map(F.lit, "ABCD")), F.array(*(part(i) for i in range(4))))
    answer = F.substring(F.lit("ABCDE"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1))
    return docs.select("doc_id", "text", options.alias("options"), answer.alias("answer"), F.concat(part(1), F.lit("  ")).alias("stated"))


def answer_text(s, d):
    text = Q.answer_text(F.col("options"), F.col("answer"))
    return _asked(s, d).select("doc_id", "answer", F.md5(text.cast("binary")).alias("digest"))


def consistent_answer(s, d):
    return _asked(s, d).select("doc_id", Q.consistent_answer(F.col("options"), F.col("answer"), F.col("stated")).alias("answer"))


def valid_question(s, d):
    return _asked(s, d).select("doc_id", Q.valid(F.col("text"), F.col("options"), F.col("answer")).alias("valid"))


def strip_sections(s, d):
    own = S.stripped(table(s, d, "documents").select("doc_id", F.concat("text", F.lit("\nChapter 9\nlast line")).alias("text")), "doc_id", "text", "(?i)^.*[0-9%|!].*$", r"(?i)^\s*chapter\s*\d+")
    return own.select("doc_id", F.length("text").alias("left"), F.md5(F.col("text").cast("binary")).alias("digest"))


def bullets(s, d):
    return S.bullets(_docs(s, d), "doc_id", "text").select("doc_id", "line_no", F.md5(F.col("bullet").cast("binary")).alias("digest"))


def print_math(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.print_math(F.col("text")).cast("binary")).alias("digest"))


def math_format(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn")
    formula = F.concat(F.lit("x"), (F.col("turn") % 9 + 1).cast("string"), F.lit(" plus y equals "), F.col("conv_id").cast("string"), F.lit(" divided by a+b minus \\alpha_{2} and z bar"))
    return said.select("conv_id", "turn", T.clean_math(formula).alias("formula"))


def escape_html(s, d):
    return table(s, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html")).cast("binary")).alias("digest"))


def first_number(s, d):
    return table(s, d, "pages").select("page_id", N.first_number(F.col("url")).alias("seconds"))


def lenient_numbers(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(" "))).otherwise("none").alias("raw"))
    return said.select("conv_id", "turn", N.digits_or(F.col("raw"), 18).alias("seconds"))


def payload(s, d):
    docs = table(s, d, "documents").select(
        F.col("doc_id").cast("string").alias("dy_ques_id"), "doc_id", F.col("source").alias("dy_code"), F.lit("LN02").alias("ln_code"), (F.col("n_chars") % 50).cast("string").alias("dy_order"),
        F.lit(None).cast("string").alias("dy_pattern"), F.concat((F.col("n_chars") % 90).cast("string"), F.lit(" sec")).alias("dy_seconds"), F.col("text").alias("dy_question"),
        F.lit("a").alias("dy_ans_1"), F.lit("b").alias("dy_ans_2"), F.lit("c").alias("dy_ans_3"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("d").alias("dy_ans_4"),
        F.substring(F.lit("ABCDx"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1)).alias("dy_correct_ans"), F.lit(None).cast("string").alias("dy_explain"),
    )
    own = docs.select("doc_id", *(c.alias(k) for k, c in Q.payload(F.lit("2"), F.lit("")).items()))
    return own.select("doc_id", "examCode", "qsOrder", "qsPattern", "qsSeconds", "crtAns", F.md5(F.col("qsQuestion").cast("binary")).alias("question"), F.array_join(Q.missing(), ",").alias("missing"))


def missing_fields(s, d):
    docs = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise("x").alias("quesId"), F.when(F.col("doc_id") % 5 != 0, "y").alias("option1"))
    return docs.select("doc_id", F.array_join(Q.missing(("quesId", "option1")), ",").alias("missing"))


def wrong_script(s, d):
    return _docs(s, d).select("doc_id", T.wrong_script(F.col("text")).alias("foreign"), T.wrong_script(F.col("text"), "À-ÿ").alias("beyond_latin"))


def stray_words(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.stray_latin(F.col("text")).alias("stray"))


def source_refs(s, d):
    """Documents with the name of their source for a phrase between two copies of their text."""
    said = F.concat_ws(" ", "text", F.element_at(F.array(*(F.lit(x) for x in _SAID)), (F.col("doc_id") % len(_SAID) + 1).cast("int")), "text")
    return table(s, d, "documents").select("doc_id", T.names_source(said).alias("names_source"))


def generic_header(s, d):
    rows = S.lines(_docs(s, d), "doc_id", "text")
    return rows.select("doc_id", "line_no", T.generic_header(F.col("line")).alias("generic"))


def unusable(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.unusable(F.col("text")).alias("unusable"))


def classify_reply(s, d):
    body = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"Status":"'), F.when(F.col("event_id") % 2 == 0, "Duplicate").otherwise("created"), F.lit('"}')))
        .when(F.col("event_id") % 5 == 1, F.lit('{"success":false}'))
        .when(F.col("event_id") % 5 == 2, F.lit('{"message":"created"}'))
        .when(F.col("event_id") % 5 == 3, F.lit('{"status":1}'))
        .otherwise(F.lit("plain text"))
    )
    return table(s, d, "events").select("event_id", Q.succeeded(F.col("value") > 10, body).alias("ok"))


def missing_topics(s, d):
    """Lines of a document that are missing from the conversation of the same number: as titles of sections, with their numbers as codes."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1001).cast("string").alias("code"), x.alias("title")))
    docs = _docs(s, d).select("doc_id", lines.alias("sections"))
    blob = table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")).alias("blob"))
    missing = G.missing_topics(F.col("sections"), F.col("blob"), None)
    return docs.join(blob, "doc_id").select("doc_id", F.array_join(F.transform(missing, lambda x: x["code"]), ",").alias("missing"))


def json_parse(s, d):
    """Replies as models write them: in a fence, with a comma too many, with words around, and with a line break inside a text."""
    props, kind = F.col("props"), F.col("event_id") % 4
    fenced = F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```"))
    torn = F.regexp_replace(props, r"^\{", '{"note":"two\nlines",')
    raw = F.when(kind == 0, fenced).when(kind == 1, F.regexp_replace(props, r"\}$", ",}")).when(kind == 2, F.concat(F.lit("Sure: "), props, F.lit(" ok"))).otherwise(torn)
    return table(s, d, "events").select("event_id", F.get_json_object(J.parsed(raw), "$.k").try_cast("bigint").alias("k"))


def to_json(s, d):
    return table(s, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("json"))


def page_split(s, d):
    """Whole texts with a page mark before every 300 characters."""
    count = F.greatest(F.lit(1), F.ceil(F.length("text") / 300).cast("int"))
    page = lambda i: F.concat(F.lit("=== PAGE "), i.cast("string"), F.lit(" ===\n"), F.substring(F.col("text"), i * 300 - 299, F.lit(300)))
    own = S.pages(_docs(s, d).withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), count), page), "\n")), "doc_id", "text")
    return own.select("doc_id", "num", F.md5(F.regexp_replace("text", r"\s+", " ").cast("binary")).alias("digest"), F.size("lines").alias("n_lines"))


def subsections(s, d):
    """Sections whose marks stand before, inside and behind real text; titles run on over line ends."""
    body = F.concat(F.lit("3.1 First part\n"), F.col("text"), F.lit("\n3.2.1 Second, part\n4.1 Other\n"), F.col("text"), F.lit("\n 3.4 Last"))
    return _docs(s, d).select("doc_id", F.inline(G.subsections(F.lit("3"), body))).toDF("doc_id", "code", "title")


def line_top(s, d):
    """The three longest lines of a document."""
    rows = S.lines(_docs(s, d), "doc_id", "text").select("doc_id", "line_no", F.length("line").alias("n"))
    return top_k(rows, ["doc_id"], [F.desc("n"), F.col("line_no")], 3)


_SAID = ("as per the text", "in this page we", "that was given", "the source says so", "from above the notes", "based on the material", "no such phrase")
QUERIES = {
    "t01_normalize_key": normal_key, "t02_math_format": math_format, "t06_consistent_answer": consistent_answer, "t07_significant_words": significant_words,
    "t08_answer_text": answer_text, "t09_strip_sections": strip_sections, "t10_json_parse": json_parse, "t11_bullets": bullets, "t12_pdf_math": print_math,
    "t18_subsections": subsections, "t19_to_json": to_json, "t20_escape_html": escape_html, "n01_digits_or": lenient_numbers, "n02_first_number": first_number,
    "f09_payload": payload, "f10_missing_fields": missing_fields, "f11_valid_question": valid_question, "f12_script": wrong_script, "f13_stray_words": stray_words,
    "f16_source_refs": source_refs, "f17_generic_header": generic_header, "f19_classify": classify_reply, "f20_missing_topics": missing_topics,
    "s08_unusable": unusable, "g01_page_split": page_split, "l01_longest_lines": line_top,
}

_Q = r"""WITH s AS (SELECT doc_id, text, regexp_split_to_array(text, '\s+') AS w FROM documents),
w AS (SELECT *, ceil(len(w) / 4)::int AS q FROM s),
q AS (SELECT doc_id, text, array_to_string(w[1:q], ' ') AS a, array_to_string(w[q + 1:2 * q], ' ') AS b, array_to_string(w[2 * q + 1:3 * q], ' ') AS c, array_to_string(w[3 * q + 1:4 * q], ' ') AS d,
  substr('ABCDE', (doc_id % 5 + 1)::int, 1) AS answer FROM w),
o AS (SELECT *, CASE answer WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d END AS chosen FROM q)"""
ORACLES = {
    "t01_normalize_key": r"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS key_digest FROM documents",
    "t02_math_format": r"""
SELECT conv_id, turn, 'x_' || (turn % 9 + 1) || ' + y = ' || conv_id || ' / (a+b) - α_2 and z' || chr(773) AS formula FROM conversations""",
    "t06_consistent_answer": _Q + r"""
SELECT doc_id, CASE WHEN chosen IS NULL OR lower(trim(chosen)) = lower(trim(b)) THEN answer WHEN lower(trim(a)) = lower(trim(b)) THEN 'A' ELSE 'B' END AS answer FROM o""",
    "t07_significant_words": None,
    "t08_answer_text": _Q + " SELECT doc_id, answer, md5(trim(coalesce(lower(chosen), ''))) AS digest FROM o",
    "t09_strip_sections": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || 'Chapter 9' || chr(10) || 'last line', chr(10))) AS line, generate_subscripts(string_split(text || chr(10) || 'Chapter 9' || chr(10) || 'last line', chr(10)), 1) AS n FROM documents),
m AS (SELECT *, regexp_matches(line, '(?i)^.*[0-9%|!].*$') AS opens, regexp_matches(line, '(?i)^\s*chapter\s*\d+') AS closes FROM l),
r AS (SELECT *, coalesce(min(CASE WHEN closes THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1 + count(*) OVER (PARTITION BY doc_id)) AS until FROM m),
k AS (SELECT doc_id, line, n FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND o.opens AND o.n <= r.n AND r.n < o.until))
SELECT d.doc_id, length(coalesce(t, ''))::int AS "left", md5(coalesce(t, '')) AS digest FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM k GROUP BY doc_id) USING (doc_id)""",
    "t10_json_parse": "SELECT event_id, (props::json ->> '$.k')::bigint AS k FROM events",
    "t11_bullets": r"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
b AS (SELECT *, trim(regexp_extract(line, '^(?:(?:\d+[\.\)]|[-*•–—])\s+|"[0-9]+\.\s*)(.+)$', 1), '", ') AS item, trim(line, '", ') AS loose,
  regexp_matches(line, '^(?:(?:\d+[\.\)]|[-*•–—])\s+|"[0-9]+\.\s*)(.+)$') AS listed FROM l
  WHERE line <> '' AND NOT regexp_matches(line, '(?i)^(?:lesson\s+\d+|chapter\s+\d+|unit\s+\d+|complete\s+pdf|overall|document:)')),
o AS (SELECT doc_id, line_no::int AS line_no, CASE WHEN listed THEN CASE WHEN length(item) > 10 THEN item END
  WHEN starts_with(line, '"') AND ends_with(line, '"') AND length(line) > 15 THEN trim(line, '"')
  WHEN NOT regexp_matches(line, '^[{}\[]') AND NOT ends_with(line, ']') AND length(line) > 25 AND loose <> '' AND NOT ends_with(loose, '{') THEN loose END AS bullet FROM b)
SELECT doc_id, line_no, md5(bullet) AS digest FROM o WHERE bullet IS NOT NULL""",
    "t12_pdf_math": r"""
SELECT doc_id, md5(trim(regexp_replace(replace(regexp_replace(regexp_replace(text, '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '$', ''), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents""",
    "t18_subsections": r"""
WITH b AS (SELECT doc_id, '3.1 First part' || chr(10) || text || chr(10) || '3.2.1 Second, part' || chr(10) || '4.1 Other' || chr(10) || text || chr(10) || ' 3.4 Last' AS t FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?m)^\s*(3(?:\.\d+)+)\s+([A-Za-z\x{B80}-\x{BFF}\s,\-]{3,80})', 1)) AS code,
  unnest(regexp_extract_all(t, '(?m)^\s*(3(?:\.\d+)+)\s+([A-Za-z\x{B80}-\x{BFF}\s,\-]{3,80})', 2)) AS title FROM b)
SELECT doc_id, code, regexp_replace(title, '^\s+|\s+$', '', 'g') AS title FROM m""",
    "t19_to_json": """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS json FROM events""",
    "t20_escape_html": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""",
    "n01_digits_or": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn ELSE 18 END AS seconds FROM conversations",
    "n02_first_number": r"SELECT page_id, coalesce(round_even(try_cast(nullif(regexp_extract(url, '-?[0-9]+(?:\.[0-9]+)?'), '') AS double), 0)::bigint, 60) AS seconds FROM pages",
    "f09_payload": """
SELECT doc_id, source AS "examCode", (n_chars % 50)::varchar AS "qsOrder", '1' AS "qsPattern", n_chars % 90 AS "qsSeconds",
       CASE WHEN doc_id % 5 = 4 THEN 1 ELSE (doc_id % 5 + 1)::int END AS "crtAns", md5(text) AS question, CASE WHEN doc_id % 4 = 0 THEN 'option4' ELSE '' END AS missing FROM documents""",
    "f10_missing_fields": "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'quesId' END, CASE WHEN doc_id % 5 = 0 THEN 'option1' END) AS missing FROM documents",
    "f11_valid_question": _Q + " SELECT doc_id, text <> '' AND a <> '' AND b <> '' AND c <> '' AND d <> '' AND answer <> 'E' AS valid FROM o",
    "f12_script": r"""
SELECT doc_id, regexp_matches(text, '[^\x00-\x7F‘’“”–—…\x{A0}\x{200C}\x{200D}×÷−±°′″√π¼½¾²³₹]') AS foreign,
       regexp_matches(text, '[^\x00-\x7F‘’“”–—…\x{A0}\x{200C}\x{200D}×÷−±°′″√π¼½¾²³₹À-ÿ]') AS beyond_latin FROM documents""",
    "f13_stray_words": """
SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '[A-Za-z]{2,}'), lambda w: upper(w) NOT IN ('CM','MM','KM','KG','GM','ML','HZ','DNA','RNA','PH','AC','DC','AM','PM','ID'))) > 0 AS stray FROM conversations""",
    "f16_source_refs": None,
    "f17_generic_header": r"""
WITH h AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS h, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int AS line_no FROM documents)
SELECT doc_id, line_no, length(h) < 3 OR length(h) > 80 OR regexp_matches(h, '^[0-9]+$') OR regexp_matches(h, '""" + T.R.GENERIC_HEADER + r"""') AS generic FROM h""",
    "f19_classify": """
SELECT event_id, CASE WHEN NOT value > 10 THEN false WHEN event_id % 5 = 0 THEN event_id % 2 <> 0 WHEN event_id % 5 IN (1, 2) THEN false ELSE true END AS ok FROM events""",
    "f20_missing_topics": """
WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) + 1000 AS code FROM documents),
b AS (SELECT conv_id AS doc_id, lower(string_agg(text, ' ' ORDER BY turn)) AS blob FROM conversations GROUP BY conv_id),
m AS (SELECT doc_id, code FROM w JOIN b USING (doc_id)
  WHERE len(list_filter(regexp_extract_all(lower(line), '[a-z]{4,}'), lambda x: contains(blob, x))) = 0 AND NOT contains(blob, code::varchar))
SELECT doc_id, coalesce(missing, '') AS missing FROM (SELECT DISTINCT doc_id FROM w JOIN b USING (doc_id)) d
LEFT JOIN (SELECT doc_id, string_agg(code::varchar, ',' ORDER BY code) AS missing FROM m GROUP BY doc_id) g USING (doc_id)""",
    "s08_unusable": r"""
WITH c AS (SELECT conv_id, turn, trim(text) AS t FROM conversations),
n AS (SELECT *, length(t) AS n, len(regexp_extract_all(t, '[\x{80}-\x{ff}]')) AS high, len(regexp_extract_all(t, '[a-zA-Z]{2,}')) AS words FROM c)
SELECT conv_id, turn, n < 30 OR (high > 10 AND high > n * 0.12) OR (words < 5 AND n > 20) AS unusable FROM n""",
    "g01_page_split": r"""
WITH n AS (SELECT doc_id, text, unnest(range(1, greatest(1, ceil(length(text) / 300)::int) + 1)) AS num FROM documents),
p AS (SELECT doc_id, num, substr(text, num * 300 - 299, 300) AS t FROM n)
SELECT doc_id, num::int AS num, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS digest, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''))::int AS n_lines FROM p""",
    "l01_longest_lines": """
WITH l AS (SELECT doc_id, length(unnest(string_split(text, chr(10))))::int AS n, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int AS line_no FROM documents)
SELECT doc_id, line_no, n FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line_no) <= 3""",
}
ORACLES["t07_significant_words"] = (
    "SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(replace(text, '-', '')), '[a-zA-Z0-9]+'), "
    "lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.R.STOP_WORDS) + "))))::int AS n_words FROM documents"
)
ORACLES["f16_source_refs"] = (
    "SELECT doc_id, regexp_matches(text || ' ' || [" + ", ".join(f"'{x}'" for x in _SAID) + f"][doc_id % {len(_SAID)} + 1] || ' ' || text, '(?i)"
    + "|".join(T.R.SOURCE_PHRASES) + "') AS names_source FROM documents"
)
