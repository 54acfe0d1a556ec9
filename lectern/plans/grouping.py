"""Aggregation and window queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.operators import aggregates as A
from lectern.operators import windows as W
from lectern.sources.tables import table


def group_quality(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return A.report(rows, ["source", "lang"], {"n_low": F.col("quality") == 0, "n_toxic": F.col("toxic") == 1})


def group_lists(s, d):
    rows = table(s, d, "documents").select("source", "lang", "doc_id")
    return rows.groupBy("source", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))


def global_counts(s, d):
    rows = table(s, d, "labels").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("pushed"), F.count_if(F.col("quality") != 1).alias("failed"))
    return rows.withColumn("ratio", F.round(F.col("pushed") / F.greatest(F.lit(1), F.col("total")), 4))


def _hosts(s, d):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    pages = table(s, d, "pages").select("page_id", host.alias("host"), (F.col("page_id") % 5).alias("doc"))
    return pages.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc")))


def header_freq(s, d):
    return A.frequent(_hosts(s, d), ["doc"], "host", "total", share=0.1)


def argmax(s, d):
    return A.most_frequent(table(s, d, "events"), ["user_id"], "event_type", "event_id")


def first_seen(s, d):
    return A.first_seen(_hosts(s, d), ["doc", "host"], "page_id")


def max_parsed(s, d):
    said = table(s, d, "conversations").withColumn("o", F.when(F.col("turn") % 3 == 0, F.concat("turn", F.lit("x"))).otherwise((F.col("turn") * 1000).cast("string")))
    return said.groupBy("conv_id").agg(A.max_digits(F.col("o")).alias("largest"))


def first_wins(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", F.md5(F.lower(F.trim("text")).cast("binary")).alias("k"))
    return A.first_wins(docs, ["lang", "k"], [F.col("doc_id")])


def ordered_concat(s, d):
    return A.joined_in_order(table(s, d, "conversations"), ["conv_id"], "turn", "text")


def script_share(s, d):
    docs = table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[À-ÿ]")).alias("marked"), F.regexp_count("text", F.lit("[A-Za-z]")).alias("latin"))
    total = F.col("marked") + F.col("latin")
    return docs.withColumn("language", F.when(F.try_divide("marked", total) > 0.1, "marked").otherwise("plain"))


def page_count(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


def number_alloc(s, d):
    rows = table(s, d, "documents").select("doc_id", "source")
    return W.allocated(rows, ["source"], [F.col("doc_id")], F.lit(100))


def order_alloc(s, d):
    said = table(s, d, "conversations")
    used = said.groupBy("conv_id").agg(A.max_digits(F.col("turn").cast("string")).alias("largest"))
    counter = used.withColumn("counter", F.when(F.col("conv_id") % 3 == 0, F.col("largest") + 5).when(F.col("conv_id") % 3 == 1, F.col("largest") - 1))
    new = said.select("conv_id", "turn").join(counter, "conv_id")
    return W.allocated(new, ["conv_id"], [F.col("turn")], W.reclaimed(F.col("counter"), F.col("largest"))).select("conv_id", "turn", "number")


def row_build(s, d):
    said = table(s, d, "conversations")
    number = F.col("turn") + 995
    return said.select(
        "conv_id", "turn", F.concat(F.lit("MAT"), N.padded(F.col("turn")), N.padded(number)).alias("dy_ques_id"),
        F.when(F.col("text").rlike("[À-ÿ]"), "LN01").otherwise("LN02").alias("ln_code"), F.lit("1").alias("dy_pattern"), F.lit("18").alias("dy_seconds"),
        N.letter_number(F.substring(F.lit("ABCDx"), (F.col("turn") % 5 + 1).cast("int"), F.lit(1))).alias("answer"),
    )


def lead_spans(s, d):
    return W.spans(table(s, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", F.lit(1000))


def asof_boundary(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn", "role")
    return W.next_boundary(said, ["conv_id"], "turn", F.col("role") == "user", F.lit(1000))


def asof_back(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn", "role")
    return W.last_before(said, ["conv_id"], "turn", F.col("role") == "user")


def _intervals(s, d):
    return table(s, d, "events").select("user_id", F.floor(F.col("event_id") % 997).alias("a")).withColumn("b", F.col("a") + F.col("user_id") % 17 + 1)


def interval_merge(s, d):
    return W.merged_intervals(_intervals(s, d), ["user_id"], "a", "b")


def interval_subtract(s, d):
    points = table(s, d, "events").select("user_id", F.floor((F.col("event_id") * 7) % 1009).alias("p")).distinct()
    return W.outside(points, W.merged_intervals(_intervals(s, d), ["user_id"], "a", "b"), ["user_id"], "p", "a", "b")


def change_rows(s, d):
    return W.changes(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


def text_windows(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    return W.text_windows(docs, "text", F.lit(3), 600).select("doc_id", "window_no", F.length("window_text").alias("n"), F.md5(F.col("window_text").cast("binary")).alias("digest"))


def split_counts(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    parts = (F.col("doc_id") % 7 + 1).cast("int")
    shares = F.posexplode(W.split_count(F.col("n_chars"), parts)).alias("part", "share")
    return docs.select("doc_id", "n_chars", shares)


def count_chunks(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(W.chunks_of(F.col("n_chars"), 500)).alias("chunk"))


def round_robin(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return said.select("conv_id", "turn", W.round_robin(nth).alias("pattern"), W.sixty_forty(nth).alias("kind"))


def spaced_positions(s, d):
    return W.rows_apart(table(s, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 300)


QUERIES = {
    "a01_group_lists": group_lists, "a02_group_quality": group_quality, "a03_global_counts": global_counts, "a05_header_freq": header_freq,
    "a06_argmax": argmax, "a07_first_seen": first_seen, "a08_max_parsed": max_parsed, "a09_first_wins": first_wins, "a10_ordered_concat": ordered_concat,
    "a11_script_share": script_share, "a12_page_count": page_count, "w01_number_alloc": number_alloc, "w02_order_alloc": order_alloc, "w03_row_build": row_build,
    "w04_lead_spans": lead_spans, "w05_change_rows": change_rows, "w05_spaced_positions": spaced_positions, "w06_interval_merge": interval_merge,
    "w07_interval_subtract": interval_subtract, "w08_text_windows": text_windows, "w09_split_count": split_counts, "w09_count_chunks": count_chunks,
    "w11_round_robin": round_robin, "j08_next_boundary": asof_boundary, "j09_last_before": asof_back,
}

_HOSTS = "WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id % 5 AS doc, count(*) OVER (PARTITION BY page_id % 5) AS total FROM pages)"
_MERGED = """i AS (SELECT user_id, event_id % 997 AS a, event_id % 997 + user_id % 17 + 1 AS b FROM events),
o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM o),
m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, n)"""
ORACLES = {
    "a01_group_lists": "SELECT source, lang, string_agg(doc_id::varchar, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY ALL",
    "a02_group_quality": """
SELECT source, lang, count(*) AS n_rows, count(*) FILTER (WHERE quality = 0) AS n_low, count(*) FILTER (WHERE toxic = 1) AS n_toxic
FROM documents JOIN labels USING (doc_id) GROUP BY ALL HAVING n_low + n_toxic > 0""",
    "a03_global_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS pushed, count(*) FILTER (WHERE quality <> 1) AS failed, round(count(*) FILTER (WHERE quality = 1) / greatest(1, count(*)), 4) AS ratio FROM labels",
    "a05_header_freq": _HOSTS + " SELECT doc, host, count(*) AS n FROM p WHERE host <> '' GROUP BY doc, host HAVING count(*) >= 2 AND count(*) <= greatest(4.0, max(total) * 0.1)",
    "a06_argmax": """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""",
    "a07_first_seen": _HOSTS + " SELECT doc, host, min(page_id) AS first FROM p GROUP BY ALL",
    "a08_max_parsed": "SELECT conv_id, coalesce(max(CASE WHEN turn % 3 <> 0 THEN turn * 1000 END), 0) AS largest FROM conversations GROUP BY conv_id",
    "a09_first_wins": "SELECT doc_id, lang, md5(lower(trim(text))) AS k FROM documents QUALIFY row_number() OVER (PARTITION BY lang, k ORDER BY doc_id) = 1",
    "a10_ordered_concat": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "a11_script_share": """
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[À-ÿ]'))::int AS marked, len(regexp_extract_all(text, '[A-Za-z]'))::int AS latin FROM documents)
SELECT *, CASE WHEN marked / nullif(marked + latin, 0) > 0.1 THEN 'marked' ELSE 'plain' END AS language FROM c""",
    "a12_page_count": "SELECT page_id, len(regexp_extract_all(html, '<p>'))::int AS paragraphs FROM pages",
    "w01_number_alloc": "SELECT doc_id, source, 100 + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents",
    "w02_order_alloc": """
WITH u AS (SELECT conv_id, max(turn) AS largest FROM conversations GROUP BY conv_id),
c AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN largest + 5 WHEN conv_id % 3 = 1 THEN largest - 1 END AS counter FROM u)
SELECT conv_id, turn, least(coalesce(counter, largest), largest) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations JOIN c USING (conv_id)""",
    "w03_row_build": """
SELECT conv_id, turn, 'MAT' || (CASE WHEN turn < 100 THEN lpad(turn::varchar, 3, '0') ELSE turn::varchar END)
    || (CASE WHEN turn + 995 < 100 THEN lpad((turn + 995)::varchar, 3, '0') ELSE (turn + 995)::varchar END) AS dy_ques_id,
  CASE WHEN regexp_matches(text, '[À-ÿ]') THEN 'LN01' ELSE 'LN02' END AS ln_code, '1' AS dy_pattern, '18' AS dy_seconds,
  CASE WHEN turn % 5 = 4 THEN 1 ELSE (turn % 5 + 1)::int END AS answer FROM conversations""",
    "w04_lead_spans": "SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000) AS span_end FROM conversations",
    "w05_change_rows": """
WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
SELECT user_id, event_id, event_type FROM e WHERE event_type IS DISTINCT FROM prev""",
    "w05_spaced_positions": """
WITH RECURSIVE k(user_id, event_id) AS (
  SELECT user_id, min(event_id) FROM events GROUP BY user_id
  UNION ALL
  SELECT k.user_id, (SELECT min(e.event_id) FROM events e WHERE e.user_id = k.user_id AND e.event_id >= k.event_id + 300)
  FROM k WHERE k.event_id IS NOT NULL)
SELECT * FROM k WHERE event_id IS NOT NULL""",
    "w06_interval_merge": f"WITH {_MERGED} SELECT user_id, a, b FROM m",
    "w07_interval_subtract": f"WITH {_MERGED}, p AS (SELECT DISTINCT user_id, event_id * 7 % 1009 AS p FROM events) SELECT user_id, p FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = p.user_id AND a <= p AND p < b)",
    "w08_text_windows": """
WITH s AS (SELECT doc_id, text, CASE WHEN length(text) > 1800 THEN length(text) // 3 + 1 ELSE 600 END AS wide FROM documents),
w AS (SELECT *, unnest(range(0, greatest(ceil(length(text) / wide)::int, 1))) AS i FROM s)
SELECT doc_id, i::int AS window_no, length(substr(text, i * wide + 1, wide))::int AS n, md5(substr(text, i * wide + 1, wide)) AS digest FROM w""",
    "w09_split_count": """
WITH s AS (SELECT doc_id, n_chars, doc_id % 7 + 1 AS k, unnest(range(0, doc_id % 7 + 1)) AS i FROM documents)
SELECT doc_id, n_chars, i::int AS part, n_chars // k + CASE WHEN i < n_chars % k THEN 1 ELSE 0 END AS share FROM s""",
    "w09_count_chunks": "WITH s AS (SELECT doc_id, n_chars, unnest(range(0, ceil(n_chars / 500)::int)) AS i FROM documents) SELECT doc_id, least(500, n_chars - i * 500) AS chunk FROM s",
    "w11_round_robin": """
WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)
SELECT conv_id, turn, (n % 14 + 1)::int AS pattern, CASE WHEN n % 5 < 3 THEN 'numeric' ELSE 'theory' END AS kind FROM n""",
    "j08_next_boundary": """
SELECT conv_id, turn, role, coalesce(min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1000) AS next_boundary FROM conversations""",
    "j09_last_before": "SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_mark FROM conversations",
}
