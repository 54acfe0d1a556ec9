"""Relational queries over the stand-in tables: documents as questions, labels as selections and push log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.operators import dml as K
from lectern.operators import relational as R
from lectern.sources.tables import table


def _docs(s, d, *columns):
    return table(s, d, "documents").select(*(columns or ("doc_id", "lang", "source", "n_chars")))


def scan_project(s, d):
    return _docs(s, d, "doc_id", "lang", F.coalesce("source", F.lit("")).alias("source"), (F.col("n_chars") > 1000).alias("long_text"))


def filters(s, d):
    docs = _docs(s, d)
    return docs.filter(R.null_safe("lang", "en") & F.col("source").isin("src1", "src2", "src3") & (F.col("source") != "src3") & F.col("n_chars").isNotNull())


def optional(s, d):
    return R.optional_filters(_docs(s, d), lang="fr", source="", n_chars=None)


def first_row(s, d):
    return R.first_row(_docs(s, d), "doc_id", 7)


def selected_flag(s, d):
    return R.flagged(_docs(s, d, "doc_id", "source"), table(s, d, "labels"), "doc_id", "doc_id", "selected")


def semi_selected(s, d):
    return R.in_keys(_docs(s, d), "doc_id", table(s, d, "labels").filter("toxic = 0").select("doc_id"))


def anti_pushed(s, d):
    return R.not_in(_docs(s, d), table(s, d, "labels").filter("quality = 1"), "doc_id", "doc_id")


def zip_positions(s, d):
    said = table(s, d, "conversations")
    users = said.filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("asked"))
    bots = said.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("reply_turn"), F.length("text").alias("answered"))
    return R.zipped(users, bots, ["conv_id"], [F.col("turn")], [F.col("reply_turn")])


def order_by_cast(s, d):
    said = table(s, d, "conversations").select("conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(" of log")).alias("position"))
    return R.ranked(said, "place", [N.lenient_int(F.col("position")).asc_nulls_first(), F.col("conv_id")], ["conv_id"])


def order_by_first_number(s, d):
    pages = table(s, d, "pages").select("page_id", "url", N.natural_key(F.col("url")).alias("number"))
    return R.ranked(pages.withColumn("bucket", F.col("page_id") % 10), "place", [F.col("number"), F.col("page_id")], ["bucket"])


def newest_first(s, d):
    events = table(s, d, "events").select("event_id", "user_id", "ts")
    return R.ranked(events, "place", [F.col("ts").desc_nulls_last(), F.col("event_id").desc()], ["user_id"])


def top_orders(s, d):
    return R.top_k(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


def replace_partition(s, d):
    stored = table(s, d, "labels").select(F.col("doc_id").alias("question_id"), F.lit("old").alias("batch_id"))
    stored = stored.withColumn("batch_id", F.when(F.col("question_id") % 3 == 0, "src1").otherwise("other"))
    new = K.selection_of(_docs(s, d).withColumnRenamed("doc_id", "id"), table(s, d, "labels").filter("quality = 1").select("doc_id"), F.col("source") == "src1")
    return K.replace_partition(stored, new.withColumn("batch_id", F.lit("src1")), "batch_id", "src1")


def cascade_delete(s, d):
    gone = table(s, d, "labels").filter("quality = 0").select("doc_id")
    bank, chosen = K.cascade_delete(_docs(s, d, "doc_id"), table(s, d, "labels").select("doc_id"), gone, "doc_id", "doc_id")
    return bank.select(F.lit("bank").alias("kind"), "doc_id").unionByName(chosen.select(F.lit("selection").alias("kind"), "doc_id"))


def point_update(s, d):
    return K.point_update(_docs(s, d, "doc_id", "lang", "source"), F.col("doc_id") == 5, lang=F.lit("xx"), source=F.trim(F.lit(" edited ")))


def tag_rows(s, d):
    changes = table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "").alias("lang"), F.when(F.col("quality") == 0, "bad").alias("source"))
    return K.tag(_docs(s, d, "doc_id", "lang", "source"), changes, "doc_id", ["lang", "source"])


def untag_rows(s, d):
    return K.untag(_docs(s, d, "doc_id", "lang", "source"), table(s, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", ["lang", "source"])


def insert_missing(s, d):
    stored = table(s, d, "labels").select("doc_id", F.lit("stored").alias("origin"))
    return K.insert_if_absent(stored, _docs(s, d, "doc_id").withColumn("origin", F.lit("new")), "doc_id")


def merge_log(s, d):
    stored = table(s, d, "labels").filter("quality = 1").select("doc_id", F.lit("online").alias("exam_type"), F.lit("success").alias("status"), F.lit(0).cast("long").alias("at"))
    changes = _docs(s, d).select("doc_id", F.lit("online").alias("exam_type"), F.when(F.col("lang") == "en", "failed").otherwise("success").alias("status"), F.col("n_chars").alias("at"))
    changes = K.last_of(changes.unionByName(changes.withColumn("at", F.col("at") - 1)), ["doc_id", "exam_type"], [F.col("at")])
    return K.upsert(stored, changes, ["doc_id", "exam_type"])


def append_ids(s, d):
    stored = table(s, d, "labels").select(F.col("doc_id").alias("id"))
    new = table(s, d, "benchmark").select("item_id")
    return K.append_with_ids(stored, new, "id", [F.col("item_id")])


def migrate(s, d):
    old = table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "B").otherwise("d").alias("correct_ans"), F.when(F.col("toxic") == 1, "3").alias("dy_correct_ans"))
    return K.migrated(K.backfilled(old, "dy_correct_ans", "correct_ans"), {"board": "string", "start_page": "int"}, {"correct_ans": "letter"})


QUERIES = {
    "s09_scan_project": scan_project, "f01_filter_eq_in_null": filters, "f06_optional_filters": optional, "f07_first_row": first_row,
    "j01_selected_flag": selected_flag, "j02_semi_selected": semi_selected, "j03_anti_pushed": anti_pushed, "j07_zip_positions": zip_positions,
    "o01_newest_first": newest_first, "o02_order_by_cast": order_by_cast, "o05_natural_order": order_by_first_number, "l01_topk_per_group": top_orders,
    "k01_append_ids": append_ids, "k03_replace_partition": replace_partition, "k04_cascade_delete": cascade_delete, "k05_point_update": point_update,
    "k06_tag_upsert": tag_rows, "k06_insert_missing": insert_missing, "k07_untag": untag_rows, "k08_merge_log": merge_log, "k13_migrate": migrate,
}

ORACLES = {
    "s09_scan_project": "SELECT doc_id, lang, coalesce(source, '') AS source, n_chars > 1000 AS long_text FROM documents",
    "f01_filter_eq_in_null": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars IS NOT NULL",
    "f06_optional_filters": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'fr'",
    "f07_first_row": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7 LIMIT 1",
    "j01_selected_flag": "SELECT d.doc_id, source, l.doc_id IS NOT NULL AS selected FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id",
    "j02_semi_selected": "SELECT doc_id, lang, source, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 0)",
    "j03_anti_pushed": "SELECT doc_id, lang, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)",
    "j07_zip_positions": """
WITH u AS (SELECT conv_id, turn, length(text) AS asked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn AS reply_turn, length(text) AS answered, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, asked, reply_turn, answered FROM u JOIN b USING (conv_id, n)""",
    "o01_newest_first": "SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS place FROM events",
    "o02_order_by_cast": "SELECT conv_id, turn, turn || ' of log' AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations",
    "o05_natural_order": r"""
WITH p AS (SELECT page_id, url, coalesce(try_cast(nullif(regexp_extract(url, '[0-9]+'), '') AS bigint), 999) AS number, page_id % 10 AS bucket FROM pages)
SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY number, page_id) AS place FROM p""",
    "l01_topk_per_group": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    "k01_append_ids": "SELECT item_id, (SELECT max(doc_id) FROM labels) + row_number() OVER (ORDER BY item_id) AS id FROM benchmark",
    "k03_replace_partition": """
SELECT doc_id AS question_id, 'other' AS batch_id FROM labels WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'src1' FROM documents WHERE source = 'src1' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "k04_cascade_delete": """
SELECT 'bank' AS kind, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 'selection', doc_id FROM labels WHERE quality <> 0""",
    "k05_point_update": "SELECT doc_id, CASE WHEN doc_id = 5 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id = 5 THEN 'edited' ELSE source END AS source FROM documents",
    "k06_tag_upsert": """
SELECT d.doc_id, CASE WHEN toxic = 1 THEN '' ELSE lang END AS lang, CASE WHEN quality = 0 THEN 'bad' ELSE source END AS source
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "k06_insert_missing": "SELECT doc_id, 'stored' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "k07_untag": """
SELECT d.doc_id, CASE WHEN toxic = 1 THEN NULL ELSE lang END AS lang, CASE WHEN toxic = 1 THEN NULL ELSE source END AS source
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "k08_merge_log": """
WITH s AS (SELECT doc_id FROM labels WHERE quality = 1),
c AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'failed' ELSE 'success' END AS status, n_chars AS at FROM documents)
SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, 'online' AS exam_type, coalesce(c.status, 'success') AS status, coalesce(c.at, 0) AS at
FROM s FULL JOIN c ON s.doc_id = c.doc_id""",
    "k13_migrate": """
SELECT doc_id, CASE WHEN quality = 1 THEN 'B' ELSE 'd' END AS letter, CASE WHEN toxic = 1 THEN '3' WHEN quality = 1 THEN '2' ELSE '4' END AS dy_correct_ans,
       NULL::varchar AS board, NULL::int AS start_page FROM labels""",
}
