"""Findings of round 3: the interval, lesson and export queries on rows that made them differ."""

import duckdb
from pyspark.sql import functions as F

from lectern.operators import segment, windows
from lectern.plans import bank, derived
from lectern.sources import printing


def agree(spark, tmp_path, query, oracle, **tables):
    """Whether a query gives the rows of its SQL over small tables."""
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = query(spark, str(tmp_path))
    asked = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle})").fetchall()
    return sorted(map(tuple, got.collect())) == sorted(asked)


def test_one_file_for_each_document_however_rows_are_dealt(spark):
    """The parts of a plan that are dealt by document are coalesced apart by adaptive execution; a document's rows must stay together."""
    own = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        rows = spark.range(400).select((F.col("id") % 80).cast("string").alias("batch_id"), F.col("id").alias("place"), F.lit("1").alias("lesson_number"), F.lit("n").alias("lesson_name"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page"), F.array(F.repeat(F.lit("point "), 40)).alias("bullets"))
        lessons = rows.withColumns({c: F.lit("x") for c in ("source_filename", "board", "standard", "subject", "difficulty")}).withColumn("lesson_number", F.row_number().over(windows.Window.partitionBy("batch_id").orderBy("place")).cast("string"))
        found = printing.printed_files(lessons).select("batch_id").collect()
        assert len(found) == len({r["batch_id"] for r in found}) == 80
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_short_line_is_a_lesson_and_no_name(spark, tmp_path):
    """Under a heading without a name a short line that begins with a point would be taken for the name."""
    texts = [(0, " .44 . Th anatble, thndstnd to ererthing helyou."), (3, "- some words that are long enough for a lesson"), (6, ". short"), (9, "words " * 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert agree(spark, tmp_path, bank.router, bank.ORACLES["g02_router"], documents=docs)


def test_units_beyond_ninety_nine(spark, tmp_path):
    """Books of more than 99 units: every unit begins a lesson."""
    pages = spark.range(2050).select(F.col("id").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.lit("<p>words of a page</p>").alias("html"))
    assert agree(spark, tmp_path, derived.unit_split, derived.ORACLES["g05_unit_split"], pages=pages)


def test_units_taken_are_those_of_a_fold(spark):
    """Several documents, one without a key, in one task: numbers and distances begin anew with each."""
    rows = [(d, p, str(u), "t", s) for d in (1, 2, None) for p, u, s in ((0, 1, True), (1, 2, False), (2, 2, True), (3, 2, True), (4, 3, False), (9, 3, True), (11, 4, False))]
    df = spark.createDataFrame(rows, "doc int, page_no int, unit string, title string, strong boolean")
    for apart, weak, pages in ((3, None, [0, 3, 9]), (0, 2, [0, 2, 4, 11])):
        got = segment.taken(df, apart, weak).collect()
        for d in (1, 2, None):
            assert sorted((r["page_no"], r["lesson_no"]) for r in got if r["doc"] == d) == [(p, n) for n, p in enumerate(pages, 1)]


def test_tied_intervals_are_merged_once(spark):
    """Equal intervals, whatever their order, and chains of them: as brute force merges them."""
    rows = [(k, a, a + w) for k in range(3) for a in (1, 1, 1, 4, 4, 9, 9, 20, 21, 21, 40) for w in (1, 1, 3 + k)]
    brute = []
    for k in range(3):
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if brute and brute[-1][0] == k and a <= brute[-1][2]:
                brute[-1] = (k, brute[-1][1], max(b, brute[-1][2]))
            else:
                brute.append((k, a, b))
    df = spark.createDataFrame(rows, "k int, a int, b int").repartition(5)
    assert sorted(map(tuple, windows.merged_intervals(df, ["k"], "a", "b").collect())) == brute
