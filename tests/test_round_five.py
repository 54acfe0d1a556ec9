"""Findings of round 4: what splitting into lessons keeps on disk."""

import random
from pathlib import Path

from lectern.operators import segment


def test_lessons_of_tamil_books_keep_little_on_disk(spark):
    """Texts are written compressed and once a step: before, whole rows of documents, of pages with their lines and of lessons stayed as they are in memory."""
    draw, letters = random.Random(5), "கசடதபறயரலவழளஞஙநமணன"
    words = lambda n: " ".join("".join(draw.choice(letters) for _ in range(6)) for _ in range(n))
    page = lambda n, *lines: f"\n=== PAGE {n} ===\n" + "\n".join(lines) + "\n"
    units = lambda: page(1, words(300)) + page(2, "இயல் 2", "மொழி", words(300)) + page(3, words(300)) + page(4, words(9)) + page(5, "கற்றல் நோக்கங்கள்", words(300)) + page(6, "வானம்", "வானம்", words(300))
    rows = [(n, units() if n % 2 else page(7, "வானம்", "வானம்", words(900)) + page("9", words(600)), None) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc int, text string, name string").repartition(2)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    out = segment.split_lessons(docs)
    got = {(r["doc"], r["lesson_no"]): (r["lesson_id"], r["lesson_name"], r["start_page"], r["end_page"]) for r in out.collect()}
    assert size() - before < 2 * sum(len(text.encode()) for _, text, _ in rows)
    for n in range(60):
        if n % 2:
            assert got.pop((n, 1)) == ("lesson_02", "இயல் 2 – மொழி", 1, 4) and got.pop((n, 2)) == ("lesson_03", "இயல் 3 – வானம்", 5, 6)
        else:
            assert got.pop((n, 1)) == ("lesson_01", "இயல் 1 – வானம்", 7, 9)
    assert not got
