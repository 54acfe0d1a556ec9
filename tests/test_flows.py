"""Whole flows with fakes at their edges: jobs as a stream's state, pushes that are run again, rounds of questions, summaries from text to printed file and back."""

import json
import os
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import dml, segment, tamil_units
from lectern.plans import adapters, exports, prompts, rounds, summaries, summary_job
from lectern.sources import files, pdf, printing, push, readers
from lectern.streaming import jobs, state

# jobs


def brute_jobs(rows, ttl, now):
    out = {}
    for key in {r[0] for r in rows}:
        job = None
        for _, at, order, status, note, step in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if job and job["status"] in ("done", "error") and at - job["updated"] > ttl:
                out[key, job["started"]] = job | {"open": False}
                job = None
            job = job or {"started": at, "updated": at, "updates": 0, "status": None, "note": None, "delivered": 0}
            job |= {"status": status or job["status"], "note": note or job["note"], "delivered": job["delivered"] + max(0, step or 0), "updated": at, "updates": job["updates"] + 1}
        out[key, job["started"]] = job | {"open": not (job["status"] in ("done", "error") and now - job["updated"] > ttl)}
    return out


def test_jobs_live_in_a_stream(spark, tmp_path):
    """Micro-batches with evictions between them, null fields and keys, several updates of one time; the same jobs as a fold of all updates in order."""
    r = random.Random(2)
    rows = [(r.choice((1, 2, 3, None)), r.randrange(0, 40_000, 50) * 1_000_000, n, r.choice((None, "running", "running", "done", "error")), r.choice((None, "a", "b")), r.choice((None, -2, 0, 3))) for n in range(160)]
    df = spark.createDataFrame([(k, n, s, x, p, t) for k, t, n, s, x, p in rows], "job long, n int, status string, note string, step int, at long").withColumn("ts", F.timestamp_micros("at"))
    stream = jobs.in_slices(df, "ts", 5, str(tmp_path / "in"))
    changes = jobs.run_all(state.job_changes(stream, "job", "ts", "n", ["status", "note"], "step", ttl_seconds=1000), str(tmp_path / "out"))
    batches = changes.select(F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1)).distinct().count()
    got = {(x["job"], x["started"]): x.asDict() for x in state.jobs_of(changes, "job").collect()}
    want = brute_jobs(rows, 1000 * 1_000_000, max(x[1] for x in rows))
    assert batches >= 5 and got == {k: {"job": k[0], **v} for k, v in want.items()} and any(not v["open"] for v in want.values())


# pushes and calls


def flaky(folder, after):
    """A post that notes itself in a file and breaks down once, after some posts; a nested function, so that workers get it by value."""

    def post(payload):
        sent = len(os.listdir(folder))
        open(os.path.join(folder, f"{sent:03d}-{payload['id']}"), "w").close()
        if sent + 1 == after:
            raise RuntimeError("the task dies after the post")
        return (500, "") if payload["id"] == "q3" else (200, '{"success":true}')

    return post


def to_push(spark, n):
    rows = [(f"q{k}", n - k, "quesId" if k == 4 else "", json.dumps({"id": f"q{k}", "v": "é"})) for k in range(n)]
    return spark.createDataFrame(rows, "key string, place long, missing string, payload string")


def test_a_push_that_is_run_again_sends_nothing_twice(spark, tmp_path):
    posted, folder = tmp_path / "posted", str(tmp_path / "push")
    posted.mkdir()
    with pytest.raises(Exception, match="dies"):
        push.push(to_push(spark, 9), flaky(str(posted), 5), folder)
    assert not os.path.exists(f"{folder}/committed.json")
    out = {r["dy_ques_id"]: r for r in push.push(to_push(spark, 9), flaky(str(posted), 0), folder).collect()}
    sent = [x.split("-")[1] for x in sorted(os.listdir(posted))]
    # only the post during which the task died is not known to have got through
    assert sent == ["q8", "q7", "q6", "q5", "q3", "q3", "q2", "q1", "q0"]
    assert len(out) == 9 and out["q3"]["http_status"] == 500 and out["q4"]["sent"] is False and out["q8"]["http_status"] == 200
    before = len(sent)
    again = push.push(to_push(spark, 10), flaky(str(posted), 0), folder, at_once=3).collect()
    assert len(again) == 10 and len(os.listdir(posted)) == before + 1  # only the new row is posted
    assert push.push(to_push(spark, 0), flaky(str(posted), 0), folder).count() == 0


def test_push_results_become_log_rows(spark):
    rows = [("Q1", False, "x", 1), ("Q1", True, "y", 2), ("Q2", False, "z", 3)]
    log = adapters.push_log(spark.createDataFrame(rows, "dy_ques_id string, ok boolean, detail string, place long"), "online")
    assert sorted(map(tuple, log.collect())) == [("Q1", "online", "success", "y"), ("Q2", "online", "failed", "z")]


def test_calls_are_bounded(spark):
    def call(prompt):
        if prompt.startswith("slow"):
            time.sleep(5)
        if prompt == "bad":
            raise ValueError
        return prompt.upper()

    began = time.monotonic()
    assert list(adapters.bounded(call, ["a", "slow", "b", "bad", "slow2", "c"], 2, 0.3, empty="-")) == ["A", "-", "B", "-", "-", "C"]
    assert time.monotonic() - began < 3
    assert list(adapters.bounded(call, ["a", "b"], 1, 9, until=time.time() - 1)) == ["", ""]
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "slow"), (3, None, "bad")], "id long, job string, prompt string")
    assert sorted(map(tuple, adapters.replies(df, call, seconds=1).collect()), key=lambda r: r[0]) == [(1, "x", "A"), (2, "y", ""), (3, None, "")]
    assert [r["reply"] for r in adapters.replies(df, call, job_seconds=0).collect()] == ["", "", ""]


# rounds of questions


def question(text, right="one", explanation="because"):
    return {"question": text, "options": {"A": right, "B": "two", "C": "three", "D": "four"}, "answer": "A", "correct_answer_text": right, "explanation": explanation}


def test_rounds_fill_windows_and_jobs(spark):
    """A fake model that knows a few questions a window and repeats itself: rounds go on until the wanted number or the most rounds; job 2's window 1 fails at first."""
    asked = []

    def ask(prompted):
        rows = sorted(prompted.collect(), key=lambda r: (r["job"], r["window_no"], r["chunk_no"]))
        out = []
        for r in rows:
            n = sum(a[:2] == (r["job"], r["window_no"]) for a in asked)
            asked.append((r["job"], r["window_no"], r["prompt"]))
            known = [f"{w} {w[::-1]} of {r['job']}{r['window_no']}?" for w in ("gravity", "magnet", "photosynthesis", "election", "quartz", "volcano", "bacteria", "harvest")]
            give = [question(k, right=k) for k in known[2 * n : 2 * n + 3]]
            out.append((r["job"], r["window_no"], r["chunk_no"], "" if (r["job"], r["window_no"], n) == ("2", 1, 0) else json.dumps({"questions": give})))
        return spark.createDataFrame(out, "job string, window_no int, chunk_no int, reply string")

    windows = spark.createDataFrame([("1", 0, "notes", 3), ("1", 1, "notes", 2), ("2", 1, "other", 4), ("3", 0, None, 2), ("4", 0, "n", 0)], "job string, window_no int, notes string, wanted int")
    build = lambda notes, n, formats, avoid: F.concat_ws("|", n.cast("string"), F.array_join(formats.cast("array<string>"), ","), F.coalesce(F.array_join(avoid, ";") if avoid is not None else F.lit(None), F.lit("-")))
    got = rounds.filled(windows, ask, build, "English", per_window=3, overall=2).collect()
    by = {}
    for x in sorted(got, key=lambda x: (x["job"], x["place"])):
        by.setdefault(x["job"], []).append(x["question"])
    assert {k: len(v) for k, v in by.items()} == {"1": 5, "2": 4} and all(len(set(v)) == len(v) for v in by.values())
    first = [a for a in asked if a[2].endswith("|-")]
    assert [(a[0], a[1], a[2].split("|")[0]) for a in first] == [("1", 0, "4"), ("1", 1, "2"), ("2", 1, "5")]
    later = [a for a in asked if not a[2].endswith("|-")]
    assert ("2", 1, "8|1,2,3,4,5,6,7,8|") in later and any("gravity" in a[2] for a in later)


def test_rounds_end_without_replies(spark):
    asked = []

    def ask(prompted):
        asked.append(prompted.count())
        return prompted.select("job", "window_no", "chunk_no", F.lit("no idea").alias("reply"))

    windows = spark.createDataFrame([("1", 0, "notes", 20), ("1", 1, "notes", 1)], "job string, window_no int, notes string, wanted int")
    got = rounds.filled(windows, ask, lambda notes, n, formats, avoid: n.cast("string"), "English", per_window=2, overall=3)
    assert got.collect() == [] and asked == [3, 2, 2, 1, 1, 1]  # 24 questions in two chunks and one; two rounds of both windows; one window at a time


def test_sizes_of_requests(spark):
    row = spark.range(1).select(*(rounds.first_sizes(F.lit(n)).alias(f"a{n}") for n in (1, 14, 15, 50)), *(rounds.more(F.lit(n)).alias(f"m{n}") for n in (1, 12, 13, 40)), rounds.formats(F.lit(13), F.lit(3)).alias("f")).first()
    assert list(row) == [[1], [17], [15, 3], [15, 15, 15, 15], 2, 24, 25, 25, [14, 1, 2]]


# prompts


def test_prompts_say_what_is_asked_for(spark):
    c = F.lit
    formats = F.array(*(c(n) for n in (1, 2, 8, 14, 3)))
    ask = lambda level, subject, language: prompts.questions(c("the notes"), c(5), c(level), c(language), formats, c(subject), F.array(c("old")), F.array(c("book one")))
    row = spark.range(1).select(ask("hard", " Maths ", "Tamil").alias("m"), ask("easy", "Biology", "English").alias("b"), prompts.summary(c("text"), c("4"), c("Air"), c("Tamil"), F.array(F.struct(c("4.1").alias("code"), c("Wind").alias("title"))), c(2), c(3)).alias("s")).first()
    maths, biology, summary = row
    lines = maths.split("\n")
    assert [x for x in lines if x.startswith("Question ") and ": format" in x][1:3] == [f"Question 2: format 2, {prompts.FORMATS[1]}", f"Question 3: format 8, {prompts.FORMATS[7]}"]
    assert [x.endswith(prompts.SUM) for x in lines if " is a sum" in x or " is theory" in x] == [True, True, True, False, False]
    assert "sums" not in biology and prompts.DIFFICULTY["easy"] in biology and prompts.DIFFICULTY["hard"] in maths and "Latin" in maths and "Latin" not in biology
    assert "- old" in maths and "- book one" in maths and maths.endswith("NOTES:\nthe notes")
    assert "- 4.1 Wind" in summary and "part 2 of 3" in summary and summary.endswith("LESSON:\ntext") and len(prompts.FORMATS) == rounds.FORMATS


# PDF files


def test_pdf_pages_go_out_and_come_back(spark):
    blocks = [("title", printing.TITLE), ("lesson", "LESSON 1 — தமிழ் (x\\y)")] + [("bullet", f"{n}. Light travels — “fast” தமிழ் எழுத்து 😀 " + "word " * (n % 50)) for n in range(80)] + [("bullet", "x" * 900), ("bullet", "a\tb\x07c")]
    pages = printing.paged(blocks)
    content = printing.pdf_of(pages)
    texts = pdf.page_texts(content)
    assert len(texts) == len(pages) > 3 and [t.rsplit("\n", 1)[1] for t in texts] == [f"Page {n} of {len(texts)}" for n in range(1, len(texts) + 1)]
    bare = "".join("".join(t.rsplit("\n", 1)[0].split()) for t in texts)
    assert bare == "".join("".join(t.split()) for _, t in blocks).replace("\x07", "")
    assert all(printing.width(t, s) <= printing.PAGE[0] - 2 * printing.MARGIN + 1e-6 for p in pages for _, _, s, t in p)
    assert all(printing.FOOT <= y <= printing.PAGE[1] for p in pages for _, y, _, _ in p)
    start = int(re.search(rb"startxref\n(\d+)", content)[1])
    for n, at in enumerate(re.findall(rb"(\d{10}) 00000 n", content[start:]), 1):
        assert content[int(at) :].startswith(b"%d 0 obj" % n)


def made_pdf(objects, tail=b""):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + tail


def flate(data, head=b""):
    z = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\r\n%s\nendstream" % (len(z), head, z)


def test_pdf_reader_takes_other_writers_files():
    """Object streams, inherited resources, escapes, arrays of strings, ToUnicode maps, differences, forms, wrong lengths, later versions of objects."""
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <41> <0B95> endbfchar 2 beginbfrange <42> <44> <0061> <45> <46> [<0078> <00790079>] endbfrange"
    packed = b"6 0 7 60 " + (b"<< /Type /Font /Subtype /Type1 /ToUnicode 9 0 R >>" + b" " * 60)[:60] + b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /eacute /B /uni0BAE /one] >> >>"
    first = packed.index(b"<<")
    body = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (ABCDEF) Tj 0 -14 TD [(A) -300 (B) 20 (C)] TJ T* (B\\)\\(\\\\) Tj ET q BT /F2 9 Tf 50 600 Td (BCD) Tj ET /X1 Do Q"
    second = b"BT /F0 9 Tf 10 10 Td <48690A21> Tj (a\\101\\\nb) ' ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 6 0 R /F2 7 0 R /F0 10 0 R >> /XObject << /X1 11 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents 12 0 R >>", 5: flate(body),
        8: flate(packed, b"/Type /ObjStm /N 2 /First %d" % first), 9: flate(cmap), 10: b"<< /Type /Font /Subtype /Type1 /Encoding /MacRomanEncoding >>",
        11: b"<< /Type /XObject /Subtype /Form /Length 3 >>\nstream\nBT /F2 9 Tf 50 580 Td (D) Tj ET\nendstream", 12: b"<< /Length 99 0 R >>\nstream\n" + second + b"\nendstream",
    }
    assert pdf.page_texts(made_pdf(objects)) == ["கabcxyy\nக ab\na)(\\\nBம1\n1", "Hi\n!\naAb"]
    newer = made_pdf(objects, b"4 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n")
    assert pdf.page_texts(newer)[1] == ""
    for bad in (b"", b"PK\x03\x04", made_pdf(objects, b"trailer << /Encrypt 5 0 R >>")):
        with pytest.raises(ValueError):
            pdf.page_texts(bad)


def test_pdf_predictors():
    rows = [bytes([2, 1, 1, 1]), bytes([1, 5, 1, 1]), bytes([4, 1, 2, 3]), bytes([3, 2, 2, 2]), bytes([0, 7, 8, 9])]
    out = pdf._predicted(b"".join(rows), {"Predictor": 15, "Columns": 3})
    assert out == bytes([1, 1, 1, 5, 6, 7, 6, 8, 11, 5, 8, 11, 7, 8, 9]) and pdf._predicted(b"ab", {}) == b"ab"


def test_files_of_many_kinds_are_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(printing.pdf_of(printing.paged([("bullet", "words that are long enough to count as a usable page of text")])))
    (tmp_path / "b.txt").write_text("plain")
    rows = files.read_pages(files.files(spark, str(tmp_path)), readers.READERS).collect()
    assert sorted((os.path.basename(r["path"]), r["num"], r["text"].split("\n")[0][:11]) for r in rows) == [("a.pdf", 1, "words that "), ("b.txt", 1, "plain")]


def test_validation_of_printed_files(spark):
    lessons = spark.createDataFrame([("a", 1, "1", ["one point of light"]), ("a", 2, "2", ["missing point", ""]), ("b", 1, "1", ["x"]), ("c", 1, "1", ["y"]), ("d", 1, None, None)], "batch_id string, place int, lesson_number string, bullets array<string>")
    pages = spark.createDataFrame([("a", 1, "LESSON 1 —\nA\none point\nof light"), ("a", 2, "LESSON 2 — B"), ("b", 1, "LESSON 1 — Complete  PDF Summary x"), ("d", 1, "Lesson 1 — �")], "batch_id string, num int, text string")
    got = {r["batch_id"]: tuple(r)[1:8] for r in printing.validated(pages, lessons).collect()}
    assert got == {"a": ("PASS", 2, 2, 2, 3, 1, 0.3333), "b": ("FAIL", 1, 1, 1, 1, 1, 1.0), "c": ("FAIL", 0, 1, 0, 1, 0, 0.0), "d": ("WARN", 1, 1, 1, 0, 0, 0.0)}


# lessons


def paged(*texts):
    return "".join(f"\n=== PAGE {n} ===\n{t}\n" for n, t in enumerate(texts, 1))


def test_a_lone_number_is_the_lesson_number(spark):
    rows = ["7\nMagnets attract", "a\n\n 12 \nb", "51\nx", "0\nx", "a\nb\nc\nd\ne\n9", "Unit 3\n7", "2.1 Force\n7", ""]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(rows)], "n int, t string")
    assert [r[0] for r in df.orderBy("n").select(segment.lesson_number(F.col("t"), F.lit("99"))).collect()] == ["7", "12", "99", "99", "99", "3", "2", "99"]


TAMIL = "தமிழ்ச் சொற்கள் நிறைந்த பக்கம் "


def test_tamil_units(spark):
    """Numbers in digits and words, inferred from goals, titles from the next page and joined lines, prefixes, parts, a first unit that snaps to the cover."""
    text = paged(
        "அட்டை", "இயல் ஒன்று\nமொழி\nஉரைநடை: தமிழின் இனிமை\n" + TAMIL, TAMIL, TAMIL,  # page 2 begins unit 1, joined with its short next line only where that is 2 to 15 long
        "கற்றல் நோக்கங்கள்\n" + TAMIL * 3, "இயற்கை வளம்\nஇயற்கை வளம்\n" + TAMIL, TAMIL,  # goals without a number: unit 2, titled by the next page's doubled heading
        "அலகு 4\nஅலகு சிறப்பு நிலை\n" + TAMIL, "இயல் 5\nx", TAMIL,  # page 9 is too near
    )
    docs = spark.createDataFrame([("t", text, "book.pdf"), ("w", paged("அறம்\nஅறம்\n" + TAMIL, TAMIL), "w.pdf"), ("e", "Lesson 1: Air\n" + "x" * 40, "e.pdf")], "doc string, text string, name string")
    got = segment.split_lessons(docs).orderBy("doc", "lesson_no").collect()
    mine = [(r["lesson_id"], r["lesson_number"], r["lesson_name"], r["start_page"], r["end_page"]) for r in got if r["doc"] == "t"]
    assert mine == [("lesson_01", "1", "இயல் 1 – மொழி", 1, 4), ("lesson_02", "2", "இயல் 2 – இயற்கை வளம்", 5, 7), ("lesson_04", "4", "அலகு சிறப்பு நிலை", 8, 10)] or mine[0][2].startswith("இயல் 1 – மொழி") and mine[1:] == [("lesson_02", "2", "இயல் 2 – இயற்கை வளம்", 5, 7), ("lesson_04", "4", "அலகு சிறப்பு நிலை", 8, 10)]
    assert [tuple(x) for x in got[[r["doc"] for r in got].index("t")]["subsections"]] == [("", "உரைநடை: தமிழின் இனிமை")]
    whole = [r for r in got if r["doc"] == "w"]
    assert [(r["lesson_number"], r["lesson_name"], r["start_page"], r["end_page"], r["subsections"]) for r in whole] == [("1", "இயல் 1 – அறம்", 1, 2, [])]
    assert [(r["lesson_number"], r["lesson_name"]) for r in got if r["doc"] == "e"] == [("1", "Air")]


def test_tamil_titles_join_the_next_line(spark):
    rows = [["12", "மொழி", "வளம்"], ["மொழி", "மொழி"], ["மொழி", "கற்கண்டு"], ["மொழி", "இது பதினைந்து எழுத்துகளை விட நீண்ட வரி"], ["ஒன்று", "வான்", "அ"], []]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(rows)], "n int, x array<string>")
    assert [r[0] for r in df.orderBy("n").select(tamil_units.title(F.col("x"))).collect()] == ["மொழிவளம்", "மொழி", "மொழி", "மொழி", "வான்", None]


# summaries


def test_summary_job_from_text_to_printed_file(spark):
    air = "\n".join(f"1.{n} {title}\n" + "gases press on walls and surfaces always " * 4 for n, title in enumerate(("Breeze", "Storm", "Cloud"), 1))
    docs = spark.createDataFrame(
        [("b1", "Lesson 1: Air\n" + air + "\nLesson 2: Water\n" + "water flows down the hills " * 6 + "\nLesson 3: Fire\n" + "fire is hot and bright always " * 6, "sci.pdf", "State", "6", "Science", "hard"), ("b2", "  ", "empty.pdf", None, None, None, None)],
        "batch_id string, text string, name string, board string, standard string, subject string, difficulty string",
    )
    asked = []

    def ask(prompted):
        out = []
        for r in sorted(prompted.collect(), key=lambda r: (r["lesson"]["lesson_no"], r["chunk_no"])):
            asked.append(r["prompt"])
            if "no bullet yet" in r["prompt"]:
                reply = json.dumps({"additional_bullets": ["Cloud is the last", " AIR HAS breeze and storm "]})
            elif "Summarise lesson 1" in r["prompt"]:
                reply = json.dumps({"bullets": ["Air has breeze and storm", "It is $x^{2}$ plus y", "it is $x^{2}$ plus y"]})
            elif "Summarise lesson 2" in r["prompt"]:
                reply = json.dumps({"bullets": ["Water flows"]}) if "at least 15" in r["prompt"] else "no"
            else:
                reply = ""
            out.append((r["lesson"], r["chunk_no"], reply))
        schema = T.StructType([prompted.schema["lesson"], prompted.schema["chunk_no"], T.StructField("reply", T.StringType())])
        return spark.createDataFrame(out, schema)

    old = spark.createDataFrame([(41,)], "id long")
    made = summary_job.summarised(docs, ask, old, "m", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    saved = {r["lesson_number"]: r for r in made.saved.collect()}
    assert {k: (r["id"], r["lesson_name"], json.loads(r["bullets"])) for k, r in saved.items()} == {
        "1": (42, "Air", ["Air has breeze and storm", "It is x^2 + y", "Cloud is the last"]), "2": (43, "Water", ["Water flows"]),
    }
    assert (saved["1"]["batch_id"], saved["1"]["difficulty"], saved["1"]["language"], saved["1"]["source_filename"], saved["1"]["model"]) == ("b1", "hard", "English", "sci.pdf", "m")
    job = {r["batch_id"]: tuple(r)[1:] for r in made.jobs.collect()}
    assert job == {"b1": ("done", 3, 2, None, "Generated 2 of 3 lessons"), "b2": ("error", 0, 0, "No text could be extracted from this file.", None)}
    file = made.files.first()
    text = "\n".join(pdf.page_texts(bytes(file["content"])))
    assert file["pages"] == 1 and "LESSON 1 — AIR" in text and "Curriculum: State | 6 | Science" in text and "3. Cloud is the last" in text and text.endswith("Page 1 of 1")
    check = made.validation.first()
    assert (check["status"], check["lessons"], check["headings"], check["total"], check["found"]) == ("PASS", 2, 2, 4, 4)
    assert sum("at least 15" in a for a in asked) == 2 and sum("no bullet yet" in a for a in asked) == 1


def test_chunked_lessons_keep_their_order(spark):
    rows = [(1, 1, json.dumps({"bullets": ["c", "A"]})), (1, 0, json.dumps({"bullets": ["a", "b"]})), (2, 0, "")]
    got = summaries.replies_to_bullets(spark.createDataFrame(rows, "lesson int, chunk_no int, reply string"), "lesson").collect()
    assert [(r["lesson"], r["bullets"]) for r in got] == [(1, ["a", "b", "c"])]


def test_exports_by_job_batch_and_choice(spark):
    rows = [(5, "b1", "10", "Ten", None, None, '["x"]', "no.te.pdf", None, "6", None, None), (4, "b1", "9", None, 1, 2, None, ".hidden", "State", "6", "Maths", "hard"), (6, "b1", "OVERALL", "all", 1, 9, "[]", "z", None, None, None, None), (7, "b2", "OVERALL", "all", 1, 9, "[]", "z", None, None, None, None)]
    stored = spark.createDataFrame(rows, "id int, batch_id string, lesson_number string, lesson_name string, start_page int, end_page int, bullets string, source_filename string, board string, standard string, subject string, difficulty string")
    wanted = spark.createDataFrame([("b1",), ("b2",), ("b1",), ("none",)], "batch_id string")
    got = {r["batch_id"]: r for r in exports.by_batch(stored, wanted).collect()}
    assert sorted(got) == ["b1", "b2", "none"] and got["b2"]["content"] is None and got["b1"]["name"] == ".hidden_summary.pdf"
    text = pdf.page_texts(bytes(got["b1"]["content"]))[0]
    assert text.index("LESSON 9 — LESSON 9") < text.index("No summary points") < text.index("LESSON 10 — TEN") and "Curriculum: State | 6 | Maths" in text and "Pages 1–2" in text
    printed = spark.createDataFrame([("b1", 1, bytearray(b"kept"))], "batch_id string, pages int, content binary")
    jobs_ = spark.createDataFrame([("j1", "b1"), ("b1", None), ("j2", "b2"), ("j3", "x")], "job_id string, batch_id string")
    by_job = {r["job_id"]: (r["route"], r["content"] and bytes(r["content"])) for r in exports.by_job(jobs_, printed, stored).collect()}
    assert by_job == {"j1": ("file", b"kept"), "b1": ("file", b"kept"), "j2": ("missing", None), "j3": ("missing", None)}
    assert {r["job_id"]: r["route"] for r in exports.by_job(jobs_, printed.limit(0), stored).collect()} == {"j1": "stored", "b1": "stored", "j2": "missing", "j3": "missing"}
    one = exports.stored_lessons(stored).filter("lesson_number = '10'")
    assert [r["name"] for r in exports.chosen(one).collect()] == [".hidden_Lesson_10_summary.pdf"]
    names = spark.createDataFrame([("a.b.pdf",), ("plain",), ("",), (None,), ("x..y",)], "n string").select(exports.file_name(F.col("n")).alias("f"))
    assert [r["f"] for r in names.collect()] == ["a.b_summary.pdf", "plain_summary.pdf", "lesson_summary_summary.pdf", "lesson_summary_summary.pdf", "x._summary.pdf"]


def test_partitions_are_replaced_on_disk(spark, tmp_path):
    path = str(tmp_path / "bank")
    table = lambda *rows: spark.createDataFrame(rows, "id int, batch string, q string")
    dml.overwrite_partitions(table((1, "a", "x"), (2, "b", "y"), (3, "c", "z")), path, "batch")
    files_of = lambda b: {f: (tmp_path / "bank" / f"batch={b}" / f).read_bytes() for f in os.listdir(f"{path}/batch={b}")}
    before = {b: files_of(b) for b in "ac"}
    dml.overwrite_partitions(table((7, "b", "new"), (8, "d", "more")), path, "batch")
    assert {b: files_of(b) for b in "ac"} == before
    assert sorted((r["id"], r["batch"], r["q"]) for r in spark.read.parquet(path).collect()) == [(1, "a", "x"), (3, "c", "z"), (7, "b", "new"), (8, "d", "more")]
    dml.emptied(spark, path, "batch", "c")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 7, 8] and files_of("a") == before["a"]
