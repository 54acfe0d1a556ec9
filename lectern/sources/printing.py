"""Lesson summaries as PDF files, and their validation.

Lines are broken by glyph widths and pages filled in Spark tasks; a document's pages are put into one file by one task. Text that the viewer's Helvetica
has is written in it, any other with 16-bit codes and a map to Unicode, so that it can be read back; the viewer has to have a font for it, none is embedded.
Pages are A4; every page ends with ``Page i of n``. A line that is longer than the page is wide breaks at spaces, a word that is, between characters; a bullet's lines stay together where a page can hold them.

Defined results: a summary without bullets says so; null names are ``Lesson`` and the number; documents without lessons give no file; control characters are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Widths of the printable ASCII characters of Helvetica in thousandths, from the space on: fixed values of the standard font.
WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
OTHER = 600
PAGE, MARGIN, FOOT = (595.28, 841.89), 40.0, 46.0
TITLE = "EXAM REVISION NOTES"
#: Kind of a line to its font size, its height and how far it is set in.
LOOK = {"title": (15.0, 24.0, 0.0), "meta": (9.0, 13.0, 0.0), "lesson": (11.0, 26.0, 0.0), "pages": (8.5, 16.0, 0.0), "bullet": (10.0, 15.0, 0.0)}
_CONTROL = re.compile(r"[\x00-\x1f\x7f]+")


def width(text: str, size: float) -> float:
    return sum(WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else OTHER for c in text) * size / 1000


def broken(text: str, size: float, most: float) -> list[str]:
    """Lines of a text that are at most so wide; words that are wider are cut."""
    lines, line, used = [], "", 0.0
    space = width(" ", size)
    for word in _CONTROL.sub(" ", text).split(" "):
        if not word:
            continue
        own = width(word, size)
        if line and used + space + own <= most:
            line, used = f"{line} {word}", used + space + own
            continue
        if line:
            lines.append(line)
        while own > most:
            n = 1
            while width(word[: n + 1], size) <= most:
                n += 1
            lines.append(word[:n])
            word = word[n:]
            own = width(word, size)
        line, used = word, own
    return [*lines, line] if line else lines


def _shown(text: str) -> list[tuple[str, bytes]]:
    """Font and string operand of each run of a line."""
    out: list[tuple[str, bytes]] = []
    for wide, run in ((w, "".join(c for _, c in g)) for w, g in _runs(text)):
        if wide:
            out.append(("U", b"<" + run.encode("utf-16-be").hex().upper().encode() + b">"))
        else:
            out.append(("H", b"(" + re.sub(rb"([\\()])", rb"\\\1", run.encode("cp1252")) + b")"))
    return out


def _plain(c: str) -> bool:
    try:
        c.encode("cp1252")
    except UnicodeEncodeError:
        return False
    return True


def _runs(text: str) -> Iterator[tuple[bool, list[tuple[bool, str]]]]:
    held: list[tuple[bool, str]] = []
    for c in text:
        wide = not _plain(c)
        if held and held[-1][0] != wide:
            yield held[-1][0], held
            held = []
        held.append((wide, c))
    if held:
        yield held[-1][0], held


def paged(blocks: list[tuple[str, str]]) -> list[list[tuple[float, float, float, str]]]:
    """Pages of lines (x, y, size, text) from (kind, text) blocks, each kept on one page if it fits on any."""
    pages: list[list[tuple[float, float, float, str]]] = [[]]
    top, bottom = PAGE[1] - MARGIN, FOOT
    y = top
    for kind, text in blocks:
        size, height, inset = LOOK[kind]
        lines = broken(text, size, PAGE[0] - 2 * MARGIN - inset)
        if y - height * len(lines) < bottom and height * len(lines) <= top - bottom and y < top:
            pages.append([])
            y = top
        for line in lines:
            if y - height < bottom:
                pages.append([])
                y = top
            y -= height
            pages[-1].append((MARGIN + inset, y, size, line))
    return pages


def _content(lines: list[tuple[float, float, float, str]], number: int, of: int) -> bytes:
    foot = f"Page {number} of {of}"
    out = [b"0.5 w %.2f 32 m %.2f 32 l S" % (MARGIN, PAGE[0] - MARGIN)]
    for x, y, size, text in [*lines, (PAGE[0] - MARGIN - width(foot, 8.0), 20.0, 8.0, foot)]:
        out.append(b"BT 1 0 0 1 %.2f %.2f Tm" % (x, y) + b"".join(b" /%s %.1f Tf %s Tj" % (font.encode(), size, run) for font, run in _shown(text)) + b" ET")
    return b"\n".join(out)


def _map() -> bytes:
    """ToUnicode map of 16-bit codes to themselves, a range for each high byte."""
    ranges = [b"<%02X00> <%02XFF> <%02X00>" % (h, h, h) for h in range(256)]
    blocks = b"\n".join(b"%d beginbfrange\n%s\nendbfrange" % (len(ranges[i : i + 64]), b"\n".join(ranges[i : i + 64])) for i in range(0, 256, 64))
    head = b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Codes def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n"
    return head + blocks + b"\nendcmap\nend\nend"


def pdf_of(pages: list[list[tuple[float, float, float, str]]]) -> bytes:
    """A PDF file of laid-out pages."""
    stream = lambda data: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(z := zlib.compress(data)), z)
    kids = b" ".join(b"%d 0 R" % (8 + 2 * n) for n in range(len(pages)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 %.2f %.2f] /Resources << /Font << /H 3 0 R /U 4 0 R >> >> >>" % (len(pages), kids, *PAGE),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 7 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor 6 0 R /DW %d >>" % OTHER,
        b"<< /Type /FontDescriptor /FontName /Helvetica /Flags 32 /FontBBox [-166 -225 1000 931] /ItalicAngle 0 /Ascent 718 /Descent -207 /CapHeight 718 /StemV 88 >>",
        stream(_map()),
    ]
    for n, lines in enumerate(pages):
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (9 + 2 * n), stream(_content(lines, n + 1, len(pages)))]
    out, starts = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for number, body in enumerate(objects, 1):
        starts.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = b"".join(b"%010d 00000 n \n" % at for at in starts)
    out += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(starts) + 1, table, len(starts) + 1, len(out))
    return bytes(out)


def heading(number: Column, name: Column) -> Column:
    named = F.when(X.strip(F.coalesce(name, F.lit(""))) == "", F.concat(F.lit("Lesson "), number)).otherwise(X.strip(name))
    return F.concat(F.lit("LESSON "), number, F.lit(" — "), F.upper(named))


def blocks_of(lessons: DataFrame, document: str) -> DataFrame:
    """(document, place, kind, text) of lessons (document, place, lesson_number, lesson_name, start_page, end_page, bullets, source_filename, board, standard, subject, difficulty) in print order."""
    c = F.col
    bullets = F.coalesce("bullets", F.array().cast("array<string>"))
    points = F.concat(F.size(bullets).cast("string"), F.lit(" Exam Points"))
    span = F.when((F.coalesce("start_page", F.lit(0)) > 0) & (F.coalesce("end_page", F.lit(0)) > 0), F.concat(F.lit("Pages "), c("start_page").cast("string"), F.lit("–"), c("end_page").cast("string"), F.lit("  •  "), points)).otherwise(points)
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    printed = lambda x: X.print_math(F.coalesce(x, F.lit("")))
    numbered = F.transform(bullets, lambda b, i: F.struct(F.lit("bullet").alias("kind"), F.concat((i + 1).cast("string"), F.lit(". "), printed(b)).alias("text")))
    none = F.array(block("bullet", F.lit("- No summary points recorded.")))
    own = F.concat(F.array(block("lesson", heading(F.coalesce(c("lesson_number").cast("string"), c("place").cast("string")), c("lesson_name"))), block("pages", span)), F.when(F.size(bullets) > 0, numbered).otherwise(none))
    some = lambda title, text: F.when(text != "", block("meta", F.concat(F.lit(title + ": "), text)))
    filled = lambda x: F.when(F.coalesce(c(x), F.lit("")) != "", c(x))
    head = F.array(block("title", F.lit(TITLE)), some("Document", F.coalesce("source_filename", F.lit(""))), some("Curriculum", F.concat_ws("  |  ", filled("board"), filled("standard"), filled("subject"))), some("Difficulty", F.initcap(F.coalesce("difficulty", F.lit("")))))
    placed = lambda place, blocks: F.transform(blocks, lambda b, i: F.struct(place.cast("long").alias("place"), i.alias("line"), b["kind"].alias("kind"), b["text"].alias("text")))
    none_before = F.array().cast("array<struct<place:bigint,line:int,kind:string,text:string>>")
    # The head goes with the first lesson rather than as rows of a union: Spark 4.1 takes a union of parts that are dealt by document as dealt by document, and then adaptive execution deals the parts apart.
    first = F.row_number().over(Window.partitionBy(document).orderBy("place", "source_filename")) == 1
    rows = lessons.withColumn("_first", first)
    return rows.select(document, F.inline(F.concat(F.when(c("_first"), placed(F.lit(-1), F.array_compact(head))).otherwise(none_before), placed(c("place"), own))))


def printed_files(lessons: DataFrame, document: str = "batch_id") -> DataFrame:
    """document, pages and content (a PDF file) of the lessons of each document; a null document is one of its own."""
    blocks = blocks_of(lessons, document).repartition(document).sortWithinPartitions(document, "place", "line")
    kind = blocks.schema[document].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            out = []
            for name, sort, text in zip(batch["document"], batch["kind"], batch["text"], strict=True):
                if held is None or name != now:
                    if held:
                        out.append((now, *_file(held)))
                    now, held = name, []
                held.append((sort, text))
            if out:
                yield pd.DataFrame(out, columns=["document", "pages", "content"])
        if held:
            yield pd.DataFrame([(now, *_file(held))], columns=["document", "pages", "content"])

    files = blocks.select(F.col(document).alias("document"), "kind", "text").mapInPandas(run, f"document {kind}, pages int, content binary")
    return files.withColumnRenamed("document", document)


def _file(blocks: list[tuple[str, str]]) -> tuple[int, bytes]:
    pages = paged(blocks)
    return len(pages), pdf_of(pages)


#: What a file of lessons must not have: a summary of the whole document. Fixed values.
UNWANTED = (r"(?i)complete\s+pdf\s+summary", r"(?i)overall\s+pdf\s+summary", r"(?i)whole\s+book\s+summary", r"(?i)combined\s+summary")


def validated(pages: DataFrame, lessons: DataFrame, document: str = "batch_id") -> DataFrame:
    """document, status, page_count, lessons, headings, total, found, coverage_ratio and characters of each printed document.

    ``pages`` (document, num, text) are those read back, ``lessons`` what was to be printed. A document is FAIL without pages or with an unwanted summary, WARN with
    replacement characters, else PASS. A bullet is found by its first 30 printed characters and a heading by its number, both ignoring case and where lines break.
    """
    c = F.col
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("num", "text"))), lambda x: x["text"]), "\n")
    flat = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    read = pages.groupBy(document).agg(F.count(F.lit(1)).alias("page_count"), text.alias("text")).withColumn("_flat", flat(c("text")))
    bullets = F.coalesce("bullets", F.array().cast("array<string>"))
    number = F.coalesce(c("lesson_number").cast("string"), c("place").cast("string"))
    own = lessons.select(F.col(document).alias("_d"), flat(F.concat(F.lit("lesson "), number, F.lit(" —"))).alias("_head"), F.transform(bullets, lambda b: flat(F.substring(X.print_math(F.coalesce(b, F.lit(""))), 1, 30))).alias("_bullets"))
    both = own.join(read.select(F.col(document).alias("_r"), "_flat"), c("_d").eqNullSafe(c("_r")), "left").withColumn("_flat", F.coalesce("_flat", F.lit("")))
    hits = F.size(F.filter("_bullets", lambda b: (b != "") & F.contains("_flat", b)))
    counts = both.groupBy("_d").agg(
        F.count(F.lit(1)).alias("lessons"), F.count_if(F.contains("_flat", "_head")).alias("headings"), F.sum(F.size("_bullets")).alias("total"), F.sum(hits).alias("found"),
    )
    rows = counts.join(read.drop("_flat").withColumnRenamed(document, "_p"), c("_d").eqNullSafe(c("_p")), "left")
    unwanted = F.lit(False)
    for pattern in UNWANTED:
        unwanted = unwanted | F.coalesce(c("text"), F.lit("")).rlike(pattern)
    status = F.when(c("page_count").isNull() | unwanted, "FAIL").when(F.contains(c("text"), F.lit("�")), "WARN").otherwise("PASS")
    ratio = F.round(c("found") / F.greatest(F.lit(1), c("total")), 4)
    return rows.select(
        c("_d").alias(document), status.alias("status"), F.coalesce("page_count", F.lit(0)).alias("page_count"), "lessons", "headings", "total", "found", ratio.alias("coverage_ratio"),
        F.coalesce(F.length("text"), F.lit(0)).alias("characters"),
    )
