"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary: pieces of sampled texts of that language. A text is encoded in blocks once with every
dictionary; the language whose encodings are smallest in sum is chosen, and rejected where the margin to the second is narrow.

Texts are compared as words: lower case, runs of other characters than letters as one space, a word that repeats the one before left out, two bytes a
UTF-16 unit, so that the encoder's shortest match is two letters and short texts tell languages apart too. Blocks of BLOCK characters see the same
dictionary each, so a long text's own repeats don't outweigh it.

The fit reads at most PER_LANG sampled documents of each of the MOST_LANGS commonest languages and keeps PIECES pieces of PIECE characters of each, chosen by
hash from all pieces of those whole texts; every text is identified whole.
Defined results: texts that are null or have no letter are ``und`` with score 0; languages of equal size go to the first by name; without learned
languages every text is ``und``; a null language teaches nothing; repeated rows each get a row; extra columns are ignored; long texts are read in windows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import fold, map_slices, prepared, sole, table

HELD = (4, 2)
UND = "und"
#: Bounds of the fit: languages, documents and pieces a language, characters a piece.
MOST_LANGS, PER_LANG, PIECES, PIECE = 400, 400, 80, 400
BLOCK, WINDOW, LEVEL = 1024, 1 << 16, 3
SALTS = 16
#: Least margin to the second language, as a share of the smallest encoding.
MARGIN = 0.01
_OTHER = re.compile(r"[\W\d_]+")
_ENCODERS: dict[str, list] = {}


def words_of(text: str) -> str:
    """Letters of a text in lower case, words apart by one space and none the same as the one before."""
    words = _OTHER.sub(" ", text.lower()).split()
    return " ".join(w for w, before in zip(words, [None, *words], strict=False) if w != before)


def blocks(text: str | None, size: int) -> Iterator[str]:
    """The words of a whole text in blocks of at most ``size`` characters; none without letters."""
    for at in range(0, len(text or ""), WINDOW):
        words = words_of(text[at : at + WINDOW])
        for k in range(0, len(words), size):
            yield f" {words[k : k + size]} "


def encoded(block: str) -> bytes:
    return block.encode("utf-16-le", "surrogatepass")


def encoder(raw: bytes) -> zstandard.ZstdCompressor:
    """A compressor whose dictionary is raw content, prepared once for all blocks."""
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(raw), source_size=2 * BLOCK, write_content_size=0, write_checksum=0, write_dict_id=0)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def sizes(text: str | None, encoders: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of a text's blocks by each encoder; empty without letters."""
    total = None
    for block in blocks(text, BLOCK):
        raw = encoded(block)
        own = [len(e.compress(raw)) for e in encoders]
        total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
    return total or []


def verdict(langs: list[str], found: list[int], margin: float) -> tuple[str, float, bool]:
    """Language of the smallest encoding, its share when a byte counts as a factor of two, and whether the margin is wide enough."""
    if not found:
        return UND, 0.0, False
    least = min(found)
    share = 1 / sum(2.0 ** -min(s - least, 1000) for s in found)
    second = sorted(found)[1] if len(found) > 1 else float("inf")
    return langs[found.index(least)], share, second - least >= margin * least


def _first(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, of which at most SALTS * n meet in one task: first those of each share of a group by hash, then those of the group."""
    for keys in ([*by, F.pmod(order[0], F.lit(SALTS))], by):
        df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")
    return df


def dictionaries(docs: DataFrame, held: tuple[int, int] | None = HELD) -> dict[str, bytes]:
    """Raw dictionary of each language from a sample of the rows outside the held-out fold (modulus, remainder); at most 64 KB each."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    if held:
        own = own.filter(fold(F.col("doc_id"), held[0]) != held[1])
    ids = own.groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    langs = [r["lang"] for r in ids.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()]
    some = _first(ids.filter(F.col("lang").isin(langs)), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], PER_LANG).select("lang", F.col("doc_id").alias("_id"))
    # At most MOST_LANGS * PER_LANG ids are broadcast; the pieces are cut where the texts are.
    texts = own.join(F.broadcast(some.withColumnRenamed("lang", "_lang")), (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("lang", "text")

    def cut(part: pa.RecordBatch) -> dict:
        found: dict[tuple[str, str], None] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            found.update(((lang, b), None) for b in blocks(text, PIECE))
        return {"lang": [k[0] for k in found], "piece": [k[1] for k in found]}

    pieces = map_slices(texts, lambda: cut, "lang string, piece string").distinct()
    rows = _first(pieces, ["lang"], [F.xxhash64("piece"), F.col("piece")], PIECES).collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["piece"])):
        out[r["lang"]] = out.get(r["lang"], b"") + encoded(r["piece"])
    return out


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred (the smallest encoding's), score (0 to 1), accepted (margin wide enough), lang (lang_pred, or ``und`` where rejected); no shuffle."""
    spark = prepared(docs.sparkSession)
    langs = sorted(model)
    sent = spark.sparkContext.broadcast([model[lang] for lang in langs])
    key = uuid.uuid4().hex

    def work() -> Callable[[pa.RecordBatch], dict]:
        sole("langid", _ENCODERS.clear)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = [encoder(raw) for raw in sent.value]
        encoders = _ENCODERS[key]

        def each(part: pa.RecordBatch) -> dict:
            found = [verdict(langs, sizes(t, encoders), margin) for t in part.column("text").to_pylist()]
            return {
                "doc_id": part.column("doc_id"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "accepted": [f[2] for f in found],
                "lang": [f[0] if f[2] else UND for f in found],
            }

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_slices(rows, work, "doc_id long, lang_pred string, score double, accepted boolean, lang string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, dictionaries(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), "lang_pred", "score", "accepted")
