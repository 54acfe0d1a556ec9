"""Language by compression, importance resampling and conversation repair against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lectern.llm import brown, importance, langid, order_minhash, structure, toxicity
from lectern.llm.common import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score long, rank string, able string, weight string"
CHAT = "conv_id long, turn long, role string, text string, nth string, fault string, audit string, place string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x", "y", "z") for i, t, lang in rows], DOCS)


def prose(seed, n, words=None):
    r = random.Random(seed)
    return " ".join(r.choice(words or [f"w{k}" for k in range(60)]) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "a b"), (5, "a b"), (6, prose(2, 30)), (6, prose(2, 30)), (None, prose(3, 40)), (None, None), (8, "é" * 50 + " 12 " + prose(8, 25)), (9, prose(1, 3000)), (10, "x" * 70000)]


# importance resampling


def brute_importance(docs, target, percent=5, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    features = lambda w: [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    place = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000), np.zeros(10000)
    for _, x in docs:
        for f in features(words(x)):
            s[place(f)] += 1
    for x in target:
        for f in features(words(x)):
            t[place(f)] += 1
    gain = [math.floor(1000.0 * math.log((t[b] + 1) * (t.sum() * 0 + s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        own = features(words(x))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in own)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: math.floor(percent * len(able) / 100)]
    return [(*r[:4], next((n for n, d in enumerate(drawn, 1) if d is r), None)) for r in rows]


def by_row(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("percent", [5, 60])
def test_importance_matches_brute_force(spark, percent):
    rows = [(n, prose(n, 5 + n * 7 % 90)) for n in range(70)] + ODD
    target = [prose(500, 40), None, "", "a b c", prose(501, 12)]
    held = spark.createDataFrame([(str(n), t, 1) for n, t in enumerate(target)], "item_id string, text string, bucket int")
    got = importance.resampled(docs_of(spark, [(*r, "en") for r in rows]).repartition(5), held, percent).collect()
    assert by_row(got) == by_row(brute_importance(rows, target, percent))


def test_importance_of_empty_tables(spark):
    none = docs_of(spark, [])
    assert importance.resampled(none, none).collect() == []
    rows = [(1, prose(1, 30))]
    assert by_row(importance.resampled(docs_of(spark, [(*rows[0], "en")]), none, 100).collect()) == by_row(brute_importance(rows, [], 100))


@pytest.mark.parametrize("limit", [1, 2, 7, 10**6])
def test_tries_are_the_same_wherever_they_are_closed(limit):
    texts = [t for _, t in ODD] + [prose(n, 50) for n in range(5)]
    whole = np.zeros(importance.BUCKETS, np.int64)
    gains = np.random.default_rng(3).integers(-9, 9, importance.BUCKETS)
    features, weight, words = (np.zeros(len(texts), np.int64) for _ in range(3))
    for trie, of, starts in importance.tries(iter(texts), limit):
        whole += trie.buckets()
        f, w = trie.walked(gains)
        np.add.at(features, of[: len(f)], f)
        np.add.at(weight, of[: len(w)], w)
        np.add.at(words, of, starts)
    for n, text in enumerate(texts):
        own = [x.decode() for x in importance.words_of(text)]
        runs = [" ".join(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1)]
        assert (words[n], features[n]) == (len(own), len(runs))
        assert weight[n] == sum(int(gains[zlib.crc32(r.encode()) % importance.BUCKETS]) for r in runs)
        np.subtract.at(whole, [zlib.crc32(r.encode()) % importance.BUCKETS for r in runs], 1)
    assert not whole.any()


# language by compression


LANGS = {"aa": ["the", "and", "house", "water", "ship", "thing", "with", "over"], "bb": ["der", "und", "haus", "wasser", "schiff", "ding", "mit", "über"], "cc": ["ель", "море", "дом", "вода", "и", "над"]}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(n, prose(n, 60, LANGS[k]), k) for n, k in enumerate(list(LANGS) * 30)]
    return langid.dictionaries(docs_of(spark, [*rows, (900, "zz zz", None), (901, None, "aa"), (None, prose(1, 20, LANGS["aa"]), "aa")]), None)


def test_languages_match_brute_force(spark, model):
    assert sorted(model) == sorted(LANGS) and all(len(v) <= 2 * langid.PIECES * (langid.PIECE + 2) for v in model.values())
    rows = [(n, prose(1000 + n, 1 + n * 13 % 400, LANGS[k]), k) for n, k in enumerate(list(LANGS) * 20)] + [(i, t, None) for i, t in ODD] + [(70, "12 34 !!", "aa"), (71, prose(5, 40000, LANGS["cc"]), "cc")]
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9), r["accepted"], r["lang"]) for r in langid.identify(docs_of(spark, rows), model).collect()}
    names, want = sorted(model), set()
    tools = []
    for lang in names:
        held = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=len(model[lang]), source_size=2 * langid.BLOCK, write_content_size=0, write_checksum=0, write_dict_id=0)
        held.precompute_compress(compression_params=how)
        tools.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how))
    for i, text, _ in rows:
        own = [0] * len(names)
        letters = False
        for at in range(0, len(text or ""), langid.WINDOW):
            words = re.findall(r"[^\W\d_]+", text[at : at + langid.WINDOW].lower())
            line = " ".join(k for k, _ in itertools.groupby(words))
            letters |= bool(words)
            for k in range(0, len(line), langid.BLOCK):
                own = [s + len(c.compress(f" {line[k:k + langid.BLOCK]} ".encode("utf-16-le"))) for s, c in zip(own, tools, strict=True)]
        if not letters:
            want.add((i, "und", 0.0, False, "und"))
            continue
        first, second = sorted(own)[:2]
        best, sure = names[own.index(first)], second - first >= langid.MARGIN * first
        want.add((i, best, round(1 / sum(2.0 ** -min(s - first, 1000) for s in own), 9), sure, best if sure else "und"))
    assert got == want
    right = [r for r in want if r[0] is not None and r[0] < 60]
    assert sum(r[1] == list(LANGS)[r[0] % 3] for r in right if len(prose(1000 + r[0], 1 + r[0] * 13 % 400, LANGS[list(LANGS)[r[0] % 3]])) > 20) >= 50


def test_language_of_odd_tables(spark):
    none = docs_of(spark, [])
    assert langid.dictionaries(none) == {} and langid.identify(none, {}).collect() == []
    assert langid.identify(docs_of(spark, [(1, "some words", "aa")]), {}).first()["lang_pred"] == "und"
    only = langid.identify(docs_of(spark, [(1, "some words", "aa"), (2, "1", "aa")]), {"aa": langid.encoded("words of one language")}).collect()
    assert [(r["lang_pred"], r["accepted"]) for r in only] == [("aa", True), ("und", False)]


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = langid.query(spark, folder).join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("lang")).first()
    assert rows[0] >= 0.99 and rows[1] > 200


# conversation repair


def brute_repair(rows):
    """Cheapest edits of (initial role, text, fault) rows by trying all: (cost, audit, repaired rows)."""
    best = None
    inserted = [x for n in range(4) for x in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}
    for gaps in itertools.product(inserted, repeat=len(rows) + 1):
        if sum(map(len, gaps)) > 3:
            continue
        for edits in itertools.product("KuaD", repeat=len(rows)):
            out = [(names[x], "") for x in gaps[0]]
            cost, audit = 3 * len(gaps[0]), "I" * len(gaps[0])
            for (role, text, fault), edit, gap in zip(rows, edits, gaps[1:], strict=True):
                if edit != "D":
                    if fault in (1, 2):
                        break
                    out.append((role if edit == "K" else names[edit], text))
                cost += {"K": 0, "D": 4}.get(edit, 3) + (3 if edit != "D" and fault == 3 else 0) + 3 * len(gap)
                audit += {"K": "K", "D": "D"}.get(edit, "R") + "I" * len(gap)
                out += [(names[x], "") for x in gap]
            else:
                if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, out)
    return best


def brute_report(conv, rows):
    order = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    seen, marked = set(), []
    for t, r, x in order:
        core = x.rstrip(" \t\n\x0b\x0c\r")
        marked.append((r, x, 1 if not core else 2 if (r, x) in seen else 3 if core[-1] not in ".!?" else 0))
        seen.add((r, x))
    turns = [t for t, _, _ in order if t is not None]
    cost, audit, out = brute_repair(marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    n = [m[2] for m in marked]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, n.count(1), n.count(2), n.count(3), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


def chat_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CHAT)


def test_repair_matches_brute_force(spark):
    r = random.Random(11)
    rows = []
    for conv in range(60):
        for _ in range(r.randint(1, 4)):
            rows.append((conv, r.choice((None, 0, 1, 2, 5)), r.choice(("user", "user", "assistant", "assistant", "system", "tool", "", None)), r.choice(("Yes.", "No!", "Well", "", " \n", None, "So? "))))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (99, 0, "user", "Hi."), (99, 0, "user", "Hi."), (98, 1, "user", "cut"), (98, 1, "user", "cut")]
    got = structure.report(chat_of(spark, rows).repartition(3), chat_of(spark, [*rows, (1000, 1, "user", "gone.")])).collect()
    want = [brute_report(c, rows) for c in {x[0] for x in rows}] + [(1000, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert by_row(got) == by_row(want)
    assert structure.report(chat_of(spark, []), chat_of(spark, [])).collect() == []


def test_long_conversations_keep_one_audit(spark):
    """Rows beyond what a search holds open, in many Arrow batches, against a search that never puts anything away; texts of any length."""
    r = random.Random(4)
    kinds = [("user", "Go on."), ("assistant", "Sure."), ("system", "Note."), ("tool", "x"), ("user", "")]
    rows = [(1, n, *(r.choice(kinds))) for n in range(3000)] + [(2, n, "user", "") for n in range(1500)] + [(3, n, ("user", "assistant")[n % 2], f"{n}" * 2000 + ".") for n in range(700)]
    rows = [(c, n, role, text and f"{text[:-1]} {n}{text[-1]}") for c, n, role, text in rows]
    found = structure.audits(structure.faulted(chat_of(spark, rows))).collect()
    for row in found:
        layer = structure.closed([(0, ""), None, None, None])
        seen = set()
        for c, _n, role, text in rows:
            if c == row["conv_id"]:
                fault = 1 if not text else 2 if (role, text) in seen else 0 if text[-1] in ".!?" else 3
                seen.add((role, text))
                layer = structure.stepped(layer, role[:1], fault)
        assert (row["cost"], row["audit"]) == min(layer[s] for s in structure.ENDS)


def test_repaired_rows_keep_the_grammar(spark, sf):
    chat = spark.read.parquet(f"{sf}/conversations.parquet")
    faults = structure.faulted(structure.damaged(chat)).checkpoint()
    rows = structure.repaired(faults, structure.audits(faults)).collect()
    by = {}
    for x in sorted(rows, key=lambda x: (x["conv_id"], x["place"])):
        by.setdefault(x["conv_id"], []).append(x)
    assert by and all(re.fullmatch(r"s?(ua)+", "".join(x["role"][0] for x in own)) for own in by.values())
    assert all((x["turn"] is None) == (x["edit"] == "I") for x in rows)


# toxicity


def test_toxicity_finds_insults_with_letters_put_in(spark):
    """Its own landmarks, put into held-out clean texts that it scores clean: whole, with signs, and with one or two random letters anywhere."""
    folder = "/root/testdata/sf0.1"
    model = toxicity.trained(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text IS NOT NULL")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IN (0, 1)").select("doc_id", "toxic")
    rows = sorted(map(tuple, docs.select("doc_id", "text").join(labels, "doc_id").filter(fold(F.col("doc_id"), 5) == 0).collect()))
    score, label = np.array(model.scores([t for _, t, _ in rows])) >= 0.5, np.array([v for _, _, v in rows])
    assert (score == label).mean() >= 0.98 and score[label == 0].mean() <= 0.02 and score[label == 1].mean() >= 0.9
    clean = [t.split() for (_, t, v), s in zip(rows, score, strict=True) if not v and not s][:150]
    insults = [w for w in model.landmarks if re.fullmatch("[a-z]{4,10}", w) and not re.match("achlich|bomente", w)][:8]
    r = random.Random(5)
    ways = {
        "plain": (lambda w: w, 0.97), "dashes": ("-".join, 0.95), "star": (lambda w: w[: len(w) // 2] + "*" + w[len(w) // 2 :], 0.95),
        "one": (lambda w: toxicity.with_letters(w, 1, r), 0.8), "two": (lambda w: toxicity.with_letters(w, 2, r), 0.4),
    }
    for name, (change, least) in ways.items():
        texts = [" ".join([*w[: len(w) // 3], change(m), *w[len(w) // 3 :]]) for w in clean for m in insults]
        assert np.mean(np.array(model.scores(texts)) >= 0.5) >= least, name


def test_toxicity_takes_long_texts_in_parts(monkeypatch):
    kernel = toxicity.Kernel(["idiot", "loser"])
    texts = [[f"w{n}" for n in range(50)] + ["idiots"], [], ["loser"] * 30, [f"v{n}x" for n in range(9)]]
    whole = toxicity.View(kernel).texts(texts)
    monkeypatch.setattr(toxicity, "MEMO", 14)
    assert np.allclose(toxicity.View(kernel).texts(texts), whole, atol=1e-5)


def test_toxicity_ceilings_leave_out_what_clean_words_come_near_to():
    clean = ["the motion of water", "a nation of people", "ideas and idioms"] * 20
    bad = ["you idiot there", "what an idiot", "motionx is here", "such motionx"] * 10
    model = toxicity.fit([(t, 0) for t in clean] + [(t, 1) for t in bad])
    room = dict(zip(model.landmarks, model.room, strict=False))
    assert np.isfinite(room["idiot"]) and not np.isfinite(room["motionx"])


# plain columns of operators whose other columns SQL cannot express


def duck(folder, sql):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return c.execute(sql).fetchall()


def test_counts_of_the_language_model_match_sql(spark, sf):
    sql = (
        importance.CRC_TABLE
        + r""",
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      xor(__CRC__, 4294967295) % 7 = 2 AS held FROM documents, crc_table),
t AS (SELECT doc_id, held, unnest(list_append(w, NULL)) AS x FROM w),
c AS (SELECT coalesce(x, ' ') AS x, count(*) AS c FROM t WHERE NOT held GROUP BY ALL),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held, count(*) AS n_tokens, count(c.c) AS n_known, max(n)::bigint AS train_tokens, sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1))) AS base_score
FROM t LEFT JOIN c ON c.x = coalesce(t.x, ' '), n GROUP BY doc_id, held"""
    ).replace("__CRC__", importance.CRC.format("doc_id::varchar"))
    rows = brown.query(spark, sf).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()
    rounded = lambda rows: sorted((*r[:5], round(r[5], 6)) for r in map(tuple, rows))
    assert rounded(rows) == rounded(duck(sf, sql))


def test_edited_texts_of_fingerprints_match_sql(spark, sf):
    sql = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM d)
SELECT doc_id, length(t), sha256(left(t, length(t) - length(t) // 3) || left(after, length(t) // 3)) FROM n"""
    rows = order_minhash.query(spark, sf).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(duck(sf, sql))


def test_words_with_few_neighbours_choose_as_units_do():
    r = np.random.default_rng(1)
    joint = r.integers(50, 5000, (9, 9)).astype(float)
    out, into = (r.poisson(0.4, (300, 9)).astype(float) for _ in range(2))
    own, old = r.poisson(0.2, 300).astype(float), r.integers(0, 8, 300)
    assert (brown.best_classes_of_few(joint, old, out, into, own) == brown.best_classes(joint, old, out, into, own)).all()
    none = np.zeros((0, 9))
    assert len(brown.best_classes_of_few(joint, np.zeros(0, np.int64), none, none, np.zeros(0))) == 0


# memory of tasks


def test_tables_between_stages_have_small_row_groups(spark):
    import pyarrow.parquet as pq

    from lectern.llm.common import BATCH_ROWS, GROUP_BYTES, written

    rows = spark.range(0, 3000, 1, 1).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.md5(F.concat(F.col("id").cast("string"), k.cast("string"))))).alias("text"))
    made = written(rows, "groups")
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 2 * GROUP_BYTES and made.count() == 3000
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(BATCH_ROWS)


def test_sweeps_of_the_class_model_write_no_table(spark, monkeypatch):
    made = []
    real = brown.written
    monkeypatch.setattr(brown, "written", lambda df, name: made.append(name) or real(df, name))
    brown.score(docs_of(spark, [(n, prose(n, 300), "en") for n in range(60)]).checkpoint(), least=1, tolerance=0.0).count()
    assert sorted(made) == ["coded", "others"]


def test_texts_are_split_twice_by_the_class_model(spark, monkeypatch):
    docs = docs_of(spark, [(n, prose(n, 300), "en") for n in range(60)]).checkpoint()
    real, split = type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *args, **named: split.append("text" in self.columns) or real(self, *args, **named))
    rows = brown.score(docs, least=400)
    assert rows.count() == 60 and sum(split) == 2


def test_words_of_arrow_are_those_of_python():
    import pyarrow as pa

    texts = [" a  B\t\x0bC\x0c\r\n", "", None, "  ", "\x1cÉ\x85x\u2003y \x1f", "ÀB\u0130 K\u212a", "\n", "z"]
    for column in (pa.array(texts), pa.array(["gone", *texts, "gone"]).slice(1, len(texts))):
        words, n = brown.words_in(column)
        assert words.to_pylist() == [w for t in texts for w in brown.tokens_of(t)] and n.tolist() == [len(brown.tokens_of(t)) for t in texts]


def test_the_class_model_is_the_same_in_small_rows(spark, monkeypatch):
    """Words that stand in many coded rows, and that go on over many batches, choose and score as in one; words that only other texts have are unseen."""
    r = random.Random(4)
    docs = docs_of(spark, [(n, " ".join(r.choice([f"w{r.randrange(60)}", f"rare{r.randrange(40)}", f"only{n}"]) for _ in range(n % 30)), "en") for n in range(120)] + [(None, None, "en"), (7, "w1 w1", "en")]).checkpoint()
    run = lambda: sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["n_tokens"], x["n_known"], round(x["base_score"], 6), round(x["score"], 6)) for x in brown.score(docs, units=20, endings=4, classes=3, least=15).collect()))
    whole = run()
    for name, value in (("PART", 9), ("AT_ONCE", 3), ("CHUNK", 5), ("COUNTED", 4), ("LONG", 1)):
        monkeypatch.setattr(brown, name, value)
    assert len(whole) == 122 and run() == whole
