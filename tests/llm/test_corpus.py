"""The corpus operators against brute force, and on nulls, empty texts, repeats, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, brown, chat, decontaminate, neardup, order_minhash, packing, quality, reputation, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _hits string, word string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], DOCS)


WORDS = [f"w{n}" for n in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    long = prose(1, 6000)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, prose(2, 80)), (7, prose(2, 80)), (None, prose(3, 40)), (None, None), (8, long), (9, long + " tail"), (10, "é" * 50)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return docs_of(spark, odd_rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# near duplicates


def brute_groups(rows, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, len(sets[n]), least.get(find(n)) if sets[n] else i) for n, (i, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(5)
    base = [prose(100 + n, 60) for n in range(6)]
    rows = []
    for n in range(150):
        w = base[n % 6].split()
        for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((n, " ".join(w)))
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(docs_of(spark, rows)).collect())
    assert got == sorted(brute_groups(rows))


def groups_of(spark, rows, **how):
    return sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(docs_of(spark, rows), **how).collect())


@pytest.mark.parametrize(("block", "shingles", "spokes"), [(2, 400_000, 256), (1024, 300, 2), (1024, 400_000, 256)])
def test_strays_are_compared_in_blocks(spark, monkeypatch, block, shingles, spokes):
    """A chain of texts in which neighbours are alike but the ends are not, in blocks of two members or of few shingles."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SHINGLES", shingles)
    monkeypatch.setattr(neardup, "SPOKES", spokes)
    w = prose(9, 120).split()
    rows = []
    for n in range(24):
        rows.append((n, " ".join(w)))
        w[(n * 5) % 120] = f"new{n}"
    assert groups_of(spark, rows) == sorted(brute_groups(rows))


@pytest.mark.parametrize("bound", [neardup.BROADCAST_IDS, 0])
def test_sets_of_repeated_ids(spark, monkeypatch, bound):
    """A doc_id on many rows, some with one text and some with others; ids sent to all tasks or shuffled."""
    monkeypatch.setattr(neardup, "BROADCAST_IDS", bound)
    a, b = prose(31, 60), prose(32, 60)
    rows = [(1, a)] * 5 + [(1, b), (2, a + " x"), (3, b + " y"), (None, a + " z"), (None, prose(33, 60))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    got = neardup.near_duplicates(docs_of(spark, rows).repartition(4)).collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=key) == sorted(brute_groups(rows), key=key)
    left = neardup.one_of_each(docs_of(spark, rows), percent=85, agree=38)
    assert sorted(x["doc_id"] for x in left.collect() if x["doc_id"] is not None) == [1, 1]


def test_recall_of_planted_near_copies(spark):
    """Pairs just above and just below the least likeness, of many sizes: every link is found and nothing else."""
    r = random.Random(77)
    rows = []
    for n in range(250):
        own = [f"p{n}_{k}" for k in range(r.choice((12, 40, 90, 400)))]
        other = list(own)
        shingles = len(own) - 4
        for at in range(0, len(own), 5):  # replaces words from the end until the likeness is near 0.85
            lost = min(shingles, at + 5)
            if (shingles - lost) / (shingles + lost) < 0.85:
                break
        other[len(own) - max(1, at - r.randint(-4, 4)):] = [f"q{n}_{k}" for k in range(max(1, at - 2))]
        rows += [(2 * n, " ".join(own)), (2 * n + 1, " ".join(other))]
    assert groups_of(spark, rows) == sorted(brute_groups(rows))


def test_near_duplicates_odd(odd, none, odd_rows):
    got = neardup.near_duplicates(odd).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=key) == sorted(brute_groups(odd_rows), key=key)
    assert neardup.near_duplicates(none).count() == 0


def test_one_of_each_keeps_columns(odd):
    left = neardup.one_of_each(odd)
    assert left.columns == odd.columns
    ids = sorted(x["doc_id"] for x in left.collect() if x["doc_id"] is not None)
    assert ids == [1, 2, 3, 4, 6, 8, 10]


def test_one_of_each_judges_rows_of_one_doc_id(spark):
    """doc_id 9 has a near copy of 3, a text of its own (with a copy under 12), another one, and that one again in capitals."""
    a, b, c = prose(70, 80), prose(71, 80), prose(72, 80)
    rows = [(3, a), (9, a + " tail"), (9, b), (12, b), (9, c), (9, c.upper()), (9, ""), (9, ""), (9, c + " tail")]
    left = sorted((x["doc_id"], x["text"].lower()) for x in neardup.one_of_each(docs_of(spark, rows)).collect())
    assert [x for x in left if not x[1].startswith(c)] == sorted([(3, a), (9, b), (9, "")]) and sum(x[1].startswith(c) for x in left) == 1


# decontamination


def brute_hits(docs, items, n=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for at in range(len(w) - k + 1) if w else ():
            grams.setdefault(tuple(w[at : at + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for at in range(len(w) - k + 1):
                g = tuple(w[at : at + k])
                if g in grams:
                    hit |= set(range(at, at + k))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(10, prose(50, 30)), (9, "Short ITEM here"), (9, prose(50, 30)), (None, prose(51, 12)), (3, None), (4, "!!")]


@pytest.mark.parametrize("bound", [200_000, 1])
def test_decontamination_matches_brute_force(spark, bound):
    docs = [(1, prose(50, 30)), (2, "a Short, item; HERE b"), (3, prose(51, 40)), (4, None), (5, ""), (5, ""), (6, prose(60, 20) + " " + prose(50, 30) + " " + prose(50, 30))]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.report(docs_of(spark, docs), items, bound=bound)
    assert sorted(map(tuple, got.collect())) == sorted(brute_hits(docs, ITEMS))


def test_decontamination_removes(spark, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, [(1, "Keep, a Short item HERE. End!"), (2, "clean\ttext."), (3, None)])
    assert sorted(x["doc_id"] for x in decontaminate.without_documents(docs, items).collect()) == [2, 3]
    cut = {x["doc_id"]: x for x in decontaminate.without_spans(docs, items).collect()}
    assert cut[1]["text"] == "Keep, a. End!" and cut[2]["text"] == "clean\ttext." and cut[3]["text"] is None and cut[1]["_hits"] == "y"
    assert decontaminate.report(none, items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).filter("contaminated").count() == 0


# BPE


@pytest.fixture(scope="module")
def tokenizers_pair():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.public_path())
    lib.no_truncation()
    lib.no_padding()
    return bpe.Tokenizer(bpe.read_vocabulary(None)), lib


def test_bpe_equals_library(tokenizers_pair):
    own, lib = tokenizers_pair
    r = random.Random(4)
    signs = "abcdefghijklmnopqrstuvwxyzéèßİΣσςſKÅ'’̧́ \t\n\x1c\x85\xa0 ,.!?019<|>%😀漢한ǅﬁ‍"
    texts = ["", "<|endoftext|>it's<|startoftext|>", "a" * 700, "ab" * 400 + "!!" * 90, "Ὀδυσσεύς ΣΑΣ"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(2000)] + ["".join(r.choice("abcdeinorst") for _ in range(r.randint(50, 400))) for _ in range(40)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        got = own.encode(text)
        assert got == want.ids, text
        assert own.decoder.pieces(got) == lib.decode(got, skip_special_tokens=False)


def test_bpe_stream_is_the_short_form_and_stays_small(tokenizers_pair):
    own, _ = tokenizers_pair
    r = random.Random(8)
    for _ in range(200):
        word = "".join(r.choice("aehinorst") for _ in range(r.randint(1, 60)))
        assert tuple(own.merges.stream(word)) == own.merges.word(word)
    long = "".join(r.choice("aehinorst") for _ in range(20_000))
    first = next(iter(own.merges.stream(iter(long))))
    assert own.names[first] == long[: len(own.names[first])]


def test_decoder_machine(tokenizers_pair):
    own, _ = tokenizers_pair
    assert "".join(own.decoder.text(own.encode("Größe 漢字 😀"))) == "größe 漢字 😀 "
    half = own.encode("😀")[:1]
    assert "\ufffd" in "".join(own.decoder.text(half)) or half == own.encode("😀")


def test_bpe_odd(odd, none):
    rows = bpe.encode_documents(odd).collect()
    assert len(rows) == odd.count() and {x["n_tokens"] for x in rows if x["doc_id"] in (1, 2, 3)} == {0}
    assert all(x["n_tokens"] == len(x["ids"]) for x in rows)
    assert bpe.encode_documents(none).count() == 0


# packing


def test_best_fit_is_best_fit():
    r = random.Random(3)
    for _ in range(150):
        length = r.choice((7, 16, 100))
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        rows = packing.best_fit(sizes, length)
        assert sorted(n for row in rows for n in row) == list(range(len(sizes)))
        rooms = []
        for size in sorted(sizes, reverse=True):
            fits = [x for x in rooms if x >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(length - size)
        assert sorted(length - sum(sizes[n] for n in row) for row in rows) == sorted(rooms)


@pytest.mark.parametrize("path", [None, bpe.public_path()])
def test_packing_round_trip(odd, none, odd_rows, path):
    own = packing.ids_of(bpe.read_vocabulary(path or bpe.public_path(packing.RANKS)), packing.public_pattern())
    rows = packing.pack(odd.filter("doc_id <> 5 AND doc_id IS NOT NULL"), length=64, path=path, group=5000).collect()
    matrix = packing.matrix_of(rows, 64)
    got = {}
    for row, ids in zip(rows, matrix, strict=True):
        assert row["position_resets"] == row["cu_seqlens"][:-1] and row["cu_seqlens"][-1] == row["n_tokens"] <= 64
        assert (packing.positions_of(row, 64)[row["position_resets"]] == 0).all()
        for n, (doc, part) in enumerate(zip(row["doc_ids"], row["parts"], strict=True)):
            got.setdefault(doc, {})[part] = ids[row["cu_seqlens"][n] : row["cu_seqlens"][n + 1]].tolist()
    for doc, text in odd_rows:
        if doc not in (5, None):
            whole = sum((got[doc][k] for k in sorted(got[doc])), [])
            assert whole == [*np.frombuffer(own.of(text), own.type).tolist(), own.end]
            assert path or own.text(np.array(whole)) == (text or "")
    assert packing.pack(none).count() == 0


# chat


def test_chat_events_fold(spark):
    log = [
        (1, 1, "a", "message", "user", "Hi"), (1, 2, "b", "message", "assistant", ""), (1, 3, "b", "delta", None, "Hel"), (1, 4, "b", "delta", None, "lo"),
        (1, 5, "a", "edit", None, "Hi!"), (1, 6, "b", "regenerate", None, "New"), (1, 7, "b", "delta", None, "er"), (1, 8, "c", "message", "user", "x"), (1, 9, "c", "delete", None, None),
        (None, 1, "z", "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq int, message string, kind string, role string, text string")
    got = sorted(((x["conv_id"] or 0, x["seq"], x["role"], x["text"]) for x in chat.fold_events(events).collect()))
    assert got == [(0, 1, "", ""), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Newer")]


def test_chat_round_trip(spark):
    nasty = ["", "\\", "###", "### user: </turn>\n", "a\\</turn>\nb", "</turn>", "\\\\#", "é\u2028", "x</turn>\n### assistant: y"]
    rows = [(1, n, ("user", "assistant", "a:b#")[n % 3], t) for n, t in enumerate(nasty)] + [(2, None, None, None), (2, None, None, None), (None, 0, "user", "u")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    got = {x["conv_id"]: x for x in chat.read_back(chat.render(chat.fold_events(chat.events_of(talk)))).collect()}
    text = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1)
    masked = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[1]["loss_sha256"] == hashlib.sha256(masked.encode()).hexdigest()
    assert got[1]["loss_chars"] == len(masked) and got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.render(chat.fold_events(chat.events_of(talk.limit(0))))).count() == 0


# classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels


@pytest.mark.parametrize(("module", "column", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_classifier_held_out(spark, labelled, module, column, least):
    docs, labels = labelled
    rows = module.classify(docs, module.trained(spark, "/root/testdata/sf0.01")).join(labels, "doc_id").filter("held_out").collect()
    right = sum(x["predicted"] == x[column] for x in rows) / len(rows)
    assert right >= least
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_odd(spark, odd, none, module):
    model = module.trained(spark, "/root/testdata/sf0.001")
    assert module.classify(odd, model).count() == odd.count()
    assert module.classify(none, model).count() == 0
    assert module.classify(odd, module.fit([])).count() == odd.count()
    kept = module.keep_clean(odd, model) if module is toxicity else module.keep_good(odd, model)
    assert kept.columns == odd.columns


def test_toxicity_tolerates_inserted_characters():
    clean = [prose(n, 30) for n in range(60)]
    bad = [c + (". You moron." if n % 2 else ". What an idiot.") for n, c in enumerate(clean[:40])]
    model = toxicity.fit([(t, 0) for t in clean] + [(t, 1) for t in bad])
    low = max(model.scores(clean))
    assert min(model.scores(["a m-o-r-o-n here", "such an id*iot", "i d i o t it is", "IDIOT!!", "m.o.r.o.n"])) > max(0.5, low)


def brute_kernel(a, b):
    """The sum over all common subsequences of three characters, by triples of places in both words."""
    from itertools import combinations

    def places(w):
        found = {}
        for i, j, k in combinations(range(len(w)), 3):
            if w[i] and w[j] and w[k]:
                found[w[i], w[j], w[k]] = found.get((w[i], w[j], w[k]), 0) + toxicity.LAMBDA ** (k - i + 1)
        return found

    x, y = places(a), places(b)
    return sum(v * y.get(t, 0) for t, v in x.items())


def test_toxicity_kernel_is_the_sum_over_subsequences():
    marks, words = ["idiot", "Größe".lower(), "идиот", "banana"], ["idiot", "id*iot", "i-d-i-o-t", "idxiot", "größer", "дурак", "идиоты", "bandana", "x", "ab", "aaaaaa", "***"]
    kernel = toxicity.Kernel(marks)
    got = kernel.words(words)
    coded = {w: toxicity.windows(w) for w in [*marks, *words]}
    for n, w in enumerate(words):
        for m, mark in enumerate(marks):
            want = 0.0
            if coded[w]:
                a, b = coded[w][0], coded[mark][0]
                want = (brute_kernel(a, b) / (brute_kernel(a, a) * brute_kernel(b, b)) ** 0.5) ** toxicity.POWER
            assert got[n, m] == pytest.approx(want, abs=1e-4), (w, mark)
    assert kernel.gram == pytest.approx(kernel.words(marks), abs=1e-5) and np.diag(kernel.gram) == pytest.approx(1, abs=1e-4)
    root = toxicity.root_of(kernel.gram)
    assert root @ kernel.gram @ root == pytest.approx(np.eye(len(marks)), abs=1e-3)
    long = "ab" * 40 + "idiot" + "cd" * 40
    assert kernel.words([long])[0, 0] > 0 and len(toxicity.windows(long)) > 1


def test_toxicity_features_are_the_pooled_kernel():
    kernel = toxicity.Kernel(["idiot", "loser"])
    texts = [toxicity.words_of(t) for t in ("an idiot, no an IDIOT", "", None, "you l o s e r here", "nothing")]
    got = toxicity.View(kernel).texts(texts)
    for n, words in enumerate(texts):
        like = kernel.words(words) if words else np.zeros((1, 2))
        assert got[n] == pytest.approx(np.r_[like.max(0), np.log1p(like.sum(0))], abs=1e-4)


def test_toxicity_sentences_cover_all_words():
    words = ("a b. c d! " + "e " * 60 + "f? g").split()
    starts = [int(x) for x in toxicity.sentence_starts(words)]
    assert starts[:3] == [0, 2, 4] and max(b - a for a, b in zip(starts, [*starts[1:], len(words)], strict=True)) <= toxicity.SENTENCE
    assert words[starts[-1]] == "g"


def test_labels_of_the_held_out_fold_are_never_read(spark, labelled):
    docs, labels = labelled
    from lectern.llm.common import fold, labelled_sample

    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert labelled_sample(docs, labels, "toxic", (5, 0), 50, 500) == labelled_sample(docs, turned, "toxic", (5, 0), 50, 500)


@pytest.mark.parametrize(("module", "column"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_are_fitted_on_whole_texts(spark, tmp_path, monkeypatch, module, column):
    ends = [(n, "clean words " * 2000 + f"end{n}") for n in range(20)]
    docs_of(spark, ends).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, n % 2, n % 2) for n in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(module, "fit", lambda rows: rows)
    rows = module.trained(spark, str(tmp_path))
    assert rows and {t for t, _ in rows} <= {t for _, t in ends}


# language model


def test_brown_base_score_and_odd(spark, odd, none, odd_rows):
    import math
    import zlib
    from collections import Counter

    counts, ends = Counter(), 0
    for i, t in odd_rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            ends += 1
    total, types = sum(counts.values()) + ends, len(counts) + 1
    want = sorted(
        (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(math.log10((c + 1) / (total + types + 1)) for c in [*(counts[x] for x in w), ends]), 6))
        for _, t in odd_rows for w in [(t or "").encode().lower().split()]
    )
    rows = brown.score(odd, units=20, endings=8, classes=4, head_size=50).collect()
    assert sorted((x["n_tokens"], x["n_known"], round(x["base_score"], 6)) for x in rows) == want
    assert all(x["score"] < 0 and x["train_tokens"] == total for x in rows)
    assert brown.score(none).count() == 0


def test_exchange_separates_two_languages():
    r = np.random.default_rng(2)
    pairs = np.zeros((9, 9))
    for _ in range(3000):
        group = r.integers(2)
        pairs[group * 4 + r.integers(4), group * 4 + r.integers(4)] += 1
    label = brown.exchange(pairs, 2)
    assert len(set(label[:4])) == 1 and len(set(label[4:8])) == 1 and label[0] != label[4]


def test_all_counted_words_are_clustered_by_their_neighbours(spark):
    """Two groups of words with the same endings that never stand together: far more words than seeds, most of them beyond the head."""
    r = random.Random(11)
    words = {g: [f"{g}{n}end" for n in range(300)] for g in "ab"}
    rows = [(n, " ".join(r.choice(words["ab"[n % 2]]) for _ in range(200))) for n in range(120)]
    mixed = [(1000 + n, " ".join(r.choice(words["ab"[k % 2]]) for k in range(200))) for n in range(40)]
    mixed = [x for x in mixed if brown_held(x[0])]
    rows = brown.score(docs_of(spark, rows + mixed), units=40, endings=4, classes=2, head_size=100).collect()
    per = lambda own: [x["score"] / x["n_tokens"] for x in rows if (x["doc_id"] >= 1000) == own]
    assert per(True) and max(per(True)) < min(per(False)) - 0.2


def brown_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % brown.HELD[0] == brown.HELD[1]


def test_exchange_ends_where_no_move_helps():
    r = np.random.default_rng(8)
    pairs = r.integers(0, 9, (14, 14)).astype(float)
    label = brown.exchange(pairs, 3)

    def worth(own):
        member = np.eye(4)[own]
        return brown.likelihood(member.T @ pairs @ member)

    for u in range(13):
        for c in range(3):
            moved = label.copy()
            moved[u] = c
            assert worth(moved) <= worth(label) + 1e-5


def coded_texts(spark, seed, units, n):
    r = np.random.default_rng(seed)
    ids = [np.concatenate(([units], r.integers(0, units, n), [units], [units])).astype(np.int32) for _ in range(5)]
    return ids, spark.createDataFrame([(bytearray(x.tobytes()),) for x in ids], "ids binary")


def test_units_choose_as_single_moves(spark):
    """A sweep's choice for each unit is the move that single moves of ``exchange`` and the likelihood give, and the counts sum to the table of classes."""
    ids, texts = coded_texts(spark, 4, 30, 400)
    label = np.append(np.random.default_rng(5).integers(0, 3, 30), 3).astype(np.int16)
    joint = brown.label_pairs(texts, label)
    counts = brown.neighbour_counts(texts, label, 4, block=7)
    assert (brown.class_table(counts, label, 4, joint[3, 3], block=7) == joint).all()
    got = brown.chosen(counts, label, joint, block=7)
    for u in range(30):
        worth = []
        for c in range(3):
            moved = label.copy()
            moved[u] = c
            pairs = np.zeros((4, 4))
            for x in ids:
                np.add.at(pairs, (moved[x[:-1]], moved[x[1:]]), 1)
            worth.append(brown.likelihood(pairs))
        assert got[u] == int(np.argmax(worth))
    assert got[30] == 3


def test_sweeps_never_lower_the_likelihood(spark):
    ids, texts = coded_texts(spark, 6, 40, 300)
    label = np.append(np.arange(40) % 3, 3).astype(np.int16)
    end, joint = brown.clustered(texts, label, tolerance=0.0)
    table = np.zeros((4, 4))
    for x in ids:
        np.add.at(table, (end[x[:-1]], end[x[1:]]), 1)
    assert (joint == table).all() and brown.likelihood(joint) > brown.likelihood(brown.label_pairs(texts, label))


def test_head_is_bounded(spark):
    rows = [(f"w{n}".encode(), c) for n, c in enumerate([2_000_000] * 6 + [1_500_000, 70, 70, 69, 5, 1])]
    counts = spark.createDataFrame(rows, "word binary, c long")
    assert brown.head_of(counts, 3) == [] and len(brown.head_of(counts, 6)) == 6 and len(brown.head_of(counts, 8)) == 7
    assert [c for _, c in brown.head_of(counts, 100, 69)][-1] == 69 and len(brown.head_of(counts, 100)) == 12 and brown.head_of(counts, 100, 10**9) == []


def test_rare_words_choose_by_their_neighbours(spark):
    """Every word beyond the head has the class that alone raises the likelihood most, others standing for their endings; the table counts all in their classes."""
    import zlib

    r = random.Random(3)
    heads = [f"h{n}" for n in range(6)]
    texts = [[r.choice(heads) if r.random() < 0.6 else f"rare{r.randrange(20)}" for _ in range(60)] for _ in range(30)] + [[], ["h1"], ["lone"], ["twice", "twice"]]
    class_of = np.array([0, 0, 1, 1, 2, 2, 0, 1, 2, 0, 3], np.int16)  # six head words, four endings, the end
    unit = {w: n for n, w in enumerate(heads)}
    spot = lambda w: unit[w] if w in unit else 6 + zlib.crc32(w.encode()[-3:]) % 4

    def table(of):
        out = np.zeros((4, 4))
        for t in texts:
            walk = [3, *map(of, t), 3]
            np.add.at(out, (walk[:-1], walk[1:]), 1)
        return out

    old = lambda w: int(class_of[spot(w)])
    ids = spark.createDataFrame([(bytearray(np.array([10, *map(spot, t), 10], np.int32).tobytes()),) for t in texts], "ids binary")
    got, there = brown.other_words(docs_of(spark, [(n, " ".join(t)) for n, t in enumerate(texts)]), ids, [w.encode() for w in heads], 4, class_of, table(old))
    found = {bytes(x["word"]).decode(): (x["c"], x["class"]) for x in got.collect()}
    want = {}
    for w in {w for t in texts for w in t if w not in unit}:
        worth = [brown.likelihood(table(lambda x, w=w, c=c: c if x == w else old(x))) for c in range(3)]
        want[w] = (sum(t.count(w) for t in texts), int(np.argmax(np.round(worth, 6))))
    final = table(lambda x: want[x][1] if x in want else old(x))
    if brown.likelihood(final) <= brown.likelihood(table(old)):
        want, final = {w: (c, old(w)) for w, (c, _) in want.items()}, table(old)
    assert {w: v[0] for w, v in found.items()} == {w: v[0] for w, v in want.items()} and found == want and (there == final).all()


# fingerprints


def test_order_minhash_matches_brute_force(spark, none):
    rows = [(n * 3, prose(n, 5 + n % 40)) for n in range(60)] + [(500, None), (501, ""), (502, "ab"), (503, prose(3, 8))]
    old = order_minhash.RANGE_ROWS
    order_minhash.RANGE_ROWS = 9
    try:
        got = {x["doc_id"]: x for x in order_minhash.against_next(docs_of(spark, rows)).collect()}
    finally:
        order_minhash.RANGE_ROWS = old
    own = order_minhash.Sketcher()
    down = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(down):
        after = down[(n + 1) % len(down)][1]
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = own.sketch(t), own.sketch(new), own.sketch(after)
        assert got[i]["fingerprint"] == order_minhash.name_of(a) and got[i]["edited_fingerprint"] == order_minhash.name_of(b)
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(order_minhash.likeness(a, b)) and got[i]["near_next"] == pytest.approx(order_minhash.likeness(a, c))
    assert order_minhash.against_next(none).count() == 0


def test_order_minhash_sees_order():
    own, w = order_minhash.Sketcher(), prose(1, 200).split()
    same, turned = " ".join(w), " ".join(w[100:] + w[:100])
    assert order_minhash.likeness(own.sketch(same), own.sketch(same)) == 1
    assert order_minhash.likeness(own.sketch(same), own.sketch(turned)) < 0.8


def test_order_minhash_odd(odd):
    rows = order_minhash.against_next(odd).collect()
    assert len(rows) == odd.count()
    assert len({x["fingerprint"] for x in rows if x["n_chars"] == 0}) == 1


# host reputation


def test_reputation_rules_and_odd(spark):
    urls = [None, "no scheme", "http://Sub.EXAMPLE.org/es/1", "http://example.org/en/12?x", "http://a.com/fr/1", "http://a.com/de/2#y", "http://b.net", "http://b.net?q://z/", "x://h/p", "http://notexample.org/es/"]
    pages = spark.createDataFrame([(n, u, "h", "clash") for n, u in enumerate(urls)] + [(2, urls[2], None, "c")], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x["page_id"]: x for x in reputation.judged(pages, reputation.label_outcomes(labels)).collect()}
    assert (got[0]["host"], got[0]["path"], got[1]["host"]) == ("", "", "")
    assert [got[n]["rule"] for n in (2, 3, 4, 5, 6, 9)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, "org/"]
    assert got[2]["verdict"] == "block" and got[4]["verdict"] == "allow" and got[7]["path"] == ""
    assert reputation.judged(pages.limit(0), reputation.label_outcomes(labels.limit(0))).count() == 0


def test_reputation_blocks_a_bad_host(spark):
    pages = spark.createDataFrame([(n, f"http://{'bad' if n % 2 else 'good'}.example.net/en/{n}", None) for n in range(400)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(n, 0 if n % 2 else 1, 0) for n in range(400)], "doc_id long, quality int, toxic int")
    got = reputation.judged(pages, reputation.label_outcomes(labels)).groupBy("host", "verdict").count().collect()
    assert {(x["host"], x["verdict"]) for x in got} == {("bad.example.net", "block"), ("good.example.net", "allow")}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "tokens"]
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) < docs.count() and len({x["doc_id"] for x in out}) == len(out)


def test_pipeline_stages_match_brute_force(spark, sf):
    import corpus_pipeline

    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    tokens = bpe.Tokenizer(bpe.read_vocabulary(None))
    models = {"toxicity": toxicity.trained(spark, sf), "quality": quality.trained(spark, sf)}
    for name, stage in corpus_pipeline.STAGES:
        rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf)
        if name == "tokens":
            assert sorted((x["doc_id"], list(x["ids"])) for x in out.collect()) == sorted((i, list(tokens.encode(t or ""))) for i, t in rows)
            return
        if name in models:
            wrong = {i for i, t in rows if (models[name].scores([t])[0] >= 0.5) != (name == "quality")}
        elif name == "near_duplicates":
            wrong = {i for i, _, least in brute_groups(rows, 80) if i != least}
        else:
            wrong = {x[0] for x in brute_hits(rows, [(x["item_id"], x["text"]) for x in items]) if x[-1]}
        docs = out.checkpoint()
        assert sorted(x["doc_id"] for x in docs.collect()) == sorted(i for i, _ in rows if i not in wrong), name


@pytest.mark.parametrize("name", ["op3_chat", "op4_decontaminate", "op9_minhash", "op10_reputation"])
def test_queries_match_their_oracles(spark, sf, tmp_path, name):
    import duckdb

    from lectern.llm import registry

    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    registry.QUERIES[name](spark, sf).write.parquet(str(tmp_path / name))
    mine, want = c.sql(f"SELECT * FROM '{tmp_path / name}/*.parquet'"), c.sql(registry.ORACLES[name])
    columns = sorted(mine.columns)
    assert columns == sorted(want.columns)
    rows = lambda r: sorted(map(repr, r.project(", ".join(f'"{x}"' for x in columns)).fetchall()))
    assert rows(mine) == rows(want)


def test_reputation_domains(spark):
    hosts = ["a.b.co.uk", "b.gov.uk", "co.uk", "x.com", "a.b.x.com", "1.2.3.4", "1.2.3.4:80", "[::1]", "com", ""]
    pages = spark.createDataFrame([(n, f"http://{h}/1") for n, h in enumerate(hosts)], "page_id long, url string")
    got = {x["page_id"]: (x["domain"], x["suffix"]) for x in reputation.parts(pages).collect()}
    assert [got[n] for n in range(len(hosts))] == [("b.co.uk", "co.uk"), ("b.gov.uk", "gov.uk"), ("co.uk", "co.uk"), ("x.com", "com"), ("x.com", "com"), ("1.2.3.4", ""), ("1.2.3.4", ""), ("[::1]", ""), ("com", "com"), ("", "")]
    assert reputation.parts(pages, ()).filter("page_id = 0").first()["domain"] == "co.uk"


def test_quality_votes_are_those_of_plain_nearest_neighbours():
    """Scores against the same vectors compared one by one."""
    r = random.Random(6)
    good = [" ".join(r.choice(WORDS[:200]).capitalize() + "." for _ in range(30)) for _ in range(60)]
    bad = [" ".join(r.choice(WORDS[200:]) + r.choice("!#$%") for _ in range(30)) for _ in range(60)]
    model = quality.fit([(t, 1) for t in good] + [(t, 0) for t in bad])
    texts = [good[0] + " " + bad[0], bad[1], good[1], "w1 w2 w3", "!!! 12", prose(4, 2000)]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    for text, got in zip(texts, model.scores(texts), strict=True):
        own = unit((unit(quality.vectors([text])[0]) * model.weight) @ model.space)
        votes = sorted(((float(own @ k), float(y)) for k, y in zip(model.known, model.label, strict=True)), reverse=True)[: quality.K]
        weight = [max(cos, 0) ** quality.SHARP for cos, _ in votes]
        want = sum(w * y for w, (_, y) in zip(weight, votes, strict=True)) / sum(weight) if sum(weight) > 1e-9 else model.base
        assert got == pytest.approx(want, abs=2e-3)
    assert model.scores([None, "", " "]) == [model.base] * 3


def test_brown_score_is_that_of_a_plain_class_model(spark):
    """Scores from a dictionary model with the same classes: transitions with additive smoothing and emissions with one unseen word a class."""
    import math
    import zlib
    from collections import Counter

    r = random.Random(21)
    rows = [(n, " ".join(r.choice(WORDS[:40] if n % 2 else WORDS[40:80]) for _ in range(60))) for n in range(60)] + [(900, "never seen words"), (901, None)]
    seen = {}
    real, real_others = brown.clustered, brown.other_words

    def spy(texts, label, tolerance):
        seen["label"], seen["joint"] = real(texts, label, tolerance)
        return seen["label"], seen["joint"]

    def spy_others(*args):
        others, joint = real_others(*args)
        seen["others"] = {bytes(x["word"]): x["class"] for x in others.collect()}
        return others, joint

    brown.clustered, brown.other_words = spy, spy_others
    try:
        got = {x["doc_id"]: x["score"] for x in brown.score(docs_of(spark, rows), units=30, endings=4, classes=3, head_size=1000, least=8).collect()}
    finally:
        brown.clustered, brown.other_words = real, real_others
    train = [(t or "").encode().lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    own = sorted((w for w in counts if counts[w] >= 8), key=lambda w: (-counts[w], w))
    label = [int(x) for x in seen["label"]]
    unit = {w: n for n, w in enumerate(own)}
    assert set(seen["others"]) == set(counts) - set(own)
    class_of = lambda w: label[unit[w]] if w in unit else seen["others"].get(w, label[len(own) + zlib.crc32(w[-3:]) % 4])
    end = label[-1]
    pairs, tokens, kinds = Counter(), Counter(), Counter()
    for t in train:
        walk = [end, *map(class_of, t), end]
        pairs.update(zip(walk, walk[1:], strict=False))
        tokens.update(map(class_of, t))
    kinds.update(map(class_of, counts))
    n = max(label) + 1
    step = lambda a, b: math.log10((pairs[a, b] + brown.ALPHA) / (sum(pairs[a, c] for c in range(n)) + n * brown.ALPHA))
    for i, t in rows:
        words = (t or "").encode().lower().split()
        walk = [end, *map(class_of, words), end]
        want = sum(step(a, b) for a, b in zip(walk, walk[1:], strict=False)) + sum(math.log10((counts[w] + 1) / (tokens[class_of(w)] + kinds[class_of(w)] + 1)) for w in words)
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_bpe_kept_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "one two", 5, "x")], "doc_id long, text string, n_tokens int, ids string")
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.encode_documents(df, keep=("doc_id", "n_tokens"))
    assert bpe.encode_documents(df.withColumnRenamed("n_tokens", "n"), keep=("doc_id", "n", "text")).first()["n"] == 5


def test_packed_rows_are_written_whole(odd, tmp_path, spark):
    rows = packing.pack(odd, length=64, group=5000)
    packing.write_packed(rows, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == rows.count()


def test_pipeline_on_odd_rows(spark, odd, none, odd_rows, tmp_path):
    """Nulls, empty and very long texts, repeats, clashing names, no labels and no benchmark; then no documents at all."""
    import corpus_pipeline

    extra = odd.withColumn("_row", F.lit(1)).withColumn("_gone_id", F.lit("g")).withColumn("_set_key", F.lit("k")).withColumn("_words", F.lit("w"))
    for name, docs in (("odd", extra), ("none", extra.limit(0))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        now = spark.read.parquet(str(folder / "documents.parquet"))
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, now, str(folder))
            if stage != "tokens":
                assert sorted(out.columns) == sorted(docs.columns)
            now = out.checkpoint()
        got = sorted((x["doc_id"] or 0, x["n_tokens"] > 0) for x in now.collect())
        assert got == (sorted([(0, True), (0, False), (1, False), (2, False), (3, False), (4, True), (6, True), (8, True), (10, True)]) if name == "odd" else [])
        assert corpus_pipeline.run(spark, str(folder)).count() == len(got)
