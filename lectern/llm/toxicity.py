"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine.

One kernel is used throughout: the gap-weighted count of the common subsequences of three characters of two words, each occurrence
weighted LAMBDA to the power of the stretch it spans in either word, divided by the words' own values and taken to the power POWER (again a
kernel). Words carry marks for begin and end; letters of every script are told apart by their code points, and any other character is only a
gap. Inserted characters and gaps weaken the kernel but don't break it; runs of single characters ("i d i o t") are read as one word. Of a
word longer than LONGEST with its marks, overlapping windows are taken and the largest value with each landmark counts.

The kernel of a text with a landmark word is the largest of its words' kernels, and beside it the logarithm of one plus their sum. Landmarks are
words of labelled toxic texts, chosen by how much of the toxic texts, beyond what clean texts have, they cover in the kernel, and the words of clean
texts that come nearest to them. K_mm^(-1/2) of the same kernels turns the values into Nystroem features. Beside them stands the excess: how far the
largest value with any landmark lies above that landmark's ceiling, the largest value that a word of the clean sample has with it, as a share of the way to what the landmark keeps when a letter is
put into it. Only landmarks count there that mostly stay above their ceiling when a letter is put into them; those that clean words come as near to need the whole word. A squared-hinge SVM learns
from the labelled texts and from their sentences. A logistic fit makes a score of the decision.

A sentence of a clean text is clean. A sentence of a toxic text has a label only if it has a landmark, and is then learned as it is and with the landmark broken up: one or two random letters
anywhere, signs between letters, a doubled letter. Its other sentences tell nothing, as what makes the text toxic stands elsewhere. CANDIDATES bounds the Gram matrix from which landmarks are chosen: it is twenty times
their number, in order of significance, and z > 2 leaves out words that stand in toxic texts by chance. Contrasts are sought among the 20,000 commonest words of the clean sample: one that is rarer moves the decision of few texts.

Fitted on a bounded sample of labelled texts (PER_CLASS of each class, whole texts); every text is scored whole.
Defined results: null and empty texts score as a text without any likeness to a landmark; without labels of both classes, or without a
landmark, every score is 0; an empty table gives no rows; repeated rows each get a row; extra columns are ignored; very long texts are taken in groups of MEMO different words; ties
of candidates go to the later word in code point order.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import given_back, labelled_sample, prepared, rejected, scored, sole, table

LAMBDA, POWER, LONGEST = 0.75, 3, 26
LANDMARKS, CONTRASTS, CANDIDATES, PER_CLASS = 32, 16, 600, 1500
COVER = 3  # landmarks wanted for each toxic text
FORMS = 40  # random forms of a landmark that tell how much of it an inserted letter leaves
SENTENCE = 24  # words of a sentence at most; longer ones count as several
FLOOR, RIDGE = 1e-2, 1e-3  # least eigenvalue of a Gram matrix; weight of the SVM's margin
MEMO = 200_000  # words whose rows a worker remembers
HELD = (5, 0)
BEGIN, END = -2, -3
_APART = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_STOPS = (".", "!", "?")
_SIGNS = ".,;:!?*#%&$()[]{}<>|\"'-_/\\"


def words_of(text: str | None) -> list[str]:
    return _APART.sub(lambda run: "".join(run[0].split()), (text or "").lower()).split()


def windows(word: str) -> list[list[int]]:
    """Code points of a word between marks, 0 for what is no letter; over-long ones in overlapping windows, so that all of them is read."""
    own = [ord(c) if c.isalpha() else 0 for c in word]
    while own and not own[-1]:
        own.pop()
    skip = next((i for i, c in enumerate(own) if c), len(own))
    if skip == len(own):
        return []
    own = [BEGIN, *own[skip:], END]
    return [own] if len(own) <= LONGEST else [own[i : i + LONGEST] for i in range(0, len(own) - LONGEST // 2, LONGEST // 2)]


def by_length(words: list[str], room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, characters as in ``windows``) of words or windows of one length, as many at a time as have ``room`` triples together."""
    plain: dict[int, list[int]] = {}
    odd: dict[int, list[tuple[int, list[int]]]] = {}
    for n, word in enumerate(words):
        if len(word) <= LONGEST - 2 and word.isalpha():
            plain.setdefault(len(word), []).append(n)
        else:
            for own in windows(word):
                odd.setdefault(len(own), []).append((n, own))
    for length, rows in plain.items():
        step = max(1, room // math.comb(length + 2, 3))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            c = np.full((len(own), length + 2), BEGIN, np.int32)
            c[:, 1:-1] = np.frombuffer("".join([words[n] for n in own]).encode("utf-32-le"), np.int32).reshape(-1, length)
            c[:, -1] = END
            yield np.array(own), c
    for length, rows in odd.items():
        step = max(1, room // math.comb(length, 3))
        for at in range(0, len(rows), step):
            yield np.array([n for n, _ in rows[at : at + step]]), np.array([own for _, own in rows[at : at + step]], np.int32)


def own_values(c: np.ndarray) -> np.ndarray:
    """The kernel of each word (characters of words of one length) with itself, by the recursion over prefixes as products of matrices."""
    a = np.arange(c.shape[1])
    gap = np.where(a[:, None] > a, LAMBDA ** np.maximum(a[:, None] - 1 - a, 0), 0).astype(np.float32)
    same = ((c[:, :, None] == c[:, None, :]) & (c != 0)[:, :, None]).astype(np.float32) * np.float32(LAMBDA**2)
    once = same * (gap @ same @ gap.T)
    return (same * (gap @ once @ gap.T)).sum((1, 2))


class Kernel:
    """Kernel values of words with fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        coded = [np.array(windows(x)[:1], np.int32) for x in landmarks]
        self.size = len(coded)
        self.letters = np.unique(np.concatenate([x.ravel() for x in coded]))
        self.base = len(self.letters) + 1
        found = [self._triples(x) for x in coded]
        cells = np.unique(np.concatenate([code[0] for code, _ in found]))
        self.place = np.zeros(self.base**3, np.int32)  # triples to rows of values; row 0 for triples of no landmark
        self.place[cells] = np.arange(1, len(cells) + 1)
        self.values = np.zeros((len(cells) + 1, self.size), np.float32)
        for n, (code, weight) in enumerate(found):
            np.add.at(self.values[:, n], self.place[code[0]], weight)
        self.own = np.concatenate([own_values(x) for x in coded])
        self.gram = self.words(landmarks)

    def _triples(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all triples of each word (0 if a character is in no landmark) and their weights."""
        at = np.minimum(np.searchsorted(self.letters, c), len(self.letters) - 1)
        known = (self.letters[at] == c) & (c != 0)
        i, j, k = _places(c.shape[1])
        # an unknown character makes the code 0 or less
        first, rest = np.where(known, (at + 1) * self.base**2, -(10**9)), np.where(known, at + 1, -(10**9))
        return np.maximum(first[:, i] + rest[:, j] * self.base + rest[:, k], 0), (LAMBDA ** (k - i + 1)).astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """The normalised kernel, to the power POWER, of each word with each landmark; of several windows the largest value."""
        cores: dict[str, int] = {}
        back = [cores.setdefault(w.strip(_SIGNS), len(cores)) for w in words]
        out = np.zeros((len(cores), self.size), np.float32)
        for rows, c in by_length(list(cores), (1 << 22) // max(self.size, 64)):
            if c.shape[1] < 3:
                continue
            code, weight = self._triples(c)
            raw = np.matmul(weight, self.values[self.place[code]])
            like = np.minimum(raw / np.sqrt(np.maximum(own_values(c), 1e-9)[:, None] * self.own), 1) ** POWER
            if len(rows) > 1 and (rows[1:] == rows[:-1]).any():
                np.maximum.at(out, rows, like)
            else:
                out[rows] = np.maximum(out[rows], like)
        return out[back]


_PLACES: dict[int, tuple] = {}


def _places(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k of all triples."""
    if length not in _PLACES:
        a = np.arange(length)
        i, j, k = np.meshgrid(a, a, a, indexing="ij")
        at = (i < j) & (j < k)
        _PLACES[length] = i[at], j[at], k[at]
    return _PLACES[length]


def sentence_starts(words: list[str]) -> np.ndarray:
    """Where sentences begin: behind a word that ends in a stop, and after SENTENCE words."""
    n = len(words)
    stop = np.fromiter(map(str.endswith, words, repeat(_STOPS)), bool, n)
    begins = np.flatnonzero(np.r_[True, stop[:-1]])
    long = np.diff(np.r_[begins, n]) > SENTENCE
    if long.any():
        last = np.zeros(n, np.int64)
        last[begins] = begins
        begins = np.flatnonzero((np.arange(n) - np.maximum.accumulate(last)) % SENTENCE == 0)
    return begins


def bare(word: str) -> str:
    """A word without what is no letter at its ends, '' if it is too short or long for a landmark."""
    core = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", word)
    return core if 3 <= len(core) <= LONGEST - 2 else ""


def choose_landmarks(bags: list[set[str]], toxic: np.ndarray) -> tuple[list[str], list[str]]:
    """Words that cover the toxic texts in the kernel, and the words of clean texts nearest to them.

    Candidates are the CANDIDATES words that most significantly stand in more toxic than clean texts (two texts at least).
    """
    bad = Counter(w for b, v in zip(bags, toxic, strict=True) if v for w in b)
    good = Counter(w for b, v in zip(bags, toxic, strict=True) if not v for w in b)
    n_bad, n_good = int(toxic.sum()), int((1 - toxic).sum())

    def surplus(word: str) -> float:
        p, q = bad[word] / n_bad, (good[word] + 0.5) / n_good
        both = (bad[word] + good[word] + 0.5) / (n_bad + n_good)
        return (p - q) / math.sqrt(both * (1 - both) * (1 / n_bad + 1 / n_good) + 1e-12)

    able = sorted(((surplus(w), w) for w, c in bad.items() if c >= 2), reverse=True)
    able = [w for z, w in able[:CANDIDATES] if z > 2]
    if not able:
        return [], []
    like = Kernel(able).gram
    at = {w: n for n, w in enumerate(able)}
    covers = np.array([like[own].max(0) if (own := [at[w] for w in b if w in at]) else np.zeros(len(able), np.float32) for b in bags])
    weight = np.where(toxic == 1, 1 / n_bad, -1 / n_good)
    covered, chosen = np.zeros(len(bags), np.float32), []
    while len(chosen) < LANDMARKS:
        gain = weight @ (np.minimum(COVER, covered[:, None] + covers) - covered[:, None])
        gain[chosen] = -1
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        chosen.append(best)
        covered = np.minimum(COVER, covered + covers[:, best])
    marks = [able[n] for n in chosen]
    others = [w for w, c in good.most_common(20_000) if w not in at and c > 1]
    near = Kernel(marks).words(others).max(1) if others and marks else np.zeros(0)
    near = near * np.log1p([good[w] for w in others])
    return marks, [others[n] for n in np.argsort(-near, kind="stable")[:CONTRASTS] if near[n] > 0]


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 40) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps on the points inside the margin; the last column of ``x`` is 1, its weight the bias. Sums go by blocks, so that no second copy of ``x`` is made."""
    sign, cost = (2.0 * y - 1).astype(np.float32), cost.astype(np.float32)
    small = np.eye(x.shape[1]) * RIDGE
    small[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        gram, right = small.copy(), np.zeros(x.shape[1])
        for at in range(0, len(x), 4096):
            part, s, c = x[at : at + 4096], sign[at : at + 4096], cost[at : at + 4096]
            m = s * (part @ w.astype(np.float32)) < 1
            g, c = part[m], c[m]
            gram += g.T @ (g * c[:, None])
            right += g.T @ (s[m] * c)
        new = np.linalg.solve(gram, right)
        if np.abs(new - w).max() < 1e-3 * np.abs(new).max():
            return new
        w = new
    return w


def fit_logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through decision values, by damped Newton steps on smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y == 1, hi, lo)
    x = np.c_[f, np.ones(len(f))]
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-3 * b)
        b = b + np.clip(step, -2, 2)
        if abs(step).max() < 1e-7:
            break
    return float(b[0]), float(b[1])


class View:
    """Texts by their kernel values with the landmarks; rows of words are remembered up to a bound, beyond it those seen in more texts than one."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.at = kernel, {}
        self.rows, self.seen = np.zeros((0, kernel.size), np.float32), np.zeros(0, np.int32)

    def learn(self, words: set[str]) -> None:
        if len(self.at) + len(words) > MEMO:
            stay = self.seen[: len(self.at)] > 1
            kept = list(compress(self.at, stay))
            if len(kept) > MEMO // 2:
                kept, stay[:] = [], False
            self.rows[: len(kept)], self.seen[:] = self.rows[: len(stay)][stay], 0
            self.at = dict(zip(kept, range(len(kept)), strict=True))
        fresh = list(words.difference(self.at))
        end = len(self.at) + len(fresh)
        if end > len(self.rows):
            more = max(end - len(self.rows), 4096)
            self.rows = np.concatenate([self.rows, np.zeros((more, self.kernel.size), np.float32)])
            self.seen = np.concatenate([self.seen, np.zeros(more, np.int32)])
        self.rows[len(self.at) : end] = self.kernel.words(fresh)
        self.at.update(zip(fresh, range(len(self.at), end), strict=True))

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """The largest kernel value of each text's words with each landmark, then the logarithm of one plus their sum.

        Words are learned for as many texts at a time as have at most MEMO // 2 words together; a longer text is taken in parts.
        """
        top, total = np.zeros((len(texts), self.kernel.size), np.float32), np.zeros((len(texts), self.kernel.size), np.float64)
        step = max(1, MEMO // 2)
        parts = [(n, words[at : at + step]) for n, words in enumerate(texts) for at in range(0, len(words), step)]
        begin, held = 0, 0
        for end, (_, words) in enumerate([*parts, (0, [None] * (step + 1))]):
            if held + len(words) > step:
                self._pool(parts[begin:end], top, total)
                begin, held = end, 0
            held += len(words)
        return np.c_[top, np.log1p(total)].astype(np.float32)

    def _pool(self, parts: list[tuple[int, list[str]]], top: np.ndarray, total: np.ndarray) -> None:
        self.learn(set().union(*(words for _, words in parts)))
        for n, words in parts:
            own = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            like = self.rows[own]
            top[n] = np.maximum(top[n], like.max(0))
            total[n] += like.sum(0)
            self.seen[own] += 1  # once a text, however often a word stands in it


class Model:
    def __init__(self, landmarks: list[str], root: np.ndarray, ceiling: np.ndarray, room: np.ndarray, weights: np.ndarray, curve: tuple[float, float]):
        self.landmarks, self.root, self.ceiling, self.room, self.weights, self.curve = landmarks, root, ceiling, room, weights, curve
        self.view: View | None = None

    def __getstate__(self):
        return {**self.__dict__, "view": None}

    def forget(self) -> None:
        self.view = None

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.landmarks:
            return [0.0] * len(texts)
        if self.view is None:
            self.view = View(Kernel(self.landmarks))
        f = np.c_[features(self.view.texts([words_of(t) for t in texts]), self.root, self.ceiling, self.room), np.ones(len(texts))] @ self.weights
        return (1 / (1 + np.exp(-np.clip(f * self.curve[0] + self.curve[1], -30, 30)))).tolist()


def features(pooled: np.ndarray, root: np.ndarray, ceiling: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Nystroem features of pooled kernel values, and the excess over the ceilings of the landmarks that have one (``room`` is infinite for the others)."""
    excess = np.clip((pooled[:, : len(ceiling)] - ceiling) / room, 0, 1).max(1)
    return np.c_[pooled @ root, excess].astype(np.float32)


NOTHING = Model([], np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0), (1.0, 0.0))


def with_letters(word: str, n: int, draw: random.Random) -> str:
    """A word with ``n`` random letters put in anywhere."""
    for _ in range(n):
        at = draw.randrange(len(word) + 1)
        word = word[:at] + draw.choice(string.ascii_lowercase) + word[at:]
    return word


def broken(word: str, draw: random.Random) -> str:
    """A word with inserted characters: every other time letters, one or two, else signs or a letter twice."""
    half = len(word) // 2
    if draw.random() < 0.5:
        return with_letters(word, draw.choice((1, 2)), draw)
    return draw.choice(("-".join(word), ".".join(word), f"{word[:half]}*{word[half:]}", word[:half] + word[half - 1 :]))


def ceilings(kernel: Kernel, marks: list[str], clean: np.ndarray, draw: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """(ceiling, room) of each landmark: the largest value of the clean texts, and from there to the median of FORMS forms with a letter put in; infinite where most forms are below."""
    ceiling = clean[:, : len(marks)].max(0)
    forms = np.array([kernel.words([with_letters(m, 1, draw) for _ in range(FORMS)])[:, n] for n, m in enumerate(marks)])
    above = (forms >= ceiling[:, None]).mean(1) >= 0.5
    return ceiling, np.where(above, np.maximum(np.median(forms, 1) - ceiling, 1e-3), np.inf)


def sentences(texts: list[list[str]], toxic: np.ndarray, marks: set[str]) -> tuple[list[list[str]], np.ndarray]:
    """Labelled sentences: all those of clean texts, and those of toxic texts that have a landmark, as they are and with it broken up."""
    draw = random.Random(7)
    out: list[list[str]] = []
    label: list[int] = []
    for n, words in enumerate(texts):
        starts = sentence_starts(words) if words else []
        for a, b in zip(starts, [*starts[1:], len(words)], strict=True):
            part = words[a:b]
            if not toxic[n]:
                out.append(part)
                label.append(0)
            elif any(bare(w) in marks for w in part):
                out += [part, [broken(bare(w), draw) if bare(w) in marks else w for w in part]]
                label += [1, 1]
    return out, np.array(label, np.int64)


def root_of(gram: np.ndarray) -> np.ndarray:
    """The inverse square root of a Gram matrix; eigenvalues count as FLOOR at least."""
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, FLOOR))) @ vectors.T


def fit(rows: list[tuple[str, int]]) -> Model:
    toxic = np.array([v for _, v in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return NOTHING
    known: dict[str, str] = {}  # each different word is held once
    texts = [[known.setdefault(w, w) for w in words_of(t)] for t, _ in rows]
    cores = {w: known.get(core := bare(w), core) for w in known}
    marks, others = choose_landmarks([{b for w in set(words) if (b := cores[w])} for words in texts], toxic)
    del known, cores
    if not marks:
        return NOTHING
    kernel = Kernel(marks + others)
    root = np.zeros((2 * kernel.size, 2 * kernel.size), np.float32)
    root[: kernel.size, : kernel.size] = root_of(kernel.gram)
    root[kernel.size :, kernel.size :] = root_of(np.log1p(kernel.gram))
    more, own = sentences(texts, toxic, set(marks))
    view, every = View(kernel), texts + more
    pooled = np.concatenate([view.texts(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    ceiling, room = ceilings(kernel, marks, pooled[toxic == 0], random.Random(7))
    x = np.ones((len(every), 2 * kernel.size + 2), np.float32)
    for i in range(0, len(every), 256):
        x[i : i + 256, :-1] = features(view.texts(every[i : i + 256]), root, ceiling, room)
    y = np.r_[toxic, own]
    cost = np.zeros(len(y))
    for part in (slice(0, len(texts)), slice(len(texts), None)):  # texts and sentences, and each class of them, weigh alike
        for v in (0, 1):
            cost[part][y[part] == v] = 0.25 / max(1, (y[part] == v).sum())
    weights = fit_svm(x, y, cost).astype(np.float32)
    model = Model(marks + others, root, ceiling, room, weights, fit_logistic((x @ weights).astype(np.float64), y))
    del view, every, more, x
    given_back()
    return model


def trained(spark: SparkSession, sf_dir: str, held: tuple[int, int] = HELD) -> Model:
    return fit(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", held, PER_CLASS))


def worker(spark: SparkSession, model: Model):
    """A factory of scorers for tasks; the model is broadcast (LANDMARKS + CONTRASTS words, fixed size)."""
    sent = prepared(spark).sparkContext.broadcast(model)

    def make():
        sole("toxicity", sent.value.forget)
        return sent.value.scores

    return make


def classify(docs: DataFrame, model: Model, held: tuple[int, int] = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by whole texts; one pass, no shuffle."""
    return scored(docs, held, worker(docs.sparkSession, model))


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``."""
    return rejected(docs, worker(docs.sparkSession, model), least, keep_high=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
