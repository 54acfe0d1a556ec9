"""BPE encoding as a bounded-lookahead streaming transducer, and streaming decoding.

Encoding rests on one property of merge lists: a sequence of tokens is the encoding of its
text exactly if every neighbouring pair keeps its boundary, and that can be read off the merge
ranks on both sides of the boundary. So the last token of the encoding of each prefix is
unique, and it is found from the prefixes at most ``lookahead`` symbols back, where
``lookahead`` is the length of the longest token the merge list can make. A token is stable,
and is emitted, once every prefix within the lookahead has it in its history; only that
window is kept, whatever the length of the text.

Defined results: a null text is empty; an empty text has no tokens; the literal special
tokens of the tokenizer file inside a text become their ids, as in the tokenizers library; repeated rows each get a row;
an empty table gives no rows; very long texts and words are read whole, with the window of the lookahead; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import batched, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import map_slices, prepared, sole, table

FAR = 1 << 62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Recent(dict):
    """A memo of bounded size: when one generation is full, the one before it is forgotten."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Merges:
    """The merge list as a transducer over symbols; ``end`` marks a word's last symbol, '' for none."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        self.vocab, self.end = vocab, end
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for at, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, at)
            if whole not in self.made:
                self.made[whole], self.parts[whole] = at, pair
        self.pairs = Recent(self._keeps, 400_000)
        self.own: dict[int, bool] = {}
        cut = len(end)
        inner, last = {}, {}
        for text, i in vocab.items():
            if i not in self.made and len(text.removesuffix(end) if cut else text) != 1:
                continue  # special tokens are not made by merges
            if not self.makes_itself(i):
                continue
            if cut and text.endswith(end) and len(text) > cut:
                last[text[:-cut]] = i
            else:
                inner[text] = i
        self.inner, self.last = inner, last if cut else inner
        #: The longest token that ends in two given symbols.
        self.reach: dict[str, int] = {}
        for text in inner:
            self.reach[text[-2:]] = max(len(text), self.reach.get(text[-2:], 0))
        #: No token is longer, so no later token begins further back than this.
        self.lookahead = max(map(len, chain(inner, last)), default=1)

    def makes_itself(self, token: int) -> bool:
        """Whether the merges turn the token's own text into this one token."""
        found = self.own.get(token)
        if found is None:
            pair = self.parts.get(token)
            found = pair is None or self.makes_itself(pair[0]) and self.makes_itself(pair[1]) and self.keeps(*pair, self.made[token])
            self.own[token] = found
        return found

    def keeps(self, left: int, right: int, until: int = FAR) -> bool:
        """Whether the boundary between two tokens outlives all merges before ``until``.

        Undoes the later merge on either side, step by step; each pair that stands at the
        boundary for a while must not be merged in that while. Of equal merges the left one goes first.
        """
        made, rank, parts = self.made, self.rank, self.parts
        end_left = end_right = until
        while True:
            at = rank.get((left, right))
            if at is not None and at < end_left and at <= end_right:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                end_left, left = a, parts[left][1]
            else:
                end_right, right = b, parts[right][0]

    def _keeps(self, both: int) -> bool:
        return self.keeps(both >> 32, both & 0xFFFFFFFF)

    def word(self, text: str) -> tuple[int, ...]:
        whole = self.last.get(text)
        if whole is not None:
            return (whole,)
        return tuple(self.stream(text)) if len(text) > 2 * self.lookahead else self.short(text)

    def short(self, word: str) -> tuple[int, ...]:
        """The same for a word that fits in the window: nothing has to be emitted before its end."""
        pairs, reach, known = self.pairs, self.reach.get, self.inner.get
        tokens, starts, n = [-1], [0], len(word)
        for e in range(1, n + 1):
            s = 0
            if e == n:
                known = self.last.get
            else:
                far = e - reach(word[e - 2 if e > 1 else 0 : e], 1)
                s = far if far > 0 else 0
            while s < e:
                t = known(word[s:e])
                if t is not None:
                    before = tokens[s]
                    if before < 0 or pairs[before << 32 | t]:
                        tokens.append(t)
                        starts.append(s)
                        break
                s += 1
            else:
                tokens.append(-2)
                starts.append(e - 1)
        return tuple(self._path(tokens, starts, n))

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Tokens of a stream of symbols, each as soon as it is stable."""
        inner, final, pairs, far = self.inner, self.last, self.pairs, self.lookahead
        window, tokens, starts = "", [-1], [-1]  # the state of prefix i is at index i; index 0 is settled
        held = None
        for symbol in chain(symbols, (None,)):
            if held is not None:
                window += held
                n = len(window)
                known = inner if symbol is not None else final
                for s in range(n - far if n > far else 0, n):
                    t = known.get(window[s:n])
                    if t is not None and (tokens[s] < 0 or pairs[tokens[s] << 32 | t]):
                        tokens.append(t)
                        starts.append(s)
                        break
                else:
                    tokens.append(-2)
                    starts.append(n - 1)
                if symbol is not None and n >= 4 * far:
                    settled = self._settled(starts, n, far)
                    if settled:
                        yield from self._path(tokens, starts, settled)
                        window, tokens, starts = window[settled:], tokens[settled:], [max(-1, x - settled) for x in starts[settled:]]
            held = symbol
        yield from self._path(tokens, starts, len(window))

    @staticmethod
    def _settled(starts: list[int], n: int, far: int) -> int:
        """The last position that lies in the history of every prefix a later token may begin at."""
        at = n - far + 1
        common = {at}
        while at > 0:
            at = starts[at]
            common.add(at)
        best = common
        for live in range(n - far + 2, n + 1):
            seen, at = {live}, live
            while at > 0:
                at = starts[at]
                seen.add(at)
            best = best & seen
        return max(best | {0})

    @staticmethod
    def _path(tokens: list[int], starts: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            if tokens[at] >= 0:
                out.append(tokens[at])
            at = starts[at]
        return out[::-1]


class Decoder:
    """Ids to text by an incremental byte-to-text machine: the bytes of token after token go in, text comes out as soon as its characters are whole.

    A character that is not finished waits for the bytes of the next token, a broken one becomes U+FFFD. The bytes of a token are, in ``restored`` text, those that its letters
    stand for, with its word end as a blank; in ``decoded`` text, those of its name, with a blank between two tokens (as for files that name no decoder).
    """

    def __init__(self, names: dict[int, str], end: str = ""):
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.restored_bytes: dict[int, bytes] = {}
        self.decoded_bytes = {i: b" " + name.encode() for i, name in names.items()}
        for i, name in names.items():
            blank = bool(end) and name.endswith(end)
            body = name[: -len(end)] if blank else name
            self.restored_bytes[i] = (bytes(letters[c] for c in body) if all(c in letters for c in body) else body.encode()) + b" " * blank

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Restored text."""
        return self.stream(ids, self.restored_bytes, 0)

    def decoded(self, ids: Iterable[int]) -> Iterator[str]:
        return self.stream(ids, self.decoded_bytes, 1)

    def pieces(self, ids: Iterable[int]) -> str:
        """Decoded text as a whole."""
        return "".join(self.decoded(ids))

    @staticmethod
    def stream(ids: Iterable[int], table: dict[int, bytes], skip: int) -> Iterator[str]:
        """The machine, over blocks of tokens; the first ``skip`` bytes are left out."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for some in batched(ids, 4096):
            yield state.decode(b"".join(map(table.__getitem__, some))[skip:])
            skip = 0
        yield state.decode(b"", True)


class Tokenizer:
    """A word-end BPE tokenizer file (NFC, lower case, split pattern, byte letters) on the transducer."""

    def __init__(self, blob: bytes, memo: int = 250_000):
        spec = json.loads(blob)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.merges = Merges(model["vocab"], (tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]), self.end)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split"))
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.decoder = Decoder(self.names, self.end)
        self.words = Recent(self._word, memo)
        self.chunks = Recent(self._chunk, memo)
        self.odd = regex.compile("[\x1c-\x1f]")
        self.blank = regex.compile(r"\s+")
        self.splits = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _word(self, word: str) -> tuple[int, ...]:
        return self.merges.word(word.encode().decode("latin-1").translate(self.letters))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        plain = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if plain.isalpha():  # the split pattern takes a run of letters whole, and a sign after it alone
            return self.words[plain]
        if plain[:-1].isalpha() and plain[-1] in ".,;:!?":
            return self.words[plain[:-1]] + self.words[plain[-1]]
        return tuple(chain.from_iterable(self.words[w] for w in self.pattern.findall(plain)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        if not text:
            return []
        if self.splits is not None and "<" in text and self.splits.search(text):
            out: list[int] = []
            for part in self.splits.split(text):
                out += [self.special[part]] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        parts = self.blank.split(text) if self.odd.search(text) else text.split()
        return list(chain.from_iterable(map(self.chunks.__getitem__, parts)))


_LOADED: dict[str, Tokenizer] = {}


def loaded(blob: bytes) -> Tokenizer:
    """One tokenizer for each file and worker process."""
    sole("bpe", _LOADED.clear)
    key = hashlib.sha256(blob).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(blob)
    return _LOADED[key]


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str | None) -> bytes:
    """The vocabulary file on the driver; workers get it by broadcast (1.7 MB, fixed)."""
    with open(path or public_path(), "rb") as f:
        return f.read()


def digest(parts: Iterable[str]) -> str:
    """SHA-256 of a text that comes in parts."""
    h = hashlib.sha256()
    for x in parts:
        h.update(x.encode())
    return h.hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Encodes whole texts and decodes them again; one row out for each row in, no shuffle.

    Columns: ``keep``, n_tokens, ids (if asked for), ids_sha256, decoded_sha256 and restored_sha256 (of the two
    texts that the byte-to-text machine gives). Repeated rows stay; a null or empty text has no ids. A kept column can't have the name of a made one.
    """
    clash = {"n_tokens", "ids", "ids_sha256", "decoded_sha256", "restored_sha256"}.intersection(keep)
    if clash:
        raise ValueError(f"rename {', '.join(sorted(clash))} first")
    spark = prepared(docs.sparkSession)
    blob = spark.sparkContext.broadcast(read_vocabulary(path))
    kept = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long", *(["ids array<int>"] if ids else []), "ids_sha256 string, decoded_sha256 string, restored_sha256 string"])
    names = list(keep)

    def work():
        tok = loaded(blob.value)
        number = {i: str(i) for i in tok.names}

        def each(part: pa.RecordBatch) -> dict:
            out: dict = {c: part.column(c) for c in names}
            rows = [tok.encode(x) for x in part.column(text).to_pylist()]
            sha = hashlib.sha256
            out["n_tokens"] = [len(r) for r in rows]
            out["ids"] = rows
            out["ids_sha256"] = [sha(" ".join(map(number.__getitem__, r)).encode()).hexdigest() for r in rows]
            out["decoded_sha256"] = [digest(tok.decoder.decoded(r)) for r in rows]
            out["restored_sha256"] = [digest(tok.decoder.text(r)) for r in rows]
            return out

        return each

    return map_slices(docs.select(*names, text) if text not in names else docs.select(*names), work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), ids=False)
