"""Tolerant reading of JSON replies: what SQL functions can parse stays in the JVM, only the rest goes through Python."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.IGNORECASE | re.DOTALL)
_SPAN = re.compile(r"[\[{].*[\]}]", re.DOTALL)
_TOKEN = re.compile(r'"(?P<string>(?:[^"\\]|\\.)*)(?P<end>")?|(?P<sign>[\[\]{}:,])|(?P<word>[^\s"\[\]{}:,]+)', re.DOTALL)
# Fences around a reply, its outermost brackets, and the two faults of commas that SQL can mend.
FENCED = r"(?is)```(?:json)?\s*(.*?)\s*```"
FENCE_ENDS = r"(?i)^```(?:json)?\s*|\s*```$"
BRACKETED = r"(?s)[\[{].*[\]}]"
TRAILING_COMMA = r",\s*([\]}])"
MISSING_COMMA = r'("(?:[^"\\]|\\.)*")\s*\n\s*(?=")'
# Fields of replies that are read on their own where a reply is broken.
FIELDS = ("lesson_number", "lesson_name", "overall_name")
LISTS = ("bullets", "additional_bullets", "missing_topics")


def core(reply: Column) -> Column:
    """The part from the first to the last bracket, without fences."""
    fenced = F.regexp_extract(reply, FENCED, 1)
    plain = F.when(fenced != "", fenced).otherwise(F.regexp_replace(F.trim(reply), FENCE_ENDS, ""))
    return F.coalesce(F.nullif(F.regexp_extract(plain, BRACKETED, 0), F.lit("")), plain)


def repaired(text: Column) -> Column:
    """Without trailing commas, with the commas that are missing between strings on two lines."""
    return F.regexp_replace(F.regexp_replace(text, TRAILING_COMMA, "$1"), MISSING_COMMA, "$1,\n")


class Broken(ValueError):
    """The text can't be read on from here."""


@dataclass
class Token:
    """A string (``text`` without quotes, escapes as they stand), a sign, or a bare word, with its place."""

    kind: str
    text: str
    start: int
    end: int
    closed: bool = True


class Reply:
    """A JSON text read leniently in one pass of tokens.

    Let pass: raw control characters inside strings, a comma before a closing bracket, and no comma between two strings on different lines.
    """

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, [], 0
        for m in _TOKEN.finditer(text):
            if m["string"] is not None:
                closed = m["end"] is not None
                self.tokens.append(Token("string", m["string"], m.start(), m.end(), closed))
            elif m["sign"]:
                self.tokens.append(Token(m["sign"], m["sign"], m.start(), m.end()))
            else:
                self.tokens.append(Token("word", m["word"], m.start(), m.end()))

    def peek(self) -> Token:
        if self.at >= len(self.tokens):
            raise Broken
        return self.tokens[self.at]

    def take(self, *kinds: str) -> Token:
        token = self.peek()
        if token.kind not in kinds:
            raise Broken
        self.at += 1
        return token

    def string(self, token: Token) -> str:
        if not token.closed:
            raise Broken
        try:
            return json.loads(f'"{token.text}"', strict=False)
        except ValueError as e:
            raise Broken from e

    def value(self):
        token = self.take("string", "word", "{", "[")
        if token.kind == "string":
            return self.string(token)
        if token.kind == "word":
            try:
                return json.loads(token.text)
            except ValueError as e:
                raise Broken from e
        return dict(self.items("}", self.pair)) if token.kind == "{" else list(self.items("]", self.value))

    def pair(self) -> tuple:
        key = self.string(self.take("string"))
        self.take(":")
        return key, self.value()

    def items(self, end: str, read) -> Iterator:
        while self.peek().kind != end:
            yield read()
            last = self.tokens[self.at - 1]
            if self.peek().kind == ",":
                self.at += 1
            elif self.peek().kind != end:
                if not last.kind == self.peek().kind == "string" or "\n" not in self.text[last.end : self.peek().start]:
                    raise Broken
        self.at += 1

    def whole(self):
        """The text as one value, or Broken."""
        self.at = 0
        found = self.value()
        if self.at < len(self.tokens):
            raise Broken
        return found

    def after(self, key: str) -> int | None:
        """The first token behind ``"key":``."""
        return next((n + 2 for n in range(len(self.tokens) - 2) if self.tokens[n].text == key and self.tokens[n].kind == "string" and self.tokens[n + 1].kind == ":"), None)

    def text_of(self, key: str) -> str | None:
        at = self.after(key)
        token = self.tokens[at] if at is not None else None
        return token.text.strip() if token and token.kind == "string" and token.closed and token.text else None

    def list_of(self, key: str) -> list[str]:
        """The texts of a list up to its end or to where the reply breaks off; what is not quoted counts by lines of some length."""
        at, out, loose = self.after(key), [], None
        if at is None or self.tokens[at].kind != "[":
            return out
        for token in [*self.tokens[at + 1 :], Token("]", "", len(self.text), len(self.text))]:
            if token.kind == "word":
                loose = (loose[0] if loose else token.start, token.end)
                continue
            lines = self.text[slice(*loose)].splitlines() if loose else []
            lines += token.text.splitlines()[:1] if token.kind == "string" and not token.closed else []
            out += [x for x in (line.strip("\", \t") for line in lines) if len(x) > 5]
            loose = None
            if token.kind == "]":
                break
            if token.kind == "string" and token.closed and (item := token.text.replace('\\"', '"').replace("\\n", "\n").strip()):
                out.append(item)
        return out

    def objects_of(self, key: str) -> list[dict]:
        """The whole flat objects of a list that ends; objects with objects inside are passed over."""
        at, out = self.after(key), []
        if at is None or self.tokens[at].kind != "[" or not any(t.kind == "]" for t in self.tokens[at:]):
            return out
        for n in range(at, len(self.tokens)):
            if self.tokens[n].kind == "]":
                break
            if self.tokens[n].kind == "{" and next((t.kind for t in self.tokens[n + 1 :] if t.kind in "{}"), "") == "}":
                self.at = n
                try:
                    found = self.value()
                except Broken:
                    continue
                if "question" in found:
                    out.append(found)
        return out


def salvage(reply: str | None) -> str | None:
    """What can be read of a reply, as JSON text; null if nothing: the whole between its outermost brackets, else the known fields one by one."""
    if not reply or not reply.strip():
        return None
    fence = _FENCE.search(reply)
    inside = fence[1] if fence else reply.strip()
    span = _SPAN.search(inside)
    try:
        found = Reply(span[0] if span else inside).whole()
    except (Broken, RecursionError):
        read = Reply(reply)
        found = {k: x for k in FIELDS if (x := read.text_of(k))} | {k: x for k in LISTS if (x := read.list_of(k))}
        whole = read.objects_of("questions")
        found |= {"questions": whole} if whole else {}
        if not found:
            return None
    return json.dumps(found, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def _salvaged(replies: pd.Series) -> pd.Series:
    return replies.map(salvage)


def parsed(reply: Column) -> Column:
    """A reply as compact JSON text; only replies that neither parse as they are nor after repairs reach Python."""
    direct = F.to_json(F.try_parse_json(core(reply)))
    mended = F.to_json(F.try_parse_json(repaired(core(reply))))
    easy = F.coalesce(direct, mended)
    return F.coalesce(easy, _salvaged(F.when(easy.isNull(), reply)))
