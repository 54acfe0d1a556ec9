"""Overlapping chunks on text boundaries, and how much to ask for in a round."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.functions import rules as R

_MARK = re.compile(R.CUT_MARK)


def cut(text: str, most: int = 60_000, overlap: int = 400) -> list[str]:
    """Chunks of at most ``most`` characters, each ending at the last cut mark in it, if there is one.

    Marks don't overlap: of three line feeds the first two are one. The next chunk begins ``overlap`` before the end of the one before, but always moves on.
    """
    marks = [m.start() for m in _MARK.finditer(text)]
    out, start = [], 0
    while len(text) - start > most:
        mark = marks[at - 1] if (at := bisect_right(marks, start + most)) else 0
        stop = mark if mark > start else start + most
        out.append(text[start:stop])
        start = max(stop - overlap, start + 1)
    return [*out, text[start:]]


def chunked(text: Column, most: int = 60_000, overlap: int = 400) -> Column:
    """The chunks of a text; a text that fits is not sent to Python."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut(t, most, overlap))

    long = F.length(text) > most
    return F.when(long, run(F.when(long, text))).otherwise(F.array(text))


def asked(short: int, most: int = 25) -> int:
    """How many to ask for when ``short`` are missing: twice as many, within bounds."""
    return min(most, max(short, round(short * 2)))


def overasked(count: int, factor: float = 1.2) -> int:
    """How many to ask for at first."""
    return max(count, round(count * factor))
