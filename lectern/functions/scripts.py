"""Repair of extracted Tamil text. Only the Unicode normal form needs Python; rows of ASCII text never reach it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import rules as R


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), _nfc(F.when(text.rlike("[^\\x00-\\x7F]"), text))).otherwise(text)


def repaired_tamil(text: Column) -> Column:
    """Tamil without what extraction adds, in any normal form: each step needs the ones before it.

    First what is no text and Latin runs that stick to Tamil letters go, then repeated signs, so that the halves of a split vowel meet and
    can be joined; only then are repeated consonants real repeats, and whole words can be told.
    """
    steps = [lambda c, p=p, to=to: F.regexp_replace(c, p, to) for p, to in R.TAMIL_REPAIRS]
    steps += [lambda c, x=x: F.replace(c, F.lit(x[0]), F.lit(x[1])) for x in R.SPLIT_VOWELS]
    steps.append(lambda c: F.regexp_replace(c, rf"([{R.TAMIL_CONSONANTS}])\1+", "$1"))
    steps += [lambda c, x=x: F.replace(c, F.lit(x[0]), F.lit(x[1])) for x in R.TAMIL_FIXES]
    return reduce(lambda c, step: step(c), steps, text)


def clean_tamil(text: Column) -> Column:
    """Repaired Tamil in canonical composition."""
    return nfc(repaired_tamil(text))


def clean_extraction(text: Column) -> Column:
    """Normal form, single combining marks, then the Tamil repairs."""
    return clean_tamil(F.regexp_replace(nfc(text), rf"([{R.REPEATED_MARKS}])\1+", "$1"))


def clean_each(texts: Column, then: Callable[[Column], Column] = lambda c: c) -> Column:
    """``clean_extraction``, and ``then`` what else is to be done, of each text of an array without nulls; the normal form is taken of all at once, as Python can't be called inside a lambda."""
    cut = "\x1e"
    whole = lambda a: F.split(nfc(F.array_join(a, cut)), cut)
    single = lambda c: F.regexp_replace(c, rf"([{R.REPEATED_MARKS}])\1+", "$1")
    once = F.transform(whole(texts), lambda x: repaired_tamil(single(x)))
    return F.when(F.size(texts) == 0, texts).otherwise(F.transform(whole(once), then))
