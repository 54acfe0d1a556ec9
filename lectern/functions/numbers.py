"""Tolerant parsing of numbers, letters and ids; nothing here throws under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import rules as R
from lectern.functions.text import strip


def digits_or(text: Column, default: int) -> Column:
    """The integer of a text of ASCII digits only (outer blanks allowed), else ``default``."""
    core = strip(text)
    return F.coalesce(F.when(core.rlike("^[0-9]+$"), core.try_cast("bigint")), F.lit(default).cast("bigint"))


def lenient_int(text: Column) -> Column:
    """Leading digits of a text, 0 if it has none; null stays null."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0)))


def first_number(text: Column, default: int = 60) -> Column:
    """The first number in a text, rounded half to even; ``default`` without one."""
    found = F.regexp_extract(text, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    return F.coalesce(F.bround(found, 0).try_cast("bigint"), F.lit(default).cast("bigint"))


def natural_key(text: Column, default: int = 999) -> Column:
    """The first run of digits as a sort key."""
    return F.coalesce(F.regexp_extract(text, "[0-9]+", 0).try_cast("bigint"), F.lit(default))


def letter_number(letter: Column, default: int | None = 1) -> Column:
    """A-D or 1-4 to 1-4."""
    core = F.upper(F.trim(letter.cast("string")))
    by_letter = F.when(core.isin("A", "B", "C", "D"), F.ascii(core) - F.ascii(F.lit("A")) + 1)
    return F.coalesce(by_letter, F.when(core.isin("1", "2", "3", "4"), core.try_cast("int")), F.lit(default))


def number_letter(number: Column) -> Column:
    """1-4 to A-D, anything else null."""
    n = number.try_cast("int")
    return F.when(n.between(1, 4), F.substring(F.lit("ABCD"), n, F.lit(1)))


def padded(number: Column, width: int = 3) -> Column:
    """Zero-filled to a width; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def lesson_id(number: Column) -> Column:
    """lesson_07 for digits, lesson_IV for anything else."""
    return F.concat(F.lit("lesson_"), F.when(number.rlike("^[0-9]+$"), padded(F.regexp_replace(number, "^0+(?=.)", ""), 2)).otherwise(number))


def subject_prefix(subject: Column) -> Column:
    """The prefix of question ids of a subject; null for an unknown one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in R.SUBJECT_PREFIXES.items() for x in pair)), subject)


def utc_now() -> Column:
    """The time now in UTC, without a zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def iso(at: Column) -> Column:
    """A time as ISO text; fractions of a second only where there are some."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
