"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import rules as R


#: White space of any script.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.btrim(text, F.lit(WHITE))


def normal_key(text: Column) -> Column:
    """Comparison key: lower case, runs of white space as one blank, no outer blanks; null gives ''."""
    return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), r"(?U)\s+", " ")


def significant_words(text: Column) -> Column:
    """Distinct words of at least three letters or digits that are not stop words; hyphens are dropped first."""
    words = F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("-"), F.lit(""))), F.lit("[a-zA-Z0-9\u0b80-\u0bff]+"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in (*R.STOP_WORDS, *R.TAMIL_STOP_WORDS)))
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), stop)


def language_of(text: Column, share: float = 0.5) -> Column:
    """Tamil if more than half of the Tamil and Latin letters are Tamil, else English."""
    tamil, latin = F.regexp_count(text, F.lit("[\u0b80-\u0bff]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(F.coalesce(F.try_divide(tamil, tamil + latin), F.lit(0.0)) > share, "Tamil").otherwise("English")


def wrong_script(text: Column, allowed: str = "") -> Column:
    """A character that is neither ASCII nor an allowed sign nor in the language's range."""
    return F.coalesce(text.rlike(f"[^\\x00-\\x7F{R.EXTRA_SIGNS}{allowed}]"), F.lit(False))


def stray_latin(text: Column) -> Column:
    """A Latin word of two letters or more that is not on the list of allowed ones; for Tamil text."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))
    return F.exists(words, lambda w: ~F.upper(w).isin(R.LATIN_ALLOWED))


def names_source(text: Column) -> Column:
    """The text refers to the notes, page or passage it was made from."""
    return F.coalesce(text.rlike("(?i)" + "|".join(R.SOURCE_PHRASES)) | text.rlike("|".join(R.TAMIL_SOURCE_PHRASES)), F.lit(False))


def generic_header(text: Column) -> Column:
    n = F.length(text)
    return F.coalesce((n < 3) | (n > 80) | text.rlike("^[0-9]+$") | text.rlike(R.GENERIC_HEADER), F.lit(True))


def unusable(text: Column) -> Column:
    """Text that has to be read again by recognition: too short, broken encoding, or hardly any letters."""
    core = strip(F.coalesce(text, F.lit("")))
    n = F.length(core)
    tamil, high = F.regexp_count(core, F.lit("[\u0b80-\u0bff]")), F.regexp_count(core, F.lit("[\\x80-\\xff]"))
    words = F.regexp_count(core, F.lit("[a-zA-Z]{2,}"))
    return (n < 30) | ((tamil < 10) & (high > 10) & (high > n * 0.12)) | ((tamil < 5) & (words < 5) & (n > 20))


def print_math(text: Column) -> Column:
    """Formula signs of printed summaries: no asterisks or dollars, LaTeX commands as signs, single blanks."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\*\*(.*?)\*\*", "$1")
    out = F.replace(F.regexp_replace(out, r"\*(.*?)\*", "$1"), F.lit("$"), F.lit(""))
    for command, sign in R.PRINT_SIGNS:
        out = F.replace(out, F.lit(command), F.lit(sign))
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def escape_html(text: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def division(text: Column) -> Column:
    """'a divided by b' as a / b; a side with + or - goes in brackets. One pass a kind of sides."""
    side = r"[A-Za-z0-9_+-]*[+-][A-Za-z0-9_+-]*"
    plain = r"[A-Za-z0-9_]+"
    by = r"\s+divided\s+by\s+"
    for left, right, to in ((side, side, "($1) / ($2)"), (side, plain, "($1) / $2"), (plain, side, "$1 / ($2)"), (plain, plain, "$1 / $2")):
        begin = rf"(?<![A-Za-z0-9_+-])(?=[A-Za-z0-9_])({left})" if left is plain else rf"\b({left})"
        end = rf"({right})(?<=[A-Za-z0-9_])(?![A-Za-z0-9_+-])" if right is plain else rf"({right})(?<=\w)\b(?![+-]*\w)"
        text = F.regexp_replace(text, f"(?i){begin}{by}{end}", to)
    return text


def clean_math(text: Column) -> Column:
    """Spoken and LaTeX formulas as signs; labels such as 'plus X' stay as they are."""
    out = text
    for pattern, to in R.FORMULAS:
        out = division(out) if pattern == R.DIVISION else F.regexp_replace(out, pattern, to)
    return F.when(text.rlike(r"(?i)^\s*(plus|minus)\s+\S+\s*$"), text).otherwise(out)
