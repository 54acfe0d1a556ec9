"""Prompts as Column expressions: what is asked for, in which formats, difficulty and language, and what to keep away from. Their wording is our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T

REPLY = 'Reply with JSON only: {"questions": [{"question": "...", "options": {"A": "...", "B": "...", "C": "...", "D": "..."}, "answer": "A", "correct_answer_text": "...", "explanation": "..."}]}'


def _lines(*parts: Column | str) -> Column:
    """Parts that are not null, a line each."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def listed(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda x: F.concat(F.lit("- "), x)), "\n")


#: What each question format asks for, by its number: fixed meanings, in words of our own.
FORMATS = (
    "choose the answer: a direct question with four options",
    "fill in the blank: the stem has ______ where a word is missing, the options are words for it; the blank is never written as a word",
    "match: four numbered items against four lettered ones; each option pairs all four, such as 1-c, 2-a, 3-d, 4-b",
    "complete the sentence: the stem begins a sentence, the options end it",
    "correct statement: two short numbered statements; the options say which of them hold (1 only, 2 only, both, none)",
    "name it: the stem describes a process, idea or thing, the options are names",
    "which of the following: the stem begins so and asks what is or is not true",
    "assertion and reason: the stem gives Assertion (A) and Reason (R), the options are the four usual verdicts on them",
    "odd one out: four terms or statements, one of which does not belong",
    "correct the statement: the stem states something wrong, the options are corrections",
    "where: the stem begins with where",
    "who: the stem begins with who",
    "what: the stem begins with what",
    "which: the stem begins with which",
)
#: What each difficulty means, likewise.
DIFFICULTY = {
    "easy": "recall of one stated fact, no reasoning",
    "moderate": "two related facts put together, or a choice of what is or is not right",
    "hard": "analysis, comparison, or an idea applied to a new case; statements, or assertion and reason",
}
#: Subjects of which three questions in five are sums, by lower-cased name: fixed values.
SUMS = ("maths", "mathematics", "business mathematics", "accountancy", "accounts", "commerce")
SUM = "a sum: a number has to be worked out from data given in the question itself"
THEORY = "theory: no calculation; a rule, property or term, each option one to three words"


def _chosen(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.lower(T.strip(key)))


def format_lines(formats: Column) -> Column:
    """A line for each question: its number, its format's number and what that asks for."""
    meaning = F.array(*map(F.lit, FORMATS))
    return F.array_join(F.transform(formats, lambda x, i: F.concat(F.lit("Question "), (i + 1).cast("string"), F.lit(": format "), x.cast("string"), F.lit(", "), F.coalesce(F.get(meaning, x - 1), F.lit(FORMATS[0])))), "\n")


def sum_lines(formats: Column, subject: Column) -> Column:
    """For subjects of sums a line for each question, the first three of every five a sum; else null."""
    kind = lambda i: F.when(i % 5 < 3, SUM).otherwise(THEORY)
    lines = F.array_join(F.transform(formats, lambda x, i: F.concat(F.lit("Question "), (i + 1).cast("string"), F.lit(" is "), kind(i))), "\n")
    return F.when(F.lower(T.strip(subject)).isin(*SUMS), F.concat(F.lit("Sixty in a hundred questions are sums and forty theory, in this order:\n"), lines))


def language_rule(language: Column) -> Column:
    """All in one language; scripts do not mix."""
    tamil = "Not one Latin letter, unit or abbreviation may stand anywhere; names are transliterated."
    return F.concat(F.lit("Everything is in "), language, F.lit(" and its own script, without glosses in brackets. Digits and signs of arithmetic may stay. "), F.when(language == "Tamil", tamil).otherwise(""))


#: Rules that hold for all questions.
RULES = (
    "Ask about the matter itself and never mention notes, lessons, pages, passages or numbered examples; restate the data that a question needs. Exactly one of the options A to D is right.",
    "A stem has at most 15 words, an option fewer than 6: both are read within 18 seconds. What needs more goes into the explanation, two or three sentences that end in a definite statement.",
    "No two questions test one fact, and they cover all of the notes. Work each question out before choosing its answer; correct_answer_text repeats the right option word for word.",
    "Formulas are plain text with signs (×, /, √, ≤, π, x^2, z_1), never words, dollar signs or backslashes. Numbers are grouped in one way throughout. Broken letters of the notes are put right.",
)


def questions(notes: Column, count: Column, difficulty: Column, language: Column, formats: Column, subject: Column | None = None, avoid: Column | None = None, book: Column | None = None) -> Column:
    """Asks for ``count`` questions on notes; ``formats`` gives each one's format number, ``avoid`` are questions not to repeat and ``book`` those of the book, whose answers are not to be asked for again."""
    none = F.lit(None).cast("string")
    some = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(title + "\n"), listed(c))) if c is not None else none
    level = F.concat(F.lit("Difficulty "), difficulty, F.lit(": "), F.coalesce(_chosen(DIFFICULTY, difficulty), F.lit(DIFFICULTY["moderate"])))
    return _lines(
        F.concat(F.lit("Write "), count.cast("string"), F.lit(" multiple choice questions for public examinations from the notes below.")), level,
        F.concat(F.lit("Subject: "), subject) if subject is not None else none, language_rule(language), *RULES,
        F.concat(F.lit("Formats:\n"), format_lines(formats)), sum_lines(formats, subject) if subject is not None else none,
        some(avoid, "Do not repeat or reword:"),
        some(book, "Questions of the book. A question with the answer of one of these is a repeat, however it is worded, translated or formatted; ask for something else:"), REPLY, "NOTES:", notes,
    )


def part_of(number: Column, of: Column) -> Column:
    """A hint for one of several requests on the same notes."""
    return F.concat(F.lit("This is request "), number.cast("string"), F.lit(" of "), of.cast("string"), F.lit(" on these notes: ask about part "), number.cast("string"), F.lit(" of them."))


def proofread(batch: Column) -> Column:
    """Asks for the same questions (JSON text) with their language mended and the answers as they are."""
    return _lines("Mend spelling and grammar of these questions; keep their number, order and answers. Reply with the JSON array only.", batch)


def verify(batch: Column, notes: Column) -> Column:
    """Asks for the questions with wrong answers put right by the notes."""
    return _lines("Check each answer against the notes and put wrong ones right; keep number and order. Reply with the JSON array only.", batch, "NOTES:", notes)


#: What the bullets of a lesson have to cover.
TOPICS = "definitions, laws, formulas, classes, processes, examples, experiments, comparisons, key values, conditions and exceptions"


def summary(lesson: Column, number: Column, name: Column, language: Column, sections: Column | None = None, chunk: Column | None = None, chunks: Column | None = None) -> Column:
    """Asks for the bullets of a lesson, or of one of its chunks; ``sections`` (code, title) are to have bullets of their own, the first 25 are named."""
    none = F.lit(None).cast("string")
    titled = F.filter(sections, lambda x: x["title"] != "") if sections is not None else None
    named = F.when(F.size(titled) > 0, F.concat(F.lit("Each of these sections has bullets of its own:\n"), listed(F.transform(F.slice(titled, 1, 25), lambda x: F.concat_ws(" ", x["code"], x["title"]))))) if sections is not None else none
    part = F.when(chunks > 1, F.concat(F.lit("This is part "), chunk.cast("string"), F.lit(" of "), chunks.cast("string"), F.lit(" of the lesson."))) if chunks is not None else none
    return _lines(
        F.concat(F.lit("Summarise lesson "), number, F.lit(": "), name, F.lit(" for an examination, from its first line to its last; number and name stay as they are and no other lesson is mixed in.")),
        f"One fact a bullet, in the order of the text, 10 to 20 words each: {TOPICS}. Nothing that the text does not say, and no words about the text.", language_rule(language), part, named,
        'Reply with JSON only: {"lesson_number": "...", "lesson_name": "...", "bullets": ["..."]}', "LESSON:", lesson,
    )


def summary_again(prompt: Column) -> Column:
    """The second request for a lesson whose reply had no bullets."""
    return _lines(prompt, "The reply has to be a JSON object whose list bullets has at least 15 entries.")


def coverage(missing: Column, bullets: Column, name: Column) -> Column:
    """Asks for bullets on sections (code, title) that are missing."""
    named = F.transform(missing, lambda x: F.concat_ws(" ", x["code"], x["title"]))
    return _lines(F.concat(F.lit("These topics of "), name, F.lit(" have no bullet yet:")), listed(named), "There are already:", listed(bullets), 'Reply with JSON only: {"additional_bullets": ["..."]}')
