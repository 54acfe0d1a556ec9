"""Fixed word lists, patterns and replacements, as data; values that results depend on."""

from __future__ import annotations

# Stop words that carry no meaning of a question.
STOP_WORDS = (
    "the a an is are was were of to in on and or for with by which what who whom according notes did does do as that this these those it at "
    "from his her their its type kind name given term following considered described provide provides very little primarily assertion reason "
    "true false correct explanation statement statements neither both only"
).split()
# Tamil stop words.
TAMIL_STOP_WORDS = (
    "என்ன எது எவை எவ்வாறு எத்தனை யாது ஆகும் உள்ளது உள்ளன கிடைக்கும் போது ஒரு ஓர் மற்றும் இந்த அந்த இவை அவை என்பது என்று என எனப்படும் எனப்பட செய்ய "
    "செய்தால் கொண்டு பயன்படுகிறது பயன்படும் குறிக்கிறது குறிக்கும் அழைக்கப்படுகிறது கூறு கூறுக பின்வருவனவற்றுள் பின்வரும்"
).split()
# Latin words that may stand in Tamil text.
LATIN_ALLOWED = "CM MM KM KG GM ML HZ DNA RNA PH AC DC AM PM ID".split()
# Signs allowed in any language.
EXTRA_SIGNS = "\u2018\u2019\u201c\u201d\u2013\u2014\u2026\u00a0\u200c\u200d\u00d7\u00f7\u2212\u00b1\u00b0\u2032\u2033\u221a\u03c0\u00bc\u00bd\u00be\u00b2\u00b3\u20b9"
# Script ranges of languages, as character classes.
SCRIPTS = {"Tamil": "\u0b80-\u0bff"}
# English phrases that refer to a source text.
_PLACE = "notes|passage|text|document|material|source"
SOURCE_PHRASES = (
    rf"\baccording to the ({_PLACE}|above|given text)\b",
    r"\bas (mentioned|stated|given|discussed|noted) (in|above)\b",
    rf"\bas per the ({_PLACE}|above)\b",
    rf"\bfrom the ({_PLACE}|above)\b",
    r"\bin the (notes|passage|given text|document|material|source)\b",
    rf"\bbased on the ({_PLACE}|above)\b",
    rf"\bthe ({_PLACE})\s+(state|states|say|says|mention|mentions|show|shows)\b",
    r"\bin this (page|passage|note|notes|lesson|section|chapter|unit|paragraph)\b",
    r"\bthis (page|passage|paragraph)\s+(states|mentions|says)\b",
    r"\b(above|given)\s+(notes|passage|text|paragraph)\b",
)
# Tamil phrases that refer to a source text.
TAMIL_SOURCE_PHRASES = (
    "இந்த பக்கத்தில்", "பக்கத்தில் இருந்து", "இந்த குறிப்பில்", "குறிப்புகளின்படி", "குறிப்புகளின் படி",
    "இந்த பாடத்தில்", "மேலே கொடுக்கப்பட்ட", "கொடுக்கப்பட்ட பத்தியில்", "இந்த பத்தியில்",
)
# Headings of end-of-chapter sections, and of chapters.
BACK_MATTER = (
    "evaluation", r"exercises?", r"additional\s+questions?", r"book\s*[- ]?back\s+questions?", r"choose\s+the\s+correct\s+answer",
    r"answer\s+the\s+following", r"fill\s+in\s+the\s+blanks?", r"match\s+the\s+following", r"very\s+short\s+answer",
    r"short\s+answer(?:\s+questions?)?", r"long\s+answer(?:\s+questions?)?", r"one\s+mark\s+questions?",
    "மதிப்பீடு", "பயிற்சி", r"கூடுதல்\s*வினாக்கள்", r"சரியான\s+விடையைத்\s+தேர்ந்தெடு.*", "குறுவினா", "சிறுவினா", "பெருவினா", "பொருத்துக", "நிரப்புக",
)
BACK_MATTER_LINE = r"(?i)^\s*(?:[IVX]+\.?\s*)?(" + "|".join(BACK_MATTER) + r")\s*[:.\-]?\s*$"
CHAPTER_LINE = r"(?i)^\s*(?:(?:unit|chapter|lesson)|பாடம்|அலகு)\s*[-:]?\s*\d+"
QUESTION_LINE = r"[?\uFF1F]\s*$|^\s*\(?\d{1,3}[.)]\s+\S"
# Keys and words of a push reply.
SUCCESS_KEYS = ("success", "ok", "issuccess", "inserted", "status")
FAILURE_KEYS = ("error", "errors", "errormessage", "message")
SUCCESS_WORDS = ("success", "ok", "created", "inserted", "true", "1")
FAILURE_WORDS = ("failed", "failure", "error", "false", "0", "duplicate", "rejected")
# LaTeX commands and signs in printed summaries, in order.
PRINT_SIGNS = (
    (r"\times", "×"), (r"\div", "÷"), (r"\pm", "±"), (r"\le", "≤"), (r"\ge", "≥"), (r"\neq", "≠"), (r"\approx", "≈"), (r"\rightarrow", "→"),
    (r"\to", "→"), (r"\degree", "°"), (r"\circ", "°"), (r"\mu", "μ"), (r"\alpha", "α"), (r"\beta", "β"), (r"\lambda", "λ"), (r"\theta", "θ"),
    (r"\pi", "π"), (r"\Omega", "Ω"), (r"\sqrt", "√"),
)
# Greek letters by name, in order.
GREEK = (
    ("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("theta", "θ"), ("lambda", "λ"), ("mu", "μ"), ("pi", "π"), ("phi", "φ"), ("sigma", "σ"), ("omega", "ω"),
    ("delta", "δ"), ("epsilon", "ε"), ("eta", "η"), ("psi", "ψ"), ("tau", "τ"), ("chi", "χ"), ("xi", "ξ"), ("zeta", "ζ"),
)
# Other LaTeX commands in formulas, in order.
FORMULA_SIGNS = (
    (r"\times", "×"), (r"\cdot", "·"), (r"\pm", "±"), (r"\neq", "≠"), (r"\le", "≤"), (r"\ge", "≥"), (r"\infty", "∞"), (r"\approx", "≈"),
    (r"\subseteq", "⊆"), (r"\cap", "∩"), (r"\cup", "∪"), (r"\in", "∈"),
)
# Words that do not go inside bars.
NOT_IN_BARS = "a|an|the|its|this|that|all|any|each|both|either|neither|of|is|are|was|were"
# Tamil number words, with forms that text recognition makes of them.
TAMIL_NUMBERS = {
    "ஒன்று": "1", "இரண்டு": "2", "மூன்று": "3", "மூன்ற": "3", "நான்கு": "4", "நான்க": "4", "ோன்கு": "4", "ஐந்து": "5",
    "ஆறு": "6", "ஏழு": "7", "எட்டு": "8", "ஒன்பது": "9", "பத்து": "10",
}
# Headings inside a Tamil unit.
SUBHEADINGS = (
    r"பாடலின்\s*பொருள்", "கற்கண்டு", r"திறன்\s*அறிவோம்", r"கற்றல்\s*நோக்கங்கள்", r"மொழியை\s*ஆள்வோம்", r"மொழியோடு\s*விளையாடு", "செயல்திட்டம்",
    r"நிற்க\s*அதற்குத்\s*தக", r"நூல்\s*வெளி", r"நுழையும்\s*முன்", "மதிப்பீடு", r"பலவுள்\s*தெரிக", "குறுவினா", "சிறுவினா", "நெடுவினா", r"பாடநூல்\s*வினாக்கள்",
    r"கலைச்சொல்\s*அறிவோம்", r"அறிவை\s*விரிவு\s*செய்",
)
# Running headers that name no lesson.
FRONT_MATTER = (
    "introduction", r"learning\s+objectives", r"points\s+to\s+remember", "summary", "glossary", "evaluation", "exercises", "activities",
    "references", "index", r"table\s+of\s+contents", "contents", "preface", "syllabus", "acknowledgements", r"model\s+question\s+paper",
    r"government\s+of", r"department\s+of", r"state\s+council", r"all\s+rights\s+reserved", r"not\s+for\s+sale", r"http[s]?://", r"www\.",
)
GENERIC_HEADERS = (
    *FRONT_MATTER,
    r"standard\s+\w+", r"\d+(?:st|nd|rd|th)\s+standard", r"class\s+\d+", r"std\s*\.?\s*\d+", "cbse", "ncert", "icse", r"state\s+board",
    r"choose\s+the\s+correct\s+answer", r"fill\s+in\s+the\s+blanks", r"match\s+the\s+following", r"true\s+or\s+false",
    r"assertion\s+and\s+reason", r"very\s+short\s+answer", r"short\s+answer", r"long\s+answer", r"hot\s+questions", r"concept\s+map",
    r"reference\s+books", r"ict\s+corner", r"textbook\s+evaluation", *SUBHEADINGS,
)
GENERIC_HEADER = r"(?i)^\s*(?:" + "|".join(GENERIC_HEADERS) + r")\s*$"
# First-page marks, sections and headings.
INTRO_WORDS = ("INTRODUCTION", "LEARNING OBJECTIVES", "அறிமுகம்", "கற்றல் நோக்கங்கள்")
SECTION_LINE = r"(?m)^\s*\d{1,2}\.1(?:\.1)?\s+[A-Za-z\u0B80-\u0BFF]"
PAGE_MARK = r"=== PAGE (\d+) ==="
REQUIRED_PAYLOAD = ("examType", "examCode", "quesId", "qsQuestion", "option1", "option2", "option3", "option4", "crtAns")

#: Stands for the rewrite of divisions among the formulas.
DIVISION = "/"
_WORD, _POWER = r"[A-Za-z0-9_]+", r"[A-Za-z0-9_]+(?:\^[-0-9T]+)?"
_BARS = rf"(?!(?:{NOT_IN_BARS})\b)"
# Rewrites of spoken and LaTeX formulas (pattern, replacement), in order.
FORMULAS = (
    (rf"(?i)\babsolute\s+value\s+of\s+({_WORD})\s+minus\s+({_WORD})\s+equals\s+({_WORD})\b", "|$1 - $2| = $3"),
    (rf"(?i)\babsolute\s+value\s+of\s+{_BARS}([A-Za-z0-9_ -]+?)\s+equals\s+([A-Za-z0-9_ -]+?)\b", "|$1| = $2"),
    (rf"(?i)\babsolute\s+value\s+of\s+{_BARS}([A-Za-z0-9_][A-Za-z0-9_\^-]*)", "|$1|"),
    (rf"(?i)\bmodulus\s+of\s+{_BARS}([A-Za-z0-9_][A-Za-z0-9_\^-]*)", "|$1|"),
    (DIVISION, ""),
    (r"(?i)(\b[A-Za-z0-9_+-]+)\s+multiplied\s+by\s+([A-Za-z0-9_+-]+\b)", "$1 × $2"),
    (r"(?i)(\b[A-Za-z0-9_]+?)\s+minus\s+(\b[A-Za-z0-9_]+?\b)", "$1 - $2"),
    (r"(?i)(\b[A-Za-z0-9_]+?)\s+plus\s+(\b[A-Za-z0-9_]+?\b)", "$1 + $2"),
    (r"(?i)\bminus\b", "-"),
    (r"(?i)\bplus\b", "+"),
    (r"(?i)\bis\s+not\s+equal\s+to\b", "≠"),
    (r"(?i)\bnot\s+equal\s+to\b", "≠"),
    (r"(?i)\bis\s+equal\s+to\b", "="),
    (r"(?i)\bequals\b", "="),
    (r"(?i)\b0\s+to\s+2p\b", "0 to 2π"),
    (r"(?i)-p\s+to\s+p\b", "-π to π"),
    (r"(?i)-p/2\s+to\s+p/2\b", "-π/2 to π/2"),
    (r"(?i)\b([zxyab])([1-9])\b", "$1_$2"),
    (r"(?i)\bz\s+bar\b", "z\u0305"),
    (r"(?i)\bzbar\b", "z\u0305"),
    (r"(?i)\b([A-Za-z])_bar\b", "$1\u0305"),
    *((rf"(?i)\\{name}", sign) for name, sign in GREEK),
    *((rf"(?i)\b{name}\b", sign) for name, sign in GREEK),
    *(("\\" + command, sign) for command, sign in FORMULA_SIGNS),
    (r"\\bar\{([^{}]+)\}", "bar($1)"),
    (r"\\bar\s+([A-Za-z0-9_]+)", "bar($1)"),
    (r"\\vec\{([^{}]+)\}", "vec($1)"),
    (r"\\hat\{([^{}]+)\}", "hat($1)"),
    (r"\$(.*?)\$", "$1"),
    (r"\$\$", ""),
    (r"\^\{(.*?)\}", "^$1"),
    (r"_\{(.*?)\}", "_$1"),
    (rf"(\b{_POWER})\s*\*\s*({_POWER}\b)", "$1 $2"),
    (r"(\)\^[-0-9T]+)\s*\*\s*([A-Za-z0-9_]+)", "$1 $2"),
    (r"([A-Za-z0-9_]+)\s*\*\s*(\(\b)", "$1 $2"),
    (r"\bz\s*\*\s*bar\(z\)", "z bar(z)"),
    (r"\bz\s*\*\s*z\s+bar", "z z bar"),
)
# Tamil marks and consonants that extraction repeats, and vowel signs that it splits.
TAMIL_MARKS = "\u0bbe-\u0bcd\u0bd7"
REPEATED_MARKS = "\u0b82\u0bbe-\u0bcd\u0bd7\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962-\u0963"
TAMIL_CONSONANTS = "\u0b95\u0b99\u0b9a\u0b9e\u0b9f\u0ba3\u0ba4\u0ba8\u0baa\u0bae\u0baf\u0bb0\u0bb2\u0bb5\u0bb4\u0bb3\u0bb1\u0ba9"
SPLIT_VOWELS = (("\u0bc6\u0bbe", "\u0bca"), ("\u0bc7\u0bbe", "\u0bcb"), ("\u0bc6\u0bd7", "\u0bcc"))
TAMIL_FIXES = (("கூட்ைோஞ்நோெோறு", "கூட்டாஞ்சோறு"), ("கூட்ைோஞ்நோோறு", "கூட்டாஞ்சோறு"), ("ணற்நோகணி", "மணற்கேணி"))
TITLE_LINE = r"(?i)^(?:lesson\s+\d+|chapter\s+\d+|unit\s+\d+|complete\s+pdf|overall|document:)"
LIST_ITEM = r'^(?:(?:\d+[\.\)]|[-*•–—])\s+|"[0-9]+\.\s*)(.+)$'
# Signs around Tamil titles, words that are no titles, and headings inside a unit.
TITLE_SIGNS = r" \-–—:.0-9●Ø▶*"
UNIT_WORDS = ("இயல்", "அலகு", "பாடம்", *(w for w in TAMIL_NUMBERS))
NOT_LESSONS = (*SUBHEADINGS, r"செய்து\s*கற்போம்", "வாழ்வியல்", "அகரமுதலி", r"இணைப்புப்\s*பக்கம்")
TITLE_LABEL = r"(?i)(?:topic|lesson|chapter|unit|பாட\s*தலைப்பு|தலைப்பு)\s*[:.-]\s*([^\n\r]{2,100})"
NOT_TITLE_START = r"(?i)^(?:http|©|government|page |class |std |department|=== page)"
FILE_WORDS = r"(?i)\b(?:1st|2nd|3rd|\d+th)\s*(?:chapter|week|test|mcq|\d+q)\b"
# Headings of exercises and papers; a page that begins with one starts no unit.
EXERCISE_HEADINGS = (
    r"choose\s+the", r"fill\s+in", r"match\s+the", r"true\s+or\s+false", r"answer\s+(?:the|in|all)", r"short\s+answer", r"long\s+answer", r"one\s+mark", r"two\s+mark", r"five\s+mark",
    r"part\s*[-–]\s*[a-d]", r"section\s*[-–]\s*[a-d]", r"time\s*:\s*\d", r"maximum\s+marks", r"marks\s*:\s*\d", r"சரியான\s*விடையை", "கோடிட்ட", "பொருத்துக", r"சுருக்கமான\s*விடை",
    r"விரிவான\s*விடை", *SUBHEADINGS,
)
EXERCISE_HEADING = r"(?iU)\b(?:" + "|".join(EXERCISE_HEADINGS) + r")\b"
# Words by which a line is no title of a unit.
NO_TITLE = (*FRONT_MATTER, r"concept\s+map", r"ict\s+corner", r"textbook\s+evaluation", *SUBHEADINGS)
NO_TITLE_LINE = r"(?iU)\b(?:" + "|".join(NO_TITLE) + r")\b"
# Words that name a unit, and how headings of units and lessons are written.
ENGLISH_UNITS = ("lesson", "chapter", "unit", "module", "topic", "section", "part", "session", "period", "theme", "block")
TAMIL_UNITS = ("பாடம்", "பாடல்", "அலகு", "இயல்", "பகுதி", "அத்தியாயம்", "உரைநடை", "செய்யுள்", "துணைப்பாடம்", "இலக்கணம்", "கட்டுரை")
_NUMBERED = r"\s*[-:.]?\s*(\d+[A-Za-z]?|[IVXLCDM]+)\b(?:\s*[-–—:.]\s*([^\n\r]{0,120}))?"
LESSON_HEADING = (
    r"(?imdU)^[ \t]*(?:(?:" + "|".join(ENGLISH_UNITS) + ")" + _NUMBERED + "|(?:" + "|".join(TAMIL_UNITS) + ")" + _NUMBERED
    + r"|(\d{1,2})\s*[-–—:]\s*([A-Za-z\u0B80-\u0BFF][^\n\r]{2,80})|(\d{1,2})\s*[\r\n]+[ \t]*([A-Z\u0B80-\u0BFF][A-Za-z\u0B80-\u0BFF\s\-]{2,80}))[ \t]*$"
)
UNIT_HEADING = (
    r"(?iU)\b(?:UNIT|LESSON|CHAPTER|MODULE|TOPIC|SECTION|PART|அலகு|பாடம்|இயல்|பகுதி|அத்தியாயம்|உரைநடை|செய்யுள்|துணைப்பாடம்|இலக்கணம்|கட்டுரை)\s*[-:]?\s*(\d{1,2}|[IVXLCDM]+)\b"
    r"(?:\s*[-:.]\s*([^\n\r]{2,80}))?"
)
UNIT_IN_FOOTER = r"(?i)(?:Unit|Lesson|Chapter)[-_](\d{1,2})"
# The number of a Tamil unit, in digits or as a word.
UNIT_NUMBER = r"(?i)\b(?:UNIT|அலகு|இயல்)\s*[-:]?\s*(\d+)"
UNIT_NUMBER_WORD = r"(?:இயல்|அலகு)\s*[-:]?\s*(" + "|".join(sorted(TAMIL_NUMBERS, key=len, reverse=True)) + ")"
# How the beginning of a Tamil unit is told: its word with a number, other words with one, learning goals; what may follow a doubled number.
_TEN = ("ஒன்று", "இரண்டு", "மூன்று", "நான்கு", "ஐந்து", "ஆறு", "ஏழு", "எட்டு", "ஒன்பது", "பத்து")
TAMIL_TEN = "(?:" + "|".join(_TEN) + ")"
IYAL = r"இயல்\s*(?:இயல்\s*)?(?:(\d{1,2})|([IVXLCDM]+)|(" + "|".join(_TEN) + "))"
IYAL_NEAR = r"இயல்\s*(?:(\d{1,2})|([IVXLCDM]+)|(" + "|".join(_TEN) + "))"
OTHER_UNIT_WORDS = ("அலகு", "பாடம்", "பகுதி", "அத்தியாயம்")
OTHER_UNIT = "(?:" + "|".join(OTHER_UNIT_WORDS) + r")\s*[-:]?\s*(\d{1,2}|[IVXLCDM]+)"
TAMIL_GOALS = r"கற்[்ற]+ல்\s*நோ[ோF]*க்[க]+ங்கள்"
IYAL_WORD, UNIT_STARTS = "இயல்", ("இயல்", "அலகு", "பாடம்")
UNIT_PARTS = ("உரைநடை", "செய்யுள்", "கற்கண்டு", "விரிவானம்", "வாழ்வியல்")
PART_SIGNS = r" \-–—:.*•"
# Names that stand for no name.
NO_NAMES = ("full document", "unknown", "lesson 1", "none", "actual topic or chapter name here", "")
# Signs that join words in file names and headings, and unit words before a name.
NAME_JOINS, NAME_UNIT = r"[_\\-]+", r"(?i)^(?:Unit|Lesson|Chapter)\s*\d+[-:\s]*"
# Where the number of a lesson stands in its text, section numbers that are none, and its sections.
FIRST_SECTION = r"(?m)^\s*(\d{1,2})\.1(?:\.1)?\s+[A-Za-z\u0B80-\u0BFF]"
NUMBER_NEAR_START = r"(?i)\b(?:UNIT|LESSON|CHAPTER|MODULE|TOPIC|PART|அலகு|பாடம்|இயல்)\s*[-:]?\s*(\d{1,2}|[IVXLCDM]+)(?![\w])"
NOT_SECTIONS = ("97", "22", "35", "0")
SECTION_TITLE = r"\s+([A-Za-z\u0B80-\u0BFF\s,\-]{3,80})"
BOOK_TITLE_LINE = r"(?i)^\s*(?:\d+|(?:\d+th|th)?\s*standard\s+science)\s*$"
# Places where a long text may be cut.
CUT_MARK = r"\n=== PAGE \d+ ===\n|\n\n\n|\n\n"
# Repairs of extracted Tamil (pattern, replacement) before and after split vowels are joined.
TAMIL = "\u0b80-\u0bff"
TAMIL_REPAIRS = (
    (r"[\ufffd\x00-\x08\x0b\x0c\x0e-\x1f]", ""),
    (rf"(?<=[{TAMIL}])[A-Za-z]+(?=[{TAMIL}])", ""),
    (rf"(?<=[{TAMIL}])[A-Za-z]+(?=\s|[-–—:.,!?]|$)", ""),
    (rf"(?:\b|(?<=\s))[A-Za-z]+(?=[{TAMIL}])", ""),
    (rf"([{TAMIL_MARKS}])\1+", "$1"),
)
# Prefixes of question ids by subject.
SUBJECT_PREFIXES = {
    "Tamil": "TA", "English": "EN", "Maths": "MA", "Science": "SC", "Social Science": "SO", "Physics": "PH", "Chemistry": "CH", "Biology": "BI", "Computer Science": "CS", "Botany": "BO",
    "Zoology": "ZO", "Commerce": "CO", "Economics": "EC", "Accountancy": "AC", "Business Mathematics": "BM", "Mathematics": "MA",
}
# The languages text recognition expects, whatever the subject and board.
RECOGNITION_LANGUAGE = "eng+tam"
LEVELS = ("easy", "moderate", "hard")
