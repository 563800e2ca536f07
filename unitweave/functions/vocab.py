"""Word lists and ranks that results depend on."""

from __future__ import annotations

# Type words, tested as substrings when department strings are cleaned.
TYPE_WORDS = (
    "department", "dept", "dpt", "school", "sch", "college", "coll", "col", "faculty", "fac", "institute", "inst",
    "institution", "center", "centre", "ctr", "division", "div", "program", "prog", "programme", "laboratory",
    "laboratories", "lab", "academy", "acad", "university", "univ", "hospital", "hosp", "administration", "admin",
    "association", "assoc", "unit", "office", "section", "sect", "sec", "branch", "group", "grp",
)

# Abbreviations, tested as whole words.
ABBREVIATIONS = (
    "dept", "dpt", "sch", "coll", "fac", "inst", "ctr", "div", "prog", "lab", "acad", "univ", "admin", "assoc", "sect",
    "sec", "grp",
)

# Stop words.
STOP_WORDS = ("of", "the", "and", "for", "in", "on", "at", "to", "amp")

# Words at which a name is split into prefix and suffix.
CUE_WORDS = (
    "school", "department", "college", "faculty", "center", "centre", "institute", "laboratory", "laboratories", "lab",
    "division", "program", "programme", "office", "unit",
)

# Words that a person-like prefix may not hold.
NOT_IN_PREFIX = (
    "school", "department", "dept", "college", "faculty", "center", "centre", "institute", "laboratory", "laboratories",
    "lab", "program", "programme", "office", "unit", "phd", "msc", "ms", "mba", "ba", "bs", "bsc", "jd", "llm",
)

# Ranks of words in the hierarchy, higher units first.
RANK_WORDS = {
    1: ("university", "univ"),
    2: ("faculty", "fac"),
    3: ("school", "sch", "college", "coll", "col"),
    4: ("department", "dept", "center", "centre", "ctr", "laboratory", "laboratories", "lab", "institute", "institution", "inst"),
}
ROOT_RANK, UNKNOWN_RANK = 0, 5
ROOT_MARK = "__INST__"

# Frequent short words of the Latin-script languages that the default tagger tells apart.
FUNCTION_WORDS = {
    "ENGLISH": ("the", "of", "and", "in", "to", "is", "that", "for", "with", "on", "was", "by", "this", "are", "as"),
    "SPANISH": ("el", "los", "las", "que", "y", "en", "del", "por", "una", "con", "para", "como", "se", "es", "su"),
    "FRENCH": ("le", "les", "des", "et", "du", "un", "une", "dans", "pour", "par", "sur", "qui", "au", "est", "à"),
    "GERMAN": ("der", "die", "das", "und", "von", "zu", "mit", "den", "ist", "nicht", "ein", "eine", "im", "für", "auf"),
}
