"""Text normalisation as column expressions; only the Unicode fold needs Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from unitweave.functions import vocab

# White space and line ends as Python's re has them, whatever the JVM's defaults.
_WS = r"(?U)[\s\x1c-\x1f]"


def _one_of(words: tuple[str, ...]) -> str:
    return "|".join(words)


def _once(value: Column, use) -> Column:
    """use(value) with value computed a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, _WS + "+", " "))


def clean_affiliation(text: Column) -> Column:
    """Single spaces, none before closing or after opening punctuation, one between punctuation and letters; no wrapping brackets. Null gives ''."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), _WS + "+", " ")
    out = F.regexp_replace(out, r" +([,;:.)\]}])", "$1")
    out = F.regexp_replace(out, r"([,;:.({\[]) +", "$1")
    out = F.regexp_replace(out, r"([,;:.)\]}])([a-zA-Z0-9])", "$1 $2")
    out = F.trim(F.regexp_replace(out, r"([a-zA-Z0-9])([({\[])", "$1 $2"))
    return F.regexp_replace(F.regexp_replace(out, r"^[(\[{]+", ""), r"[)\]}]+$", "")


def clean_department(text: Column, blank_amp: bool = True) -> Column:
    """A department string in lower case without brackets' rest, punctuation and outer stop words; '' where no type word occurs.

    blank_amp mirrors the removal of "amp" even inside words. Outer stop words are taken from the front of the text and of
    the reversed text: there a possessive loop needs neither the stack nor a second look, however long their run.
    """
    outer = lambda words: f"^(?:(?:{_one_of(words)})(?: |$))++"
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?d)\(.*$", " ")
    out = F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", " ")
    if blank_amp:
        out = F.replace(out, F.lit("amp"), F.lit(" "))
    out = F.regexp_replace(collapse(out), outer(vocab.STOP_WORDS), "")
    out = F.reverse(F.regexp_replace(F.reverse(out), outer(tuple(w[::-1] for w in vocab.STOP_WORDS)), ""))
    return _once(out, lambda x: F.when(x.rlike(_one_of(vocab.TYPE_WORDS)), F.trim(F.regexp_replace(x, r"(?U)^\d+[\s\x1c-\x1f]*", ""))).otherwise(F.lit("")))


def is_abbreviation(text: Column) -> Column:
    """Whether a type-word abbreviation occurs as a whole word."""
    return text.rlike(rf"(?U)\b(?:{_one_of(vocab.ABBREVIATIONS)})\b")


@F.pandas_udf(StringType())
def _ascii_fold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower() if x is not None else "")


def fold_name(text: Column) -> Column:
    """Lower-case ASCII words without diacritics and punctuation; '&' becomes 'and'. Apply it to distinct names."""
    out = F.replace(F.replace(_ascii_fold(text), F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(" "))
    return collapse(F.regexp_replace(out, r"[^a-z0-9_\s\x1c-\x1f]", " "))


def core_name(folded: Column) -> Column:
    """What follows the first type word of a folded name, else what precedes it, without stop words; else the name itself."""
    pattern = rf"^(.*?)\b(?:{_one_of(vocab.TYPE_WORDS)})\b(.*)$"
    part = lambda k: F.nullif(F.trim(F.regexp_extract(folded, pattern, k)), F.lit(""))
    core = F.when(folded.rlike(pattern), F.coalesce(part(2), part(1), F.lit(""))).otherwise(folded)
    core = collapse(F.regexp_replace(core, rf"\b(?:{_one_of(vocab.STOP_WORDS)})\b", ""))
    return F.coalesce(F.nullif(core, F.lit("")), folded)


def _any_of(token: Column, words: tuple[str, ...]) -> Column:
    return token.isin(*words)


def split_prefix(name: Column, cues: tuple[str, ...] = vocab.CUE_WORDS, most: int = 3) -> Column:
    """struct(prefix, suffix, valid): split before the first cue word that is not the last word.

    valid: the prefix has 1 to most words of letters only (after - ' . are taken out), none of them excluded.
    """
    tokens = F.filter(F.split(F.coalesce(name, F.lit("")), _WS + "+"), lambda t: t != "")
    at = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))), lambda i: (i < F.size(tokens)) & _any_of(F.get(tokens, i - 1), cues)), F.lit(1))
    before = F.slice(tokens, F.lit(1), at - 1)
    bare = F.transform(before, lambda t: F.regexp_replace(t, r"[-'.]", ""))
    valid = (at > 1) & (at - 1 <= most) & F.forall(bare, lambda t: t.rlike(r"^\p{L}+$") & ~_any_of(t, vocab.NOT_IN_PREFIX))
    return F.struct(
        F.coalesce(F.array_join(before, " "), F.lit("")).alias("prefix"),
        F.coalesce(F.array_join(F.slice(tokens, at, F.size(tokens)), " "), F.lit("")).alias("suffix"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def split_ids(text: Column) -> Column:
    """A ';'-joined list of ids as array<bigint>, blanks dropped."""
    return F.transform(F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("long"))


def clamped_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two offsets, both clamped into it."""
    first = F.greatest(F.lit(0), F.least(F.length(text), start))
    last = F.greatest(first, F.least(F.length(text), end))
    return F.substring(text, first + 1, last - first)


def language(text: Column) -> Column:
    """Default language tag: script first, then the language with most function words (ties in the listed order), else UNKNOWN.

    One pass finds the function words of all languages, a second counts them by language.
    """
    known = _one_of(tuple(w for some in vocab.FUNCTION_WORDS.values() for w in some))
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<!\p{{L}})(?:{known})(?!\p{{L}})"), F.lit(0))
    names = list(vocab.FUNCTION_WORDS)
    more = lambda n, w: F.struct(*[(n[x] + w.isin(*vocab.FUNCTION_WORDS[x]).cast("int")).alias(x) for x in names])

    def most(n: Column) -> Column:
        best = F.greatest(*[n[x] for x in names])
        out = F.when(best == 0, "UNKNOWN")
        for x in names:
            out = out.when(n[x] == best, x)
        return out

    counted = F.aggregate(found, F.struct(*[F.lit(0).alias(x) for x in names]), more, most)
    return (
        F.when(text.rlike(r"[\x{3040}-\x{30ff}]"), "JAPANESE").when(text.rlike(r"[\x{4e00}-\x{9fff}]"), "CHINESE").when(text.rlike(r"[\x{0400}-\x{04ff}]"), "RUSSIAN")
        .otherwise(counted)
    )


def first_words(text: Column, most: int) -> Column:
    """At most so many words from the front, as a model with bounded input sees a text."""
    return F.regexp_extract(text, rf"^\s*(?:\S+\s*){{0,{most}}}", 0)
