"""Scores of the hierarchy and similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitweave.functions import vocab


def is_root(name: Column) -> Column:
    return name.startswith(vocab.ROOT_MARK)


def lexical_rank(name: Column) -> Column:
    """0 for a root, the first rank with a word of the name, else null."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))
    out = F.when(is_root(name), F.lit(vocab.ROOT_RANK))
    for rank, some in vocab.RANK_WORDS.items():
        out = out.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in some])), F.lit(rank))
    return out


def lexical_bonus(parent_rank: Column, child_rank: Column, cap: float = 0.25) -> Column:
    """A quarter for each rank between them, capped; 0 where a rank is unknown or the root's."""
    bonus = F.greatest(F.lit(-cap), F.least(F.lit(cap), (child_rank - parent_rank) / F.lit(float(len(vocab.RANK_WORDS)))))
    return F.when((parent_rank > vocab.ROOT_RANK) & (child_rank > vocab.ROOT_RANK), bonus).otherwise(F.lit(0.0))


def gap_penalty(parent_rank: Column, child_rank: Column, weight: float = 0.15) -> Column:
    """Minus weight for each rank skipped between parent and child; the root counts as unknown."""
    known = lambda r: F.when(r > vocab.ROOT_RANK, r).otherwise(F.lit(vocab.UNKNOWN_RANK))
    gap = known(child_rank) - known(parent_rank) - 1
    return F.when(gap > 0, gap * F.lit(-weight)).otherwise(F.lit(0.0))


def frequency_scale(frequency: Column) -> Column:
    """Damping of frequent parents."""
    return F.when(frequency <= 0, F.lit(1.0)).otherwise(1.0 / (1.0 + F.log1p(frequency.cast("double"))))


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient that is infinite over 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(float("inf")))


def softmax_best(logits: Column) -> Column:
    """struct(index, score): the place from 0 of the greatest logit (the first of equals) and its share after softmax; null for no logits."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top.cast("double")))
    return F.when(F.size(logits) > 0, F.struct((F.array_position(logits, top) - 1).cast("int").alias("index"), (F.lit(1.0) / total).alias("score")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, within -1 and 1; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def cosine_distance(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - similarity))
