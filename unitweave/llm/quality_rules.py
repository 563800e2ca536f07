"""Quality rules: counting rules, then a logistic regression over hashed word and character n-grams.

The regression learns from labelled rows, is calibrated on a part of them that it was not fitted on, and scores whole
texts in Arrow batches: each n-gram looks up a weight, and a text's logit is the offset plus the mean weight of its word
n-grams and of its character n-grams. A document is kept if no counting rule fails and its probability of good quality
reaches a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import Texts, bound_batches, mix, slices

#: Labelled documents to fit on, at most: those first by a hash of doc_id.
MAX_LABELLED = 4000
BUCKETS = 2048
CHARACTERS = 3
THRESHOLD = 0.5
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20
RIDGE, ROUNDS, SCALE = 1e-4, 150, 40.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Model:
    """weights: of word n-gram buckets, then of character n-gram buckets; calibration: slope and offset of the logit."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * BUCKETS))
    offset: float = 0.0
    calibration: tuple[float, float] = (1.0, 0.0)


def _grams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all word 1- and 2-grams with their rows, and of all character 3-grams with theirs."""
    words = texts.word_hashes()
    rows = texts.row_of_words()
    at, pairs = texts.windows(words, 2)
    word_buckets = (np.concatenate([mix(words + np.uint64(1)), pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    heads = np.flatnonzero((texts.data & 0xC0) != 0x80)
    ends = np.append(heads[1:], len(texts.data))
    body = texts.data
    point = body[heads].astype(np.uint64)
    for k in (1, 2, 3):
        more = np.flatnonzero(ends - heads > k)
        point[more] = (point[more] << np.uint64(8)) | body[heads[more] + k]
    first = np.searchsorted(heads, texts.offsets)
    n = len(point) - CHARACTERS + 1
    if n <= 0:
        return word_buckets, np.concatenate([rows, rows[at]]), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = sum(mix(point[k : k + n] + np.uint64(k << 40)) for k in range(CHARACTERS))
    char_rows = np.repeat(np.arange(texts.n), np.diff(first))[:n]
    inside = np.arange(n) + CHARACTERS <= first[1:][char_rows]
    return word_buckets, np.concatenate([rows, rows[at]]), (mix(total[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64) + BUCKETS, char_rows[inside]


def shares(texts: Texts) -> np.ndarray:
    """For each text the share of each bucket among its word n-grams and among its character n-grams."""
    out = np.zeros((texts.n, 2 * BUCKETS), np.float32)
    word_at, word_rows, char_at, char_rows = _grams(texts)
    for at, rows in ((word_at, word_rows), (char_at, char_rows)):
        found = np.bincount(rows * (2 * BUCKETS) + at, minlength=out.size).reshape(out.shape)
        out += found / np.maximum(np.bincount(rows, minlength=texts.n), 1)[:, None]
    return out


def logits(model: Model, texts: Texts) -> np.ndarray:
    out = np.full(texts.n, model.offset)
    word_at, word_rows, char_at, char_rows = _grams(texts)
    for at, rows in ((word_at, word_rows), (char_at, char_rows)):
        out += SCALE * np.bincount(rows, model.weights[at], texts.n) / np.maximum(np.bincount(rows, minlength=texts.n), 1)
    return out * model.calibration[0] + model.calibration[1]


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counting rules' numbers for each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = texts.data
    heads = (data & 0xC0) != 0x80
    lines = np.zeros(texts.n, np.int64)
    for i, (a, b) in enumerate(zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist())):
        full = [x for x in data[a:b].tobytes().split(b"\n") if x.strip()]
        lines[i] = len(full) - len(set(full))
    rows = texts.row_of_words()
    at, windows = texts.windows(texts.word_hashes(), REPEAT_WINDOW)
    windows = mix(windows ^ mix(rows[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(windows)
    ordered = windows[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    again = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": texts.counts.astype(np.int64),
        "word_chars": texts.sums(texts.inside & heads),
        "n_symbols": texts.sums(_SYMBOL[data]),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(rows, covered, texts.n).astype(np.int64),
    }


def _descend(x: np.ndarray, y: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by accelerated gradient steps of a length that the data's spread allows."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (0.25 * balance.max() * (float(np.linalg.norm(x @ v) ** 2) + len(x)) / len(x) + RIDGE)
    w = z = np.zeros(x.shape[1], np.float32)
    b = c = 0.0
    for k in range(ROUNDS):
        gap = balance * (1 / (1 + np.exp(-np.clip(x @ z + c, -30, 30))) - y) / len(x)
        w_next, b_next = z - step * (x.T @ gap.astype(np.float32) + RIDGE * z), c - step * float(gap.sum())
        pull = k / (k + 3)
        z, c = w_next + pull * (w_next - w), b_next + pull * (b_next - b)
        w, b = w_next, b_next
    return w, b


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, w = np.stack([raw, np.ones_like(raw)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (p - y) + 1e-2 * (w - [1.0, 0.0]))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most max_labelled labelled documents; a fifth of them only calibrates. One class alone gives a model that knows its share."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    some = some.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_labelled)
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id")).select("text", "quality", F.xxhash64("doc_id").alias("place"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                made = shares(Texts(batch.column(0))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in made], pa.binary()), batch.column(1), batch.column(2)], names=["shares", "quality", "place"])

    bound_batches(docs.sparkSession)
    rows = sorted(labelled.mapInArrow(features, "shares binary, quality int, place long").collect(), key=lambda r: r["place"])
    if not rows:
        return Model()
    x = np.stack([np.frombuffer(r["shares"], np.float16) for r in rows]).astype(np.float32) * SCALE
    y = np.array([1.0 if r["quality"] else 0.0 for r in rows])
    good = y.mean()
    if good in (0.0, 1.0):
        return Model(offset=4.0 if good else -4.0)
    test = np.arange(len(y)) % 5 == 0
    if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
        test = np.zeros(len(y), bool)
    balance = np.where(y > 0, 0.5 / good, 0.5 / (1 - good))
    w, b = _descend(x[~test], y[~test], balance[~test])
    model = Model(w.astype(np.float64), b)
    if test.any():
        model.calibration = _calibrate(x[test] @ w + b, y[test])
    return model


def apply_rules(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the counting rules' numbers, base_failed, kept and quality (a probability) for each row of docs (doc_id, text).

    Null and empty texts have no words and fail. Repeated rows are judged alike, each for itself. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column(1))
                found = counts(texts)
                failed = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED_PERCENT * found["n_words"])
                good = 1 / (1 + np.exp(-np.clip(logits(model, texts), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[x]) for x in names], pa.array(failed), pa.array(~failed & (good >= THRESHOLD)), pa.array(good)], names=["doc_id", *names, "base_failed", "kept", "quality"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, quality double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """apply_rules() with a model fitted on labels (doc_id, quality)."""
    return apply_rules(docs, fit(docs, labels))
