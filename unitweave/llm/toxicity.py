"""Toxicity by maximum-scoring segment search.

Words, and word beginnings, get log-odds of toxic against clean documents under a Dirichlet prior that follows their
frequency in both classes together. Only those whose log-odds are surely above zero score; all other words cost a fixed
amount. A linear scan then finds all maximal scoring segments of a document (every passage that no shorter or longer
passage around it beats), and Karlin-Altschul statistics of clean documents tell how much of a segment's score a
document of this length reaches by chance. What lies above that, over all significant segments, is mapped to a
probability by a logistic curve fitted on the same labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import Texts, cut, slices

#: Labelled documents to learn from, at most: those first by a hash of doc_id.
MAX_LABELLED = 20_000
PREFIXES = (5, 6, 7)
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """prior: weight of the Dirichlet prior; least_docs: toxic documents that a feature needs; chance: features whose log-odds
    would lie so many standard deviations above zero by chance, among all that have enough documents, so that more labels
    raise the bar; cost: of a word without a feature. The defaults had the least log loss, summed over sf0.01, sf0.1 and the
    small check table, in folds of the rows that may be learnt from; held-out rows played no part."""

    prior: float = 0.3
    least_docs: int = 4
    chance: float = 0.3
    cost: float = 0.35


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


@dataclass
class Model:
    """features and scores: sorted hashes of words and beginnings, with log-odds; cost: of other words; scale and k:
    Karlin-Altschul; curve: logistic."""

    features: np.ndarray
    scores: np.ndarray
    cost: float = Settings.cost
    scale: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (1.0, 0.0)


def _features(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.arange(len(texts.starts)), texts.word_hashes()), *texts.prefix_hashes(PREFIXES)]


def count_features(labelled: DataFrame) -> DataFrame:
    """feature, toxic, clean: documents with a word or beginning, for labelled (text, toxic). Feature 0 has the class totals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column(0), letters=True)
                label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
                row = texts.row_of_words().astype(np.uint64)
                found, toxic = [], []
                for at, h in _features(texts):
                    order = np.lexsort((row[at], h))
                    h, r = h[order], row[at][order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                    found.append(h[new])
                    toxic.append(label[r[new].astype(np.int64)].astype(np.int64))
                words = len(found[0])
                h, t = np.concatenate(found), np.concatenate(toxic)
                key, at = np.unique(h, return_inverse=True)
                n_toxic, n_all = np.bincount(at, t, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
                total = int(toxic[0].sum())
                key, n_toxic, n_clean = np.append(key.view(np.int64), 0), np.append(n_toxic, total), np.append(n_all - n_toxic, words - total)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n_toxic), pa.array(n_clean)], names=["feature", "toxic", "clean"])

    rows = labelled.select("text", "toxic").mapInArrow(count, "feature long, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Features whose log-odds are surely above zero, sorted by hash, and their log-odds less a standard deviation."""
    counts = cut(counts.where((F.col("feature") == 0) | (F.col("toxic") >= settings.least_docs)), "feature-counts")
    total = counts.where("feature = 0").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return np.zeros(0, np.uint64), np.zeros(0)
    n_t, n_c, prior = float(total["toxic"]), float(total["clean"]), settings.prior
    # The prior gives each class its share of a word's documents, at prior times the class's own weight.
    y_t = F.col("toxic") + (F.col("toxic") + F.col("clean")) * (prior * n_t / (n_t + n_c))
    y_c = F.col("clean") + (F.col("toxic") + F.col("clean")) * (prior * n_c / (n_t + n_c))
    odds = F.log(y_t / (n_t * (1 + prior) - y_t)) - F.log(y_c / (n_c * (1 + prior) - y_c))
    sd = F.sqrt(1.0 / y_t + 1.0 / y_c)
    n = counts.count()
    least = NormalDist().inv_cdf(1 - min(settings.chance / n, 0.5))
    sure = counts.where("feature != 0").select("feature", odds.alias("odds"), sd.alias("sd")).where(F.col("odds") > least * F.col("sd")).select("feature", (F.col("odds") - F.col("sd")).alias("odds"))
    rows = sorted(((r["feature"] % (1 << 64), r["odds"]) for r in sure.collect()))
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])


def word_scores(model: Model, texts: Texts) -> np.ndarray:
    """The log-odds of each word: the greatest among its features', or 0."""
    out = np.zeros(len(texts.starts))
    if len(model.features):
        for at, h in _features(texts):
            place = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
            hit = np.flatnonzero(model.features[place] == h)
            out[at[hit]] = np.maximum(out[at[hit]], model.scores[place[hit]])
    return out


def maximal_segments(places: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) of a row of words, of which only the given ones score above
    zero and every other costs the same. Each word is pushed and merged at most once, so the time is linear."""
    kept: list[list] = []  # [sum before, sum after, first, last, link to the nearest kept one with a smaller sum before]
    total, last = 0.0, -1
    for place, score in zip(places, scores):
        total -= cost * (place - last - 1)
        new = [total, total + score, place, place]
        total, last = total + score, place
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= new[0]:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= new[1]:
                kept.append([*new, j])
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(k[2], k[3], k[1] - k[0]) for k in kept]


def passages(model: Model, texts: Texts) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each row with a scoring word: the row, and its maximal segments as (first word, last word, score)."""
    scores = word_scores(model, texts)
    hits = np.flatnonzero(scores > 0)
    rows = np.searchsorted(texts.first, hits, side="right") - 1
    cuts = np.flatnonzero(np.diff(rows)) + 1
    for part in np.split(np.arange(len(hits)), cuts) if len(hits) else []:
        row = int(rows[part[0]])
        at = hits[part]
        yield row, maximal_segments((at - texts.first[row]).tolist(), scores[at].tolist(), model.cost)


def evidence(model: Model, n_words: int, segments: list[tuple[int, int, float]]) -> float:
    """Nats by which segments exceed what chance gives in so many words, over all that exceed it."""
    chance = np.log(max(model.k * n_words, 1.0))
    return float(sum(max(0.0, model.scale * s - chance) for _, _, s in segments))


def _score_scale(scores: np.ndarray, times: np.ndarray, words: int, cost: float) -> float:
    """The positive root of E[exp(scale * score)] = 1 over words of clean documents, of which some score so many times each."""
    low, high = 1e-6, 50.0
    share = times.sum() / words
    grows = lambda x: float(times @ np.exp(np.minimum(x * scores, 600))) / words + (1 - share) * np.exp(-x * cost) - 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if grows(mid) < 0 else (low, mid)
    return float(low)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _calibrate(labelled: DataFrame, model: Model) -> None:
    """Set scale and k from clean documents. Counts of equal scores reach the driver: as many as there are features, and steps of a thousandth of a segment's score."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column(0), letters=True)
                clean = batch.column(1).to_numpy(zero_copy_only=False) == 0
                scores = word_scores(model, texts)
                hits = scores[(scores > 0) & clean[texts.row_of_words()]]
                found = np.array([s for row, segments in passages(model, texts) if clean[row] for _, _, s in segments])
                kinds, values, times = [0], [0.0], [int(texts.counts[clean].sum())]
                for kind, x in ((1, hits), (2, np.round(found, 3))):
                    value, n = np.unique(x, return_counts=True)
                    kinds, values, times = kinds + [kind] * len(n), values + value.tolist(), times + n.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.float64()), pa.array(times, pa.int64())], names=["kind", "value", "times"])

    rows = labelled.mapInArrow(scan, "kind int, value double, times long").groupBy("kind", "value").agg(F.sum("times").alias("times")).collect()
    words = sum(r["times"] for r in rows if r["kind"] == 0)
    hits = sorted((r["value"], r["times"]) for r in rows if r["kind"] == 1)
    if words and hits:
        scores, times = np.array([x for x, _ in hits]), np.array([n for _, n in hits])
        model.scale = _score_scale(scores, times, words, model.cost)
        level = float(scores[np.searchsorted(np.cumsum(times), times.sum() / 2)])
        above = sum(r["times"] for r in rows if r["kind"] == 2 and r["value"] >= level - 1e-3)
        model.k = max(above, 1) * float(np.exp(model.scale * level)) / words


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, settings: Settings = Settings()) -> Model:
    """Learn from the labelled documents that are not held out, at most max_labelled of them (first by a hash of doc_id).

    Their texts are written once and counted, then scanned for calibration and for the curve, for which one number of each
    reaches the driver. Labels that are null, or of a null doc_id, are no labels; of several for an id the largest counts.
    """
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = some.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_labelled)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labelled = cut(texts.join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id")).select("text", "toxic"), "labelled")
    model = Model(*log_odds(count_features(labelled), settings), settings.cost)
    _calibrate(labelled, model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                nats, _, _ = _evidence_of(model, Texts(batch.column(0), letters=True))
                yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(nats)], names=["toxic", "nats"])

    rows = labelled.mapInArrow(scan, "toxic int, nats double").collect()
    if rows:
        model.curve = _logistic(np.log1p([r["nats"] for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    return model


def _evidence_of(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: nats of evidence, significant passages, and words in them."""
    nats, count, covered = np.zeros(texts.n), np.zeros(texts.n, np.int64), np.zeros(texts.n, np.int64)
    for row, segments in passages(model, texts):
        chance = np.log(max(model.k * texts.counts[row], 1.0))
        sure = [(a, b) for a, b, s in segments if model.scale * s > chance]
        nats[row], count[row], covered[row] = evidence(model, int(texts.counts[row]), segments), len(sure), sum(b - a + 1 for a, b in sure)
    return nats, count, covered


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), n_passages, passage_words for docs (doc_id, text): one row each, whole texts.

    Null and empty texts have no passages and get the curve's value for none. Repeated rows get the same score each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column(1), letters=True)
                nats, count, covered = _evidence_of(model, texts)
                value = 1 / (1 + np.exp(-np.clip(model.curve[0] * np.log1p(nats) + model.curve[1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array(count), pa.array(covered)], names=["doc_id", "score", "n_passages", "passage_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, score double, n_passages long, passage_words long")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns and in one pass.

    Null and empty texts stay, unless the curve holds a text without evidence for toxic; repeated rows share their fate.
    """
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                nats, _, _ = _evidence_of(model, Texts(batch.column(at), letters=True))
                keep = model.curve[0] * np.log1p(nats) + model.curve[1] < 0
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passage_words for each row of docs (doc_id, text); labels has doc_id, toxic.

    Without labels of both classes nothing scores above the curve's value for no evidence. A null doc_id is not held out.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passage_words")
