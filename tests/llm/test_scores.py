"""Toxicity and quality: kernels against brute force, classifiers by held-out accuracy."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from unitweave.llm import quality_rules, toxicity
from unitweave.llm.common import Texts


def brute_segments(scores):
    """All maximal scoring segments: the best one, then those left and right of it."""
    best = max(((sum(scores[i : j + 1]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i, len(scores))), default=None)
    if best is None or best[0] <= 1e-9:
        return []
    _, _, _, i, j = best
    return [(a, b) for a, b in brute_segments(scores[:i])] + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in brute_segments(scores[j + 1 :])]


def test_segments_are_maximal():
    rng = random.Random(2)
    for _ in range(150):
        scores = [rng.choice([rng.random() * 3, -0.35, -0.35, -0.35]) for _ in range(rng.randrange(1, 25))]
        at = [i for i, s in enumerate(scores) if s > 0]
        found = toxicity.maximal_segments(at, [scores[i] for i in at], 0.35)
        assert [(a, b) for a, b, _ in found] == brute_segments(scores)
        assert all(abs(s - sum(scores[a : b + 1])) < 1e-9 for a, b, s in found)


def test_letters_and_prefixes():
    texts = Texts(pa.array(["ÉTÉ, idiot### x", None, "", "IDIOT"]), letters=True)
    words = texts.word_hashes()
    assert texts.counts.tolist() == [3, 0, 0, 1] and words[1] == words[3]
    assert [len(at) for at, _ in texts.prefix_hashes((2, 4))] == [3, 2]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.avg((F.col("toxic") == 0).cast("double"))).first()
    assert right[0] > 0.97 > right[1]


def test_toxicity_hard_rows(spark, hard_docs, hard_rows, no_docs):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(hard_docs, labels).collect()
    assert len(out) == len(hard_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert toxicity.score_toxicity(no_docs, labels.limit(0)).count() == 0
    assert toxicity.keep_clean(hard_docs, labels.limit(0)).columns == hard_docs.columns


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counting_rules(spark, sf_docs, hard_docs, hard_rows, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in sf_docs.collect() if len(r["text"] or "") < 9000]
    found = quality_rules.counts(Texts(pa.array([t for _, t in rows])))
    assert [tuple(int(found[k][i]) for k in found) for i in range(len(rows))] == [brute_counts(t) for _, t in rows]
    out = quality_rules.apply_rules(hard_docs, quality_rules.Model()).collect()
    assert len(out) == len(hard_rows) and not any(r["kept"] for r in out if r["n_words"] < 10)
    assert quality_rules.judge_quality(no_docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_logits_are_linear_in_shares():
    rng = np.random.default_rng(1)
    model = quality_rules.Model(rng.normal(size=2 * quality_rules.BUCKETS), 0.3, (1.5, -0.2))
    texts = Texts(pa.array(["é a bc d", "", "x", None, "many words in this one and more"]))
    want = (quality_rules.shares(texts) @ model.weights * quality_rules.SCALE + 0.3) * 1.5 - 0.2
    assert np.allclose(quality_rules.logits(model, texts), want, atol=1e-4)


def test_quality_is_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    wanted = labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("label"))
    out = quality_rules.judge_quality(docs, labels.where("doc_id % 2 = 0")).join(wanted, "doc_id").where("not base_failed")
    assert out.agg(F.avg((F.col("kept").cast("int") == F.col("label")).cast("double"))).first()[0] > 0.9
