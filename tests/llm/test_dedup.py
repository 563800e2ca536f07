"""Exact, substring and near dedup against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from unitweave.llm import common, exact_dedup, near_dedup, substring_dedup
from unitweave.llm.common import span_hash, window_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    best = {b: min(g)[3] for b, g in groups.items()}
    return sorted((repr(i), repr(best[b := re.sub(r"[\x20\x09-\x0D]", "", t or "")]), len(groups[b]), i == best[b], hashlib.sha256(b.encode()).hexdigest()) for i, t in rows)


def told(df):
    return sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_exact(hard_docs, hard_rows, no_docs):
    assert told(exact_dedup.exact_groups(hard_docs)) == exact([(i, t) for i, t, _ in hard_rows])
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_exact_compares_content(hard_docs, hard_rows):
    """A digest that many texts share must not merge them."""
    weak = lambda c: (F.length(c) % 2).cast("string")
    assert told(exact_dedup.exact_groups(hard_docs, digest=weak, salts=2)) == exact([(i, t) for i, t, _ in hard_rows])


def test_exact_keeps_whole_rows(hard_docs):
    kept = exact_dedup.keep_first(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id in (4, 5, 6)").collect()) == [6]


def test_exact_drops_only_the_copies(spark):
    """What shares a dropped copy's doc_id, or like it has none, stays when its text is another."""
    rows = [(1, "one text"), (None, "one text"), (None, "only here"), (None, None), (2, "two texts"), (3, "two texts"), (3, "three")]
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(1, "one text"), (None, "only here"), (None, None), (2, "two texts"), (3, "three")]))


def test_exact_keeps_one_of_rows_that_share_all(spark, hard_docs, hard_rows, no_docs):
    rows = [(3, "a b"), (3, "a b"), (3, "ab"), (3, "c"), (None, "x"), (None, "x"), (4, "a  b"), (5, "c")]
    kept = exact_dedup.keep_first(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, place_0 int").repartition(3)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, [(4, "a  b"), (3, "c"), (None, "x")]))
    best = {}
    for i, t, _ in hard_rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[body] = min(best.get(body, (1, True, 0, "")), (-len(t or ""), i is None, i or 0, t or ""))
    kept = exact_dedup.keep_first(hard_docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted((i, t) for _, _, i, t in best.values())
    assert exact_dedup.keep_first(no_docs).count() == 0


def removed(rows, n):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for i, t in order:
        w = WORD.findall(t or "")
        gone = {x for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] != i for x in range(k, k + n)}
        out.append((repr(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def stripped(df):
    return sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("window, first", [(13, 7), (5, 2), (3, 3)])
def test_substrings(spark, hard_docs, hard_rows, window, first, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD_WINDOWS", 50)
    assert stripped(substring_dedup.remove_repeats(hard_docs, window, first)) == removed([(i, t) for i, t, _ in hard_rows], window)


def test_substrings_of_shared_passages(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{rng.randrange(50)}" for _ in range(rng.randrange(30))] + passage[rng.randrange(8) :] + [f"b{rng.randrange(9)}" for _ in range(20)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert stripped(substring_dedup.remove_repeats(docs)) == removed(rows, 13)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_all_ask():
    """Rows of one task that share the least doc_id (null, or repeated) but not the text each ask about their window; copies ask once."""
    for key in (substring_dedup._NULL, 7):
        keys = np.array([[key, 11], [key, 12], [key, 12], [9 if key == 7 else key, 13]])
        same = np.full(4, 5, np.uint64)
        rows = substring_dedup._long_blocks(keys, np.arange(4), same, same, np.arange(4), 1)
        asking = [tuple(np.frombuffer(r[2], "<i8").reshape(-1, 2)[k]) for r in rows if r[1] == substring_dedup._WAITING for k in np.frombuffer(r[3], "<u2")]
        assert sorted(asking) == sorted({(key, 11), (key, 12)} | ({(key, 13)} if key != 7 else set()))


def opposite_words(size=1024):
    """Two words of equal length whose letters a and b are swapped, so ordered that sums of powers of any odd base agree modulo 2 ** 64."""
    x, y = "a", "b"
    while len(x) < size:
        x, y = x + y, y + x
    return x, y


def test_words_that_sums_of_powers_confuse(spark):
    x, y = opposite_words()
    rows = [(1, " ".join([f"w{i}" for i in range(12)] + [x])), (2, " ".join([f"w{i}" for i in range(12)] + [y])), (3, " ".join([x] * 3)), (4, " ".join([y] * 3)), (5, x), (6, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert stripped(substring_dedup.remove_repeats(docs)) == removed(rows, 13)
    assert grouped(near_dedup.near_groups(docs)) == near(rows)


def test_hashes_tell_spans_apart():
    """All spans of a text differ in hash exactly where they differ in bytes, in both lanes, below and above the length of long words."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = rng.integers(0, 300, 3000)
    ends = starts + rng.integers(0, 100, 3000)
    spans = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    for lane in (0, 1):
        hashes = span_hash(data, starts, ends, lane).tolist()
        assert len(set(hashes)) == len(set(spans)) == len(set(zip(spans, hashes)))
    for n in (1, 2, 5, 7, 13):
        few = rng.integers(0, 2, 300).astype(np.uint64)
        found = window_hash(few, n).tolist()
        runs = [tuple(few[i : i + n].tolist()) for i in range(301 - n)]
        assert len(found) == len(runs) and len(set(found)) == len(set(runs)) == len(set(zip(runs, found)))


def test_rows_that_share_an_id_over_tasks(spark, monkeypatch):
    """Twelve rows with one id and different texts hold a passage of a smaller id: all lose it, whichever tasks hold them."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), *[(5, f"own{i} text{i} {passage} end{i}") for i in range(12)], *[(None, f"none{i} {passage}") for i in range(3)]]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert stripped(substring_dedup.remove_repeats(docs)) == removed(rows, 13)


def test_more_documents_than_16_bits_name():
    keys = np.stack([np.arange(70_000), np.arange(70_000)], axis=1)
    with pytest.raises(OverflowError):
        substring_dedup._docs_blob(keys, np.arange(70_000))
    assert substring_dedup.HELD_DOCS + common.SLICE_ROWS <= 1 << 16
    batch = pa.record_batch([pa.array(["x"] * 40_000)], names=["text"])
    assert [len(x) for x in common.slices(batch)] == [1 << 14, 1 << 14, 40_000 - (1 << 15)]


def test_many_short_documents(spark):
    """One task holds more documents than one batch may name."""
    words = " ".join(f"w{i}" for i in range(13))
    rows = [(i, f"{words} {i % 5}" if i % 2 else f"short {i}") for i in range(70_000)]
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).coalesce(1)
    out = substring_dedup.remove_repeats(docs).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(2, 0, 35_000), (14, 0, 1), (14, 13, 4), (14, 14, 34_995)]


def near(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(i, set()).update([tuple(w)] if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"f{seed}_{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def grouped(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_families(spark, monkeypatch):
    """Groups whose members are partly linked only through others, compared in blocks of a few members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup.compare_blocks, "__defaults__", (4,))
    texts = family(1, 30, 200, 8) + family(2, 10, 120, 4) + family(3, 5, 40, 2) + ["A b", "a  B", "lone text of five words", ""]
    rows = list(enumerate(texts))
    assert grouped(near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == near(rows)


def test_near_hard(hard_docs, hard_rows, no_docs):
    out = near_dedup.near_groups(hard_docs).collect()
    assert len(out) == len(hard_rows)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[5]["component_id"] == 4 and by_id[6]["component_id"] == 4 and by_id[8]["component_id"] == 7
    assert by_id[1]["n_shingles"] == 0 and by_id[2]["component_id"] == 2 and by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert near_dedup.near_groups(no_docs).count() == 0
    assert near_dedup.keep_one(hard_docs).columns == hard_docs.columns


def test_keep_one_links_from_080(spark):
    """The pipeline's stage drops copies whose similarity lies from 0.80 up to 0.85; the query does not link them."""
    base = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:50] + ["x"] + base[51:75] + ["y"] + base[76:])), (3, " ".join(base[:20] + ["u"] + base[21:45] + ["v"] + base[46:70] + ["z"] + base[71:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[2] for r in near(rows, 80)] == [1, 1, 3] and [r[2] for r in near(rows, 85)] == [1, 2, 3]
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == [1, 3]
    assert grouped(near_dedup.near_groups(docs)) == near(rows)


def test_keep_one_by_rows(spark, no_docs):
    """Rows that share an id or have none are judged by their own texts."""
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(7, " ".join(base)), (7, " ".join(other)), (8, " ".join(base[:59] + ["x"])), (None, " ".join(base[:59] + ["y"])), (None, "alone in the world of texts"), (9, ""), (None, None), (7, " ".join(other))]
    kept = [(r["doc_id"], (r["text"] or "")[:2]) for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(7, "w0"), (7, "v0"), (None, "al"), (9, ""), (None, "")]))
    assert near_dedup.keep_one(no_docs).count() == 0
