"""The registered queries against their SQL, and the pipeline against its stages."""

import collections
import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from unitweave.llm import mixing, queries
from unitweave.llm.common import cut


def rows(frame):
    told = lambda x: None if pd.isna(x) else (round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
    return sorted((tuple(told(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_exact(docs):
    best = {}
    for r in docs:
        body = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[body] = min(best.get(body, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    return sorted(i for _, i in best.values())


def brute_near(docs):
    sets = {}
    for r in docs:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    seen, links = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            seen.setdefault(g, []).append(i)

    def root(i):
        while links[i] != i:
            i = links[i]
        return i

    for a, b in {(a, b) for some in seen.values() for a in some for b in some if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            links[max(x, y)] = min(x, y)
    return sorted(i for i in sets if root(i) == i)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage over what its predecessor kept, on the whole table, against plain Python."""
    import sentencepiece

    sf = "/root/testdata/sf0.01"
    sf_docs = spark.read.parquet(f"{sf}/documents.parquet")

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    scores = {r["doc_id"]: r["predicted"] for r in queries.op1_toxicity(spark, sf).collect()}
    docs, kept = sf_docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == sf_docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        ids = sorted(r["doc_id"] for r in rows)
        kept.append(len(ids))
        if name == "toxicity":
            assert ids == sorted(r["doc_id"] for r in before if not scores[r["doc_id"]])
        elif name == "exact dedup":
            assert ids == brute_exact(before)
        elif name == "near dedup":
            assert ids == brute_near(before)
        elif name == "source mixing":
            mixed = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(before, sf_docs.schema)).collect()}
            own = collections.Counter(ids)
            assert all(own[i] * r["size"] == r["taken"] for i, r in mixed.items()) and set(own) <= set(mixed)
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
        else:
            assert sorted((r["doc_id"], model.decode(r["ids"])) for r in rows) == sorted((r["doc_id"], r["text"] or "") for r in before)
            assert all(r["round_trip"] for r in rows)
    assert sf_docs.count() > kept[0] > kept[1] >= kept[2] and kept[3] == kept[4] > 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == ids


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_registered_queries_cover_their_tables(spark, sf, sf_docs, name):
    """Those without SQL: one row for each document, with the columns of their contract."""
    columns = {
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_sentencepiece": ["doc_id", "ids", "n_pieces", "round_trip"],
        "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op8_token_binary": ["doc_id", "start", "n_tokens", "ids_crc32"],
    }[name]
    out = queries.queries()[name](spark, sf)
    assert out.columns[: len(columns)] == columns
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in sf_docs.select("doc_id").collect())


def test_stages_on_hard_rows_and_empty_tables(spark, sf, hard_docs, hard_rows, no_docs):
    """Nulls, repeats, long texts and clashing extra columns go through every stage; an empty table gives empty results."""
    for docs, start in ((hard_docs, len(hard_rows)), (no_docs, 0)):
        counts = [start]
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            assert out.columns == (hard_docs.columns if k < 4 else ["doc_id", "ids", "n_pieces", "round_trip"]), name
            docs = cut(out, "test")
            counts.append(docs.count())
        assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5]
        assert (counts[5] > 0) == (start > 0)
