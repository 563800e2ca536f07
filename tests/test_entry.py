import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from unitweave.plans import queries as plans

SF = "/root/testdata/sf0.001"
QUICK = ["raw_string_counts", "ordered_distinct_list", "lang_tag", "clean_department", "core_variants", "person_prefix_strip", "suffix_variants", "cluster_json", "cooccur_pairs", "edge_scores", "segment_split", "merge_touching_runs", "bio_decode", "nearest_right", "release_hierarchy", "parent_forest", "hierarchy_build", "fuzzy_match", "csv_round_trip", "csv_pruned_typed", "jsonl_entities", "jsonl_broken_lines", "first_rows", "softmax_scores", "chosen_institutions", "normalised_sums", "sorted_export", "borderline_pairs", "clean_department_texts"]


def rows(frame):
    def told(x):
        if pd.isna(x):
            return None
        return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(told(x) for x in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(plans.QUERIES) >= 50 and set(plans.SQL) <= set(plans.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def equal_to_sql(spark, name):
    """The query's rows, held against its SQL."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    return got


def test_whole_texts_are_folded(spark):
    got = equal_to_sql(spark, "fold_name")
    assert got["folded"].str.len().max() > 1000


def test_lexical_signals_between_ranks(spark):
    got = equal_to_sql(spark, "lexical_signals")
    names = set(got["parent"])
    assert len(got) == len(names) * (len(names) - 1)
    assert got["bonus"].min() < 0 < got["bonus"].max() and (got.where(got["parent_rank"] > 0)["penalty"] < 0).any()


def test_spans_are_whole_turns(spark):
    got = equal_to_sql(spark, "span_topk")
    turns = {t.strip(" ") for t in spark.read.parquet(f"{SF}/conversations.parquet").toPandas()["text"].dropna()}
    assert len(got) and set(got["word"]) <= turns and got["word"].str.len().max() > 20


def test_all_pairs_of_odd_vectors(spark, tmp_path):
    from unitweave.operators import canonical

    some = [[0.0, 0.0, 0.0], None, [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [3e38, 3e38, 1.0], [1e-45, 0.0, 0.0], [1.0, -1.0, 0.0]]
    some += [[float(i % 7 - 3), float(i % 5), float(i % 3 - 1)] for i in range(60)]
    data = [(k, i, label, v) for label in (1, 2, None) for k, (i, v) in enumerate([(i // 2 if i > 40 else i, v) for i, v in enumerate(some)])]
    frame = spark.createDataFrame([(None if k == 9 else i, label, v) for k, i, label, v in data], "vec_id long, label int, embedding array<float>")
    frame.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(plans.SQL["cosine_pairs"]).fetchall()
    for block in (7, 2048):
        got = canonical.cosine_pairs(plans.vectors(spark, str(tmp_path)), block) if block == 7 else plans.QUERIES["cosine_pairs"](spark, str(tmp_path))
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert canonical.cosine_pairs(plans.vectors(spark, str(tmp_path)).limit(0)).count() == 0
