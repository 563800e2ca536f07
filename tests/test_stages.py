import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitweave.__main__ import main
from unitweave.functions import kernels, numeric, providers, text
from unitweave.operators import canonical, entities, hierarchy, release
from unitweave.plans.config import Config
from unitweave.plans.pipeline import Pipeline
from unitweave.sources import files, schemas
from unitweave.streaming import strings as streams

E_ = "entity_group string, word string, start int, end int"


def test_segments(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 10, 5, None, 7])], "k int, i int, start int")
    out = entities.with_segments(rows, ["k"], ["i"]).orderBy("i").collect()
    assert [(r["segment"], r["place"]) for r in out] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


def test_quota(spark):
    df = spark.createDataFrame([(None,), ("0",), ("3",), ("x",)], "c string")
    assert [r[0] for r in df.select(entities.span_quota(F.col("c"))).collect()] == [1, 1, 3, 1]


def test_decode_and_merge(spark):
    tokens = [("B-SUB", 0.5, 0, 3, 1), ("I-SUB", 1.0, 3, 5, 1), ("I-SUB", 1.0, 5, 5, 1), ("ORG", 0.8, 5, 7, 1), ("O", 1.0, 7, 8, 1), ("I-ORG", 0.6, 8, 99, 1), ("B-SUB", 0.9, 0, 2, 0), ("B-SUB", 0.9, 0, 2, 1)]
    df = spark.createDataFrame([(tokens, "abcdefghij")], "t array<struct<label:string,score:double,start:int,end:int,mask:int>>, x string")
    found = df.select(entities.decode_tags(F.col("t"), F.col("x")).alias("e")).first()["e"]
    assert [(e["entity_group"], e["word"], round(e["score"], 6)) for e in found] == [("SUB", "abcde", 0.75), ("ORG", "fg", 0.8), ("ORG", "ij", 0.6)]
    rows = [("A", 0, 2, "ab", 1.0), ("A", 2, 3, "c", 0.5), ("A", 3, 4, "d", 0.25), ("B", 4, 5, "e", 1.0)]
    merged = spark.createDataFrame([(rows,)], f"e {entities.ENTITIES}").select(entities.merge_touching(F.col("e")).alias("e")).first()["e"]
    assert [tuple(e) for e in merged] == [("A", 0, 4, "abcd", 0.5), ("B", 4, 5, "e", 1.0)]


def test_attribution(spark):
    found = [("SUB", "Department of Physics", 0, 20), ("ORG", "University of X", 22, 37), ("SUB", "School of Art", 40, 53), ("SUB", "School of Law", 0, 13), ("SUB", "University of X", 20, 30), ("ORG", "Other University", 90, 99)]
    ner = spark.createDataFrame([(1, None, found), (2, 5, found), (None, 1, found), (3, 1, [])], f"raw_affiliation_string_id long, frequency long, entities array<struct<{E_.replace(' string', ':string').replace(' int', ':int')}>>")
    lists = spark.createDataFrame([(1, "7;8"), (3, "7")], "raw_affiliation_string_id long, institution_ids_str string")
    named = spark.createDataFrame([(7, "University of X"), (8, "Other University"), (9, None)], "institution_id long, institution_name string")
    abbr = spark.createDataFrame([("dept x", "department x")], schemas.ABBREVIATION)
    out = {r["raw_dept_str"]: r for r in entities.attribute(ner, lists, named, abbr).collect()}
    assert set(out) == {"Department of Physics", "School of Art", "School of Law"}
    assert out["Department of Physics"]["institution_ids"] == [7] and out["Department of Physics"]["inst_count"] == 1
    assert out["School of Art"]["institution_ids"] == [7, 8] and out["School of Art"]["inst_count"] == 2
    assert out["School of Law"]["institution_ids"] == [8] and out["School of Law"]["frequency"] == 1


def test_rule_stages(spark):
    rows = spark.createDataFrame([(1, "jane doe school of art", "2"), (1, "school of art", "90"), (1, "x", "bad"), (2, "school of art", "1"), (1, " ", "3")], "institution_id long, clean_dept_str string, frequency string")
    loaded = canonical.load_names(rows)
    assert loaded.count() == 3
    out = canonical.strip_person_prefixes(loaded).where("institution_id = 1").select("name").distinct().collect()
    assert [r["name"] for r in out] == ["school of art"]
    cores = spark.createDataFrame([(1, "physics department", 150), (1, "department of physics", 60), (2, "physics department", 9)], "institution_id long, clean_dept_str string, frequency long")
    out = canonical.unify_core_variants(canonical.load_names(cores)).orderBy("institution_id", "clean_dept_str").collect()
    assert [r["name"] for r in out] == ["physics department"] * 3
    variants = spark.createDataFrame([(1, "smith school of art", 400), (1, "jones school of art", 200), (1, "school of art", 1)], "institution_id long, clean_dept_str string, frequency long")
    assert {r["name"] for r in canonical.unify_suffix_variants(canonical.load_names(variants)).collect()} == {"smith school of art"}


def test_clusters(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [1.0, 0.01]), (1, "c", [0.0, 1.0]), (2, "a", [1.0, 0.0])], "institution_id long, name string, embedding array<float>")
    assert {(r[0], r[1], r[2]) for r in canonical.cluster_records(rows).collect()} == {(1, "a", "a"), (1, "b", "a"), (1, "c", "c"), (2, "a", "a")}


def test_clusters_of_many_names(spark):
    """An institution of many blocks is clustered as one of a single block."""
    rng = np.random.default_rng(8)
    rows = [(i, f"n{k:03d}", [float(x) for x in rng.normal(size=3)]) for i, n in ((1, 90), (2, 5), (3, 31)) for k in range(n)]
    vectors = spark.createDataFrame(rows, "institution_id long, name string, embedding array<float>")
    for linkage in ("average", "complete"):
        whole = {tuple(r) for r in canonical.cluster_records(vectors, 0.05, linkage).collect()}
        assert whole == {tuple(r) for r in canonical.cluster_records(vectors, 0.05, linkage, block=12).collect()}
        assert len(whole) == len(rows) > len({(r[0], r[2]) for r in whole})
    labels = vectors.select("institution_id", "name", F.right("name", F.lit(1)).alias("cluster"))
    found = {tuple(r) for r in canonical.borderline_pairs(vectors, labels, 0.05, 0.05).collect()}
    assert found and found == {tuple(r) for r in canonical.borderline_pairs(vectors, labels, 0.05, 0.05, block=12).collect()}
    unit = {(i, n): np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, n, v in rows}
    brute = {(i, m, n) for (i, m), x in unit.items() for (j, n), y in unit.items() if i == j and m < n and m[-1] != n[-1] and 0.9 <= x @ y < 0.95}
    assert {r[:3] for r in found} == brute
    assert canonical.borderline_pairs(vectors, labels, 0.05, 0.0).count() == 0


def test_top_coverage(spark):
    rows = spark.createDataFrame([(1, n, f) for n, f in (("a", 60), ("b", 30), ("c", 6), ("d", 4))] + [(2, "z", 0)], "institution_id long, canonical_dept_name string, frequency long")
    assert sorted(r[1] for r in hierarchy.top_coverage(rows).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        Config(top_coverage=1.5)


def test_hierarchy_and_release(spark):
    rows = [(1, raw, name, start, 1, name.upper()) for raw in range(6) for name, start in (("department of a", 0), ("faculty of b", 20))] + [(1, 9, "office c", 0, 1, "C"), (2, 9, "office c", 0, 1, "C")]
    rows = spark.createDataFrame(rows, "institution_id long, raw_affiliation_id long, canonical_dept_name string, start int, frequency long, raw_dept_str string")
    named = spark.createDataFrame([(1, "Uni One"), (2, None)], schemas.INSTITUTION_NAME)
    tree = hierarchy.check_one_parent(hierarchy.build(rows, named, Config(top_coverage=1.0)))
    got = {(r["institution_id"], r["parent_name"], r["child_name"]) for r in tree.collect()}
    assert (1, "faculty of b", "department of a") in got and (1, "uni one", "office c") in got and (2, None, "office c") in got
    strings = spark.createDataFrame([(i, f"s{i}") for i in range(10)], schemas.RAW_STRING)
    tables = release.check_release(release.release(rows, tree, named, spark.createDataFrame([(1,)], schemas.EDUCATION), strings))
    subs = {r["canonical_name"]: r["sub_institution_id"] for r in tables["sub_institutions"].collect()}
    assert sorted(subs.values()) == [1, 2, 3]
    links = {(r["parent_sub_institution_id"], r["child_sub_institution_id"]) for r in tables["hierarchy"].collect()}
    assert (subs["faculty of b"], subs["department of a"]) in links and (None, subs["office c"]) in links
    with pytest.raises(ValueError):
        release.check_release(release.release(rows, tree, named, spark.createDataFrame([(1,)], schemas.EDUCATION), strings.limit(0)))


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'NA "x", y'), (2, None), (3, "null")], schemas.INSTITUTION_NAME)
    files.write_csv(rows, str(tmp_path / "c"), quote_all=False, one_file=True)
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), schemas.INSTITUTION_NAME).collect()} == {tuple(r) for r in rows.collect()}
    (tmp_path / "e.jsonl").write_text('{"raw_affiliation_string_id": 1, "entities": [{"entity_group": "SUB", "word": "é", "start": 0, "end": 1}]}\nbroken\n{"entities": []}\n')
    good, broken = files.read_entities(spark, str(tmp_path / "e.jsonl"), schemas.ENTITY_ROW)
    assert [(r["raw_affiliation_string_id"], r["frequency"]) for r in good.collect()] == [(1, 1)]
    assert tuple(broken.first()) == (1, 3, 1)
    files.write_entities(good.drop("frequency"), str(tmp_path / "j"))
    assert "é" in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00", "Department of Physics"), ("2024-01-01 11:00:00", "nothing")], "seen_at string, raw_dept_str string").withColumn("seen_at", F.col("seen_at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seen_at timestamp, raw_dept_str string").parquet(str(tmp_path / "in"))
    job = streams.count_names(source).writeStream.outputMode("complete").format("memory").queryName("named").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert [(r["clean_dept_str"], r["frequency"]) for r in spark.table("named").collect()] == [("department of physics", 1)]


def test_token_model(spark):
    """A model that each worker loads once: its logits become scores, labels and entities."""

    def load():
        def model(texts):
            logits = {"D": [4.0, 0.0, 0.0], "o": [0.0, 4.0, 0.0], "X": [0.0, 0.0, 4.0]}
            return [[(i, i + 1, 1, logits.get(c, [0.0, 4.0, 0.0])) for i, c in enumerate(t)] for t in texts]

        return model

    rows = spark.createDataFrame([(1, "DooX"), (2, ""), (3, None)], "id long, text string")
    out = {r["id"]: r["entities"] for r in providers.TokenModelTagger(load, ("B-SUB", "I-SUB", "O")).entities(rows).collect()}
    share = math.exp(4) / (math.exp(4) + 2)
    assert [(e["entity_group"], e["word"], round(e["score"], 9)) for e in out[1]] == [("SUB", "Doo", round(share, 9))] and out[2] == out[3] == []
    assert providers.TokenModelTagger(load, ("B-SUB", "I-SUB", "O")).spans(rows).columns == ["id", "text", "spans"]
    some = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],)], "x array<double>").select(numeric.softmax_best(F.col("x")).alias("b")).collect()
    assert some[0]["b"]["index"] == 1 and some[1]["b"] is None


def test_embeddings(spark):
    out = {r["name"]: r["embedding"] for r in providers.HashEmbedder(64).embed(spark.createDataFrame([("school of art",), ("schools of art",), ("law",), ("",)], "name string")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(out[a], out[b]))
    assert all(abs(dot(n, n) - 1) < 1e-5 for n in out) and dot("school of art", "schools of art") > dot("school of art", "law")


def test_model_embedder(spark):
    """The model is loaded in the worker, sees few names at a time, and its vectors come out at length 1."""

    def load():
        def model(names):
            assert len(names) <= 2
            return [[len(n), 0.0, 3.0 if n else 0.0] for n in names]

        return model

    out = {r["name"]: r["embedding"] for r in providers.ModelEmbedder(load, 2).embed(spark.createDataFrame([("four",), ("four",), ("",), ("ab",), ("abcdef",)], "name string")).collect()}
    assert [round(x, 5) for x in out["four"]] == [0.8, 0.0, 0.6] and out[""] == [0.0, 0.0, 0.0] and len(out) == 4


def test_guards(spark):
    names = spark.createDataFrame([(1, "school of art", 5)], "institution_id long, clean_dept_str string, frequency long")
    with pytest.raises(ValueError, match="chosen"):
        canonical.check_names(canonical.load_names(names, Config(institution_ids=(9,))), Config(institution_ids=(9,)))
    with pytest.raises(ValueError, match="left"):
        canonical.check_names(canonical.load_names(names.limit(0)))
    twice = spark.createDataFrame([(1, "a"), (1, "b")], schemas.INSTITUTION_NAME)
    with pytest.raises(ValueError, match="twice"):
        release.check_unique(twice, ["institution_id"], "institution")
    with pytest.raises(ValueError, match="twice"):
        Pipeline().run({"institution": twice})
    with pytest.raises(ValueError, match="parent"):
        hierarchy.check_one_parent(spark.createDataFrame([(1, "u", "a", "x"), (1, "u", "b", "x")], schemas.HIERARCHY))
    with pytest.raises(ValueError, match="missing"):
        entities.require_columns(names, ("nothing",))
    with pytest.raises(ValueError, match="names no institution"):
        main(["canonicalise", "--input", "x", "--output", "y", "--institution-id", " , "])


def test_first_words(spark):
    out = spark.createDataFrame([("a b  c d",), ("  a",), (None,), ("",)], "t string").select(text.first_words(F.col("t"), 2)).collect()
    assert [r[0] and r[0].split() for r in out] == [["a", "b"], ["a"], None, ""]


def test_links_of_near_rows():
    """Components by falling labels equal those of a search, over several blocks."""
    rng = np.random.default_rng(4)
    for n in (1, 7, 60):
        x = rng.normal(size=(n, 3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found = kernels._parts(x, 0.02, 8)
        near = 1.0 - x @ x.T < 0.02
        reach = np.linalg.matrix_power((near | near.T | np.eye(n, dtype=bool)).astype(float), n) > 0
        assert found.tolist() == [int(np.flatnonzero(r)[0]) for r in reach]
