"""The command line from files to files, all stages in turn."""

import pytest
from pyspark.sql import functions as F

from unitweave.__main__ import main
from unitweave.sources import files, schemas


def test_stages_from_files_to_files(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    text = "Department of {0}, School of {1}, University of X of the and in"
    raw = [(i, 1, 10 + i, text.format(*pair)) for i, pair in enumerate([("Physics", "Science"), ("Physics", "Science"), ("Law", "Humanities"), ("Law", "Humanities"), ("Physics", "Science")])]
    raw.append((9, 1, 3, "日本 University"))
    files.write_csv(spark.createDataFrame(raw, schemas.COUNTED_STRING), at("strings"), quote_all=True)
    files.write_csv(spark.createDataFrame([(i, 1, "7") for i in range(10)], schemas.INSTITUTION_LIST), at("lists"))
    files.write_csv(spark.createDataFrame([(7, "University of X"), (8, None)], schemas.INSTITUTION_NAME), at("names"))
    files.write_csv(spark.createDataFrame([("dept", "department")], schemas.ABBREVIATION), at("abbr"))
    files.write_csv(spark.createDataFrame([(7,)], schemas.EDUCATION), at("edu"))
    main(["detect-language", "--input", at("strings"), "--output", at("tagged")])
    main(["tag-entities", "--input", at("tagged"), "--output", at("entities"), "--max-rows", "100", "--max-length", "128"])
    main(["attribute", "--ner-jsonl", at("entities"), "--raw-aff-institutions", at("lists"), "--institution-names", at("names"), "--abbr-lookup", at("abbr"), "--detailed-output", at("detailed"), "--dedupe-output", at("dedupe")])
    main(["canonicalise", "--input", at("dedupe"), "--output", at("clusters"), "--borderline-output", at("borderline"), "--institution-id", "7"])
    main(["merge-canonical", "--ner-detailed", at("detailed"), "--clusters", at("clusters"), "--output", at("canonical")])
    main(["build-hierarchy", "--input", at("canonical"), "--institution-names", at("names"), "--output", at("tree")])
    main(["release", "--canonical-dept", at("canonical"), "--hierarchy", at("tree"), "--institution-names", at("names"), "--raw-aff-strings", at("tagged"), "--education-institutions", at("edu"), "--output-dir", at("out")])
    tagged = files.read_csv(spark, at("tagged"), schemas.TAGGED_STRING)
    assert {r["language"] for r in tagged.where("raw_affiliation_string_id < 9").collect()} == {"ENGLISH"} and tagged.where("raw_affiliation_string_id = 9").first()["language"] == "CHINESE"
    assert files.read_entities(spark, at("entities"), schemas.ENTITY_ROW)[0].count() == 5
    tree = {(r["parent_name"], r["child_name"]) for r in files.read_csv(spark, at("tree"), schemas.HIERARCHY).collect()}
    units = {"department of physics", "school of science", "department of law", "school of humanities"}
    assert {c for _, c in tree} == units and len(tree) == 4
    subs = files.read_csv(spark, f"{at('out')}/sub_institutions", "sub_institution_id bigint, institution_id bigint, canonical_name string").collect()
    assert [r["sub_institution_id"] for r in subs] == [1, 2, 3, 4] and {r["canonical_name"] for r in subs} == units
    mappings = files.read_csv(spark, f"{at('out')}/mappings", "raw_affiliation_string_id bigint, institution_id bigint, sub_institution_id bigint, raw_sub_institution_name string")
    assert mappings.count() == 10 and mappings.where(F.col("sub_institution_id").isNull()).count() == 0
    with pytest.raises(ValueError, match="chosen"):
        main(["canonicalise", "--input", at("dedupe"), "--output", at("none"), "--institution-id", "99"])
