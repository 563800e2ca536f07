"""Command line: each stage from files to files. python -m unitweave STAGE --help shows a stage's options."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.functions import text as T
from unitweave.operators import canonical, entities, hierarchy, release
from unitweave.plans.config import Config
from unitweave.plans.pipeline import Pipeline
from unitweave.sources import files, schemas


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="unitweave", description=__doc__)
    stages = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, *paths: str, **options) -> None:
        p = stages.add_parser(name)
        for path in paths:
            p.add_argument("--" + path, required=not path.startswith("borderline"))
        for option, (kind, default) in options.items():
            p.add_argument("--" + option.replace("_", "-"), type=kind, default=default)
        if name == "canonicalise":
            p.add_argument("--institution-id", action="append", default=[])
            p.add_argument("--output-style", choices=["compact", "detailed"], default="compact")
            p.add_argument("--linkage", choices=["average", "complete"], default="average")

    c = Config()
    stage("detect-language", "input", "output")
    stage("tag-entities", "input", "output", max_rows=(int, None), max_length=(int, c.max_tokens))
    stage("attribute", "ner-jsonl", "raw-aff-institutions", "institution-names", "abbr-lookup", "detailed-output", "dedupe-output")
    stage(
        "canonicalise", "input", "output", "borderline-output", min_frequency=(int, 1), limit_institutions=(int, None), min_suffix_freq_in_inst=(int, 3), max_prefixed_ratio=(float, 0.25), max_full_freq=(int, 5),
        min_suffix_variant_freq=(int, 500), min_prefix_variants=(int, 2), min_core_group_freq=(int, 200), distance_threshold=(float, 0.15), borderline_margin=(float, 0.05),
    )
    stage("merge-canonical", "ner-detailed", "clusters", "output")
    stage("build-hierarchy", "input", "institution-names", "output", top_coverage=(float, 0.95))
    stage("release", "canonical-dept", "hierarchy", "institution-names", "raw-aff-strings", "education-institutions", "output-dir")
    return top


def _detailed(spark: SparkSession, path: str) -> DataFrame:
    return files.read_csv(spark, path, schemas.ATTRIBUTED).withColumn("institution_ids", T.split_ids(F.col("institution_ids")))


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("unitweave").getOrCreate()
    read = lambda path, schema: files.read_csv(spark, path, schema)
    if a.stage == "detect-language":
        files.write_csv(Pipeline().detect_language(read(a.input, schemas.COUNTED_STRING)), a.output)
    elif a.stage == "tag-entities":
        files.write_entities(Pipeline(Config(max_rows=a.max_rows, max_tokens=a.max_length)).tag_entities(read(a.input, schemas.TAGGED_STRING)), a.output)
    elif a.stage == "attribute":
        ner, _ = files.read_entities(spark, a.ner_jsonl, schemas.ENTITY_ROW)
        out = entities.attribute(ner, read(a.raw_aff_institutions, schemas.INSTITUTION_LIST), read(a.institution_names, schemas.INSTITUTION_NAME), read(a.abbr_lookup, schemas.ABBREVIATION))
        told = F.array_join(F.transform("institution_ids", lambda x: x.cast("string")), ";")
        files.write_csv(out.withColumn("institution_ids", told), a.detailed_output, quote_all=True)
        files.write_csv(entities.dedupe_input(_detailed(spark, a.detailed_output)).withColumnRenamed("institution_id", "institution_ids").orderBy(F.col("institution_ids").cast("string"), F.col("frequency").desc()), a.dedupe_output, quote_all=True)
    elif a.stage == "canonicalise":
        ids = tuple(int(x) for some in a.institution_id for x in some.split(",") if x.strip())
        if a.institution_id and not ids:
            raise ValueError("--institution-id names no institution")
        config = Config(
            min_frequency=a.min_frequency, institution_ids=ids, limit_institutions=a.limit_institutions, min_suffix_frequency=a.min_suffix_freq_in_inst, max_prefixed_ratio=a.max_prefixed_ratio, max_full_frequency=a.max_full_freq,
            min_suffix_variant_frequency=a.min_suffix_variant_freq, min_prefix_variants=a.min_prefix_variants, min_core_group_frequency=a.min_core_group_freq, distance_threshold=a.distance_threshold, borderline_margin=a.borderline_margin, linkage=a.linkage,
        )
        names = read(a.input, schemas.DEDUPE_INPUT).withColumnRenamed("institution_ids", "institution_id")
        clusters, borderline = Pipeline(config).canonicalise(names, a.output_style == "detailed")
        files.write_csv(clusters, a.output)
        if a.borderline_output:
            files.write_csv(borderline, a.borderline_output)
    elif a.stage == "merge-canonical":
        files.write_csv(canonical.attach_canonical(_detailed(spark, a.ner_detailed), read(a.clusters, schemas.CLUSTERS)), a.output)
    elif a.stage == "build-hierarchy":
        tree = hierarchy.build(read(a.input, schemas.CANONICAL), read(a.institution_names, schemas.INSTITUTION_NAME), Config(top_coverage=a.top_coverage))
        files.write_csv(hierarchy.check_one_parent(tree).orderBy("institution_id", "parent_name", "child_name"), a.output)
    else:
        release.check_unique(read(a.institution_names, schemas.INSTITUTION_NAME), ["institution_id"], "institution names")
        strings = read(a.raw_aff_strings, schemas.TAGGED_STRING).select("raw_affiliation_string_id", "raw_affiliation_string")
        tables = release.release(read(a.canonical_dept, schemas.CANONICAL), read(a.hierarchy, schemas.HIERARCHY), read(a.institution_names, schemas.INSTITUTION_NAME), read(a.education_institutions, schemas.EDUCATION), strings)
        for name, table in release.check_release(tables).items():
            files.write_csv(table.orderBy(*table.columns), f"{a.output_dir}/{name}", one_file=True)


if __name__ == "__main__":
    main()
