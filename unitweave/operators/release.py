"""Release tables with ids: institutions, sub-institutions, mappings, hierarchy and the raw strings they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.sources.stages import stage_table

INST = "institution_id"


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Ids 1..N in order. Rows are counted by range partition first, so that no task sees all of them."""
    parts = stage_table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "id-ranges")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = parts.withColumn("place", place)
    counts = placed.groupBy("part").agg(F.max("place").alias("n"), F.min(F.struct(*order)).alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(counts.select("part", before.alias("before")), "part").withColumn(name, F.col("before") + F.col("place")).drop("part", "place", "before")


def root_like(mappings: DataFrame, hierarchy: DataFrame, institutions: DataFrame) -> DataFrame:
    """institution_id, name: names that equal their institution's name but for case."""
    names = hierarchy.select(INST, F.col("parent_name").alias("name")).unionByName(hierarchy.select(INST, F.col("child_name").alias("name")))
    names = names.unionByName(mappings.select(INST, F.col("canonical_dept_name").alias("name"))).where("name is not null").distinct()
    known = institutions.select(INST, F.lower("institution_name").alias("lower_name")).distinct()
    return names.join(known, INST).where(F.lower("name") == F.col("lower_name")).select(INST, "name")


def _without(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    return rows.join(names.withColumnRenamed("name", column), [INST, column], "left_anti").select(*rows.columns)


def _under_root() -> Column:
    return F.col("parent_name").eqNullSafe(F.col("institution_name"))


def drop_root_like(mappings: DataFrame, hierarchy: DataFrame, institutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mappings and edges without root-like names; edges from the root itself stay."""
    names = root_like(mappings, hierarchy, institutions)
    kept = _without(hierarchy, names, "child_name")
    return _without(mappings, names, "canonical_dept_name"), kept.where(_under_root()).unionByName(_without(kept.where(~_under_root()), names, "parent_name"))


def release(canonical: DataFrame, hierarchy: DataFrame, institutions: DataFrame, education: DataFrame, strings: DataFrame) -> dict[str, DataFrame]:
    """The five tables, for education institutions only; raises where a mapping's raw string is missing."""
    rows, edges = canonical.join(education, INST, "left_semi"), hierarchy.join(education, INST, "left_semi")
    named = edges.select(INST, F.col("parent_name").alias("canonical_dept_name")).unionByName(edges.select(INST, F.col("child_name").alias("canonical_dept_name"))).distinct()
    rows, edges = stage_table(rows.join(named, [INST, "canonical_dept_name"], "left_semi").select(*canonical.columns), "release-rows"), stage_table(edges, "release-edges")
    rows, edges = (stage_table(x, "release-clean") for x in drop_root_like(rows, edges, institutions))
    inner = edges.where(~_under_root())
    pool = inner.select(INST, F.col("parent_name").alias("canonical_name")).unionByName(edges.select(INST, F.col("child_name").alias("canonical_name")))
    pool = pool.unionByName(rows.select(INST, F.col("canonical_dept_name").alias("canonical_name"))).where("canonical_name is not null").distinct()
    subs = stage_table(dense_ids(pool, [INST, "canonical_name"], "sub_institution_id").select("sub_institution_id", INST, "canonical_name"), "sub-institutions")
    mappings = rows.join(subs.withColumnRenamed("canonical_name", "canonical_dept_name"), [INST, "canonical_dept_name"], "left")
    mappings = mappings.select(F.col("raw_affiliation_id").alias("raw_affiliation_string_id"), INST, "sub_institution_id", F.col("raw_dept_str").alias("raw_sub_institution_name")).distinct()
    parent = subs.select(INST, F.col("canonical_name").alias("parent_name"), F.col("sub_institution_id").alias("parent_sub_institution_id"))
    child = subs.select(INST, F.col("canonical_name").alias("child_name"), F.col("sub_institution_id").alias("child_sub_institution_id"))
    tree = edges.join(parent, [INST, "parent_name"], "left").join(child, [INST, "child_name"], "left")
    tree = tree.select(INST, F.when(~_under_root(), F.col("parent_sub_institution_id")).alias("parent_sub_institution_id"), "child_sub_institution_id").distinct()
    used = subs.select(INST).union(tree.select(INST)).union(mappings.select(INST)).distinct()
    named = institutions.join(used, INST, "left_semi").select(INST, "institution_name").distinct()
    return {"institutions": named, "sub_institutions": subs, "mappings": mappings, "hierarchy": tree, "raw_affiliation_strings": used_strings(mappings, strings)}


def used_strings(mappings: DataFrame, strings: DataFrame) -> DataFrame:
    """Raw strings that mappings use, each once."""
    ids = mappings.select("raw_affiliation_string_id").distinct()
    return strings.join(ids, "raw_affiliation_string_id", "left_semi").groupBy("raw_affiliation_string_id").agg(F.min("raw_affiliation_string").alias("raw_affiliation_string"))


def check_unique(rows: DataFrame, columns: list[str], what: str) -> DataFrame:
    """The rows, or an error where a key that look-ups rely on occurs twice."""
    twice = rows.groupBy(*columns).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"{what} has {columns} twice")
    return rows


def check_release(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables, or an error where an id leads nowhere."""
    missing = tables["mappings"].join(tables["raw_affiliation_strings"], "raw_affiliation_string_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"raw strings are missing, such as {missing.first()['raw_affiliation_string_id']}")
    for table, column in (("mappings", "sub_institution_id"), ("hierarchy", "child_sub_institution_id")):
        if not tables[table].where(F.col(column).isNull()).isEmpty():
            raise ValueError(f"{table} has rows without {column}")
    check_unique(tables["sub_institutions"], [INST, "canonical_name"], "sub_institutions")
    check_unique(tables["institutions"], [INST], "institutions")
    return tables
