"""Extraction from relational sources: raw strings with counts, institution lists, names and education institutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDUCATION_TYPE = 3


def raw_string_counts(affiliations: DataFrame, links: DataFrame, strings: DataFrame) -> DataFrame:
    """Raw strings that are linked to an institution, with their numbers of institutions and works; by_id() sorts them for export."""
    counts = links.join(affiliations, ["work_id", "affiliation_seq"]).groupBy("raw_affiliation_string_id").agg(
        F.countDistinct("institution_id").alias("institution_count"), F.countDistinct("work_id").alias("frequency")
    )
    out = counts.join(strings, "raw_affiliation_string_id")
    return out.select("raw_affiliation_string_id", "institution_count", "frequency", "raw_affiliation_string")


def institution_lists(affiliations: DataFrame, links: DataFrame) -> DataFrame:
    """Each raw string's distinct institutions in numeric order, joined by ';'; by_id() sorts them for export."""
    pairs = affiliations.where("raw_affiliation_string_id is not null").join(links, ["work_id", "affiliation_seq"]).select("raw_affiliation_string_id", "institution_id").distinct()
    lists = pairs.groupBy("raw_affiliation_string_id").agg(F.count("institution_id").alias("institution_count"), F.array_sort(F.collect_list("institution_id")).alias("ids"))
    joined = F.nullif(F.array_join(F.transform("ids", lambda x: x.cast("string")), ";"), F.lit(""))
    return lists.select("raw_affiliation_string_id", "institution_count", joined.alias("institution_ids_str"))


def by_id(rows: DataFrame) -> DataFrame:
    """Rows in order of their first column, as exported tables are."""
    return rows.orderBy(rows.columns[0])


def institution_names(institutions: DataFrame) -> DataFrame:
    return institutions.select("institution_id", "institution_name").orderBy("institution_id")


def education_institutions(institutions: DataFrame) -> DataFrame:
    return institutions.where(F.col("institution_type_id") == EDUCATION_TYPE).select("institution_id").orderBy("institution_id")
