"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are combined within each map task, then within salted digest groups, then across the salts of a digest. Each of
these stages groups by the whole normalised text beside its digest, so two texts that share a digest never merge. Only
texts that do share one with another text (found by counting) are compared by content again when rows look up their
group; all others look it up by digest and salt alone, so that texts do not travel a third time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.llm.common import SPACE_PATTERN, cut

SALTS = 32
#: doc_id becomes a number that is larger for smaller ids; 0 stands for a null id, which never wins a tie.
_TOP, _STEP = "9223372036854775807", "100000000000000000000"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_PATTERN, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(length: Column, doc_id: Column) -> Column:
    """One decimal that is largest for the longest text and, among equals, the smallest id."""
    turned = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)")) + F.lit(1)
    return (length.cast("decimal(11,0)") * F.lit(_STEP).cast("decimal(21,0)") + turned).cast("decimal(38,0)")


def _winner(rank: Column) -> Column:
    turned = (rank % F.lit(_STEP).cast("decimal(21,0)")).cast("decimal(21,0)")
    return F.when(turned > 0, (F.lit(_TOP).cast("decimal(21,0)") + F.lit(1) - turned).cast("long"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    Texts are equal when identical after deleting ASCII white space; a null text counts as empty, and all empty texts
    are one group. The row with the most code points, then the smallest doc_id, stays. A null doc_id loses ties; where
    it is all a group has, keep_id is null and the row is kept. Rows that repeat a doc_id in a group are counted in
    group_size and share the fate of that id. Other columns are ignored, and an empty table gives no rows.
    """
    body = normalised(F.col("text"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), F.length(F.coalesce("text", F.lit(""))).alias("length"))
    base = base.select("*", digest(F.col("body")).alias("digest"), sha256(F.col("body")).alias("text_sha256"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    salted = base.groupBy("digest", "salt", "body").agg(F.max(_rank(F.col("length"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("rows"))
    by_digest, by_body = Window.partitionBy("digest"), Window.partitionBy("digest", "body")
    groups = (
        salted.repartition("digest")
        .withColumns({"best": F.max("best").over(by_body), "rows": F.sum("rows").over(by_body)})
        .withColumn("alone", F.min("body").over(by_digest) == F.max("body").over(by_digest))
        .select("digest", "salt", _winner(F.col("best")).alias("keep_id"), F.col("rows").alias("group_size"), "alone", F.when(~F.col("alone"), F.col("body")).alias("body"))
    )
    groups = cut(groups, "exact-groups")
    found = base.join(groups.where("alone").select("digest", "salt", "keep_id", "group_size"), ["digest", "salt"])
    clashes = groups.where("not alone").select("digest", "salt", "body", "keep_id", "group_size")
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if clashes.isEmpty():
        return found.select(columns)
    return found.select(columns).unionByName(base.join(clashes, ["digest", "salt", "body"]).select(columns))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns.

    The row with the most code points, then the smallest doc_id, stays; a null doc_id loses ties. Rows are known by doc_id
    and text together, so that what shares only a dropped copy's id stays; of rows that share both, the one with the
    longest text, then the first text in code-point order, stays once. An empty table gives no rows.
    """
    told = cut(exact_groups(docs).select(F.col("doc_id").alias("told_id"), F.col("text_sha256").alias("told_sha256"), "kept"), "exact-rows")
    same = lambda some: docs["doc_id"].cast("long").eqNullSafe(some["told_id"]) & (sha256(normalised(docs["text"])) == some["told_sha256"])
    lost = told.where("not kept").select("told_id", "told_sha256").distinct()
    rest = docs.join(lost, same(lost), "left_anti")
    twins = cut(told.where("kept").groupBy("told_id", "told_sha256").count().where("count > 1").select("told_id", "told_sha256"), "exact-twins")
    if twins.isEmpty():
        return rest
    place = next(x for x in (f"place_{k}" for k in itertools.count()) if x not in docs.columns)
    alike = Window.partitionBy(docs["doc_id"], sha256(normalised(docs["text"]))).orderBy(F.length(docs["text"]).desc_nulls_last(), docs["text"])
    first = rest.join(twins, same(twins), "left_semi").withColumn(place, F.row_number().over(alike)).where(F.col(place) == 1).drop(place)
    return rest.join(twins, same(twins), "left_anti").union(first)
