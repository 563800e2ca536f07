"""Canonical names inside an institution: three rule stages, clustering by vectors, and the choice of a name.

Tables have institution_id, name (as it is being rewritten), clean_dept_str (as it came) and frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.functions import numeric as N
from unitweave.functions import text as T
from unitweave.functions.kernels import cluster, cosine_batches, near_band, near_parts, rounded
from unitweave.plans.config import Config
from unitweave.sources.stages import stage_table


def check_names(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of load_names(), or an error where a choice of institutions or the filters leave nothing."""
    if rows.isEmpty():
        raise ValueError("no rows of the chosen institutions are left" if config.institution_ids else "no rows are left to canonicalise")
    return rows


def load_names(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Trimmed, non-blank rows of the wanted institutions with a whole frequency of at least the minimum (what is no number counts as 0)."""
    out = rows.select("institution_id", F.trim("clean_dept_str").alias("clean_dept_str"), F.coalesce(F.col("frequency").try_cast("long"), F.lit(0)).cast("long").alias("frequency"))
    out = out.where(F.col("institution_id").isNotNull() & (F.length("clean_dept_str") > 0) & (F.col("frequency") >= config.min_frequency))
    if config.institution_ids:
        out = out.where(F.col("institution_id").isin(*config.institution_ids))
    if config.limit_institutions:
        some = out.select("institution_id").distinct().orderBy(F.col("institution_id").cast("string")).limit(config.limit_institutions)
        out = out.join(some, "institution_id", "left_semi")
    return out.withColumn("name", F.col("clean_dept_str"))


def strip_person_prefixes(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """A rare name with a person-like prefix becomes its suffix, where the suffix is frequent enough in the institution.

    Names are summed before they are split and joined, and only those with a suffix take part, so names without one, the
    most, meet in no task.
    """
    names = records(rows).withColumn("s", T.split_prefix(F.col("name"), most=config.prefix_words)).where("s.suffix != ''")
    names = names.select("institution_id", "name", F.col("frequency").alias("full_sum"), F.col("s.suffix").alias("suffix"), F.col("s.valid").alias("valid"))
    sums = names.groupBy("institution_id", "suffix").agg(F.sum("full_sum").alias("suffix_sum"))
    share = F.when(F.col("suffix_sum") > 0, N.ratio(F.col("full_sum"), F.col("suffix_sum"))).otherwise(F.lit(float("inf")))
    rare = (F.col("suffix_sum") >= config.min_suffix_frequency) & (share <= config.max_prefixed_ratio) & (F.col("full_sum") <= config.max_full_frequency)
    renamed = names.where("valid").join(sums, ["institution_id", "suffix"]).where(rare).select("institution_id", "name", F.col("suffix").alias("new_name"))
    return rows.join(renamed, ["institution_id", "name"], "left").withColumn("name", F.coalesce("new_name", "name")).select(*rows.columns)


def _best_name() -> Column:
    """The most frequent row's name, then the longest, then the first."""
    return F.min_by("name", F.struct((-F.col("frequency")).alias("f"), (-F.length("name")).alias("l"), F.col("name").alias("n")))


def _rename_groups(rows: DataFrame, keyed: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    # Rows without a key look for their own name behind a mark that no key has, so that they spread over the tasks.
    spread = keyed.withColumn("group_key", F.coalesce(key, F.concat(F.lit("\0"), "name")))
    named = spread.join(groups.select("institution_id", F.col(key).alias("group_key"), "best"), ["institution_id", "group_key"], "left")
    return named.withColumn("name", F.coalesce("best", "name")).select(*rows.columns)


def unify_suffix_variants(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Names that share a frequent suffix under several valid prefixes take the group's best name."""
    keyed = rows.withColumn("s", T.split_prefix(F.col("name"), most=config.variant_prefix_words)).withColumn("suffix", F.nullif(F.col("s.suffix"), F.lit("")))
    valid = F.col("s.valid")
    groups = keyed.where("suffix is not null").groupBy("institution_id", "suffix").agg(
        F.coalesce(F.sum(F.when(valid, F.col("frequency"))), F.lit(0)).alias("total"), F.countDistinct(F.when(valid, F.col("s.prefix"))).alias("variants"), _best_name().alias("best")
    )
    groups = groups.where((F.col("total") >= config.min_suffix_variant_frequency) & (F.col("variants") >= config.min_prefix_variants))
    return _rename_groups(rows, keyed, groups, "suffix")


def unify_core_variants(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Names with one core, frequent enough together, take the group's best name."""
    cores = rows.select("name").distinct().withColumn("core", F.nullif(T.core_name(T.fold_name(F.col("name"))), F.lit("")))
    keyed = rows.join(cores, "name")
    groups = keyed.where("core is not null").groupBy("institution_id", "core").agg(F.sum("frequency").alias("total"), F.countDistinct("name").alias("variants"), _best_name().alias("best"))
    groups = groups.where((F.col("total") >= config.min_core_group_frequency) & (F.col("variants") >= 2))
    return _rename_groups(rows, keyed, groups, "core")


def records(rows: DataFrame) -> DataFrame:
    return rows.groupBy("institution_id", "name").agg(F.sum("frequency").alias("frequency"))


def members(rows: DataFrame) -> DataFrame:
    """Each name's raw names with frequencies, most frequent first, then by name."""
    summed = rows.groupBy("institution_id", "name", "clean_dept_str").agg(F.sum("frequency").alias("frequency"))
    entry = F.struct((-F.col("frequency")).alias("less"), F.col("clean_dept_str").alias("raw_name"))
    listed = summed.groupBy("institution_id", "name").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    return listed.select("institution_id", "name", F.transform("m", lambda x: F.struct(x["raw_name"].alias("raw_name"), (-x["less"]).alias("frequency"))).alias("members"))


def cluster_records(vectors: DataFrame, threshold: float = 0.15, linkage: str = "average", block: int = 2048) -> DataFrame:
    """institution_id, name, cluster (its first member by name) for records with an embedding, clustered inside each institution.

    An institution of more names than a block is first parted into components of near pairs, a task for each pair of its
    blocks; no cluster spans two of them, so each is clustered by itself and no matrix of all names forms.
    """
    key = ["institution_id", "name"]
    rows = vectors.select(*key, "embedding")
    sizes = _sizes(rows, block)
    kind = dict(vectors.dtypes)["institution_id"]
    schema = f"institution_id {kind}, name string, cluster string"

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("name", ignore_index=True)
        label = cluster(group["embedding"].tolist(), threshold, linkage) if len(group) else []
        return pd.DataFrame({"institution_id": group["institution_id"], "name": group["name"], "cluster": group["name"].to_numpy()[label] if len(group) else []})

    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return rows.groupBy("institution_id").applyInPandas(inside, schema)
    few = rows.join(large, "institution_id", "left_anti").groupBy("institution_id").applyInPandas(inside, schema)
    many = stage_table(rows.join(large, "institution_id"), "many-names")
    parted = many.join(_near_components(many, threshold, block), key)
    return few.union(parted.groupBy("institution_id", "component").applyInPandas(inside, schema))


def _sizes(rows: DataFrame, block: int) -> DataFrame:
    return rows.groupBy("institution_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))


def _block_pairs(rows: DataFrame) -> DataFrame:
    """rows (institution_id, name, blocks, ...) once for each pair of blocks (low, high) of an institution that their own block is in."""
    placed = rows.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")


def _near_components(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """institution_id, name, component (its first name) for rows (institution_id, name, embedding, blocks) linked by near pairs."""
    placed = _block_pairs(rows)
    kind = dict(rows.dtypes)["institution_id"]

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("name", ignore_index=True)
        head = group["name"].to_numpy()[near_parts(group["embedding"].tolist(), threshold, block)]
        out = pd.DataFrame({"institution_id": group["institution_id"], "name": group["name"], "head": head})
        return out[out["name"] != out["head"]]

    links = placed.groupBy("institution_id", "low", "high").applyInPandas(link, f"institution_id {kind}, name string, head string")
    links = stage_table(links.distinct(), "near-links")
    both = links.union(links.select("institution_id", "head", "name")).toDF("institution_id", "name", "near")
    found = rows.select("institution_id", "name", F.col("name").alias("component"))
    while True:
        near = found.select("institution_id", F.col("name").alias("near"), F.col("component").alias("offered"))
        offers = both.join(near, ["institution_id", "near"]).groupBy("institution_id", "name").agg(F.min("offered").alias("offered"))
        after = found.join(offers, ["institution_id", "name"], "left").select("institution_id", "name", F.least("component", F.coalesce("offered", "component")).alias("component"), "component")
        after = stage_table(after.toDF("institution_id", "name", "component", "before"), "near-components")
        found = after.drop("before")
        if after.where("component != before").isEmpty():
            return found


def borderline_pairs(vectors: DataFrame, clusters: DataFrame, threshold: float = 0.15, margin: float = 0.05, block: int = 2048) -> DataFrame:
    """Pairs of an institution in different clusters whose similarity lies just below the merge similarity; none for margin 0.

    A task compares two blocks of an institution's names by one product of matrices and emits what lies in the margin.
    """
    low, high = max(0.0, 1.0 - threshold - margin), 1.0 - threshold
    rows = vectors.join(clusters, ["institution_id", "name"]).select("institution_id", "name", "embedding", "cluster").where(F.lit(margin > 0))
    placed = _block_pairs(rows.join(_sizes(rows, block), "institution_id"))
    kind = dict(vectors.dtypes)["institution_id"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first, second = group[group["own"] == group["low"]], group[group["own"] == group["high"]]
        at = near_band(first["embedding"].tolist(), second["embedding"].tolist(), low, high) if len(first) and len(second) else ([], [], [])
        a, b = first.iloc[at[0]], second.iloc[at[1]]
        out = pd.DataFrame({"institution_id": a["institution_id"].to_numpy(), "dept_a": a["name"].to_numpy(), "dept_b": b["name"].to_numpy(), "similarity": at[2]})
        apart = (a["cluster"].to_numpy() != b["cluster"].to_numpy()) & ((out["dept_a"] < out["dept_b"]) | (a["own"].to_numpy() != b["own"].to_numpy()))
        return out[apart]

    found = placed.groupBy("institution_id", "low", "high").applyInPandas(compare, f"institution_id {kind}, dept_a string, dept_b string, similarity double")
    return found.select("institution_id", F.least("dept_a", "dept_b").alias("dept_a"), F.greatest("dept_a", "dept_b").alias("dept_b"), F.round("similarity", 4).alias("similarity"))


#: Pairs of a task of cosine_pairs, about; a row weighs as LEAST_PAIRS at least.
TASK_PAIRS, LEAST_PAIRS = 1 << 20, 128


def cosine_pairs(vectors: DataFrame, block: int = 2048) -> DataFrame:
    """institution_id, dept_a, dept_b, similarity, distance (to 6 decimals) of all pairs dept_a < dept_b of an institution's names.

    A task multiplies the matrices of two blocks of an institution's names, some rows at a time, and hands the pairs on in
    Arrow batches; no row but a pair leaves it. Both values are NaN where a vector is zero and null where one is missing or empty.
    """
    rows = vectors.select("institution_id", "name", "embedding").where("institution_id is not null and name is not null")
    of = F.count(F.lit(1))
    weight = rows.groupBy("institution_id").agg((of * F.greatest(of / 2, F.lit(LEAST_PAIRS))).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
    key = ["institution_id", "low", "high"]
    placed = _block_pairs(rows.join(_sizes(rows, block), "institution_id")).repartition(1 + int(weight / TASK_PAIRS), *key)
    kind = dict(vectors.dtypes)["institution_id"]

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        own, names = group["own"].to_numpy(), group["name"].combine_chunks()
        first, second = np.flatnonzero(own == key[1].as_py()), np.flatnonzero(own == key[2].as_py())
        for a, b, similar, known in cosine_batches(names.to_numpy(zero_copy_only=False), group["embedding"].to_numpy(), first, second):
            values = [pa.array(rounded(v, 6), mask=~known, from_pandas=False) for v in (similar, 1.0 - similar)]
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(a)), names.take(pa.array(a)), names.take(pa.array(b)), *values], ["institution_id", "dept_a", "dept_b", "similarity", "distance"])

    return placed.groupBy(*key).applyInArrow(compare, f"institution_id {kind}, dept_a string, dept_b string, similarity double, distance double")


def canonical_names(clustered: DataFrame) -> DataFrame:
    """For rows (institution_id, cluster, name, frequency) each cluster's name (most frequent, shortest, first), total and size."""
    order = F.struct((-F.col("frequency")).alias("f"), F.length("name").alias("l"), F.lower("name").alias("n"), F.col("name").alias("exact"))
    return clustered.groupBy("institution_id", "cluster").agg(F.min_by("name", order).alias("canonical_dept_name"), F.sum("frequency").alias("cluster_total_frequency"), F.count(F.lit(1)).alias("member_count"))


def cluster_rows(clustered: DataFrame, member_lists: DataFrame, detailed: bool = False) -> DataFrame:
    """A row for each member, or with detailed for each cluster with its members as JSON."""
    named = clustered.join(canonical_names(clustered), ["institution_id", "cluster"]).join(member_lists, ["institution_id", "name"])
    if not detailed:
        return named.select("institution_id", "canonical_dept_name", "cluster_total_frequency", F.explode("members.raw_name").alias("member_dept_name"))
    entry = F.struct((-F.col("frequency")).alias("f"), F.lower("name").alias("n"), "name", "members")
    whole = named.groupBy("institution_id", "canonical_dept_name", F.col("cluster_total_frequency").alias("total_frequency"), "member_count").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    listed = F.flatten(F.transform("e", lambda x: F.transform(x["members"], lambda m: F.struct(m["raw_name"].alias("raw_name"), m["frequency"].alias("frequency"), x["name"].alias("normalized_name")))))
    return whole.select("institution_id", "canonical_dept_name", "total_frequency", "member_count", F.to_json(listed).alias("member_details"))


def attach_canonical(detailed: DataFrame, clusters: DataFrame) -> DataFrame:
    """Attributed rows of a single institution with the canonical name of their cluster."""
    single = detailed.where("inst_count = 1").withColumn("institution_id", F.element_at("institution_ids", 1))
    names = clusters.select("institution_id", F.col("member_dept_name").alias("clean_dept_str"), "canonical_dept_name", "cluster_total_frequency")
    out = single.join(names, ["institution_id", "clean_dept_str"])
    return out.select(F.col("raw_aff_id").alias("raw_affiliation_id"), "institution_id", "raw_dept_str", "clean_dept_str", "start", "end", "frequency", "canonical_dept_name", "cluster_total_frequency")


def match_ratio(all_rows: DataFrame, kept: DataFrame) -> DataFrame:
    """kept_rows, all_rows, ratio (null where there are no rows)."""
    a, b = all_rows.agg(F.count(F.lit(1)).alias("all_rows")), kept.agg(F.count(F.lit(1)).alias("kept_rows"))
    return b.join(a).select("kept_rows", "all_rows", F.try_divide(F.col("kept_rows").cast("double"), F.col("all_rows").cast("double")).alias("ratio"))
