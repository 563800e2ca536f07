"""Parent and child units from co-occurrence in raw strings.

Tables have institution_id, raw_affiliation_id, canonical_dept_name, start and frequency; a root node stands for the
institution and comes first in every record.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.functions import numeric as N
from unitweave.functions import vocab
from unitweave.functions.kernels import greedy_forest
from unitweave.plans.config import Config
from unitweave.sources.stages import stage_table

INST = "institution_id"


def top_coverage(rows: DataFrame, coverage: float = 0.95) -> DataFrame:
    """institution_id, canonical_dept_name that together reach the share of all frequency, most frequent first, then by name."""
    sums = rows.groupBy(INST, "canonical_dept_name").agg(F.sum("frequency").alias("frequency"))
    w = Window.partitionBy(INST)
    before = F.coalesce(F.sum("frequency").over(w.orderBy(F.col("frequency").desc(), "canonical_dept_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = sums.withColumns({"before": before, "total": F.sum("frequency").over(w)})
    return out.where((F.col("total") > 0) & (F.col("before") < F.col("total") * F.lit(float(coverage)))).select(INST, "canonical_dept_name")


def record_positions(rows: DataFrame) -> DataFrame:
    """institution_id, raw_affiliation_id, names (in order of their first start, then by name), for records with any name."""
    first = rows.where(F.trim("canonical_dept_name") != "").groupBy(INST, "raw_affiliation_id", F.trim("canonical_dept_name").alias("name"))
    start = F.min(F.when(F.isnan(F.col("start").try_cast("double")), None).otherwise(F.col("start").try_cast("double"))).alias("start")
    first = first.agg(F.coalesce(start, F.lit(float("inf"))).alias("start"))
    listed = first.groupBy(INST, "raw_affiliation_id").agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("l"))
    return listed.select(INST, "raw_affiliation_id", F.transform("l", lambda x: x["name"]).alias("names"))


def _root() -> Column:
    return F.concat(F.lit(vocab.ROOT_MARK), F.col(INST).cast("string"))


def nodes(records: DataFrame) -> DataFrame:
    """institution_id, name, frequency (records), position (mean place from 0, the root's, to 1)."""
    n = F.size("names")
    each = records.select(INST, F.posexplode("names").alias("i", "name"), n.alias("n")).select(INST, "name", ((F.col("i") + 1) / F.col("n")).alias("place"))
    roots = records.select(INST, _root().alias("name"), F.lit(0.0).alias("place"))
    return each.unionByName(roots).groupBy(INST, "name").agg(F.count(F.lit(1)).alias("frequency"), F.avg("place").alias("position"))


def pairs(records: DataFrame) -> DataFrame:
    """institution_id, a, b (a before b by code point), n records with both, a_first and b_first of them."""
    whole = records.select(INST, F.concat(F.array(_root()), F.col("names")).alias("names"))
    first = whole.select(INST, "names", F.posexplode("names").alias("i", "first"))
    both = first.select(INST, "first", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("second"))
    keyed = both.select(INST, F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"), (F.col("first") < F.col("second")).cast("long").alias("a_first"))
    return keyed.groupBy(INST, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("a_first").alias("a_first")).withColumn("b_first", F.col("n") - F.col("a_first"))


def degrees(pair_rows: DataFrame) -> DataFrame:
    both = pair_rows.select(INST, F.col("a").alias("name")).unionByName(pair_rows.select(INST, F.col("b").alias("name")))
    return both.groupBy(INST, "name").agg(F.count(F.lit(1)).alias("degree"))


def score_edges(records: DataFrame, config: Config = Config()) -> DataFrame:
    """institution_id, parent_dept, child_dept, direction_score: both directions of every pair that occurs often enough."""
    edges = stage_table(pairs(records), "pairs")
    info = nodes(records).join(degrees(edges), [INST, "name"]).withColumn("rank", N.lexical_rank(F.col("name")))
    side = lambda x: info.select(INST, F.col("name").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("frequency", "position", "degree", "rank")])
    often = edges.where(F.col("n") >= config.min_pair_count).join(side("a"), [INST, "a"]).join(side("b"), [INST, "b"])
    fa, fb, n = F.col("frequency_a").cast("double"), F.col("frequency_b").cast("double"), F.col("n").cast("double")
    often = often.where(n / F.least(fa, fb) >= config.min_association)
    da, db = F.col("degree_a").cast("double"), F.col("degree_b").cast("double")
    base = config.weight_coverage * (n / fb - n / fa) + config.weight_degree * ((da - db) / (da + db)) + config.weight_frequency * ((fa - fb) / (fa + fb))

    def directed(parent: str, child: str, sign: float) -> Column:
        ahead = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f"position_{parent}") - F.col(f"position_{child}")))
        steady = (F.col(f"{child}_first") - F.col(f"{parent}_first")) / n
        place = config.weight_position * (config.position_average * ahead + config.position_consistency * steady)
        lexical = N.lexical_bonus(F.col(f"rank_{parent}"), F.col(f"rank_{child}"), config.lexical_cap)
        gap = N.gap_penalty(F.col(f"rank_{parent}"), F.col(f"rank_{child}"), config.rank_gap_penalty)
        return (sign * base + place + lexical + gap) * N.frequency_scale(F.col(f"frequency_{parent}"))

    forth = F.struct(F.col("a").alias("parent_dept"), F.col("b").alias("child_dept"), directed("a", "b", 1.0).alias("direction_score"))
    back = F.struct(F.col("b").alias("parent_dept"), F.col("a").alias("child_dept"), directed("b", "a", -1.0).alias("direction_score"))
    return often.select(INST, F.inline(F.array(forth, back))).withColumn("direction_score", F.round("direction_score", 12))


def keep_strong(edges: DataFrame, config: Config = Config()) -> DataFrame:
    """Edges that reach the institution's quantile of scores and the floor, and do not lead to a root."""
    limit = edges.groupBy(INST).agg(F.expr(f"percentile(direction_score, {config.score_quantile})").alias("q"))
    out = edges.join(limit, INST).where(F.col("direction_score") >= F.greatest(F.lit(config.score_floor), F.coalesce("q", F.lit(config.score_floor))))
    return out.where(~N.is_root(F.col("child_dept"))).drop("q")


def top_parents(edges: DataFrame, most: int = 3) -> DataFrame:
    w = Window.partitionBy(INST, "child_dept").orderBy(F.col("direction_score").desc(), "parent_dept")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def parent_forest(edges: DataFrame) -> DataFrame:
    """Of each institution's edges, best score first, those that give a child its first parent and close no cycle."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["direction_score", "parent_dept", "child_dept"], ascending=[False, True, True])
        return group[greedy_forest(group["parent_dept"].tolist(), group["child_dept"].tolist())]

    rows = edges.select(INST, "parent_dept", "child_dept", "direction_score")
    return rows.groupBy(INST).applyInPandas(choose, rows.schema)


def complete_roots(forest: DataFrame, rows: DataFrame, institutions: DataFrame) -> DataFrame:
    """institution_id, institution_name, parent_name, child_name: every unit without a parent comes under the institution.

    Names are in lower case; an institution without a name keeps its root mark as parent of chosen edges, and null otherwise.
    """
    names = institutions.groupBy(INST).agg(F.min("institution_name").alias("institution_name"))
    units = rows.select(INST, "canonical_dept_name").distinct()
    children = forest.select(INST, F.col("child_dept").alias("canonical_dept_name")).distinct()
    missing = units.join(children, [INST, "canonical_dept_name"], "left_anti")
    chosen = forest.join(names, INST, "left").select(INST, "institution_name", F.when(N.is_root(F.col("parent_dept")), F.coalesce("institution_name", "parent_dept")).otherwise(F.col("parent_dept")).alias("parent"), F.col("child_dept").alias("child"))
    added = missing.join(names, INST, "left").select(INST, "institution_name", F.col("institution_name").alias("parent"), F.col("canonical_dept_name").alias("child"))
    lower = [F.lower(c).alias(o) for c, o in (("institution_name", "institution_name"), ("parent", "parent_name"), ("child", "child_name"))]
    return chosen.unionByName(added).select(INST, *lower).distinct()


def check_one_parent(hierarchy: DataFrame) -> DataFrame:
    """The hierarchy, or an error if a child has two parents."""
    twice = hierarchy.groupBy(INST, "child_name").agg(F.countDistinct("parent_name").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a unit has more than one parent")
    return hierarchy


def build(rows: DataFrame, institutions: DataFrame, config: Config = Config()) -> DataFrame:
    """The hierarchy of canonical rows."""
    kept = stage_table(rows.join(top_coverage(rows, config.top_coverage), [INST, "canonical_dept_name"], "left_semi"), "covered")
    forest = parent_forest(top_parents(keep_strong(stage_table(score_edges(record_positions(kept), config), "edges"), config), config.parents_per_child))
    return complete_roots(stage_table(forest, "forest"), kept, institutions)
