"""Entities of raw strings: decoding, merging, span choice, segments, and attribution of sub-units to institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.functions import text as T
from unitweave.functions.kernels import token_sort_ratio
from unitweave.plans.config import Config
from unitweave.sources.stages import stage_table

ENTITY = "struct<entity_group:string,start:int,end:int,word:string,score:double>"
ENTITIES = f"array<{ENTITY}>"


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def first_rows(df: DataFrame, most: int | None, key: str) -> DataFrame:
    """The first rows by key, or all; 0 and None set no limit."""
    return df.orderBy(key).limit(most) if most else df


def keep_language(df: DataFrame, language: str = "ENGLISH") -> DataFrame:
    return df.where(F.col("language") == language) if "language" in df.columns else df


def span_quota(count: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(count.try_cast("int"), F.lit(0)))


def decode_tags(tokens: Column, raw: Column) -> Column:
    """Entities from tagged tokens array<struct<label, score, start, end, mask>> of a text.

    Decoding ends at the first masked token and skips empty ones. O closes; B-, another group or nothing open begins an
    entity; anything else extends it. A label without a dash begins one. The score is the mean of its tokens'.
    """
    blank = F.lit(None).cast("struct<entity_group:string,start:int,end:int,total:double,n:int>")
    first_masked = F.array_position(F.transform(tokens, lambda t: t["mask"]), 0)
    seen = F.when(first_masked > 0, F.slice(tokens, F.lit(1), first_masked.cast("int") - 1)).otherwise(tokens)
    seen = F.filter(seen, lambda t: t["end"] > t["start"])

    def step(acc: Column, t: Column) -> Column:
        dashed = F.instr(t["label"], "-") > 0
        begins = ~dashed | (F.substring_index(t["label"], "-", 1) == "B")
        group = F.when(dashed, F.regexp_replace(t["label"], "^[^-]*-", "")).otherwise(t["label"])
        open_ = acc["open"]
        closed = F.when(open_.isNotNull(), F.concat(acc["done"], F.array(open_))).otherwise(acc["done"])
        new = F.struct(group.alias("entity_group"), t["start"].alias("start"), t["end"].alias("end"), t["score"].alias("total"), F.lit(1).alias("n"))
        more = F.struct(open_["entity_group"].alias("entity_group"), open_["start"].alias("start"), t["end"].alias("end"), (open_["total"] + t["score"]).alias("total"), (open_["n"] + 1).alias("n"))
        outside = t["label"] == "O"
        starts = begins | open_.isNull() | (open_["entity_group"] != group)
        return F.struct(
            F.when(outside | starts, closed).otherwise(acc["done"]).alias("done"),
            F.when(outside, blank).when(starts, new).otherwise(more).alias("open"),
        )

    zero = F.struct(F.array().cast("array<struct<entity_group:string,start:int,end:int,total:double,n:int>>").alias("done"), blank.alias("open"))
    found = F.aggregate(seen, zero, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))

    def finish(e: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(F.length(raw), e["start"]))
        end = F.greatest(start, F.least(F.length(raw), e["end"]))
        return F.struct(e["entity_group"].alias("entity_group"), start.alias("start"), end.alias("end"), F.substring(raw, start + 1, end - start).alias("word"), (e["total"] / e["n"]).alias("score"))

    return F.transform(found, finish)


def merge_touching(entities: Column) -> Column:
    """Neighbours of one group where one begins at the other's end become one; scores average pairwise from the left."""

    def step(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["entity_group"].alias("entity_group"), last["start"].alias("start"), e["end"].alias("end"), F.concat(last["word"], e["word"]).alias("word"), ((last["score"] + e["score"]) / 2.0).alias("score"))
        touches = F.coalesce((last["end"] == e["start"]) & (last["entity_group"] == e["entity_group"]), F.lit(False))
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(e)))

    return F.aggregate(entities, F.array().cast(ENTITIES), lambda acc, e: step(acc, e))


def keep_groups(entities: Column, groups: tuple[str, ...] = ("SUB", "ORG")) -> Column:
    return F.filter(entities, lambda e: e["entity_group"].isin(*groups))


def choose_spans(spans: Column, count: Column) -> Column:
    """The texts of the longest spans (then best, then first), as many as institutions, one at least; blank ones never."""
    trimmed = F.filter(F.transform(spans, lambda s, i: F.struct((s["start"] - s["end"]).alias("less"), (-s["score"]).alias("worse"), i.alias("place"), F.trim(s["word"]).alias("word"))), lambda s: s["word"] != "")
    return F.transform(F.slice(F.array_sort(trimmed), F.lit(1), span_quota(count)), lambda s: s["word"])


def with_segments(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """segment and place for entity rows: a new segment begins where start falls below the last start that is not null."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("start") < before).cast("int"), F.lit(0))
    out = rows.withColumn("cut", cut).withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("cut").withColumn("place", (F.row_number().over(Window.partitionBy(*key, "segment").orderBy(*order)) - 1).cast("int"))


def nearest_right(orgs: Column, end: Column, most: int) -> Column:
    """The institution of the ORG (struct start, place, institution_id) that begins next at or after end, if near enough."""
    hit = F.array_min(F.filter(orgs, lambda o: o["start"] >= end))
    return F.when(hit["start"] - end <= most, hit["institution_id"])


def next_in_order(orgs: Column, place: Column, most: int) -> Column:
    """The institution of the next ORG in order, if few enough entities away."""
    hit = F.array_min(F.transform(F.filter(orgs, lambda o: o["place"] > place), lambda o: F.struct(o["place"].alias("place"), o["institution_id"].alias("institution_id"))))
    return F.when(hit["place"] - place <= most, hit["institution_id"])


def abbreviation_table(lookup: DataFrame) -> DataFrame:
    """abbr, expanded: lower-case; of repeated abbreviations the last row (by ordinal, else by full name) wins."""
    order = "ordinal" if "ordinal" in lookup.columns else "full_name"
    return lookup.where("abbr_name is not null").groupBy(F.lower("abbr_name").alias("abbr")).agg(F.lower(F.max_by("full_name", order)).alias("expanded"))


def attribute(ner: DataFrame, candidates: DataFrame, institutions: DataFrame, abbreviations: DataFrame, config: Config = Config()) -> DataFrame:
    """Sub-units with the institution or institutions they belong to.

    ner: raw_affiliation_string_id, frequency, entities; candidates: raw_affiliation_string_id, institution_ids (array or
    ';'-joined); institutions: institution_id, institution_name; abbreviations: abbr_name, full_name. Rows without id,
    candidates or entities give nothing; a null frequency counts as 1.
    """
    ids = F.col("institution_ids") if dict(candidates.dtypes).get("institution_ids", "").startswith("array") else T.split_ids(F.col("institution_ids_str"))
    lists = candidates.where("raw_affiliation_string_id is not null").select(F.col("raw_affiliation_string_id").alias("raw_aff_id"), ids.alias("candidates")).where(F.size("candidates") > 0)
    rows = ner.where("raw_affiliation_string_id is not null").select(
        F.col("raw_affiliation_string_id").alias("raw_aff_id"), F.coalesce("frequency", F.lit(1)).cast("long").alias("frequency"), F.posexplode("entities").alias("position", "e")
    )
    rows = rows.join(lists, "raw_aff_id").select("raw_aff_id", "frequency", "candidates", "position", F.col("e.entity_group").alias("kind"), F.col("e.word").alias("word"), F.col("e.start").cast("int").alias("start"), F.col("e.end").cast("int").alias("end"))
    rows = with_segments(rows, ["raw_aff_id"], ["position"]).withColumn("clean", T.clean_department(F.col("word")))
    few = (F.col("kind") == "SUB") & (F.size(F.filter(F.split("clean", " "), lambda t: t != "")) < 2)
    rows = rows.join(abbreviation_table(abbreviations), F.col("clean") == F.col("abbr"), "left").where("clean != ''").where(~few)
    rows = rows.withColumn("clean", F.when(T.is_abbreviation(F.col("clean")), F.coalesce("expanded", "clean")).otherwise(F.col("clean"))).drop("abbr", "expanded")
    rows = stage_table(rows, "entity-words")  # both sides of the match use them
    names = institutions.select("institution_id", T.clean_department(F.col("institution_name")).alias("name")).where("name != ''")
    orgs = rows.where("kind = 'ORG' and start is not null and end is not null and clean != ''")
    offered = orgs.select("raw_aff_id", "segment", "place", "start", "clean", F.posexplode("candidates").alias("rank", "institution_id")).join(names, "institution_id")
    scored = offered.select("clean", "name").distinct().withColumn("match", token_sort_ratio("clean", "name"))
    best = offered.join(scored, ["clean", "name"]).groupBy("raw_aff_id", "segment", "place", "start").agg(F.max(F.struct("match", (-F.col("rank")).alias("first"), "institution_id")).alias("best"))
    matched = best.where(F.col("best.match") >= config.org_match_score).groupBy("raw_aff_id", "segment").agg(F.collect_list(F.struct("start", "place", F.col("best.institution_id").alias("institution_id"))).alias("orgs"))
    known = institutions.where("institution_name is not null").select(F.lower("institution_name").alias("clean")).distinct()
    subs = rows.where("kind = 'SUB'").join(known, "clean", "left_anti").join(matched, ["raw_aff_id", "segment"], "left")
    found = F.coalesce(nearest_right(F.col("orgs"), F.col("end"), config.right_org_distance), next_in_order(F.col("orgs"), F.col("place"), config.right_org_window))
    subs = subs.withColumn("found", found)
    return subs.select(
        "raw_aff_id", F.when(F.col("found").isNotNull(), F.array("found")).otherwise(F.col("candidates")).alias("institution_ids"),
        F.when(F.col("found").isNotNull(), F.lit(1)).otherwise(F.size("candidates")).cast("long").alias("inst_count"),
        F.col("word").alias("raw_dept_str"), F.col("clean").alias("clean_dept_str"), "start", "end", "frequency",
    )


def dedupe_input(detailed: DataFrame) -> DataFrame:
    """Frequencies of names that belong to a single institution."""
    single = detailed.where("inst_count = 1").select(F.element_at("institution_ids", 1).alias("institution_id"), "clean_dept_str", "frequency")
    return single.groupBy("institution_id", "clean_dept_str").agg(F.sum("frequency").alias("frequency"))
