"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources share the words of the mix by weight. A source never gives more than max_epochs times its own words: such a
source is clamped there and what it cannot give is shared among the others by weight, again and again until none is
above its cap. Each document is then taken as often as the whole part of its source's epochs; for the fractional part
documents are put into a seeded order and taken until the words taken are as near the target as whole documents allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.llm.common import cut, n_words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the seeded hash that form a bucket: order is by bucket, then within it, so no task orders a whole source.
BUCKET_DIGITS = 3


def seeded_order(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target for a table of one row per source (source, source_size).

    Sources in code-point order, null last, take the weights in turn. Sorted by cap per weight, the clamped sources are
    a prefix; the first source whose cap is at least its share of what the clamped ones leave ends it. That closed form
    gives the same levels as clamping round by round. All arithmetic before the last division is on whole numbers.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    chosen = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", chosen.cast("long").alias("weight")).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level), F.lit(0)),
            "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)),
        }
    )
    stops = (F.col("cap") * F.col("weights")) >= (F.col("rest") * F.col("weight"))
    level = F.min(F.when(stops, F.struct((F.col("cap") / F.col("weight")).alias("level"), F.col("weights").cast("long").alias("weights"), F.col("rest").cast("long").alias("rest")))).over(everything)
    filled = left.withColumn("first", level)
    clamped = (F.col("cap") * F.col("first.weights")) < (F.col("first.rest") * F.col("weight"))
    target = F.when(clamped, F.col("cap").cast("double")).otherwise((F.col("first.rest") * F.col("weight")).cast("double") / F.col("first.weights").cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def _repetitions(docs: DataFrame, row: Column, write: bool, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """row, size, source_size, target, times for each row of docs. write: rows are small and written, so that texts are read once."""
    order = seeded_order(docs["doc_id"], seed)
    rows = docs.select(row.alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), order.alias("place"))
    # A key that is never null lets the window and the join below share one exchange.
    rows = rows.withColumns({"bucket": F.substring("place", 1, BUCKET_DIGITS), "key": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    rows = cut(rows, "mix-rows") if write else rows
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = cut(buckets, "mix-buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("before", before)
    plan = buckets.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "bucket", "before", "source_size", "target")
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, ["key", "bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    start = F.col("before") + F.col("within")
    part = ((start + start + F.col("size")).cast("double") < F.lit(2.0) * rest).cast("long")
    return placed.withColumn("whole", whole).select("row", "size", "source_size", "target", (F.col("whole") + part).alias("times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source).

    size is the number of words (null text: 0); a document with size 0 takes 0, and a source of such documents has
    target 0. A null source is a source of its own. Rows that repeat a doc_id count as documents of their own. The same
    rows give the same mix in any partitioning. An empty table gives no rows. Other columns are ignored.
    """
    row = F.struct(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"))
    times = _repetitions(docs, row, True, weights, max_epochs, seed)
    return times.select("row.doc_id", "row.source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, with the columns of docs. A document without words, which
    takes no words of the mix however often it comes, stays as often as its source's epochs say."""
    times = _repetitions(docs, F.struct(*[docs[c] for c in docs.columns]), False, weights, max_epochs, seed).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
