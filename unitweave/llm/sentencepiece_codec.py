"""SentencePiece encoding and decoding over a relational lattice of pieces, in DataFrame operations only.

Texts are cut into units: a space mark with the letters or the other characters after it. No piece of the model spans two
units, so that the best path of a text is that of its units. The distinct units of all documents explode into substrings
of bounded length, which an equi-join matches with the piece table; what matches are the edges of a unit's lattice, which
are grouped by unit and folded by Viterbi's rule with a higher-order aggregate.

Texts are cut at spaces, line ends and marks at the end of a word first, which is much faster than cutting units by their
pattern. What this gives are parts: one unit or a few, which are as short as a lattice may be, or the units of a longer run.

Texts are never shuffled: each task writes its own into blocks, the buckets of a table. A block's parts are made distinct
inside it and look their ids up among the parts of all blocks. Those of many blocks, a bounded number, come back to all of
them by broadcast, the others to the blocks that have them, as hash tables, arrays of small maps, in which each occurrence
finds its ids. So occurrences of words are neither shuffled nor sorted, and no table of all words meets in one task.

The model is a byte-pair model, whose scores are ranks of merges. They become costs by the law of Zipf and Mandelbrot,
log(ZIPF + rank), so a path's cost stands for a probability; ids are those of the best path, which for about one word in
six is another than that which the library reaches by merging.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.llm.common import cut, fresh_path, pieces_for

SPACE = "▁"
#: Longest run of one kind of character that makes a unit; longer runs are cut.
UNIT = 32
ZIPF = 1000
#: Cost, in millionths of a nat, of a character that no piece covers and that is spelt in bytes.
UNKNOWN_COST = 50_000_000
#: Text of a block, whose texts and units meet in one task; larger blocks share more units and need more memory.
BLOCK_BYTES = 16 << 20
#: Maps of a block's hash table, and of that of all blocks, powers of two.
MAPS, COMMON_MAPS = 1 << 15, 1 << 16
#: Parts, at most, whose ids all blocks get; those in most blocks.
COMMON = 400_000
#: Where texts are cut into parts; a text that has it is cut by the pattern of units.
CUT = "\x01"

# An edge of a lattice is one long: its end, cost, size and id. A node of a path is the path's cost so far, then size and id
# of its last edge, in the same places.
_COST_BITS, _SIZE_BITS, _ID_BITS = 28, 6, 22
_COST_AT, _END_AT = _SIZE_BITS + _ID_BITS, _COST_BITS + _SIZE_BITS + _ID_BITS
_UNKNOWN = (1 << _ID_BITS) - 1
_UNITS = (
    rf"{SPACE}?[\p{{L}}\p{{M}}]{{1,{UNIT}}}|{SPACE}?[^{SPACE}\t-\f\p{{L}}\p{{M}}]{{1,{UNIT}}}"
    rf"|{SPACE}{{1,{UNIT // 2}}}(?={SPACE})|{SPACE}|[\t-\f]"
)


@dataclass
class Model:
    """pieces: (piece, id, cost) of all plain pieces; byte_ids: the ids that spell single bytes; texts: what each id decodes to, in hex."""

    pieces: list[tuple[str, int, int]]
    byte_ids: list[int]
    texts: list[str]
    longest: int

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, cost."""
        return spark.createDataFrame(self.pieces, "piece string, id long, cost long")


def load(path: str) -> Model:
    """The tables of a SentencePiece byte-pair model file with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    names = [model.id_to_piece(i) for i in ids]
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = [(names[i], i, round(1e6 * math.log(ZIPF - model.get_score(i)))) for i in plain]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    spelt = {i: f"{b:02X}" for b, i in enumerate(byte_ids)}
    shown = lambda i: spelt.get(i) or ("" if model.is_control(i) else (" ⁇ " if model.is_unknown(i) else names[i].replace(SPACE, " ")).encode().hex())
    return Model(pieces, byte_ids, [shown(i) for i in ids], max(len(names[i]) for i in plain))


def units(text: Column) -> Column:
    """The units of a text, in order; none of an empty one. Joined, they are the text after a space, with marks for spaces."""
    marked = F.when(text != "", F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))).otherwise("")
    return F.regexp_extract_all(marked, F.lit(_UNITS), F.lit(0))


def parts(text: Column) -> Column:
    """Units of a text, in order, with those of a word joined where they have at most UNIT characters; some parts are empty.

    A space or a line end begins a unit, and a line end is one, unless spaces (or their marks) are three or more in a row.
    """
    marked = F.replace(text, F.lit(" "), F.lit(CUT + SPACE))
    marked = F.concat(F.lit(SPACE), F.replace(marked, F.lit("\n"), F.lit(f"{CUT}\n{CUT}")), F.lit(CUT))
    marked = F.regexp_replace(marked, rf"[.,](?={CUT})(?<=[\p{{L}}\p{{M}}].)", f"{CUT}$0")
    long = lambda part: F.length(part) > UNIT
    cut_long = lambda part: F.when(long(part), F.regexp_extract_all(part, F.lit(_UNITS), F.lit(0))).otherwise(F.array(part))
    by_word = F.transform(F.array(F.split(marked, CUT)), lambda w: F.when(F.exists(w, long), F.flatten(F.transform(w, cut_long))).otherwise(w))[0]
    odd = (text == "") | F.contains(text, F.lit(CUT)) | F.contains(text, F.lit(SPACE)) | F.contains(text, F.lit("  ")) | F.startswith(text, F.lit(" "))
    return F.when(odd, units(text)).otherwise(by_word)


def viterbi(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit, path (array of struct(end, id)) for the distinct rows of words (unit), by pieces (piece, id, cost) of at most longest characters.

    A path is the cheapest way to cut a unit into pieces; end is the place of a piece's last character. Of ways of equal
    cost the one whose last piece is shortest wins at each place. A character that no piece covers stands for itself, with
    a null id. Null units give no rows and empty ones an empty path. Other columns of words stay with their unit. pieces is
    broadcast: it has the size of a vocabulary. A unit has at most 127 characters; words should be partitioned by unit, as
    then nothing else is shuffled.
    """
    if longest >= 1 << _SIZE_BITS:
        raise ValueError(f"pieces of {longest} characters are too long")
    own = words.columns
    # One number for each end and size; a group's own number, not its unit, comes first in sorting.
    numbered = words.where("unit is not null").distinct().select(F.monotonically_increasing_id().alias("group"), "*")
    spans = numbered.select("*", F.explode_outer(F.sequence(F.lit(0), F.nullif(F.length("unit"), F.lit(0)) * longest - 1)).alias("span"))
    spans = spans.select("group", *own, (F.floor(F.col("span") / longest) - F.col("span") % longest + 1).cast("int").alias("start"), (F.col("span") % longest + 1).alias("size")).where("start is null or start > 0")
    edges = spans.join(F.broadcast(pieces), F.substring("unit", F.col("start"), F.col("size")) == F.col("piece"), "left").where("id is not null or size = 1 or size is null")
    end, cost, place = (F.col("start") + F.col("size") - 1).cast("long"), F.coalesce("cost", F.lit(UNKNOWN_COST)).cast("long"), F.coalesce("id", F.lit(_UNKNOWN)).cast("long")
    edge = F.shiftleft(end, _END_AT) + F.shiftleft(cost, _COST_AT) + F.shiftleft(F.col("size").cast("long"), _ID_BITS) + place
    lattice = edges.groupBy("group", *own).agg(F.array_sort(F.collect_list(edge)).alias("edges"))

    def step(way: Column, e: Column) -> Column:
        """way: for each place before the one at hand the node of the cheapest way there, and the cheapest node so far; edges come by end."""
        best, node = way["best"], way["node"]
        end = F.shiftright(e, _END_AT).cast("int")
        start = end - F.shiftright(e, _ID_BITS).bitwiseAND((1 << _SIZE_BITS) - 1).cast("int")
        before = F.when(start == F.size(best), node).otherwise(F.get(best, start))
        to = before.bitwiseAND(-1 << _COST_AT) + e.bitwiseAND((1 << _END_AT) - 1)
        same, after = F.struct(best.alias("best"), F.least(node, to).alias("node")), F.struct(F.concat(best, F.array(node)).alias("best"), to.alias("node"))
        return F.when(F.size(best) == end, same).otherwise(after)

    first = F.struct(F.array().cast("array<bigint>").alias("best"), F.lit(0).cast("long").alias("node"))
    best = lattice.select(*own, F.aggregate("edges", first, step, lambda way: F.concat(way["best"], F.array(way["node"]))).alias("best"))

    def back(walk: Column, node: Column) -> Column:
        """walk: the place whose node comes next, the place of this node, and the pieces after it."""
        taken = F.struct(walk["at"].alias("end"), F.nullif(node.bitwiseAND(_UNKNOWN).cast("int"), F.lit(_UNKNOWN)).alias("id"))
        size = F.shiftright(node, _ID_BITS).bitwiseAND((1 << _SIZE_BITS) - 1).cast("int")
        here = walk["here"] - 1
        taken_now = F.struct((here - size).alias("at"), here.alias("here"), F.concat(F.array(taken), walk["path"]).alias("path"))
        return F.when((here == walk["at"]) & (here > 0), taken_now).otherwise(F.struct(walk["at"].alias("at"), here.alias("here"), walk["path"].alias("path")))

    begin = F.struct((F.size("best") - 1).alias("at"), F.size("best").alias("here"), F.array().cast("array<struct<end:int,id:int>>").alias("path"))
    return best.select(*own, F.aggregate(F.reverse("best"), begin, back)["path"].alias("path"))


def _spelt(unit: Column, path: Column, byte_ids: list[int]) -> Column:
    """The ids of a path; characters without one are spelt by the bytes of their UTF-8."""
    table = F.array(*[F.lit(i) for i in byte_ids])
    octets = lambda at: F.regexp_extract_all(F.hex(F.encode(F.substring(unit, at, F.lit(1)), "UTF-8")), F.lit(".."), F.lit(0))
    spelt = lambda at: F.transform(octets(at), lambda x: F.element_at(table, F.conv(x, 16, 10).cast("int") + 1))
    with_bytes = F.flatten(F.transform(path, lambda p: F.when(p["id"].isNull(), spelt(p["end"])).otherwise(F.array(p["id"]))))
    return F.when(F.exists(path, lambda p: p["id"].isNull()), with_bytes).otherwise(F.transform(path, lambda p: p["id"]))


def encode(docs: DataFrame, model_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip for each row of docs (doc_id, text).

    round_trip tells whether decoding the ids gives the text again: always, but where a text holds the space mark itself,
    which comes back as a space. A null or empty text has no ids and comes back empty. Repeated rows are each encoded.
    Other columns are ignored; an empty table gives no rows.
    """
    spark, model = docs.sparkSession, load(model_path)
    texts, n = _blocks(docs, block_bytes)
    # Which blocks have which part, dealt by part. A part keeps its first block, so that both uses read both columns and this
    # exchange is made once.
    seen = texts.select("block", F.explode(parts(F.col("text"))).alias("unit")).distinct().repartition(n, "unit")
    distinct = seen.groupBy("unit").agg(F.min("block").alias("first_block"))
    paths = viterbi(distinct, model.table(spark), model.longest)
    coded = paths.select(F.col("unit").alias("coded"), "first_block", _spelt(F.col("unit"), F.col("path"), model.byte_ids).alias("ids"))
    # The second condition only keeps first_block in use; as an equality it would be a key, and both sides be dealt again.
    where = seen.groupBy("unit").agg(F.collect_list("block").alias("blocks"), F.min("block").alias("least"))
    told = where.join(coded.hint("shuffle_hash"), (F.col("unit") == F.col("coded")) & (F.col("least") >= F.col("first_block")))
    told = _cut_clean(told.select("unit", "ids", "blocks"))
    spread = _spread(told)
    rare = told.where(F.size("blocks") < spread).select(F.explode("blocks").alias("block"), "unit", "ids", _map_of(F.col("unit"), MAPS).alias("map"))
    # Every block gets every map, if only an empty one, so that a map's number is its place.
    keys = texts.select("block").distinct()
    empty = keys.select("block", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("array<int>").alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(MAPS - 1))).alias("map"))
    tables = _tables(rare.union(empty).repartition(n, "block"), "block", "table")
    many = told.where(F.size("blocks") >= spread).select(F.lit(0).alias("all"), "unit", "ids", _map_of(F.col("unit"), COMMON_MAPS).alias("map"))
    none = spark.range(COMMON_MAPS).select(F.lit(0).alias("all"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("array<int>").alias("ids"), F.col("id").cast("int").alias("map"))
    common = _tables(many.union(none), "all", "common").select("common")
    rows = texts.groupBy("block").agg(F.collect_list(F.struct("doc_id", "text")).alias("rows"))
    find = lambda u: F.coalesce(F.element_at(F.get("common", _map_of(u, COMMON_MAPS)), u), F.element_at(F.get("table", _map_of(u, MAPS)), u))
    ids_of = lambda text: F.flatten(F.transform(parts(text), find))
    coded_rows = F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["text"].alias("text"), ids_of(r["text"]).alias("ids")))
    out = rows.join(tables.hint("shuffle_hash"), "block").crossJoin(F.broadcast(common)).select(F.inline(coded_rows))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), (_text_of(F.col("ids"), model) == F.col("text")).alias("round_trip"))


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """A table of block, doc_id, text in buckets by block, and the number of buckets. A task writes to as few as have the size of a block.

    The values of block are such that each falls into a bucket of its own.
    """
    spark = docs.sparkSession
    sizes = docs.select(F.octet_length(F.col("text").cast("string")).alias("n"), F.spark_partition_id().alias("part"))
    size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("part"), F.lit(0)).alias("last")).first()
    n = pieces_for(spark, size["n"], block_bytes)
    share = -(-n // (size["last"] + 1))
    n = max(n, share * min(n, size["last"] + 1))
    drawn = spark.range(64 * n).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("bucket"))
    of = [r["id"] for r in drawn.groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()]
    own = F.spark_partition_id() * share + F.coalesce(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)).cast("int"), F.lit(0))
    block = F.element_at(F.split(F.lit(",".join(map(str, of))), ","), F.pmod(own, F.lit(len(of))) + 1).cast("int")
    rows = docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = f"texts_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, "block").option("compression", "zstd").option("path", fresh_path(spark, "texts")).format("parquet").saveAsTable(name)
    texts = spark.table(name)
    texts.schema
    spark.sql(f"DROP TABLE {name}")  # the files stay, as the table only refers to them
    return texts, n


def _cut_clean(df: DataFrame) -> DataFrame:
    """Write a frame and read it back; its exchanges leave the disk."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return cut(df, "sentencepiece")
    finally:
        conf.set(name, before)


def _spread(told: DataFrame) -> int:
    """The least number of blocks that at most COMMON parts have; one number for each number of blocks reaches the driver."""
    left, least = COMMON, None
    for r in told.groupBy(F.size("blocks").alias("k")).count().orderBy(F.desc("k")).collect():
        left -= r["count"]
        if left < 0:
            return r["k"] + 1
        least = r["k"]
    return least or 1


def _tables(told: DataFrame, by: str, name: str) -> DataFrame:
    """by, name: a hash table of each group of told (by, unit, ids, map), whose null units only make maps."""
    maps = told.groupBy(by, "map").agg(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("unit", "ids"))).alias("entries"))
    tables = maps.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("map", "entries"))).alias("t"))
    return tables.select(by, F.transform("t", lambda x: F.map_from_entries(x["entries"])).alias(name))


def _map_of(unit: Column, maps: int) -> Column:
    return F.xxhash64(unit).bitwiseAND(maps - 1).cast("int")


def _text_of(ids: Column, model: Model) -> Column:
    """The text of ids; bytes that are not UTF-8 become U+FFFD."""
    table = F.split(F.lit(",".join(model.texts)), ",")
    octets = F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))
    return F.regexp_replace(F.make_valid_utf8(octets.cast("string")), "^ ", "")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text for each row of encoded (doc_id, ids). Null ids are no ids and null elements no text; an id that the model lacks is an error."""
    ids = F.filter(F.coalesce("ids", F.array().cast("array<int>")), lambda i: i.isNotNull())
    return encoded.select("doc_id", _text_of(ids, load(model_path)).alias("text"))
