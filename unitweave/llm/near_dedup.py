"""MinHash near-dedup with odd sketches.

Each document's distinct five-word shingles give MinHash samples. Bands of samples find candidates; the samples folded
into a bitmap of parities (an odd sketch) tell from the population count of an exclusive-or how similar two candidates
are, precisely so for high similarities; what the sketch does not rule out is confirmed on the full shingle sets.

Documents with equal sets are one class from the start. Within a bucket of a band, members are first compared with one
member that stands for it, another in each round, as long as that links anything; only then are the members of different
components compared among themselves. So a large group of copies costs a comparison for each member, not for each pair,
and still no link between different components is missed: a pair is left out only if it is in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.llm.common import Texts, cut, mix, slices

SHINGLE = 5
PERCENT = 85
#: The limit where one row of each component is kept.
KEEP_PERCENT = 80
BANDS, ROWS = 40, 6  # a pair shares no band with a chance of 5e-6 at a similarity of 0.8, and of 6e-9 at 0.85
SKETCH_BITS = 512
#: Sketches that differ in more bits are ruled out: a difference over 140 is six deviations off at a similarity of 0.8, eight at 0.85.
MOST_DIFFERENT = 140
WORDS64 = SKETCH_BITS // 64
#: Parts of a set's documents that look for their class apart.
SALTS = 32
#: Members of a bucket that one task compares among themselves.
BLOCK = 512
_MULTIPLIERS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and the rows' first places. A shorter text is one shingle."""
    words = texts.word_hashes()
    at, hashes = texts.windows(words, shingle)
    short = np.flatnonzero((texts.counts > 0) & (texts.counts < shingle))
    if len(short):
        whole = [texts.windows(words, int(n)) for n in range(1, shingle)]
        extra = np.array([whole[texts.counts[r] - 1][1][np.searchsorted(whole[texts.counts[r] - 1][0], texts.first[r])] for r in short], np.uint64)
        at, hashes = np.concatenate([at, texts.first[short]]), np.concatenate([hashes, extra])
    row = np.searchsorted(texts.first, at, side="right") - 1
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(texts.n + 1))


def _signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set that has members: band hashes, sketch words and two sums that name the set."""
    full = np.flatnonzero(np.diff(first))
    heads = first[full]
    base = (h >> np.uint64(32)).astype(np.uint32)
    samples = np.stack([np.minimum.reduceat(base * a + c, heads) for a, c in zip(_MULTIPLIERS, _ADDENDS)], axis=1)
    wide = samples.astype(np.uint64)
    bands = np.stack([mix(sum(mix(wide[:, b * ROWS + k] + np.uint64(k + 1 << 33)) for k in range(ROWS)) + np.uint64(b)) for b in range(BANDS)], axis=1)
    bits = (mix(wide + (np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32))) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    odd = np.bincount((bits + np.arange(len(full))[:, None] * SKETCH_BITS).ravel(), minlength=len(full) * SKETCH_BITS).reshape(-1, SKETCH_BITS) & 1
    sketch = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")
    names = np.stack([np.add.reduceat(mix(h + np.uint64(k)), heads) for k in (1, 2)], axis=1)
    return bands.view(np.int64), sketch, names.view(np.int64)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, and for non-empty sets name (two longs), bands and sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                h, first = shingle_sets(Texts(batch.column(1), lower=True))
                sizes = np.diff(first)
                empty = sizes == 0
                columns = [np.zeros((len(sizes), n), np.int64) for n in (2, BANDS, WORDS64)]
                if len(h):
                    for out, made in zip((columns[1], columns[2], columns[0]), _signatures(h, first)):
                        out[~empty] = made
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), *lists], names=["doc_id", "n_shingles", "name", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, name array<long>, bands array<long>, sketch array<long>")


def _sketch_columns(side: str, sketch: str = "sketch") -> list:
    return [F.element_at(sketch, k + 1).alias(f"{side}{k}") for k in range(WORDS64)]


def _near_enough() -> object:
    return sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(WORDS64)), F.lit(0)) <= MOST_DIFFERENT


def _not_ruled_out(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches are near enough."""
    left = sketches.select(F.col("node").alias("a"), *_sketch_columns("a"))
    right = sketches.select(F.col("node").alias("b"), *_sketch_columns("b"))
    return pairs.join(left, "a").join(right, "b").where(_near_enough()).select("a", "b")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes as bytes) of the documents named by nodes (node)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                h, first = shingle_sets(Texts(batch.column(1), lower=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(nodes.distinct().hint("merge"), "node", "left_semi")
    return rows.mapInArrow(sets, "node long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) with 100 * common shingles >= percent * all shingles of both."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _block_links(rows: dict[str, list], percent: int) -> list[tuple[int, int]]:
    """Links between different components of one block pair of a bucket, as few as join all that are linked."""
    component, side, own = (np.array(rows[x]) for x in ("component", "side", "band"))
    n, band = len(component), int(own[0])
    sketch, bands = np.array(rows["sketch"], np.int64).view(np.uint64), np.array(rows["bands"], np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    sizes = np.array([len(x) for x in sets])
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for i in range(n):
        after = np.arange(i + 1, n)
        after = after[(component[after] != component[i]) & ((side[after] != side[i]) | (side[i] < 0))]
        after = after[100 * np.minimum(sizes[after], sizes[i]) >= percent * np.maximum(sizes[after], sizes[i])]
        after = after[np.bitwise_count(sketch[after] ^ sketch[i]).sum(axis=1) <= MOST_DIFFERENT]
        after = after[~(bands[after, :band] == bands[i, :band]).any(axis=1)]  # the first band that two share compares them
        if len(after):
            mine, others = sets[i], np.concatenate([sets[j] for j in after])
            same = mine[np.minimum(np.searchsorted(mine, others), len(mine) - 1)] == others
            both = np.add.reduceat(same.astype(np.int64), np.r_[0, np.cumsum(sizes[after])[:-1]])
            for j in after[100 * both >= percent * (sizes[after] + sizes[i] - both)].tolist():
                x, y = find(int(component[i])), find(int(component[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((rows["node"][i], rows["node"][j]))
    return links


def compare_blocks(placed: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different components within buckets, for rows (key, band, node, component, bands, sketch, shingles).

    A bucket larger than a block is dealt out as pairs of blocks, so that no task holds more than two blocks of a bucket.
    """
    sizes = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    rows = placed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    rows = rows.withColumn("side", F.when(F.col("low") == F.col("high"), -1).otherwise(F.col("own")))
    rows = rows.select("key", "low", "high", "band", "node", "component", "side", "bands", "sketch", "shingles").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    names = rows.columns

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = {n: [] for n in names}, None
        found: list[tuple[int, int]] = []

        def finish() -> None:
            if len(held["node"]) > 1:
                found.extend(_block_links(held, percent))
            for x in held.values():
                x.clear()

        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            for i, here in enumerate(zip(columns["key"], columns["low"], columns["high"])):
                if here != at:
                    finish()
                    at = here
                for n in names:
                    held[n].append(columns[n][i])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
                found.clear()
        finish()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for edges (a, b), by alternating stars until nothing changes.

    Each round points every node's larger neighbours, then its smaller ones, to the smallest it knows. The number of
    rounds follows the logarithm of the longest path. Edges stay spread over the cluster; the driver sees two numbers.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        small = small.where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if (now["n"], now["s"]) == state:
            break
        state = (now["n"], now["s"])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(found.withColumnRenamed("component", "known"), "node", "left").withColumn("component", F.coalesce("known", "node")).drop("known")


def link_classes(docs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, component for those of the class representatives (node, bands, sketch) that are linked with another."""
    rows = sketches.select("node", F.posexplode("bands").alias("band", "key"))
    several = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"), "bucket-keys")
    open_buckets = cut(rows.join(several, "key", "left_semi").select("key", "band", "node").distinct(), "buckets")
    some = cut(sketches.join(open_buckets.select("node").distinct(), "node", "left_semi").select("node", "bands", "sketch"), "bucket-sketches")
    sets = cut(full_sets(docs, some.select("node")), "bucket-sets")
    found, tried, turn, before = None, None, 0, -1
    while True:
        placed, stands = _open(open_buckets, found, turn)
        pairs = placed.join(stands, "key").where(F.col("s.component") != F.col("component"))
        pairs = pairs.select(F.least("node", "s.node").alias("a"), F.greatest("node", "s.node").alias("b")).distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut(_not_ruled_out(pairs, some), "pairs")
        fresh = cut(confirm(pairs, sets, percent), "links")
        n = fresh.count()
        tried = pairs if tried is None else tried.unionByName(pairs)
        if n:
            found = components(_with_found(fresh, found))
        open_buckets, turn = cut(placed.join(stands, "key", "left_semi").select("key", "band", "node"), "buckets"), turn + 1
        if n == 0 or 4 * n < before:
            break
        before = max(before, n)
    placed, stands = _open(open_buckets, found, turn)
    placed = cut(placed.join(stands, "key", "left_semi"), "open-buckets")
    fresh = cut(compare_blocks(placed.join(some.join(sets, "node"), "node"), percent), "links")
    return components(_with_found(fresh, found))


def _with_found(links: DataFrame, found: DataFrame | None) -> DataFrame:
    """New links, and a link from each node to the component that older ones gave it."""
    return links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))


def _open(buckets: DataFrame, found: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets (key, band, node) with their component, and for each key with several components the member that
    stands for it in a turn. Keys are aggregated before they are shuffled, and both tables are written, so that a join of
    them can be split where a key has very many members."""
    placed = cut(_with_component(buckets, found), "placed")
    order = F.struct(F.col("node")) if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"))
    chosen = F.min(F.struct(order.alias("o"), F.col("node").alias("node"), F.col("component").alias("component"))).alias("s")
    stands = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), chosen)
    return placed, cut(stands.where("low < high").select("key", "s"), "stands")


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    A set holds the distinct five-word shingles of the text with A-Z in lower case; a text of fewer words is one shingle;
    without words the set is empty and linked with nothing. Documents are linked whose sets have a Jaccard similarity of
    percent or more, and component_id is the smallest doc_id reachable. Rows that repeat a doc_id count as one document
    that has the links of any of them. A null doc_id is a component of its own with a null id, kept, and links nothing.
    Other columns are ignored; an empty table gives no rows.
    """
    sketched = cut(sketch_documents(docs), "sketches")
    named = sketched.where("n_shingles > 0 and doc_id is not null")
    # The least doc_id of a set's salts, then of the set: a set that a third of all documents share meets in no task.
    salted = named.select("doc_id", "name", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    least = salted.groupBy("name", "salt").agg(F.min("doc_id").alias("node"))
    least = least.withColumn("node", F.min("node").over(Window.partitionBy("name")))
    classes = cut(salted.join(least, ["name", "salt"]).select("doc_id", "node").distinct(), "classes")
    heads = classes.where("doc_id = node").select("node").distinct()
    sketches = named.select(F.col("doc_id").alias("node"), "bands", "sketch").join(heads, "node", "left_semi")
    linked = link_classes(docs, sketches, percent)
    ids = classes.join(linked, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    out = sketched.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = KEEP_PERCENT) -> DataFrame:
    """The rows of docs that stand for their component at this limit, with all their columns.

    Where each row has a doc_id of its own, the one with the smallest stays. Where ids repeat or are null, rows are
    numbered and each is a document of its own: of a component the row with the smallest number stays.
    """
    odd = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("id is null or n > 1")
    if odd.isEmpty():
        lost = near_groups(docs, percent).where("not kept").select(F.col("doc_id").alias("lost_id"))
        return docs.join(lost, docs["doc_id"].cast("long") == lost["lost_id"], "left_anti")
    # Numbers hold as the numbered rows are written before they are used.
    rows = cut(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*[docs[c] for c in docs.columns]).alias("row")), "numbered")
    lost = near_groups(rows.select(F.col("number").alias("doc_id"), "row.text"), percent).where("not kept").select(F.col("doc_id").alias("number"))
    return rows.join(lost, "number", "left_anti").select("row.*")
