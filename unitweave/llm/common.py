"""What the operators of this subpackage share: cutting lineage, word patterns and batch hashing."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]"

_own_folder: list[str] = []
#: Paths that this session's operators have written below the shared folder, in order.
written: list[str] = []


#: Bytes of an Arrow batch: the JVM and a Python worker each hold some at once.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may leave it unset and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="unitweave-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return "file://" + _own_folder[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    written.append(path)
    return path


def drop_written(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables and files that no frame in use reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        written.remove(path)


def bound_batches(spark: SparkSession) -> None:
    """Let the session exchange Arrow batches of at most BATCH_BYTES with Python workers, unless it has a setting of its own.

    Frames that operators return run later, so the setting stays; it changes no result.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later jobs neither recompute it nor depend on executors."""
    bound_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Words of a text as a long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, to size partitions from; one number reaches the driver."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def pieces_for(spark: SparkSession, n_bytes: int, per_piece: int) -> int:
    """How many parts keep each part near per_piece bytes, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_piece))


# ---- batch kernels: texts of an Arrow batch as one byte array -------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[65:91] = _LETTER[97:123] = True
#: Longer words are hashed by a digest of their own, shorter ones eight bytes at a time for all words together.
LONG_WORD = 64
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans of bytes. The two lanes are independent: together they make 128 bits.

    Eight bytes at a time are mixed into a state whose every bit depends on all bytes before, so no two patterns of
    letters cancel as they may in a sum of powers.
    """
    sizes = ends - starts
    wide = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(16, np.uint8)).data, strides=(1,))
    out = mix(sizes.astype(np.uint64) + _SEEDS[lane])
    at, k = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(at):
        out[at] = mix(out[at] ^ (wide[starts[at] + k] & _LOW_BYTES[np.minimum(sizes[at] - k, 8)]))
        k += 8
        at = at[sizes[at] > k]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return out


def window_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of so many hashes, by joining runs of half the length, of a quarter, and so on."""
    span = 1
    while span < length and len(hashes) > length - span:
        step = min(span, length - span)
        hashes, span = mix(mix(hashes[:-step] + np.uint64(span + step)) ^ hashes[step:]), span + step
    return hashes if span == length else hashes[:0]


def offsets_of(column: pa.Array) -> np.ndarray:
    """Where the bytes of a string or binary array's rows begin, and where the last ends; 32-bit or 64-bit in Arrow."""
    if not len(column):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


#: Rows of a slice, at most.
SLICE_ROWS = 1 << 14


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 1 << 20):
    """Cut a batch into runs of rows with about most_bytes of text, and at most SLICE_ROWS rows; a longer text stands alone."""
    offsets = offsets_of(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = min(max(first + 1, int(np.searchsorted(offsets, int(offsets[first]) + most_bytes, side="right")) - 1), first + SLICE_ROWS)
        yield batch.slice(first, last - first)
        first = last


class Texts:
    """The texts of an Arrow batch as bytes, with the words of each: byte spans, and rows' first words."""

    def __init__(self, column: pa.Array, lower: bool = False, letters: bool = False):
        """lower: A-Z become a-z. letters: words are runs of letters (ASCII letters, and all bytes beyond ASCII), in lower case."""
        column = column.cast(pa.string()).fill_null("") if column.null_count or column.type != pa.string() else column
        n = len(column)
        offsets = offsets_of(column)
        body = column.buffers()[2] if n else None
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.n, self.offsets, self.data = n, offsets - offsets[0], _LOWER[data] if lower or letters else data
        inside = _LETTER[data] if letters else ~_SPACE[data]
        if letters and len(data):  # the Latin-1 capitals, whose second byte is 0x80 to 0x9E after 0xC3
            capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            self.data[capital] += 32
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        heads = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before[heads] = False
        after[(self.offsets[1:] - 1)[self.offsets[:-1] < self.offsets[1:]]] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # row i has words first[i] .. first[i + 1] - 1
        self.counts = np.diff(self.first)

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def word_hashes(self, lane: int = 0) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends, lane)

    def prefix_hashes(self, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the words with more code points than that, and hashes of their first so many."""
        heads = np.flatnonzero((self.data & 0xC0) != 0x80)
        first, last = np.searchsorted(heads, self.starts), np.searchsorted(heads, self.ends)
        heads, out = np.append(heads, len(self.data)), []
        for n in lengths:
            at = np.flatnonzero(last - first > n)
            out.append((at, mix(span_hash(self.data, self.starts[at], heads[first[at] + n]) + np.uint64(n))))
        return out

    def windows(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all windows of so many words inside one row, and their hashes."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(hashes))
        at = np.flatnonzero(room >= length)
        return at, window_hash(hashes, length)[at]

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte, by row."""
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


# ---- files of our own formats in the shared folder ------------------------------------------------------------------


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def open_output(uri: str):
    """A stream for a new file at a URI of the shared store, with its folder made."""
    store, path = _store(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A file of the shared store for range reads."""
    store, path = _store(uri)
    return store.open_input_file(path)


def task_tag() -> str:
    """A name part that no other task attempt uses, so that a lost or repeated attempt never overwrites a good file."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else uuid.uuid4().hex
