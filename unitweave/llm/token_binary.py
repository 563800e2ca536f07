"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The most frequent ids get the smallest ranks. A rank takes 1 to 4 bytes; two bits of a control byte say how many, and
control bytes stand apart from data bytes, so that numpy decodes a whole file by table look-up. A file holds documents
in ascending doc_id order: a header, doc_ids, id counts, control bytes, data bytes. Files are written by ranges of
doc_id. Beside them a folder holds the table of ranks and the list of files, whose order gives each file's first position
in the whole stream, so that a folder can be read by its path alone.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.llm.common import bound_batches, cut, fresh_path, offsets_of, open_input, open_output, slices, task_tag

END_ID = 2
FILE_IDS = 1 << 21
#: Entries of a worker's memory of encoded matches; it starts anew when full.
REMEMBERED = 500_000
MAGIC = b"UWTOK1\0\0"
RANKS, LIST = "ranks.u32", "list"
NULL_ID = -(1 << 63)
_LIST = "first long, file string, n_ids long"

# The pre-tokenizer's pattern for texts whose characters all lie in ranges where Python's classes of letters, numbers and
# white space are surely the library's: Latin without its odd white space, and common punctuation. Others are encoded whole.
_SPACES, _LETTERS, _NUMBERS = " \t-\r", "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_MATCH = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_OTHER = re.compile("[^\0-\x1b\x20-\x84\x86-\x9f\xa1-\u024f\u2010-\u2027]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on, in order."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in itself else chr(next(others)) for b in range(256)]


class _Known(dict):
    """Remembers what make() gives for a key."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        made = self[key] = self.make(key)
        return made


class MatchEncoder:
    """Encodes texts with a byte-level BPE tokenizer file, each distinct pre-tokenizer match once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # What the library finds in a text before it is pre-tokenized: texts that hold any are encoded whole.
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = dict(enumerate(_byte_letters()))
        self.known = _Known(self._spelt)

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text by the library alone, as little-endian bytes of self.dtype."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelt(self, match: str) -> bytes:
        """One match, spelt in the letters of its bytes and merged by the library's model."""
        spelt = match.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same ids as whole()."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for text in texts:
            if _OTHER.search(text) or self.added.search(text):
                out += self.whole([text])
            else:
                out.append(b"".join(map(self.known.__getitem__, _MATCH.findall(text))))
        return out


_encoders: dict[str, MatchEncoder] = {}


def _encoder(path: str) -> MatchEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = MatchEncoder(path)
    return _encoders[path]


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian bytes), width (bytes of an id) for docs (doc_id, text); each ends with end_id. Null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        last = np.array([end_id], encoder.dtype).tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x + last for x in ids], pa.binary()), pa.array(np.full(len(ids), encoder.dtype.itemsize, np.int32))], names=["doc_id", "ids", "width"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids binary, width int")


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch's rows, and how many each row has."""
    column = batch.column(batch.schema.get_field_index("ids"))
    offsets = offsets_of(column)
    width = batch.column(batch.schema.get_field_index("width"))[0].as_py() if len(column) else 4
    body = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return body.view(f"<u{width}").astype(np.uint32), np.diff(offsets) // width


def id_ranks(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency over all documents (ties: smaller id first). At most one row for each id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_ids_of(batch)[0])
            if len(found) > len(total):
                total = np.pad(total, (0, len(found) - len(total)))
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = encoded.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


_CODES = np.arange(256)
_LENGTHS = np.stack([(_CODES >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), wide[np.arange(4) < lengths[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks that pack() was given."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    body = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = body[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        ranks[more] |= body[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def write_files(encoded: DataFrame, folder: str, by_rank: np.ndarray) -> None:
    """Write encoded documents in doc_id order below folder, with the ranks and a list of the files: first (doc_id), file, n_ids."""
    with open_output(f"{folder}/{RANKS}") as out:
        out.write(by_rank.astype("<u4").tobytes())
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, part, docs, counts, ids, held = task_tag(), 0, [], [], [], 0

        def flush():
            nonlocal part, docs, counts, ids, held
            name = f"{folder}/{tag}-{part:06d}.uwt"
            all_ids, all_docs, all_counts = np.concatenate(ids), np.concatenate(docs), np.concatenate(counts)
            control, data = pack(rank_of[all_ids])
            with open_output(name) as out:
                out.write(MAGIC + np.array([len(all_docs), len(all_ids), len(control), len(data)], "<i8").tobytes())
                for x in (all_docs.astype("<i8").tobytes(), all_counts.astype("<i8").tobytes(), control, data):
                    out.write(x)
            row = {"first": int(all_docs[0]), "file": name, "n_ids": len(all_ids)}
            part, docs, counts, ids, held = part + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("first", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64())]))

        for whole in batches:
            for batch in slices(whole, "ids", 1 << 20):
                found, n = _ids_of(batch)
                docs.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                counts.append(n)
                ids.append(found)
                held += len(found)
                if held >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    bound_batches(encoded.sparkSession)
    ordered.mapInArrow(write, _LIST).write.parquet(f"{folder}/{LIST}")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each document, decoded from
    the files of a folder. An empty folder list gives no rows; a file of another kind is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_input(f"{folder}/{RANKS}") as source:
            by_rank = np.frombuffer(source.read(), "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["file"]) as source:
                    raw = source.read()
                if raw[:8] != MAGIC:
                    raise ValueError(f"{row['file']} is not a token file")
                n_docs, n_ids, n_control, n_data = np.frombuffer(raw, "<i8", 4, 8).tolist()
                at = 40
                docs, counts = np.frombuffer(raw, "<i8", n_docs, at), np.frombuffer(raw, "<i8", n_docs, at + 8 * n_docs)
                at += 16 * n_docs
                ids = by_rank[unpack(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], n_ids)].astype("<u4")
                ends = np.cumsum(counts)
                body = ids.view(np.uint8)
                for first in range(0, n_docs, 2000):
                    some = range(first, min(n_docs, first + 2000))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[first : some.stop], mask=docs[first : some.stop] == NULL_ID),
                            pa.array(row["start"] + ends[first : some.stop] - counts[first : some.stop]),
                            pa.array(counts[first : some.stop]),
                            pa.array([zlib.crc32(body[4 * (ends[i] - counts[i]) : 4 * ends[i]]) for i in some], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy(F.col("first"), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = spark.read.schema(_LIST).parquet(f"{folder}/{LIST}")
    placed = files.withColumn("start", before).select("file", "start")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of docs (doc_id, text), read back from the files they were written to.

    A null text is empty and has only the end id. A null doc_id comes first. Rows that share a doc_id are documents of
    their own, in the order of their ids. Other columns are ignored; an empty table gives no files and no rows.
    """
    encoded = cut(encode_ids(docs, tokenizer_path, end_id), "encoded")
    folder = fresh_path(docs.sparkSession, "token-ids")
    write_files(encoded, folder, id_ranks(encoded))
    return read_files(docs.sparkSession, folder)
