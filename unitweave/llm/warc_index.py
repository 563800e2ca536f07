"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record. The index sorts captures by reversed-host URL key into compressed blocks
of lines; a part's directory keeps the first key, place and length of each block, and the list of parts, a file beside
them, keeps the first key of each part. A look-up binary-searches the parts, the part's directory and the block, and reads
one range of one archive. Parts are ranges of the sort order, so a host with most captures spreads over many parts. Each
record has a name of its own, so rows that repeat url and page_id stay apart; the folder alone is enough to look up.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import cut, fresh_path, open_input, open_output, pieces_for, task_tag

LEAST_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 512
#: Captures that a task looks up, at most.
LOOK_UPS = 20_000
PARTS = "parts.json"
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: com,example,www)/path?query; what has no host is kept as it is."""
    safe = quote(url or "-", safe="%/:?#[]@!$&'()*+,;=~", encoding="utf-8")
    try:
        host = urlsplit(safe).hostname
    except ValueError:
        host = None
    if not host:
        return safe
    tail = safe.split("://", 1)[-1]
    cuts = [i for i in (tail.find("/"), tail.find("?"), tail.find("#")) if i >= 0]
    return ",".join(reversed(host.split("."))) + ")" + (tail[min(cuts) :] if cuts else "/")


def _plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html and, for revisits, the page_id and url of the response that holds the same payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.where(F.octet_length("html") >= LEAST_BYTES).select("page_id", "url", F.sha2("html", 256).alias("payload"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    best = keyed.groupBy("payload", "salt").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = best.groupBy("payload").agg(F.max("best").alias("best"), F.sum("n").alias("n")).where("n > 1")
    best = best.select("payload", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url"))
    again = keyed.join(best, ["payload", "salt"]).where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = again.select(F.col("page_id").alias("again_id"), F.col("payload").alias("again_payload"), "refers_to", "refers_url").distinct()
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.sha2("html", 256) == F.col("again_payload"))
    return rows.join(again, same, "left").select("page_id", "url", "html", "refers_to", "refers_url")


def _record(page_id: int | None, record: str, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    clean = lambda x: quote(x or "-", safe="%/:?#[]@!$&'()*+,;=~", encoding="utf-8")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    body = http if again else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{record}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {clean(refers_url)}"] if again else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of one record, and its payload (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives for pages (page_id, url, html) below folder; returns captures: key, page_id, record, file, offset, length.

    record names a record among all that were written; a repeated task gives other names.
    """

    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, part, out, at, n = task_tag(), 0, None, 0, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None:
                    name, at = f"{folder}/archive/{tag}-{part:04d}.warc.gz", 0
                    out, part = open_output(name), part + 1
                record, n = f"{tag}-{n:09d}", n + 1
                member = gzip.compress(_record(row["page_id"], record, row["url"], row["html"].encode(), row["refers_to"], row["refers_url"]), 1, mtime=0)
                out.write(member)
                rows.append((url_key(row["url"]), row["page_id"], record, name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["key", "page_id", "record", "file", "offset", "length"])
        if out is not None:
            out.close()

    return cut(_plan_records(pages).mapInArrow(write, "key string, page_id long, record string, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> None:
    """Write index parts below folder, and a list of them in order: first line, file, place of the part's directory."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/index/{task_tag()}.cdx"
        out, at, directory, lines = None, 0, [], []

        def flush() -> None:
            nonlocal out, at, lines
            if lines:
                out = out or open_output(name)
                block = zlib.compress("\n".join(lines).encode(), 6)
                out.write(block)
                directory.append((lines[0], at, len(block)))
                at, lines = at + len(block), []

        for batch in batches:
            for row in batch.to_pylist():
                lines.append(_line(row["key"], row["page_id"], row["record"]) + "\t" + json.dumps([row["file"], row["offset"], row["length"]]))
                if len(lines) >= block_lines:
                    flush()
        flush()
        if out is not None:
            out.write(zlib.compress(json.dumps(directory).encode(), 6))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "file": name, "at": at}], pa.schema([("first", pa.string()), ("file", pa.string()), ("at", pa.int64())]))

    ordered = captures.withColumn("place", F.concat(F.col("key"), F.lit("\t"), _padded("page_id"), F.lit("\t"), F.col("record"))).repartitionByRange("place").sortWithinPartitions("place")
    parts = ordered.select("key", "page_id", "record", "file", "offset", "length").mapInArrow(write, "first string, file string, at long")
    listed = sorted(((r["first"], r["file"], r["at"]) for r in cut(parts, "index-parts").collect()), key=lambda p: p[0].encode())
    with open_output(f"{folder}/{PARTS}") as out:
        out.write(json.dumps(listed).encode())


def _padded(column: str):
    """A page_id as 20 digits that sort like the number; null sorts first."""
    return F.coalesce(F.lpad((F.col(column).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), F.lit("-"))


def _line(key: str, page_id: int | None, record: str = "") -> str:
    return f"{key}\t" + ("-" if page_id is None else f"{page_id + (1 << 63):020d}") + f"\t{record}"


class CaptureIndex:
    """Look-ups in the index of a folder; blocks, directories and open archives that were used last stay at hand."""

    def __init__(self, folder: str, keep: int = 16):
        with open_input(f"{folder}/{PARTS}") as source:
            self.parts = json.loads(source.read())
        self.firsts, self.keep = [p[0].encode() for p in self.parts], keep
        self._kept: dict[str, OrderedDict] = {"directory": OrderedDict(), "block": OrderedDict(), "file": OrderedDict(), "record": OrderedDict()}

    def _at_hand(self, kind: str, key, make):
        kept = self._kept[kind]
        if key not in kept:
            kept[key] = make()
            if len(kept) > self.keep:
                kept.popitem(last=False)
        kept.move_to_end(key)
        return kept[key]

    def _range(self, file: str, offset: int, length: int) -> bytes:
        source = self._at_hand("file", file, lambda: open_input(file))
        source.seek(offset)
        return source.read(length)

    def _directory(self, part: int) -> tuple[list[bytes], list]:
        def make():
            _, file, at = self.parts[part]
            source = self._at_hand("file", file, lambda: open_input(file))
            rows = json.loads(zlib.decompress(self._range(file, at, source.size() - at)))
            return [r[0].encode() for r in rows], rows

        return self._at_hand("directory", part, make)

    def _lines(self, part: int, block: int) -> list[bytes]:
        _, at, length = self._directory(part)[1][block]
        return self._at_hand("block", (part, block), lambda: zlib.decompress(self._range(self.parts[part][1], at, length)).split(b"\n"))

    def find(self, key: str, page_id: int | None, record: str = "") -> Iterator[tuple[str, int, int]]:
        """The archive, offset and length of each capture of a key and page_id in turn, or of the record of that name alone."""
        wanted = _line(key, page_id, record).encode() + (b"\t" if record else b"")
        part = max(bisect.bisect_right(self.firsts, wanted) - 1, 0)
        block = max(bisect.bisect_right(self._directory(part)[0], wanted) - 1, 0) if self.parts else 0
        while part < len(self.parts):
            lines = self._lines(part, block)
            for line in lines[bisect.bisect_left(lines, wanted) :]:
                if not line.startswith(wanted):
                    return
                yield tuple(json.loads(line.split(b"\t")[-1]))
            block += 1
            if block == len(self._directory(part)[1]):
                part, block = part + 1, 0

    def read(self, place: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        """Headers and payload of the record at a place."""
        return self._at_hand("record", place, lambda: parse_record(gzip.decompress(self._range(*place))))

    def record(self, key: str, page_id: int | None, record: str = "") -> tuple[dict[str, str], bytes]:
        for place in self.find(key, page_id, record):
            return self.read(place)
        raise KeyError(f"no capture of {key} {page_id} {record}")

    def response(self, key: str, page_id: int | None, digest: str) -> bytes:
        """The payload with this digest that a response of the key and page_id holds."""
        for place in self.find(key, page_id):
            headers, payload = self.read(place)
            if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] == digest:
                return payload
        raise KeyError(f"no response of {key} {page_id} with {digest}")


def read_captures(wanted: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest of captures (key, page_id, record), each found through
    the index of a folder. A revisit's payload is read from the response it refers to; a capture that is not there is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder)
        page = lambda x: int(x) if x else None
        for batch in batches:
            rows = []
            for key, page_id, record in zip(*(batch.column(i).to_pylist() for i in range(3))):
                headers, payload = index.record(key, page_id, record)
                refers = None
                if headers["WARC-Type"] == "revisit":
                    refers = page(headers["WARC-Refers-To"][10:-1])
                    url = headers["WARC-Refers-To-Target-URI"]
                    payload = index.response(url_key(None if url == "-" else url), refers, headers["WARC-Payload-Digest"])
                digest = hashlib.sha1(payload)
                if base64.b32encode(digest.digest()).decode() != headers["WARC-Payload-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"payload digest of page {page_id} differs")
                rows.append((page(headers["WARC-Record-ID"][10:-1].split(":")[0]), headers["WARC-Target-URI"], headers["WARC-Type"], refers, len(payload), digest.hexdigest()))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    tasks = pieces_for(wanted.sparkSession, wanted.count(), LOOK_UPS)
    placed = wanted.select("key", "page_id", "record").repartitionByRange(tasks, "key", "page_id", "record").sortWithinPartitions("key", "page_id", "record")
    return placed.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archive pages (page_id, url, html), index the archives, and read every capture back through the index.

    A null html is an empty payload. Of equal payloads of at least 1000 bytes the one with the largest page_id is the
    response and the others revisit it; smaller ones are all responses. Null urls stand as "-". Rows that repeat a
    page_id, or a page_id and url, are records of their own and each read back; with the largest page_id of a payload
    they are all responses. Other columns are ignored; an empty table gives no rows.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    write_index(captures, folder)
    return read_captures(captures, folder)
