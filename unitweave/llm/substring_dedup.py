"""Substring dedup by level-wise doubling.

A window can only be repeated if every shorter window inside it is. Windows are therefore tested at one length, and only
those repeated at that length are extended to twice the length and tested again, up to the wanted length; the search ends
where nothing survives. At lengths below the wanted one each wanted window is stood for by one shorter window inside it,
the one with the smallest hash, which is the same wherever the wanted window occurs: no repeat is lost and a small share
of positions is exchanged. The last level compares 96-bit digests and finds the smallest doc_id of each window.

Tasks combine what they read before they exchange it: a window that many documents of a task share is sent once, and
what that task already knows about it goes straight to its documents. So the rows of a passage that a third of all
documents share grow with the number of tasks, not of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import SLICE_ROWS, Texts, cut, mix, pieces_for, slices, text_bytes

WINDOW = 13
FIRST_LENGTH = 7
PART_BYTES = 16 << 20
#: A task exchanges what it has combined after so many windows or documents; a batch names its documents with 16 bits.
HELD_WINDOWS, HELD_DOCS = 1_000_000, (1 << 16) - SLICE_ROWS
_SHORT = np.uint64((1 << 48) - 1)
_NULL = (1 << 63) - 1

_BLOCK = "part int, batch long, kind int, docs binary, at binary, hashes binary, positions binary"
_ANSWER = "batch long, docs binary, at binary, items binary"
_FACT = "doc_key long, tag long, found binary"


def lengths(window: int, first: int) -> list[int]:
    """Window lengths of the levels: doubling from first, ending with the wanted one."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _standing(texts: Texts, hashes: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted window, the position of the shorter window that stands for it, and all shorter windows' hashes by position."""
    at, short = texts.windows(hashes, length)
    by_position = np.zeros(len(hashes) + 1, np.uint64)
    by_position[at] = short
    room = np.repeat(texts.first[1:], texts.counts) - np.arange(len(hashes))
    wanted = np.flatnonzero(room >= window)
    best, place = by_position[wanted], wanted.copy()
    for k in range(1, window - length + 1):
        other = by_position[wanted + k]
        less = np.flatnonzero(other < best)
        best[less] = other[less]
        place[less] = wanted[less] + k
    return wanted, np.stack([place, best.view(np.int64)]) if len(wanted) else np.zeros((2, 0), np.int64)


def _parts_of(hashes: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Indices of hashes by part."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[x[0]]), x) for x in np.split(order, cuts)] if len(order) else []


def _docs_blob(keys: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """The documents that some rows use, and each row's place among them."""
    used, at = np.unique(docs, return_inverse=True)
    return keys[used].tobytes(), _places(at, len(used))


def _places(at: np.ndarray, n: int) -> bytes:
    if n > 1 << 16:
        raise OverflowError(f"{n} documents in a batch")
    return at.astype("<u2").tobytes()


def _six(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _rows(rows: list[tuple], batch: int) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    columns.insert(1, [batch] * len(rows))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["part", "batch", "kind", "docs", "at", "hashes", "positions"])


# Kinds of exchanged blocks: windows that wait for other tasks' answer, windows known to be repeated, and facts that are
# known already and only pass through.
_WAITING, _REPEATED, _KNOWN = 0, 1, 2


def _short_blocks(keys: np.ndarray, docs: np.ndarray, hashes: np.ndarray, parts: int) -> list[tuple]:
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    many = np.diff(np.append(np.flatnonzero(head), len(h))) > 1
    shared = np.repeat(many, np.diff(np.append(np.flatnonzero(head), len(h)))) if len(h) else np.zeros(0, bool)
    rows = []
    for part, at in _parts_of(h[~shared], parts):
        rows.append((part, _WAITING, *_docs_blob(keys, d[~shared][at]), _six(h[~shared][at] & _SHORT), b""))
    for part, at in _parts_of(h[head & shared], parts):
        rows.append((part, _REPEATED, b"", b"", _six(h[head & shared][at] & _SHORT), b""))
    if shared.any():
        rows.append((int(mix(keys[d[shared][:1], 0].astype(np.uint64))[0] % np.uint64(parts)), _KNOWN, *_docs_blob(keys, d[shared]), _six(h[shared] & _SHORT), b""))
    return rows


def _long_blocks(keys: np.ndarray, docs: np.ndarray, first: np.ndarray, second: np.ndarray, positions: np.ndarray, parts: int) -> list[tuple]:
    ids, tags = keys[docs, 0], keys[docs, 1]
    order = np.lexsort((positions, docs, tags, ids, second, first))
    a, b, i, t, d, p = first[order], second[order], ids[order], tags[order], docs[order], positions[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.repeat(i[head], np.diff(np.append(np.flatnonzero(head), len(a)))) if len(a) else i
    later = i > least
    asks = head.copy()  # rows that share the least doc_id but not the text each ask
    asks[1:] |= (t[1:] != t[:-1]) & ~later[1:]
    rows = []
    for part, at in _parts_of(a[asks], parts):
        x = np.flatnonzero(asks)[at]
        rows.append((part, _WAITING, *_docs_blob(keys, d[x]), np.stack([a[x], b[x]], axis=1).astype("<u8").view(np.uint8).reshape(-1, 16)[:, :12].tobytes(), p[x].astype("<u4").tobytes()))
    if later.any():
        by_doc = np.lexsort((p[later], d[later]))
        d, p = d[later][by_doc], p[later][by_doc]
        rows.append((int(mix(keys[d[:1], 0].astype(np.uint64))[0] % np.uint64(parts)), _KNOWN, *_docs_blob(keys, d), b"", p.astype("<u4").tobytes()))
    return rows


def _by_document(docs: np.ndarray, items: np.ndarray) -> pd.DataFrame:
    """Facts (bytes of each document's items) from rows of (doc_id, tag) and their items."""
    order = np.lexsort((docs[:, 1], docs[:, 0]))
    docs, items = docs[order], items[order]
    cuts = np.flatnonzero((docs[1:] != docs[:-1]).any(axis=1)) + 1
    heads = np.concatenate([[0], cuts]).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
    return pd.DataFrame({"doc_key": docs[heads, 0], "tag": docs[heads, 1], "found": [x.tobytes() for x in np.split(items, cuts)] if len(docs) else []})


def _answer(last: bool):
    """What a part answers to each batch that asked it: which of its windows (hashes or positions) are repeated, by document."""

    def answer(block: pd.DataFrame) -> pd.DataFrame:
        docs, items, hashes, kinds, batches = [], [], [], [], []
        for batch, kind, d, at, h, p in zip(block["batch"], block["kind"], block["docs"], block["at"], block["hashes"], block["positions"]):
            keys = np.frombuffer(d, "<i8").reshape(-1, 2)
            docs.append(keys[np.frombuffer(at, "<u2")] if kind != _REPEATED else np.full((len(h) // 6, 2), _NULL, np.int64))
            n = len(docs[-1])
            if last:
                wide = np.zeros((n, 16), np.uint8)
                if kind == _WAITING:
                    wide[:, :12] = np.frombuffer(h, np.uint8).reshape(-1, 12)
                hashes.append(wide.view("<u8"))
                items.append(np.frombuffer(p, "<u4"))
            else:
                hashes.append(_from_six(h))
                items.append(np.frombuffer(h, np.uint8).reshape(-1, 6))
            kinds.append(np.full(n, kind))
            batches.append(np.full(n, batch))
        docs, items, hashes, kinds, batches = (np.concatenate(x) for x in (docs, items, hashes, kinds, batches))
        known, asked = kinds == _KNOWN, np.flatnonzero(kinds != _KNOWN)
        if last:
            order = asked[np.lexsort((docs[asked, 0], hashes[asked, 1], hashes[asked, 0]))]
            h = hashes[order]
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]).any(axis=1)
            runs = np.diff(np.append(np.flatnonzero(head), len(h)))
            hit = docs[order, 0] > np.repeat(docs[order[head], 0], runs) if len(h) else np.zeros(0, bool)
        else:
            order = asked[np.argsort(hashes[asked], kind="stable")]
            h = hashes[order]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            runs = np.diff(np.append(np.flatnonzero(head), len(h)))
            repeated = np.maximum.reduceat(kinds[order] == _REPEATED, np.flatnonzero(head)) if len(h) else np.zeros(0, bool)
            hit = np.repeat((runs > 1) | repeated, runs) & (kinds[order] == _WAITING)
        chosen = np.concatenate([np.flatnonzero(known), order[hit]])
        chosen = chosen[np.argsort(batches[chosen], kind="stable")]
        cuts = np.flatnonzero(np.diff(batches[chosen])) + 1
        rows = []
        for some in np.split(chosen, cuts) if len(chosen) else []:
            used, at = np.unique(docs[some], axis=0, return_inverse=True)
            rows.append((int(batches[some[0]]), used.astype("<i8").tobytes(), _places(at, len(used)), items[some].tobytes()))
        return pd.DataFrame(rows, columns=["batch", "docs", "at", "items"])

    return answer


def _gather(last: bool):
    """All answers to one batch as facts, one row for each of its documents."""

    def gather(block: pd.DataFrame) -> pd.DataFrame:
        docs = [np.frombuffer(d, "<i8").reshape(-1, 2)[np.frombuffer(at, "<u2")] for d, at in zip(block["docs"], block["at"])]
        items = [np.frombuffer(x, "<u4") if last else np.frombuffer(x, np.uint8).reshape(-1, 6) for x in block["items"]]
        return _by_document(np.concatenate(docs), np.concatenate(items))

    return gather


def _candidates(texts: Texts, hashes: np.ndarray, window: int, length: int, found: list[list[bytes]]) -> np.ndarray:
    """The wanted windows whose standing window of a length is among the hashes found for their document."""
    wanted, (place, best) = _standing(texts, hashes, window, length)
    row = np.searchsorted(texts.first, wanted, side="right") - 1
    known = [_from_six(b"".join(x)) for x in found]
    known_row = np.repeat(np.arange(len(known)), [len(x) for x in known]).astype(np.uint64)
    known = np.sort(mix((np.concatenate(known) if known else np.zeros(0, np.uint64)) ^ mix(known_row + np.uint64(1))))
    mine = mix((best.view(np.uint64) & _SHORT) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    if not len(known):
        return wanted[:0]
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    return wanted[known[at] == mine]


def _exchange(rows: DataFrame, window: int, length: int, below: int | None, parts: int) -> DataFrame:
    """Facts of one level for rows (doc_key, tag, text, found: facts of the level below, if any)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, docs, columns, n_docs, held, sent = [], [], [[], [], []], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, docs, columns, n_docs, held, sent
            k, d = np.concatenate(keys), np.concatenate(docs)
            made = [np.concatenate(x) for x in columns if x]
            keys, docs, columns, n_docs, held, sent = [], [], [[], [], []], 0, 0, sent + 1
            return _rows(_long_blocks(k, d, *made, parts) if length == window else _short_blocks(k, d, made[0], parts), TaskContext.get().partitionId() << 24 | sent)

        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column(2))
                if not texts.counts.size or texts.counts.max() < window:
                    continue
                hashes = texts.word_hashes()
                chosen = None if below is None else _candidates(texts, hashes, window, below, [x or [] for x in batch.column(3).to_pylist()])
                if length == window:
                    at, first = texts.windows(hashes, window)
                    second = texts.windows(texts.word_hashes(lane=1), window)[1]
                    pick = np.arange(len(at)) if chosen is None else np.searchsorted(at, chosen)
                    row = np.searchsorted(texts.first, at[pick], side="right") - 1
                    made = (first[pick], second[pick] & np.uint64(0xFFFFFFFF), at[pick] - texts.first[row])
                else:
                    wanted, (place, best) = _standing(texts, hashes, window, length)
                    pick = np.arange(len(wanted)) if chosen is None else np.searchsorted(wanted, chosen)
                    place, once = np.unique(place[pick], return_index=True)
                    row, made = np.searchsorted(texts.first, place, side="right") - 1, (best.view(np.uint64)[pick][once],)
                keys.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
                docs.append(row + n_docs)
                for x, y in zip(columns, made):
                    x.append(y)
                n_docs, held = n_docs + texts.n, held + len(row)
                if held >= HELD_WINDOWS or n_docs >= HELD_DOCS:
                    yield flush()
        if keys:
            yield flush()

    blocks = rows.mapInArrow(send, _BLOCK)
    # A task for each part: hashing the few parts would put several into one task and none into another.
    answers = blocks.repartitionById(parts, "part").groupBy("part").applyInPandas(_answer(length == window), _ANSWER)
    facts = answers.groupBy("batch").applyInPandas(_gather(length == window), _FACT)
    return facts.groupBy("doc_key", "tag").agg(F.collect_list("found").alias("found"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, first_length: int = FIRST_LENGTH) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (doc_key, tag, text), and for those with windows that a smaller doc_id has too, the windows' positions."""
    spark = docs.sparkSession
    parts = pieces_for(spark, text_bytes(docs), PART_BYTES)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_key"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))
    below, facts = None, None
    for length in lengths(window, first_length):
        some = rows if facts is None else rows.join(facts, ["doc_key", "tag"]).select("doc_key", "tag", "text", "found")
        facts = cut(_exchange(some, window, length, below, parts), f"repeats-{length}")
        if facts.isEmpty():
            break
        below = length
    return rows, facts


def remove_repeats(docs: DataFrame, window: int = WINDOW, first_length: int = FIRST_LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space) for each row of docs (doc_id, text).

    A word goes if a window of so many words covers it whose words also begin in a document with a smaller doc_id; windows
    are judged on the input. Words are unchanged runs of other characters than ASCII white space. Null and empty texts
    have no words. A null doc_id counts as larger than every other. Rows that repeat a doc_id are not repeats of one
    another and are each judged. Other columns are ignored; an empty table gives no rows.
    """
    rows, facts = repeated_windows(docs, window, first_length)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = Texts(batch.column(1))
                lost = np.zeros(len(texts.starts) + 1, np.int64)
                found = [np.frombuffer(b"".join(x), "<u4").astype(np.int64) if x else np.zeros(0, np.int64) for x in batch.column(2).to_pylist()]
                if any(len(x) for x in found):
                    at, hashes = texts.windows(texts.word_hashes(), window)
                    row = np.searchsorted(texts.first, at, side="right") - 1
                    hashes = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))
                    told = np.searchsorted(at, np.concatenate([x + texts.first[i] for i, x in enumerate(found)]))
                    hit = at[np.isin(hashes, hashes[told])]
                    np.add.at(lost, hit, 1)
                    np.add.at(lost, hit + window, -1)
                gone = np.cumsum(lost)[:-1] > 0
                counts, digests, kept = [], [], []
                for i in range(texts.n):
                    a, b = texts.first[i], texts.first[i + 1]
                    words = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().split()
                    if gone[a:b].any():
                        words = [w for w, x in zip(words, gone[a:b].tolist()) if not x]
                    text = b" ".join(words)
                    counts.append(b - a - len(words))
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts.counts.astype(np.int64)), pa.array(counts, pa.int64()), pa.array(digests), pa.array(kept, pa.string())], names=["doc_key", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(facts, ["doc_key", "tag"], "left").select("doc_key", "text", "found")
    out = joined.mapInArrow(strip, "doc_key long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(F.when(F.col("doc_key") != _NULL, F.col("doc_key")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")
