"""Models as exchangeable parts, with deterministic defaults that need no model files.

A provider turns a table into a table, so that one backed by a neural model can load it once for each Python worker with
mapInArrow. The defaults are rules; results of neural models differ from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.functions import numeric as N
from unitweave.functions import text as T
from unitweave.functions import vocab


class LanguageTagger(Protocol):
    def tag(self, rows: DataFrame) -> DataFrame:
        """rows with a raw_affiliation_string get a language."""


class SpanTagger(Protocol):
    def spans(self, rows: DataFrame) -> DataFrame:
        """rows with a text get spans: array<struct<entity_group, start, end, word, score>>."""


class EntityTagger(Protocol):
    def entities(self, rows: DataFrame) -> DataFrame:
        """rows with a text get entities, of the same type as spans."""


class Embedder(Protocol):
    def embed(self, names: DataFrame) -> DataFrame:
        """Distinct names (name) get an embedding: array<float> of length 1."""


class RuleLanguageTagger:
    def tag(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("language", T.language(F.col("raw_affiliation_string")))


def _pieces(text, pattern: str, group):
    """Stretches between separators, with their offsets, as entity structs."""
    parts = F.split(text, pattern)
    placed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<entity_group:string,start:int,end:int,word:string,score:double>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + 1).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        group(p).alias("entity_group"),
                        (acc["at"] + F.length(p) - F.length(F.ltrim(p))).alias("start"),
                        (acc["at"] + F.length(F.rtrim(p))).alias("end"),
                        F.trim(p).alias("word"),
                        F.lit(1.0).cast("double").alias("score"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return F.filter(placed["out"], lambda e: e["word"] != "")


class RuleSpanTagger:
    """A span for each part between semicolons."""

    def spans(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("spans", _pieces(F.col("text"), ";", lambda p: F.lit("SPAN")))


class RuleEntityTagger:
    """An entity for each part between commas: ORG with a word for a whole institution, SUB with another type word."""

    ORGANISATIONS = ("university", "univ", "hospital", "academy", "université", "universität", "universidad")

    def entities(self, rows: DataFrame) -> DataFrame:
        org, sub = (rf"(?U)\b(?:{'|'.join(words)})\b" for words in (self.ORGANISATIONS, vocab.TYPE_WORDS))
        kind = lambda p: F.when(F.lower(p).rlike(org), "ORG").when(F.lower(p).rlike(sub), "SUB").otherwise("LOC")
        return rows.withColumn("entities", _pieces(F.col("text"), ",", kind))


class TokenModelTagger:
    """Entities from a token classifier that each Python worker loads once.

    load() gives a model; model(texts) gives for each text a list of tokens (start, end, mask, logits), and labels names
    the logits in order. Scores are softmax shares; decoding is that of decode_tags().
    """

    _TOKENS = "array<struct<start:int,end:int,mask:int,logits:array<double>>>"

    def __init__(self, load, labels: tuple[str, ...]):
        self.load, self.labels = load, labels

    def entities(self, rows: DataFrame) -> DataFrame:
        return self._tagged(rows, "entities")

    def spans(self, rows: DataFrame) -> DataFrame:
        return self._tagged(rows, "spans")

    def _tagged(self, rows: DataFrame, name: str) -> DataFrame:
        from unitweave.operators.entities import decode_tags

        load, at = self.load, rows.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("mask", pa.int32()), ("logits", pa.list_(pa.float64()))]))
            for batch in batches:
                found = model([x or "" for x in batch.column(at).to_pylist()])
                told = [[{"start": s, "end": e, "mask": m, "logits": [float(x) for x in logits]} for s, e, m, logits in tokens] for tokens in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, kind)], names=[*batch.schema.names, "tokens"])

        schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", tokens {self._TOKENS}"
        names = F.array(*[F.lit(x) for x in self.labels])

        def tagged(t):
            best = N.softmax_best(t["logits"])
            return F.struct(F.get(names, best["index"]).alias("label"), best["score"].alias("score"), t["start"].alias("start"), t["end"].alias("end"), t["mask"].alias("mask"))

        return rows.mapInArrow(run, schema).withColumn(name, decode_tags(F.transform("tokens", tagged), F.coalesce("text", F.lit("")))).drop("tokens")


class ModelEmbedder:
    """Vectors of a text encoder that each Python worker loads once: load() gives a model, model(names) a row of numbers for
    each name. Vectors come out at length 1; a zero vector stays zero."""

    def __init__(self, load, batch_size: int = 64):
        self.load, self.batch_size = load, batch_size

    def embed(self, names: DataFrame) -> DataFrame:
        load, most = self.load, self.batch_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for batch in batches:
                for first in range(0, batch.num_rows, most):
                    some = batch.slice(first, most)
                    made = np.asarray(model([x or "" for x in some.column(0).to_pylist()]), np.float32)
                    made = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
                    yield pa.RecordBatch.from_arrays([some.column(0), lists], names=["name", "embedding"])

        return names.select("name").distinct().mapInArrow(run, "name string, embedding array<float>")


class HashEmbedder:
    """Counts of hashed character trigrams, of length 1; computed for a whole Arrow batch at once."""

    def __init__(self, size: int = 256):
        self.size = size

    def embed(self, names: DataFrame) -> DataFrame:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                told = [f"  {x or ''} " for x in batch.column(0).to_pylist()]
                points = np.frombuffer("".join(told).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                row = np.repeat(np.arange(len(told)), [len(x) for x in told])
                three = np.flatnonzero(row[2:] == row[:-2])
                hashed = (points[three] * np.uint64(0x9E3779B97F4A7C15) + points[three + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + points[three + 2]
                hashed = (hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
                counts = np.bincount(row[three] * size + (hashed % np.uint64(size)).astype(np.int64), minlength=len(told) * size).reshape(-1, size).astype(np.float32)
                counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(told) + 1, dtype=np.int32) * size), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["name", "embedding"])

        return names.select("name").distinct().mapInArrow(run, "name string, embedding array<float>")
