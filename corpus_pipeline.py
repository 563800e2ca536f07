"""The corpus pipeline: toxic documents go, then exact and near copies, then sources are mixed and texts encoded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. run() writes each stage's result and reads it back, as a cluster would between jobs, and removes what only
the stages before have used.

Null texts count as empty in every stage. Rows with null or repeated doc_ids are judged and taken row by row. An empty
table gives an empty result. Columns beside those of documents stay as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unitweave.llm import exact_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from unitweave.llm.common import cut, drop_written, written
from unitweave.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learnt from the labels of sf_dir that are not held out, does not predict toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for ASCII white space."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of rows linked from a similarity of 0.8 on five-word shingles."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a source at its cap is taken three times, others partly."""
    return mixing.repeat_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip of each row."""
    return sentencepiece_codec.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The first stage's classifier cannot be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for place, (_, stage) in enumerate(STAGES):
        mark = len(written)
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut(docs, "pipeline")
            *used, kept = written[mark:]
            drop_written(spark, before + used)
            before = [kept]
    return docs
