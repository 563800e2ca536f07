"""Readers and writers at the edges: CSV, JSON lines, Parquet and JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header. Only an empty cell is null: texts such as NA stay texts."""
    df = spark.read.options(**_CSV, nullValue="", enforceSchema=False).schema(schema).csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, quote_all: bool = False, one_file: bool = False) -> None:
    """CSV with a header and empty cells for null; one_file is for release tables that a person downloads."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=quote_all, nullValue="", emptyValue="").csv(path)


def read_entities(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Entity rows from JSON lines, and how many lines were no JSON. Rows without id or entities are left out; a missing frequency is 1."""
    raw = spark.read.schema(schema + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    good = raw.where("raw_affiliation_string_id is not null").where(F.size(F.coalesce("entities", F.array().cast(raw.schema["entities"].dataType))) > 0)
    broken = raw.agg(F.count("_broken").alias("broken_lines"), F.count(F.lit(1)).alias("lines"), F.count("raw_affiliation_string_id").alias("with_id"))
    return good.withColumn("frequency", F.coalesce("frequency", F.lit(1)).cast("long")).drop("_broken"), broken


def write_entities(df: DataFrame, path: str) -> None:
    """JSON lines of rows that have entities."""
    df.where(F.size("entities") > 0).write.mode("overwrite").json(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table or query of a relational database, read in parts by ranges of a number column."""
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()
