"""The row-local stages on a stream of raw strings, and counts of names with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.functions import text as T


def tag_stream(strings: DataFrame) -> DataFrame:
    """A stream or table of raw_affiliation_string with language and the cleaned text."""
    return strings.withColumn("language", T.language(F.col("raw_affiliation_string"))).withColumn("text", T.clean_affiliation(F.col("raw_affiliation_string")))


def count_names(strings: DataFrame, time: str = "seen_at", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of cleaned department names by window of time; rows later than the watermark are left out."""
    named = strings.withColumn("clean_dept_str", T.clean_department(F.col("raw_dept_str"))).where("clean_dept_str != ''")
    return named.withWatermark(time, late).groupBy(F.window(time, window).alias("period"), "clean_dept_str").agg(F.count(F.lit(1)).alias("frequency"))
