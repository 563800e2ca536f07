"""Tables between stages: written once to the folder that all executors share, then read by whatever follows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the session's spark.checkpoint.dir. Only a local session may leave that unset and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="unitweave-stages-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = "file://" + _own[0]
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """df as a table of its own: its plan ends here, later uses do not compute it again, and lost executors cost nothing."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
