"""Tables that outlive one query, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.model import InvalidConfig

_WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a private folder, a cluster without one is an error."""
    known = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.tidemark.folder", "")
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise InvalidConfig("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.tidemark.folder", known)
    return known.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that sweep() deletes."""
    path = f"{folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: its plan ends here."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete all that was written so far; results that read it can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        place = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        place.getFileSystem(conf).delete(place, True)
