"""Writing moderated tables, and where jobs may write on the cluster."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The posting's fields in the final record.
RECORD_FIELDS = (
    "title description requirements benefits city_codes province district address company employment money_str"
).split()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """One folder for all sessions of a process that have no shared one; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="sangloc-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's `spark.checkpoint.dir`.

    Only a session whose driver is its one executor may leave the setting out.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    Cuts the lineage: a lost executor does not recompute earlier stages, later plans stay
    small, and their join strategies see true sizes.  `removed` takes the folder away again.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame, per_core: int = 1) -> DataFrame:
    """The rows of a table, dealt out where it has fewer than `per_core` splits for each core; for rows that are costly to process.

    A few small files may be cut into as many splits as there are cores and yet have rows in one split each, where a file is
    one row group: with two splits a core that is ruled out, as splits are then of the size of a row group.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(cores, splits)) if splits < per_core * cores else df


def removed(*tables: DataFrame) -> None:
    """Delete the folders of staged tables that no later step reads."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove_folder(table.sparkSession, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store its scheme names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of whatever store; none where it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def response_json(df: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, status, response): the final record, with the repaired posting, as JSON text; `error` is null."""
    posting = F.struct(*[F.coalesce(f"{c}_fixed", c).alias(c) if f"{c}_fixed" in df.columns else F.col(c) for c in RECORD_FIELDS if c in df.columns])
    record = F.struct(
        key, "num_error", "status_text", F.col("messages").alias("message"), posting.alias("posting"), F.lit(None).cast("string").alias("error")
    )
    response = F.to_json(record, {"ignoreNullFields": "false"})
    return df.select(key, "status", response.alias("response"))


def write_moderated(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write the final records partitioned by status."""
    df.write.mode(mode).partitionBy("status").format(fmt).save(path)
    return path
