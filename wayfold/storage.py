"""The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

Executors and the driver share no local disk, so whatever outlives a stage goes there.
Only a session in one process (``local[...]``, as in tests) may go without the setting.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get(FOLDER, None)
    if named is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {FOLDER} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(FOLDER, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to a new folder and read it back: cuts the lineage, keeps columns prunable."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
