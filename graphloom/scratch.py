"""Scratch tables in the folder that every node of the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is set only for local runs that name none. On a cluster it must be
    named, as the executors' own disks are not shared."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what ``write_table`` wrote, once nothing reads it any more."""
    jvm, path = df.sparkSession.sparkContext._jvm, df.scratch_path
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
