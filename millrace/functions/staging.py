"""Tables written once in the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, whose executors are the driver, gets one of its own where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            path = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _own.append(path)
            spark.sparkContext.setCheckpointDir(f"file://{path}")
        base = _own[0]
    return base if "://" in base else f"file://{base}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete what stage() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/millrace/" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
