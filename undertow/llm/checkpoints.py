"""Cutting lineage so that it outlives executors: always through the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; where that is unset (tests, local runs), one of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="undertow-checkpoints-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the shared checkpoint folder."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, hashes: bool = False) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read again. For wide rows, of which a
    checkpoint would keep an uncompressed copy; ``hashes`` spares columns that nothing makes smaller the attempt."""
    spark = df.sparkSession
    ensure_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4_raw" if hashes else "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.undertow_path = path
    return out


def discard(written: DataFrame) -> None:
    """Remove the files of a ``table`` that nothing reads any more. Shuffle files behind it go as the driver collects
    its garbage, which a driver with memory to spare would put off while they fill the executors' disks."""
    spark = written.sparkSession
    spark.sparkContext._jvm.System.gc()
    path = spark._jvm.org.apache.hadoop.fs.Path(written.undertow_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
