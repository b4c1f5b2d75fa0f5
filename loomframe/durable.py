"""Tables cut from their lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        wanted = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not wanted:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            wanted = tempfile.mkdtemp(prefix="loomframe-")
        sc.setCheckpointDir(wanted)
        folder = sc._jsc.sc().getCheckpointDir()
    return folder.get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that lost executors cost no recomputation of what is above."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of tables that are cut and otherwise out of use; else they may stay until memory is short."""
    spark._jvm.System.gc()


def publish(df: DataFrame, folder: str, name: str) -> bool:
    """df written as Parquet beside folder/name and moved there by one rename; False, and nothing written, if the name is taken."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    aside, place = path(f"{folder}/_{name}-{uuid.uuid4().hex}"), path(f"{folder}/{name}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place):
        return False
    df.write.parquet(aside.toString())
    if fs.exists(place) or not fs.rename(aside, place):
        fs.delete(aside, True)
        return False
    return True


def discard(spark: SparkSession, place: str) -> None:
    """Removes a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
