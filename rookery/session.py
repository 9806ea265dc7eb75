"""Session-level helpers: table access and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a
    laptop) a folder of our own is made and set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rookery-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in a folder of this application that is deleted when its driver ends."""
    context = spark.sparkContext
    own = f"{shared_dir(spark)}/rookery/{context.applicationId}"
    if getattr(context, "_rookery_work", None) != own:
        place = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        context._rookery_work = own
    return f"{own}/{label}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Delete everything this application has written below the shared folder; tables read from there are gone then."""
    own = getattr(spark.sparkContext, "_rookery_work", None)
    if own:
        place = spark._jvm.org.apache.hadoop.fs.Path(own)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        spark.sparkContext._rookery_work = None


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs far more than a shuffle.

    Inputs of as many files as cores, or of as many full splits by the planner's estimate, are spread
    already and aren't moved. Nothing is run to find out. Streams stay as they are.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= cores:
        return df
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if size >= cores * split else df.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_rookery_shipped", False):
        return
    base = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="rookery-"), "rookery.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), base))
    context.addPyFile(archive)
    context._rookery_shipped = True
