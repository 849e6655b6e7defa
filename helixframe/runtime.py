"""Session helpers: tables, the checkpoint folder, skew-safe building blocks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder of spark.checkpoint.dir; where that is unset, a local session gets a folder of its own, and on a
    cluster, where executors couldn't share one, it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="helixframe-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint, which all executors can read again after a loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder as compressed Parquet and read from there: a smaller checkpoint for larger tables."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, upon which the shuffle files of jobs that are over are deleted; else they stay until its
    memory is short, and the disk may be first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster runs tasks at once, for work that costs far more than reading.

    Large inputs come in more splits than that and are left as they are; only small ones are shuffled. df must be a scan
    with narrow steps, so that its partitions are known without running anything.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def distinct_rows(df: DataFrame, id_col: str) -> DataFrame:
    """One row for each id, for tables whose rows may be re-sent under the same id with equal columns.

    Rows with a null id can't be told from a re-sent row and are left out.
    """
    return df.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
