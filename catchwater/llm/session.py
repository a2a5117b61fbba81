"""What the operators take from the session."""

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, so that later steps read files and not a long lineage.

    The folder is spark.checkpoint.dir; only where a local session sets none, as in tests, a temporary one serves.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def few(df: DataFrame, rows: int, each: int = 4096) -> DataFrame:
    """df in as many partitions as so many rows fill, one a core at least; it never gets more than it has.

    Small tables else take a task for each shuffle partition in every step, which may cost far more than their rows.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of rows that have an id; other columns are left behind, so none can clash."""
    return df.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(text, '') as text", *more).where("doc_id is not null")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
