"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir of the session.

    A local session (master local) that has none gets a temporary folder of its one
    machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the execution inside go at its end: what it made is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends here, and
    work that is lost with an executor after this point is not repeated."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _tidied(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    with _tidied(df.sparkSession):
        return df.checkpoint()


def placed(df: DataFrame, name: str) -> DataFrame:
    """df, a plain read of Parquet files, and each row's place from 0 in the order of the
    files' names and of their rows. Only the files are counted; no row is moved."""
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = cut(df.select(file.alias("__file"), row.alias("__index")).groupBy("__file").agg(F.count("*").alias("c"), F.max("__index").alias("last")))
    if not files.where("c <> last + 1").isEmpty():
        raise ValueError("places need all rows of the files")
    before = F.coalesce(F.sum("c").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.select(*df.columns, file.alias("__file"), row.alias("__index"))
    return out.join(F.broadcast(files.select("__file", before.alias("__start"))), "__file").select(*df.columns, (F.col("__start") + F.col("__index")).alias(name))


@contextmanager
def bucketed(df: DataFrame, name: str, key: str) -> Iterator[DataFrame]:
    """df stored below the shared folder in as many buckets by key as shuffles have
    partitions, for joins by key that leave its rows where they are. The table's name
    goes at the end, its files stay."""
    spark = df.sparkSession
    table_name = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _tidied(spark):
        df.write.option("path", scratch(spark, name)).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table_name, format="parquet")
    try:
        yield spark.table(table_name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
