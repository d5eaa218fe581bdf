"""Written intermediate tables: they cut lineage, and a lost executor repeats no more than one of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. One of this machine's only where Spark runs on it alone, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="veritrail-"))
    return _own[0]


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; other jobs have theirs beside it."""
    return f"{scratch_root(spark)}/veritrail/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_parts(spark: SparkSession) -> int:
    """The number of partitions for work that is many times what its bytes suggest."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; the result knows its folder, for forget()."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*written: DataFrame) -> None:
    """Delete what materialise() wrote, once what reads it has been written too. Other tables are left alone."""
    for df in written:
        if path := getattr(df, "written_to", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application wrote; for the end of a job, when no result reads it any more."""
    _delete(spark, own_folder(spark))
