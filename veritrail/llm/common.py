"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.scratch import forget, materialise

__all__ = ["forget", "id_crc", "materialise", "own_name", "table", "without"]


def own_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores added as keep it apart from df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: set[str] | list[str]) -> DataFrame:
    """df without columns of these names, whatever their case: an operator's own columns win."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def id_crc(id_col: str | Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
