"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str | None, columns: list[str]) -> DataFrame:
    """One record for each id: the last loaded row, and of several such the greatest by its columns.

    Rows with a null id are dropped: they are no record. Aggregates before the shuffle (max of a struct), so that a
    key which holds very many repeated rows costs one row for each map task.
    """
    rest = [c for c in columns if c not in (key, version)]
    packed = F.struct(*([F.col(version)] if version else []), *[F.col(c) for c in rest])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(packed).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in ([version] if version else []) + rest])
    )


def current(results: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """Those of ``results`` (made row by row, with key and version) that stem from the last loaded row of their id.

    Only the narrow (key, version) pairs are shuffled, never the texts. A null version is older than any other.
    """
    old = F.lit("0001-01-01").cast("timestamp")
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(F.col(version), old)).alias("_last"))
    return (
        results.join(last, key)
        .where(F.coalesce(F.col(version), old) == F.col("_last"))
        .drop("_last", version)
        .distinct()
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows of a table over at least as many partitions as there are cores, for costly work in Python on few large row groups.

    A row group can't be split and texts are not worth a shuffle, so a table with fewer partitions than cores is read as often as it takes to
    give each core a slice of the keys: reading is far cheaper than the work that follows. Any table with enough partitions stays as it is.
    """
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if n >= cores or not n:
        return df
    slices = -(-cores // n)
    parts = [df.where(F.pmod(F.xxhash64(key), F.lit(slices)) == k) for k in range(slices)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
