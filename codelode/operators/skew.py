"""Keys that hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16


def hot_keys(rows: DataFrame, keys: list[str], least: int, most: int = 1000) -> DataFrame | None:
    """(keys, n_rows) of the keys with more rows than ``least`` and than a ``most``-th of all rows; None if there is none.

    So there are at most ``most`` of them at any size of the data, which bounds what is broadcast, and any other key holds at most a ``most``-th of
    the rows or ``least``. Rows are counted in a fixed number of hash buckets first, so each task sends at most that many counts; only the rows of
    buckets above the bound are counted by key. Rows with a null key are not counted.
    """
    known = rows.select(*keys).dropna()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    counts = known.groupBy(bucket.alias("bucket")).count().collect()  # at most BUCKETS rows
    bound = max(least, sum(r["count"] for r in counts) // most)
    heavy = [r["bucket"] for r in counts if r["count"] > bound]
    if not heavy:
        return None
    found = known.where(bucket.isin(heavy)).groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > bound)
    hot = found.collect()  # at most ``most`` rows
    return rows.sparkSession.createDataFrame(hot, found.schema) if hot else None
