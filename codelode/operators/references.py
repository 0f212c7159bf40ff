"""References to records that do not exist.

References and the validity intervals of the parents are put into one stream, co-partitioned by
(kind, repo, key) and sorted by time; one linear pass over the merged streams keeps the number of open
intervals. A reference with no open interval is an orphan:

* ``missing`` - the key has no parent record at all in that repo;
* ``late``    - the first parent record begins only after the reference;
* ``deleted`` - a parent was there before, its interval has ended.

Hot keys, those with more references than ``hot_rows`` and a thousandth of all, are found by a counting pass that aggregates before its
shuffle; there are at most a thousand. Their references are spread over as many sub-partitions as their number asks for, and their few
parent rows copied to each of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.skew import hot_keys

#: the columns of a reference and of a parent
REF = ["ref_table", "row_id", "ref_field", "kind", "repo", "key", "at"]
PARENT = ["kind", "repo", "key", "valid_from", "valid_to"]


def table_key(name: Column) -> Column:
    """A table name without case, blanks, quotes, backticks and schema prefix."""
    bare = F.regexp_replace(F.lower(name), "[\\s\"'`]", "")
    return F.substring_index(bare, ".", -1)


def merge_references(refs: DataFrame, parents: DataFrame, hot_rows: int = 200_000, counted: DataFrame | None = None) -> DataFrame:
    """Every reference with its ``status``: ok, missing, late or deleted.

    refs: REF columns, ``at`` null where the parent counts at any time. parents: PARENT columns; ``valid_to`` null means
    still there, ``any_time`` parents have both ends null. Further columns are ignored, whatever their names.

    Nulls: a reference with a null key is no reference and is dropped; with a null repo it is missing. A parent with a null
    repo or key is nobody's parent. A parent whose ``valid_from`` is null counts from the beginning. Repeated references
    give repeated rows, repeated parents change nothing. ``counted`` (kind, repo, key), by default the references, is what hot keys are told by: any frame
    with at least as many rows of each key will do, such as the rows before they were made unique. Empty tables give an empty result, or all missing.
    """
    keys = ["kind", "repo", "key"]
    refs = refs.select(*REF).where(F.col("key").isNotNull())
    parents = parents.select(*PARENT).where(F.col("repo").isNotNull() & F.col("key").isNotNull())
    hot = hot_keys(refs if counted is None else counted, keys, hot_rows)
    salts = lambda df: df.withColumn("salts", F.lit(1)) if hot is None else df.join(F.broadcast(hot.select(*keys, F.ceil(F.col("n_rows") / hot_rows).cast("int").alias("salts"))), keys, "left")
    # references without a repo have no parent, wherever they are sent
    salt = F.pmod(F.xxhash64("row_id"), F.coalesce("salts", F.lit(1)))
    salted = salts(refs).withColumn("salt", F.when(F.col("repo").isNull(), F.pmod(F.xxhash64("row_id"), F.lit(1 << 16))).otherwise(salt).cast("int"))
    far_past = F.lit("0001-01-01 00:00:00").cast("timestamp")
    some_time = lambda c: c.cast("timestamp")
    marks = F.array(
        F.struct(some_time(F.coalesce(F.col("valid_from"), far_past)).alias("t"), F.lit(1).alias("d")),
        F.struct(some_time(F.col("valid_to")).alias("t"), F.lit(-1).alias("d")),
        # the header: sorts before every time, says that the key is known at all
        F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit(0).alias("d")),
    )
    events = (
        salts(parents)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .withColumn("m", F.explode(marks))
        .where((F.col("m.d") >= 0) | F.col("m.t").isNotNull())
        .select(*keys, "salt", F.col("m.t").alias("t"), F.lit(0).alias("is_ref"), F.col("m.d").alias("d"),
                *[F.lit(None).cast(k).alias(c) for c, k in (("ref_table", "string"), ("row_id", "long"), ("ref_field", "string"), ("at", "timestamp"))])
    )
    last = F.lit("9999-12-31 00:00:00").cast("timestamp")
    asks = salted.select(*keys, "salt", F.coalesce(F.col("at").cast("timestamp"), last).alias("t"), F.lit(1).alias("is_ref"), F.lit(0).alias("d"),
                         "ref_table", F.col("row_id").cast("long").alias("row_id"), "ref_field", F.col("at").cast("timestamp").alias("at"))
    w = Window.partitionBy(*keys, "salt").orderBy(F.col("t").asc_nulls_first(), F.col("is_ref")).rowsBetween(Window.unboundedPreceding, 0)
    merged = events.unionByName(asks).select(
        "*",
        F.sum("d").over(w).alias("open"),
        F.max(F.when(F.col("is_ref") == 0, 1).otherwise(0)).over(w).alias("known"),
        F.max(F.when(F.col("d") > 0, 1).otherwise(0)).over(w).alias("begun"),
    )
    status = (
        F.when(F.col("open") > 0, "ok").when(F.col("known") == 0, "missing").when(F.col("begun") == 0, "late").otherwise("deleted")
    )
    return merged.where("is_ref = 1").select("ref_table", "row_id", "ref_field", "repo", "key", "at", status.alias("status"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field, month and status; the month is null where the reference has no time."""
    return (
        found.where("status <> 'ok'")
        .groupBy("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("month"), "status")
        .agg(F.count("*").alias("n_orphans"))
    )
