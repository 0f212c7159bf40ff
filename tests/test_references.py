import datetime as dt
import random

from codelode.operators.references import PARENT, REF, merge_references, orphan_counts, table_key
from codelode.operators.skew import hot_keys
from pyspark.sql import functions as F

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
R = "ref_table string, row_id long, ref_field string, kind string, repo string, key string, at timestamp, extra int, status string"
P = "kind string, repo string, key string, valid_from timestamp, valid_to timestamp, extra int"


def refs(spark, rows):
    return spark.createDataFrame([("e", i, "f", "node", r, k, t, 1, "x") for i, (r, k, t) in enumerate(rows)], R)


def parents(spark, rows):
    return spark.createDataFrame([("node", *r, 1) for r in rows], P)


def by_row(df):
    return {r["row_id"]: r["status"] for r in df.collect()}


def test_status_of_each_case(spark):
    p = parents(spark, [("a", "X", T(10), T(20)), ("a", "X", T(30), None), ("a", "X", T(30), None), ("a", "Y", None, None)])
    r = refs(spark, [("a", "X", T(10)), ("a", "X", T(20)), ("a", "X", T(5)), ("a", "X", T(35)), ("b", "X", T(15)), ("a", "Z", T(1)), ("a", "Y", T(1)), (None, "X", T(15)), ("a", "X", T(25))])
    assert by_row(merge_references(r, p)) == {0: "ok", 1: "deleted", 2: "late", 3: "ok", 4: "missing", 5: "missing", 6: "ok", 7: "missing", 8: "deleted"}


def test_null_keys_empty_tables_and_repeats(spark):
    p = parents(spark, [("a", None, T(1), None), (None, "X", T(1), None)])
    assert by_row(merge_references(refs(spark, [("a", None, T(1)), ("a", "X", T(1))]), p)) == {1: "missing"}
    assert merge_references(refs(spark, []), p).count() == 0
    none = parents(spark, [])
    twice = refs(spark, [("a", "X", T(1))])
    assert merge_references(twice.union(twice), none).count() == 2


def test_hot_keys_agree_with_brute_force(spark):
    rng = random.Random(5)
    ps = [("a", rng.choice("PQRS"), T(s := rng.randint(0, 60)), rng.choice([None, T(s + rng.randint(0, 30))])) for _ in range(40)]
    rs = [("a", rng.choice("PPPPPQRZ"), T(rng.randint(0, 90))) for _ in range(400)]
    got = by_row(merge_references(refs(spark, rs), parents(spark, ps), hot_rows=30))
    for i, (r, k, t) in enumerate(rs):
        own = [p for p in ps if p[:2] == (r, k)]
        want = "missing" if not own else "ok" if any(p[2] <= t and (p[3] is None or t < p[3]) for p in own) else "late" if all(p[2] > t for p in own) else "deleted"
        assert got[i] == want, (i, r, k, t)


def test_one_key_of_a_third_is_spread(spark):
    rows = spark.range(300_000).select(F.lit("node").alias("kind"), F.lit("a").alias("repo"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("key"))
    hot = hot_keys(rows, ["kind", "repo", "key"], 5_000)
    assert [tuple(r) for r in hot.collect()] == [("node", "a", "HOT", 100_000)]
    assert hot_keys(rows, ["kind", "repo", "key"], 100_000) is None and hot_keys(rows.limit(0), ["key"], 1) is None
    ref = rows.select(F.lit("e").alias("ref_table"), F.monotonically_increasing_id().alias("row_id"), F.lit("f").alias("ref_field"), "kind", "repo", "key", F.lit(T(5)).alias("at"))
    merged = merge_references(ref, parents(spark, [("a", "HOT", T(1), None)]), hot_rows=5_000)
    assert merged.where("status = 'ok'").count() == 100_000


def test_counts_and_table_keys(spark):
    found = merge_references(refs(spark, [("a", "X", T(1)), ("a", "Y", T(40))]), parents(spark, []))
    assert {(r["month"], r["n_orphans"]) for r in orphan_counts(found).collect()} == {("2024-01", 1), ("2024-02", 1)}
    df = spark.createDataFrame([("public.`Users`",), ('"app"."x y"',), (" t ",)], "n string")
    assert [r[0] for r in df.select(table_key(F.col("n"))).collect()] == ["users", "xy", "t"]
    assert REF[0] == "ref_table" and PARENT[0] == "kind"
