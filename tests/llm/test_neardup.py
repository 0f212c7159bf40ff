import random

from codelode.llm import neardup as N
from pyspark.sql import functions as F


def texts(seed=3, families=12, words=90):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for v in range(5):
            t = list(base)
            for _ in range(v * 2):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
    return out + [out[0], out[0].replace(" ", "\n"), "short text", "", "x " * 60_000]


def shingles(t):
    w = N.WORD.findall(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(ts, t, least=60):
    sets = {i: shingles(x) for i, x in enumerate(ts) if x is not None and len(N.WORD.findall(x)) >= least}
    return {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9}


def run(spark, ts, plan, extra=()):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(ts)] + list(extra), "id long, text string, version timestamp")
    return N.near_duplicates(N.sketch_texts(df, plan, 5, 60), df, lambda p: N.verify_texts(p, df, plan), plan), df


def test_all_pairs_as_brute_force(spark):
    ts, plan = texts(), N.Plan(0.6, 1)
    (pairs, members), _ = run(spark, ts, plan, [(None, ts[0], None), (500, None, None), (1, ts[1], None)])
    got = {(r["id_a"], r["id_b"]) for r in N.expand(pairs, members).collect()}
    assert got == brute(ts, 0.6) and len(got) > 30
    sim = {(r["id_a"], r["id_b"]): r["similarity"] for r in pairs.collect()}
    for (a, b), s in sim.items():
        x, y = shingles(ts[a]), shingles(ts[b])
        assert abs(s - len(x & y) / len(x | y)) < 1e-9


def test_last_version_counts(spark):
    import datetime as dt

    ts = texts()
    at = [dt.datetime(2024, 1, d) for d in (1, 2)]
    df = spark.createDataFrame([(1, ts[0], at[0]), (1, "now short", at[1]), (2, ts[0], None)], "id long, text string, version timestamp")
    plan = N.Plan(0.6, 1)
    pairs, members = N.near_duplicates(N.sketch_texts(df, plan, 5, 60), df, lambda p: N.verify_texts(p, df, plan), plan)
    assert N.expand(pairs, members).count() == 0


def test_sets_blocks_and_empty(spark):
    rng = random.Random(1)
    sets = [[rng.randrange(60) for _ in range(9)] for _ in range(40)]
    sets += [sets[0][:8] + [99], sets[0], list(sets[0]), [1, 2], [], None]
    df = spark.createDataFrame([(i, s and [x for x in s], None) for i, s in enumerate(sets)], "id long, elements array<long>, version timestamp").withColumn("elements", F.transform("elements", lambda e: F.xxhash64(e)))
    plan = N.Plan(0.7, 5)
    pairs, members = N.near_duplicates(N.sketch_sets(df, plan), df, lambda p: N.verify_sets(p, df, plan), plan)
    own = {i: set(s) for i, s in enumerate(sets) if s and len(set(s)) >= 5}
    want = {(i, j) for i in own for j in own if i < j and len(own[i] & own[j]) >= 0.7 * len(own[i] | own[j]) - 1e-9}
    assert {(r["id_a"], r["id_b"]) for r in N.expand(pairs, members).collect()} == want
    keyed = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 50), (3, 1), (3, 2)], "k int, id long")
    got = sorted((r["id_a"], r["id_b"]) for r in N.pairs_within(keyed, ["k"], block_rows=4).collect())
    assert got == sorted([(i, j) for i in range(30) for j in range(i + 1, 30)] + [(1, 2)])
    # one key of a third of all rows: its members never stand in one partition
    third = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    spread = N.hot_keys(third, ["k"], 500).select("k", F.ceil(F.col("n_rows") / 500).cast("int").alias("blocks"))
    assert [tuple(r) for r in spread.collect()] == [(-1, 6)] and N.pairs_within(third, ["k"], block_rows=500).count() == 3000 * 2999 // 2
    none = df.limit(0)
    pairs, members = N.near_duplicates(N.sketch_sets(none, plan), none, lambda p: N.verify_sets(p, none, plan), plan)
    assert N.expand(pairs, members).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in parent}
    got = {r["id"]: r["group"] for r in N.components(spark.createDataFrame(links, "id_a long, id_b long")).collect()}
    assert got == {x: g for x, g in want.items()}
    assert N.components(spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_pruning_bounds():
    plan = N.Plan(0.6, 1)
    steps = plan.least_matches()
    assert steps[-1][0] == plan.hashes and all(0 <= m <= 0.7 * n for n, m in steps) and 1 - (1 - 0.6**4) ** plan.bands >= 1 - plan.miss


def test_id_filter_and_plans_without_texts(spark):
    ids = spark.range(0, 3000, 3)
    known = N.IdFilter(ids)
    pdf = spark.range(3000).select("id", known.probes().alias("p")).toPandas()
    has = known.has(pdf["p"])
    assert has[::3].all() and has.sum() < 1100
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts())], "id long, text string, version timestamp")
    pairs = spark.createDataFrame([(0, 1)], "id_a long, id_b long")
    out = N.verify_texts(pairs, df, N.Plan(0.6, 1))
    assert out.count() <= 1 and "text" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
