"""Similar functions against brute force."""

import random
from itertools import combinations

from codelode.operators import analysis as A
from pyspark.sql import functions as F

FUNCTIONS = "repo string, ord long, name string, path string, params array<string>, is_async boolean, structure string, calls array<string>"


def score(a, b):
    share = lambda p, q, most: int(most * sum(x in q for x in p) / max(len(p), len(q)) + 0.5) if max(len(p), len(q)) else 0
    s, t = ([x for x in f[6].split("|") if x] for f in (a, b))
    structure = 25 if a[6] == b[6] != "" else share(s, t, 25)
    return (30 if len(a[4]) == len(b[4]) else 0) + share(a[4], b[4], 20) + (10 if a[5] == b[5] else 0) + structure + share(a[7], b[7], 15)


def pairs(rows, threshold):
    return {(a[0], a[1], b[1], score(a, b)) for a, b in combinations(sorted(rows), 2) if a[0] == b[0] and not (a[2] == b[2] and a[3] == b[3]) and not (len(a[6]) < 3 and len(b[6]) < 3) and score(a, b) >= threshold}


def test_all_pairs_in_blocks(spark):
    r = random.Random(1)
    some = lambda xs, n: r.sample(xs, r.randrange(n))
    rows = [("pq"[r.random() < 0.3], i, r.choice("fgh"), r.choice(["u", "v"]), some(["x", "y", "z"], 3), r.random() < 0.3, "|".join(r.choices(["IF", "FOR", "RET"], k=r.randrange(4))), some(["k", "l", "m"], 3)) for i in range(150)]
    f = spark.createDataFrame(rows, FUNCTIONS)
    want = pairs(rows, 60)
    assert any(len(x[4]) != len(y[4]) for x, y in combinations(rows, 2) if (x[0], x[1], y[1], score(x, y)) in want)
    assert {(x["repo"], x["a_ord"], x["b_ord"], x["score"]) for x in A.similar_functions(f).collect()} == want
    links, members = A.similar_classes(f, 70, most_in_block=7)
    assert links.agg(F.sum("n_links")).first()[0] == len(pairs(rows, 70)) and members.count() == len(rows)


def test_similar_pairs_lower_the_score(spark):
    from codelode.extract import facts as X

    text = "".join(f"/** Adds. @param a {{number}} @returns {{number}} */\nexport function f{k}(a) {{ if (a) {{ return g(a); }} return h(a); }}\n" for k in range(3))
    files = spark.createDataFrame([(1, "r", "a.js", ".js", text)], "file_id long, repo string, path_rel string, ext string, raw string")
    empty = spark.createDataFrame([], "repo string, severity string")
    row = A.full_analysis(X.functions(X.extract(files)), empty.select("repo"), empty, spark.createDataFrame([("r", "ok")], "repo string, rating string")).first()
    assert row["similar"] == 3 and "3 similar pairs" in row["topics"] and row["score"] <= 91


def test_members_compare_no_pairs(spark, monkeypatch):
    from codelode.plans.catalogue import QUERIES

    folder = "/root/testdata/sf0.001"
    columns = ["repo", "class_file_id", "class_n", "file_id", "n", "name"]
    monkeypatch.setattr(A, "similarity", lambda *_, **__: 1 / 0)
    monkeypatch.setattr(A, "similar_classes", lambda *_, **__: 1 / 0)
    got = QUERIES["code_similar_members"](spark, folder)
    assert got.columns == columns and got.where("struct(class_file_id, class_n) = struct(file_id, n)").count() == got.select(*columns[:3]).distinct().count()
    assert got.count() == A.comparable(functions_of(spark, folder)).where("repo is not null").count()


def some_functions(spark, n=400):
    r = random.Random(2)
    some = lambda xs, k: r.choices(xs, k=r.randrange(k))
    rows = [("pq"[r.random() < 0.2], i, r.choice("fgh"), r.choice("uvw"), some("xyz", 4), r.random() < 0.3, "|".join(some(["IF", "FOR", "RET"], 5)), some("klm", 4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, FUNCTIONS)


def test_links_are_made_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(A, "similarity", lambda *_, **__: 1 / 0)
    rows, f = some_functions(spark)
    assert {(x["repo"], x["a_ord"], x["b_ord"], x["score"]) for x in A.similar_functions(f).collect()} == pairs([(*x[:4], sorted(x[4]), *x[5:7], sorted(x[7])) for x in rows], 60)


def test_pairs_are_counted_without_links(spark, monkeypatch):
    monkeypatch.setattr(A, "similar_classes", lambda *_, **__: 1 / 0)
    rows, f = some_functions(spark)
    want = pairs([(*x[:4], sorted(x[4]), *x[5:7], sorted(x[7])) for x in rows], 70)
    assert {r["repo"]: r["similar"] for r in A.similar_counts(f, 70, most_in_block=50).collect()} == {q: sum(x[0] == q for x in want) for q in "pq"}
    test_similar_pairs_lower_the_score(spark)


def functions_of(spark, folder):
    from codelode.extract import facts as X
    from codelode.plans.code_facts_queries import facts

    return X.functions(facts(spark, folder))
