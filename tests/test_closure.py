"""What is reached along calls in any number of steps."""

import random
from collections import deque
from pathlib import Path

import duckdb
from codelode.operators import graph as G
from codelode.plans.catalogue import ORACLE, QUERIES
from pyspark.sql import functions as F

NODES = "node_id long, repo string, alias string, kind string, node_name string, extends_name string, methods array<string>, props array<string>, exported boolean, path_rel string, line_no int, seen_from timestamp, seen_to timestamp, loaded_at timestamp"
EDGES = "edge_id long, repo string, src string, op string, dst string, observed_at timestamp, loaded_at timestamp"


def both(spark, folder, nodes, edges):
    """Rows of graph_closure and of its SQL for nodes(repo, alias), all of them starts, and edges(repo, src, dst)."""
    at = F.lit("2024-01-01").cast("timestamp")
    rows = [(20 * i, r, a, "C", a, None, [], [], True, "a.js", 1, None, None, None) for i, (r, a) in enumerate(nodes)]
    spark.createDataFrame(rows, NODES).withColumn("loaded_at", at).write.parquet(f"{folder}/graph_nodes.parquet")
    spark.createDataFrame([(i, r, s, G.CALL, d, None, None) for i, (r, s, d) in enumerate(edges)], EDGES).withColumn("loaded_at", at).write.parquet(f"{folder}/graph_edges.parquet")
    db = duckdb.connect()
    for t in ("graph_nodes", "graph_edges"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES["graph_closure"](spark, str(folder)).select("start", "alias", "depth").collect()
    return sorted(tuple(r) for r in got), sorted(db.execute(ORACLE["graph_closure"]).fetchall())


def test_more_than_a_thousand_steps(spark, tmp_path):
    n = 1100
    got, want = both(spark, tmp_path, [("r", "a0"), ("r", "a7"), ("r", "alone")], [("r", f"a{i}", f"a{(i + 1) % n}") for i in range(n)])
    assert got == want and len(got) == 2 * n + 1 and max(r[2] for r in got) == n - 1


def test_what_is_reached_is_not_stored(spark, tmp_path):
    """The disk that is taken goes with the links, not with the rows that come out of them."""
    from codelode.session import checkpoint_dir

    n, rand, folder = 300, random.Random(3), Path(checkpoint_dir(spark)[len("file:") :])
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    got, want = both(spark, tmp_path, [("r", f"a{i}") for i in range(n)], [("r", f"a{i}", f"a{rand.randrange(n)}") for i in range(n) for _ in range(4)])
    assert got == want and len(got) > 80_000
    assert size() - before < 300 * (4 * n + n)


def test_repos_and_aliases_with_slashes(spark, tmp_path):
    """a/b/c is the alias b/c of repo a and the alias c of repo a/b, in the SQL, too."""
    nodes = [("a", "x"), ("a", "b/c"), ("a/b", "d"), ("", "e"), ("", "x"), (None, "x"), ("a", None)]
    edges = [("a", "x", "b/c.m"), ("a/b", "c", "d"), ("a/b", "d", "c"), ("", "e", "f"), ("", "f", "e"), (None, "x", "y"), ("a", "x", "x"), ("a", "x", "b/c.n"), ("a", None, "x"), ("a", "x", None)]
    got, want = both(spark, tmp_path, nodes, edges)
    assert got == want and ("a/x", "a/b/d", 2) in got


def test_empty_tables(spark, tmp_path):
    assert both(spark, tmp_path, [], []) == ([], [])


def test_closure_by_brute_force(spark, monkeypatch):
    rand = random.Random(5)
    links = [(f"r{k}", f"r{k}/{rand.randrange(size)}", f"r{k}/{rand.randrange(size)}") for k, size in enumerate((1, 3, 30, 200)) for _ in range(2 * size)]
    starts = [(f"r{k}", f"r{k}/{i}") for k, size in enumerate((1, 3, 30, 220)) for i in range(size)]
    after = {}
    for _, s, d in links:
        after.setdefault(s, set()).add(d)
    want = []
    for _, s in starts:
        depth, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in after.get(x, ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        want += [(s, a, d) for a, d in depth.items()]
    a = spark.createDataFrame([*links, *links, (None, "x", "y"), ("r0", None, "y")], "root string, src string, dst string")
    b = spark.createDataFrame([*starts, *starts, (None, "x")], "root string, start string")
    rows = lambda **how: sorted(tuple(r) for r in G.closure(a, b, **how).collect())
    # one place for each root; several for the large ones; the largest by way of joins
    assert rows() == rows(own=10, most_parts=7) == rows(own=1, most_links=100) == sorted(want)
    # many starts in blocks, told in small batches that also break a part
    monkeypatch.setattr(G, "BITS", 64 * 400)
    monkeypatch.setattr(G, "CELLS", 128)
    local = sorted((*[(r, 0, s, d) for r, s, d in set(links) if s != d], *[(r, 0, s, None) for r, s in starts]), key=lambda r: (r[0], r[3] is None))
    batches = [G.pa.RecordBatch.from_pylist([dict(zip(("root", "part", "src", "dst"), r, strict=True)) for r in local[i : i + 37]], schema=G.pa.schema([("root", "string"), ("part", "int32"), ("src", "string"), ("dst", "string")])) for i in range(0, len(local), 37)]
    assert sorted((r["start"], r["alias"], r["depth"]) for out in G._closures(iter(batches)) for r in out.to_pylist()) == sorted(want)
