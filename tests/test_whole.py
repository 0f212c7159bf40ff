"""Cases that are lost when an operator stops early."""

from collections import defaultdict

import pytest
from codelode.operators import graph as G


def brute(links, starts):
    out = defaultdict(set)
    for a, b in links:
        if a != b:
            out[a].add(b)
    rows = set()
    for s in starts:
        depth, front = {s: 0}, [s]
        while front:
            nxt = []
            for a in front:
                for b in out[a]:
                    if b not in depth:
                        depth[b] = depth[a] + 1
                        nxt.append(b)
            front = nxt
        rows |= {(s, a, d) for a, d in depth.items()}
    return rows


def test_long_chains_are_followed_to_the_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(24)], "src string, dst string")
    start = spark.createDataFrame([("n0",)], "start string")
    assert G.reachable(edges, start).count() == 25
    assert G.reachable(edges, start, 3).count() == 4
    assert len(G.call_chain(edges, "n0", "n24")) == 25
    with pytest.raises(RuntimeError):
        G.reachable(edges, start, most_steps=5).count()
    with pytest.raises(RuntimeError):
        G.call_chain(edges, "n0", "n24", most_steps=5)


def test_closure_against_brute_force(spark):
    from codelode.plans import graph_queries as Q

    folder = "/root/testdata/sf0.001"
    links = {(f"{r['repo']}/{r['src']}", f"{r['repo']}/{r['dst'].split('.')[0]}") for r in Q.edges(spark, folder).where("op = '→' and repo is not null").collect()}
    starts = {f"{r['repo']}/{r['alias']}" for r in spark.read.parquet(f"{folder}/graph_nodes.parquet").where("node_id % 20 = 0 and repo is not null and alias is not null").collect()}
    want = brute(links, starts)
    assert {tuple(r) for r in Q.graph_closure(spark, folder).collect()} == want
    assert max(d for _, _, d in want) > 3
