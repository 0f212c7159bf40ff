"""Vendored subtrees in families of forks."""

import pytest
from codelode.llm import provenance as V


def trees(spark, repos, **kw):
    """repos: name to {path: text}."""
    rows = [(i, r, p, ".js", t, None) for i, (r, p, t) in enumerate((r, p, t) for r, fs in repos.items() for p, t in fs.items())]
    files = spark.createDataFrame(rows, "file_id long, repo string, path_rel string, ext string, raw string, version timestamp")
    return {(r["repo"], r["dir"]) for r in V.shared_subtrees(files, **kw).collect()}


V_TREE = {f"{k}.js": f"v{k}" * 200 for k in range(2)}
own = lambda name, n: {f"src/{k}.js": f"{name}{k}" * 90 for k in range(n)}
lib = lambda files: {f"lib/{p}": t for p, t in files.items()}


@pytest.mark.parametrize("forks,other", [(("a", "b"), "c"), (("a", "c"), "b"), (("b", "c"), "a")])
def test_forks_and_an_unrelated_repo(spark, forks, other):
    repos = {f: own("fork", 8) | lib(V_TREE) for f in forks} | {other: own("other", 8) | lib(V_TREE)}
    assert trees(spark, repos) == {(r, "lib") for r in "abc"}
    repos["s"] = V_TREE
    assert trees(spark, repos, single_owners=4) == {(r, "lib") for r in "abc"}


def test_two_unrelated_users_of_a_small_project(spark):
    repos = {r: own(r, 8) | lib(V_TREE) for r in "ab"} | {"s": {f"src/{p}": t for p, t in V_TREE.items()}}
    # in s the files are the project itself; three own each of them
    assert trees(spark, repos) == {(r, d) for r in "ab" for d in ("lib", "lib/0.js", "lib/1.js")}


def test_moves_partial_copies_and_single_files(spark):
    part = {"lib/0.js": V_TREE["0.js"], "lib/deep/1.js": V_TREE["1.js"], "lib/deep/2.js": "v2" * 200}
    repos = {"old": own("same", 8) | part, "new": {f"moved/{p}": t for p, t in (own("same", 8) | part).items()}, "user": own("user", 8) | {p.replace("lib/0", "lib/changed"): t for p, t in part.items()}}
    # a renamed repo is the same one; of a copy with a changed file the unchanged directory below is found
    assert trees(spark, repos) == {(r, d) for r, d in (("old", "lib/deep"), ("new", "moved/lib/deep"), ("user", "lib/deep"))}
    single = {r: own(r, 8) | {f"{r}/jq.js": "jq" * 300} for r in ("a", "b")}
    assert trees(spark, single) == set()
    single["c"] = own("c", 8) | {"x/y/jq.js": "jq" * 300, "x/z.js": "z" * 300}
    assert trees(spark, single) == {("a", "a"), ("a", "a/jq.js"), ("b", "b"), ("b", "b/jq.js"), ("c", "x/y"), ("c", "x/y/jq.js")}


def test_deep_paths(spark):
    deep = "/".join(f"d{k}" for k in range(24))
    rows = [(i, r, f"{r}/{deep}/{p}" if p in V_TREE else p, ".js", t, None) for i, (r, p, t) in enumerate((r, p, t) for r in "ab" for p, t in (V_TREE | own(r, 4)).items())]
    files = spark.createDataFrame(rows, "file_id long, repo string, path_rel string, ext string, raw string, version timestamp")
    hashes = V.directory_hashes(files, checkpoint_every=3, shallow=5)
    top = {(r["repo"], r["n_files"], r["h1"], r["h2"]) for r in hashes.where("parts in (array('a'), array('b'))").collect()}
    assert len(top) == 2 and len({x[1:] for x in top}) == 1  # the same tree below roots of other names
    assert hashes.where("size(parts) > 1 and n_files = 2").count() == 2 * 24


def test_relatives_are_told_by_whole_repositories(spark):
    repos = {"p": own("p", 10), "q": {f"else/{k}.js": f"p{k}" * 90 for k in range(4, 10)} | {f"own/{k}.js": f"q{k}" * 90 for k in range(4)}, "r": {f"x/{k}.js": f"p{k}" * 90 for k in range(4)} | own("r", 8)}
    rows = [(r, p, t) for r, fs in repos.items() for p, t in fs.items()]
    files = spark.createDataFrame(rows, "repo string, path_rel string, raw string")
    got = {(r["repo"], r["family"]) for r in V.families(files, files.select("repo").distinct()).collect()}
    assert got == {("p", "p"), ("q", "p")}  # 6 of 10 texts, wherever they stand; r shares 4 of 12
