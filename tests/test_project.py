import json

import pytest
from codelode.config import Filters, Mode, Workspace
from codelode.operators import analysis as A
from codelode.sources import project as P
from codelode.streaming import events as E

TREE = {
    "package.json": '{"dependencies": {"express": "5"}, "devDependencies": {"glob": "1"}}',
    "src/tide.js": "/**\n * Height of the water some hours after low tide.\n * @param {number} hours\n * @param {number} range\n */\nexport function heightAfter(hours, range) { return range * Math.sin(hours / 12); }\n\n\nexport function slackTimes(day) { return [day * 6, day * 18]; }\nfunction _roundTo(v, step) { return step * Math.floor(v / step); }\n",
    "src/harbour.js": "import { heightAfter } from './tide.js';\nclass Berth {\n  depth() { return heightAfter(3, 4); }\n}\nclass DryDock extends Berth {\n  depth() { return this.pumpOut(); }\n  pumpOut(gate) { if (gate) { gate.close(); } return Berth.reserve(gate); }\n}\n",
    "schema.sql": "CREATE TABLE vessels (id SERIAL, hull VARCHAR(80));\n", "node_modules/x/a.js": "function hidden() {}", "src/a.test.js": "function test() {}", "packages/one/package.json": "{}", ".context/src/tide.ctx": "heightAfter(hours,range)|Height", "src/tide.ctx": "old()", "project.ctx": "x",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for p, text in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    return str(root)


def test_scan(spark, tree):
    files = P.source_files(spark, tree, "demo")
    assert {r["path_rel"] for r in files.collect()} == {"src/tide.js", "src/harbour.js", "schema.sql"}
    more = P.source_files(spark, tree, "demo", Filters().remove(["node_modules"], ["*.test.js"]))
    assert {r["path_rel"] for r in more.collect()} >= {"node_modules/x/a.js", "src/a.test.js"}
    paths = P.all_files(spark, tree)
    assert paths.count() == len(TREE) - 1 and [tuple(r) for r in P.sub_projects(paths).collect()] == [("one", "packages/one")]
    deps = P.package_dependencies(spark.createDataFrame([("demo", TREE["package.json"]), ("bad", "{")], "repo string, text string"))
    assert {r["name"] for r in deps.collect()} == {"express", "glob"}
    ctx = [(r["target"], r["text"]) for r in P.context_files(spark, tree).collect()]
    assert ctx[0][0] == "project" and ("src/tide", "heightAfter(hours,range)|Height") in ctx


def test_commands(spark, tree, capsys):
    from codelode.cli import COMMANDS, Project, call_chain, main

    p = Project(tree)
    rows = {name: [r.asDict() for r in COMMANDS[name](p).collect()] for name in ("legend", "stats", "orphans", "duplicates", "complexity", "undocumented", "tables", "dialect", "minify", "inventory", "skeleton")}
    assert {r["name"]: r["alias"] for r in rows["legend"]} == {"Berth": "bB", "DryDock": "DD", "heightAfter": "hA", "slackTimes": "sT", "_roundTo": "_T"}
    assert [r["alias"] for r in rows["orphans"]] == ["_T"] and rows["duplicates"][0]["members"] == "Berth:2,DryDock:5" and {r["col_name"] for r in rows["tables"]} == {"id", "hull"}
    assert {r["name"] for r in rows["undocumented"]} >= {"slackTimes", "depth"} and all(r["n_after"] <= r["n_before"] for r in rows["minify"])
    assert call_chain(p, "DD", "hA") == ["DD", "bB", "hA"] and call_chain(p, "hA", "DD") is None
    assert main(["nothing"]) == 2 and "Commands" in capsys.readouterr().out
    assert COMMANDS["similar"](p, "60").count() >= 1 and COMMANDS["deps"](p, "bB").count() >= 1
    expanded = COMMANDS["expand"](p, "bB.depth").first()
    assert expanded["full_name"] == "Berth.depth" and expanded["code"] == "depth() { return heightAfter(3, 4); }" and COMMANDS["expand"](p, "DD").first()["calls"] == "bB.reserve" and COMMANDS["expand"](p, "zz").count() == 0
    assert COMMANDS["expand"](p, "DD.pumpOut").first()["code"].endswith("return Berth.reserve(gate); }")
    assert {r["name"] for r in COMMANDS["redundant"](p).collect()} == {"glob"} and COMMANDS["summary"](p).first()["functions"] == 6
    assert {r["rule"] for r in COMMANDS["style"](p).where("path_rel = 'src/harbour.js'").collect()} == {"missing-ctx-header", "missing-ctx-file", "indented-lines"}


def test_rule_files(spark, tree, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "web", "detect": {"packageJson": ["express"], "imports": [], "patterns": []}, "rules": [{"id": "no-max", "pattern": "Math.floor", "patternType": "string", "severity": "error", "filePattern": "*.js"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"name": "all", "alwaysApply": True, "rules": [{"id": "r", "pattern": "return\\s+\\[", "patternType": "regex", "severity": "info", "filePattern": "*.js"}]}))
    (tmp_path / "c.json").write_text("{ no json")
    sets, rules = P.rule_sets(spark, str(tmp_path))
    files = P.source_files(spark, tree, "demo")
    deps = P.package_dependencies(spark.createDataFrame([("demo", TREE["package.json"])], "repo string, text string"))
    assert {(r["ruleset"], r["reason"]) for r in A.detect_rulesets(sets, deps, files).collect()} == {("web", "package.json: express"), ("all", "always")}
    hits = A.check_rules(A.lines_of(files, ["path_rel"]), rules, ["path_rel"], "path_rel")
    assert {(r["path_rel"], r["rule_id"]) for r in hits.collect()} >= {("src/tide.js", "no-max"), ("src/tide.js", "r")}
    assert A.upsert_rules(rules, rules.limit(1)).count() == 2 and A.delete_rule(rules, "web", "no-max").count() == 1
    found = P.diagnostics(spark.createDataFrame([("a.ts(3,5): error TS2304: Cannot find name 'x'.",), ("noise",)], "value string")).collect()
    assert [(r["line"], r["code"]) for r in found] == [(3, "TS2304")]


def test_settings(tmp_path):
    assert Filters().with_ignore_file("# a\n\nvendor\n").ignore == ("vendor",) and "x" in Filters().add(["x"]).dirs
    Mode(mode=1).save(str(tmp_path / "m.json"))
    assert Mode.load(str(tmp_path / "m.json")).mode == 1 and Mode.load(str(tmp_path / "none.json")) == Mode() and Mode().describe()
    (tmp_path / "bad.json").write_text('{"mode": 5}')
    assert Mode.load(str(tmp_path / "bad.json")) == Mode()
    with pytest.raises(ValueError):
        Mode(mode=5).save(str(tmp_path / "m.json"))
    with pytest.raises(ValueError):
        Workspace(tmp_path).resolve("../x")
    assert Workspace(tmp_path).resolve("a/b").name == "b"


def test_streams(spark, tree, tmp_path):
    rows = [(k, k * 600, 1, "view" if k % 3 else "error", 1.0, "{}") for k in range(20)]
    src = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string").selectExpr("event_id", "timestamp_seconds(s) as ts", "user_id", "event_type", "value", "props")
    src.write.parquet(str(tmp_path / "events"))
    want = sorted(map(tuple, E.event_windows(src).collect()))
    q = E.event_windows(E.read_events(spark, str(tmp_path / "events"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == want and len(want) > 3
    files = P.source_files(spark, tree, "demo").drop("mtime")
    files.write.parquet(str(tmp_path / "files"))
    for _ in range(2):
        stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "files"))
        E.keep_facts(stream, str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
        files.write.mode("append").parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert stored.count() == 3 and stored.select("file_id").distinct().count() == 3


def test_sub_projects_changes_and_sidecar(spark, tree, tmp_path):
    files = spark.createDataFrame([("src/a.js",), ("packages/one/b.js",), ("packages/one/deep/c.js",), ("apps/x/d.js",)], "path_rel string")
    subs = spark.createDataFrame([("one", "packages/one")], "name string, path string")
    got = {(r["path_rel"], r["sub_project"], r["sub_path"]) for r in P.with_sub_projects(files, subs).collect()}
    assert got == {("src/a.js", None, "src/a.js"), ("packages/one/b.js", "one", "b.js"), ("packages/one/deep/c.js", "one", "deep/c.js"), ("apps/x/d.js", None, "apps/x/d.js")}
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(3):
        (tmp_path / f"f{k}.js").write_text(str(k))
        run("add", ".")
        run("commit", "-q", "-m", "x")
    (tmp_path / "new.js").write_text("n")
    assert {r["path_rel"] for r in P.changed_files(spark, str(tmp_path), back=1).collect()} == {"f2.js"} and {r["path_rel"] for r in P.changed_files(spark, str(tmp_path), back=None).collect()} == {"f0.js", "f1.js", "f2.js", "new.js"}
    assert P.changed_files(spark, str(tmp_path / "none")).count() == 0
