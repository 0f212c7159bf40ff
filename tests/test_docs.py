import pytest
from codelode.functions import compact as C
from codelode.functions.metadata import validate, validate_text
from codelode.operators import docs as D
from codelode.syntax.ecma import Grammar
from pyspark.sql import functions as F

CODE = "// first\nimport a from 'a';\n\n/** Adds   numbers. */\nexport function add(x, y = 1) {\n  // inner /* */\n  const s = '/** not a doc */  keep   ' + `t ${ x }  keep`;\n  return x + +y - -1; // end\n}\nclass A extends B {\n  m() { return /a  b\\/\\//g }\n}\nlet k = 1\nlet j = k\n++j\n"


@pytest.mark.parametrize("f", [C.minify, C.beautify])
def test_rewriting_keeps_the_code(f):
    js, out = Grammar("js"), f(CODE)
    assert js.check(CODE) and js.check(out) and "keep   '" in out and "}  keep`" in out and "/a  b\\/\\//g" in out
    assert f(out) == out or f is C.beautify
    assert C.minify(C.beautify(C.minify(CODE))) == C.minify(CODE)


def test_minify_and_strip():
    m = C.minify(CODE)
    assert "first" not in m and "inner" not in m and len(m) < 0.75 * len(CODE) and "x+ +y- -1" in m and "\n++j" in m
    s, n = C.strip_docs(CODE)
    assert n == 1 and "Adds" not in s and "'/** not a doc */" in s and C.strip_docs(s) == (s, 0)
    again, k = C.inject_docs(s, {"add": "Adds numbers.", "m": "/**\n * M.\n */"})
    assert k == 2 and C.inject_docs(again, {"add": "x"})[1] == 0 and Grammar("js").check(again)
    assert C.legend(CODE) == "add(x,y=) - Adds numbers."


def test_edit_and_split():
    assert len(C.top_level(CODE)) == 6
    new, error = C.edit(CODE, "add", "export function add(a) { return a; }")
    assert error is None and "return a;" in new and "class A" in new
    assert C.edit(CODE, "nope", "x")[1] and C.edit(CODE, "A", "class A {")[0] == CODE
    assert C.is_single_line("const a = 1; function f() {}") and not C.is_single_line("const a = 1;")
    assert C.ctx_params("a:Map<string, number>, b=, ...c") == [("a", "Map<string, number>"), ("b", None), ("c", None)]


def test_metadata():
    assert validate({"clusters": [{"label": "x", "match": "web/**"}], "version": "2"}) == [] and validate([]) == ["metadata must be an object"]
    bad = {"clusters": [{"label": "Empty", "color": "blue"}, None], "stories": {}, "hiddenNodes": {}, "focusPresets": {}, "nodeDescriptions": [], "layoutPins": []}
    assert sorted(validate(bad)) == sorted(["clusters[0] must define at least one path, pattern, node, or match", "clusters[0].color must be a hex color", "clusters[1] must be an object", "stories must be an array", "hiddenNodes must be an array", "focusPresets must be an array", "nodeDescriptions must be an object", "layoutPins must be an object"])
    assert validate({"stories": [{"beats": [{"nodes": [""], "clusterId": 3}]}, {"beats": []}]}) == ["stories[0].beats[0].nodes must be an array of non-empty strings", "stories[0].beats[0].clusterId must be a string", "stories[1].beats must be a non-empty array"]
    assert len(validate_text("{")) == 1 and len(validate_text(None)) == 1


def test_context_and_checklists(spark):
    text = "--- a.js ---\nexport add(x:number,y=)→number→help,go|Adds numbers\nhelper()→too,many calls!|{DESCRIBE}\nclass C extends B|2m,1$|x\n  .m()|y\nPATTERNS: z"
    e = D.ctx_entries(spark.createDataFrame([("a.ctx", text), ("b.ctx", None)], "path string, text string"))
    rows = {r["name"]: r for r in e.collect()}
    assert set(rows) == {"add", "helper"} and rows["add"]["params"] == ["x:number", "y="] and rows["add"]["returns"] == "number" and rows["add"]["calls"] == ["help", "go"] and rows["helper"]["description"] == ""
    f = spark.createDataFrame([("a.ctx", "add", ["x", "z"], False), ("a.ctx", "other", [], True)], "path string, name string, params array<string>, exported boolean")
    got = {(r["name"], r["severity"]) for r in D.contracts(e, f, strict=True).collect()}
    assert got == {("add", "warning"), ("helper", "warning"), ("other", "info")}
    t = "# X\n- [ ] no: a → b\n## Tests\n- [x] login: ok → in\n- [!] login: bad → out (FAILED: slow)\n- [ ] cart: add → one\n## Other\n- [ ] z: y"
    files = spark.createDataFrame([("c.md", t)], "path string, text string")
    items = {r["item"]: (r["status"], r["expected"], r["fail_reason"]) for r in D.checklist(files).collect()}
    assert items == {"login.0": ("passed", "in", None), "login.1": ("failed", "out", "slow"), "cart.0": ("pending", "one", None)}
    assert D.checklist_totals(D.checklist(files), ["path"]).first()["progress"] == 67
    one = files.select(D.mark_item(F.col("text"), "login", 1, True).alias("a"), D.mark_item(F.col("text"), "cart", 0, False, "late").alias("b"), D.reset_items(F.col("text")).alias("c")).first()
    assert "- [x] login: bad → out\n" in one["a"] and "- [!] cart: add → one (FAILED: late)" in one["b"] and "[x]" not in one["c"] and "FAILED" not in one["c"]


LISTS = [
    (1, "r", "checklist", "- [x] a: before any heading\n- [ ] b: x"),
    (2, "r", "checklist", "- [x] a: x\r\n## Tests\r\n- [!] a: y (FAILED: z)\r- [ ] a: u\u2028v\n  - [ ] c: indented\n- [ ] d:close\n### Deep\n- [x] b: y\n# Other\n- [x] b: z\n## Testsuite\n- [x] b: z\n## Tests again\n- [x] a: w"),
    (3, "r", "checklist", ""), (4, "r", "checklist", "## Tests"), (5, "r", "checklist", None),
]


def documents(spark, folder):
    spark.createDataFrame(LISTS, "doc_id long, repo string, source string, text string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def by_sql(folder, name):
    import duckdb
    from codelode.plans.catalogue import ORACLE

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cur = db.execute(ORACLE[name])
    return sorted(tuple(r) for r in cur.fetchall()), [d[0] for d in cur.description]


def test_items_before_any_heading_are_none(spark, tmp_path):
    from codelode.plans.catalogue import QUERIES

    folder = documents(spark, tmp_path)
    want, columns = by_sql(folder, "checklist_ids")
    assert sorted(tuple(r) for r in QUERIES["checklist_ids"](spark, folder).select(*columns).collect()) == want
    assert [(r[1], r[4]) for r in want] == [(3, "a.0"), (4, "a.1"), (8, "b.0"), (14, "a.2")]


def test_totals_of_lists_with_items_before_any_heading(spark, tmp_path):
    from codelode.plans.catalogue import QUERIES

    folder = documents(spark, tmp_path)
    want, columns = by_sql(folder, "checklist_summary")
    assert sorted(tuple(r) for r in QUERIES["checklist_summary"](spark, folder).select(*columns).collect()) == want
    assert dict(zip(columns, want[0], strict=True)) == {"repo": "r", "total": 4, "passed": 2, "failed": 1, "pending": 1, "progress": 75}


def test_frames(spark):
    from codelode.extract import facts as X

    files = spark.createDataFrame([(1, "r", "a.js", ".js", CODE), (2, "r", "b.js", ".js", "'open"), (3, "r", "c.py", ".py", "x"), (4, "r", "d.js", ".js", None)], "file_id long, repo string, path_rel string, ext string, raw string")
    got = {r["file_id"]: r for r in D.rewrite(files, "minify").collect()}
    assert set(got) == {1, 2} and got[1]["n_after"] < got[1]["n_before"] and got[2]["error"] and got[2]["text"] == "'open"
    facts = X.extract(files)
    text = D.dialect(X.functions(facts), X.classes(facts)).collect()
    assert [r["text"] for r in text] == ["--- a.js ---\nexport add(x,y=)\nclass A extends B|1m,0$"]
    assert D.interface_hash(X.functions(facts), X.classes(facts), ["path_rel"]).count() == 1
    assert D.context_totals(text and spark.createDataFrame([("r", "abcd")], "repo string, text string"), spark.createDataFrame([("r", "a" * 40)], "repo string, text string")).first()["savings"] == 90.0


def test_lookup_and_suffixes(spark):
    import pytest
    from codelode.operators import docs as D

    t = lambda rows: spark.createDataFrame(rows, "repo string, path_rel string, text string")
    files = t([("r", "a.js", ""), ("r", "b.js", ""), ("r", "c.js", ""), ("r", "c.js", "")])
    notes = t([("r", "a.js", "# a\n\n## Notes\n## Follow-ups\n## Decisions\n"), ("r", "b.js", "mind the gap"), ("r", "c.js", None)])
    got = {r["path_rel"]: r["text"] for r in D.doc_lookup(files, t([("r", "a.js", " own "), ("r", "b.js", " ")]), t([("r", "a.js", "x"), ("r", "b.js", "section")]), notes).collect()}
    assert got == {"a.js": "own", "b.js": "section\n\nmind the gap", "c.js": "No documentation found for: c.js"}
    hits = D.by_suffix(t([("r", "src/gate.js", ""), ("r", "lib/gate.js", ""), ("q", "x", "")]), ["gate.js", "gate.js", "none"])
    assert [tuple(r) for r in hits.collect()] == [("r", "gate.js", "lib/gate.js")]
    with pytest.raises(ValueError):
        D.by_suffix(files, [str(k) for k in range(D.MOST_NAMES + 1)])
