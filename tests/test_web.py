from codelode.extract import facts as X
from codelode.operators import analysis as A
from codelode.operators import docs as D
from codelode.operators import web as W
from pyspark.sql import functions as F

FILES = {
    "ui/panel.js": "import { template } from './panel.tpl.js';\nimport { style } from './panel.css.js';\nexport class Panel extends Base { init() { this.addEventListener('click', f); this.dispatchEvent(new CustomEvent('done')); this.sub('a/b', g); } }\nPanel.reg('my-panel');\n",
    "ui/panel.tpl.js": "export const template = html`<my-item ref=\"one\" ${{onclick: 'go'}} item-tag=\"my-row\"></my-item><my-panel></my-panel>`;",
    "ui/panel.css.js": "export const style = css`:host { --tone: red; }`;",
    "ui/item.js": "class Item extends HTMLElement {}\ncustomElements.define('my-item', Item);\nclass Plain {}\n",
}


def frame(spark):
    return spark.createDataFrame([(i, "r", p, ".js", t) for i, (p, t) in enumerate(FILES.items())] + [(9, "r", "x.js", ".js", None)], "file_id long, repo string, path_rel string, ext string, raw string")


def test_components(spark):
    files = frame(spark)
    facts = X.extract(files)
    rows = W.components(files, X.classes(facts), X.imports(facts))
    got = {r["name"]: r for r in rows.collect()}
    assert set(got) == {"Panel", "Item"} and got["Item"]["tag"] == "my-item"
    p = got["Panel"]
    assert (p["tag"], p["template"], p["children"], p["refs"], p["bindings"], p["css_tokens"], p["item_tags"]) == ("my-panel", "ui/panel.tpl.js", ["my-item"], ["one"], ["onclick"], ["--tone"], ["my-row"])
    assert p["listeners"] == ["click"] and p["dispatches"] == ["done"] and p["subscriptions"] == ["a/b"]
    assert [tuple(r) for r in W.element_edges(rows).collect()] == [("r", "Panel", "Item")]
    assert W.components(files.limit(0), X.classes(facts), X.imports(facts)).where("tag is not null").count() == 0


def test_context_style_and_report(spark):
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "<template><b>"), (1, 3, "in"), (1, 4, "</template>"), (1, 5, "out")], "file_id long, line_no int, line string")
    assert [r["inside"] for r in A.inside_context(lines, ["file_id"], "template").orderBy("line_no").collect()] == [False, True, True, False, False]
    files = frame(spark)
    facts = X.extract(files)
    context = "--- a ---\nexport f(a,b:number)|{DESCRIBE}\nexport gone(x)|(auto-documented)"
    texts = [("const one = 1;let two = 2;var three = 3;function four() {}", context), ("// @ctx a\nimport a from 'a';\nimport b from 'b';\nexport function shown(a) {\n  return 'const inside = 1';\n}\nfunction f() {}\nconst g1 = 1", context), ("#!/x\n// @ctx a\nconst aaa = 1, b = 2;\nlet bbb;\nlet ccc;\nfunction ddd() {}", " "), (None, "x"), ("", None)]
    made = spark.createDataFrame(texts, "raw string, ctx string").select(A.style_rules(F.col("raw"), F.col("ctx")).alias("x")).collect()
    got = [r["x"] and {x["rule"]: x["n"] for x in r["x"]} for r in made]
    assert got[0] == {"missing-ctx-header": 1, "incomplete-ctx": 2, "ctx-minified-params": 3, "ctx-untyped-params": 2, "ctx-coverage": 1, "long-names": 4}
    assert got[1] == {"incomplete-ctx": 3, "ctx-minified-params": 3, "ctx-untyped-params": 2, "ctx-coverage": 1, "multi-line-imports": 2, "indented-lines": 1}
    assert got[2] == {"missing-ctx-file": 1, "long-names": 4} and got[3] is None and got[4] == {"missing-ctx-header": 1, "missing-ctx-file": 1}
    sizes = A.large_files(A.inventory(files.where("raw is not null")).selectExpr("repo", "n_lines", "0 n_functions", "0 n_classes", "0 n_exports"))
    dead = spark.createDataFrame([("r",)] * 3, "repo string")
    findings = spark.createDataFrame([("r", "error"), ("r", "warning")], "repo string, severity string")
    row = A.full_analysis(X.functions(facts), dead, findings, sizes).first()
    assert (row["dead"], row["errors"], row["undocumented"], row["score"], row["rating"]) == (3, 1, 1, 90, "excellent") and row["topics"].startswith("3 dead code")
    ctx = D.generate_context(X.functions(facts), X.classes(facts), D.ctx_entries(spark.createDataFrame([("ui/item.js", "Item()|kept")], "path string, text string")))
    assert {r["path_rel"]: r["text"] for r in ctx.collect()}["ui/item.js"].split("\n") == ["--- ui/item.js ---", "class Item extends HTMLElement|kept", "class Plain|{DESCRIBE}"]


def test_undocumented_levels_and_mismatches(spark):
    js = """class K { _p() {} get g() { return 1; } run(a) {} }
/** Moves.
 * @param {number} x
 */
function move(x, y) { return x; }


function bare() {}
async function w() { fs.readFileSync('a'); readSync(); util.promisify(f); promisify(g); }
"""
    x = X.extract(spark.createDataFrame([(1, "r", "a.js", ".js", js)], "file_id long, repo string, path_rel string, ext string, raw string"))
    rows = {(r["level"], r["name"], r["reason"]) for r in A.undocumented(X.functions(x), X.classes(x)).collect()}
    assert rows == {("params", "move", "@returns"), ("all", "move", "@returns"), ("all", "K", "No JSDoc")} | {(level, n, more + "@param, @returns") for level, more in (("params", ""), ("all", "description, ")) for n in ("bare", "w", "K.run")}
    assert {(r["name"], r["kind"], r["severity"]) for r in A.doc_mismatches(X.functions(x)).collect()} == {("move", "count", "error"), ("move", "returns", "warning")}
    found = sorted(f["rule"] for f in X.facts_of(".js", js)["findings"])
    assert found == ["promisify-usage", "sync-in-async"]
    red = A.redundant_dependencies(spark.createDataFrame([("r", "uuid"), ("r", "uuid"), ("r", "left-pad"), (None, "glob"), ("r", None)], "repo string, name string"))
    assert {tuple(r) for r in red.collect()} == {("r", "uuid", "crypto.randomUUID()", "Node 19"), (None, "glob", "fs.glob()", "Node 22")}
