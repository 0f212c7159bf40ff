import pytest
from codelode.extract import facts as X
from codelode.extract.ecma_facts import parameter, split_top

JS = """import { heightAfter } from './tide.js';
import fs, { join as j } from 'fs';
/** Prints a mooring.
 * @param {number} rope the length
 * @returns {string} text
 */
export function label(rope, unit = 'm') { return rope + unit; }
export async function readLog(path, options = {}) { if (!path || x) return null; for (const a of b) { await go(a); } return this.m.k(path); }
class Berth { constructor(side) { this.side = side; } depth() { return heightAfter(1, 2); } static reserve(n) { return new Berth(n); } }
export class DryDock extends Berth { depth() {} pumpOut(gate) { return gate; } }
var old = require('x');
const s = `function fake() { ${heightAfter(1)} }`; // function no() {}
"""


def test_ecma():
    f = X.facts_of(".js", JS)
    names = {(x["owner"], x["name"]): x for x in f["functions"]}
    assert set(names) == {(None, "label"), (None, "readLog"), ("Berth", "constructor"), ("Berth", "depth"), ("Berth", "reserve"), ("DryDock", "depth"), ("DryDock", "pumpOut")}
    assert names[None, "label"]["params"] == ["rope", "unit="] and names[None, "label"]["doc_params"] == ["rope"] and names[None, "label"]["doc_returns"]
    d = names[None, "readLog"]
    assert d["is_async"] and d["complexity"] == 4 and d["structure"] == "IF|RET|FOROF|AWAIT|RET" and d["calls"] == ["go", "m.k"] and d["exported"]
    assert names["Berth", "reserve"]["calls"] == []
    classes = {c["name"]: c for c in f["classes"]}
    assert classes["Berth"]["methods"] == ["depth", "reserve"] and classes["DryDock"]["extends"] == "Berth"
    assert [(i["source"], i["names"]) for i in f["imports"]] == [("./tide.js", ["heightAfter"]), ("fs", ["fs", "j"])]
    assert {x["rule"] for x in f["findings"]} == {"var-usage", "require-usage"} and "j" in f["unused_imports"] and f["exports"] == ["DryDock", "label", "readLog"]
    with pytest.raises(X.Bad):
        X.facts_of(".js", "const a = 'open")


@pytest.mark.parametrize("p,want", [("a", "a"), ("b = 5", "b="), ("...rest", "...rest"), ("{ a, b }", "options"), ("{ a } = {}", "options="), ("name: string", "name:string"), ("f = () => 1", "f=")])
def test_parameters(p, want):
    assert parameter(p) == want
    assert split_top("a, {b, c}, d = [1, 2]") == ["a", "{b, c}", "d = [1, 2]"]


def test_python_go_sql():
    f = X.facts_of(".py", "import os\nfrom a import b as c\nclass K(Base):\n    def m(self, x, *a, y=1):\n        '''Doc.\n\n        :param x: it\n        '''\n        if x and y:\n            return self.go(x)\ndef _p(): pass\n")
    assert [(x["owner"], x["name"], x["params"], x["complexity"]) for x in f["functions"]] == [("K", "m", ["x", "...a", "y="], 3), (None, "_p", [], 1)]
    assert f["functions"][0]["calls"] == ["go"] and f["exports"] == ["K"] and f["imports"][1] == {"source": "a", "names": ["c"], "line": 2}
    g = X.facts_of(".go", 'package p\nimport (\n\tf "fmt"\n)\ntype S struct {\n\tBase\n\tn int\n}\nfunc (s *S) Do(a int, b ...string) error {\n\tif a > 1 && ok { return f.Print(")") }\n\treturn nil\n}\n')
    assert g["classes"][0]["extends"] == "Base" and g["classes"][0]["methods"] == ["Do"] and g["functions"][0]["params"] == ["a", "...b"] and g["functions"][0]["complexity"] == 3
    assert g["imports"] == [{"source": "fmt", "names": ["f"], "line": 3}]
    t = X.facts_of(".sql", "-- c\nCREATE TABLE IF NOT EXISTS app.users (\n id SERIAL, name NUMERIC(10, 2), PRIMARY KEY (id)\n);")["tables"]
    assert t == [{"name": "users", "line": 2, "columns": [{"name": "id", "type": "SERIAL"}, {"name": "name", "type": "NUMERIC(10,2)"}]}]


def test_frame(spark):
    rows = [(1, "r", "a.js", ".JS", JS, 9), (2, "r", "b.py", ".py", "def (", 9), (3, None, None, None, None, 9), (None, "r", "x", ".js", "", 9)]
    df = X.extract(spark.createDataFrame(rows, "file_id long, repo string, path_rel string, ext string, raw string, functions int"))
    got = {r["file_id"]: r for r in df.collect()}
    assert set(got) == {1, 2, 3} and len(got[1]["functions"]) == 7 and got[2]["parse_error"] and got[3]["functions"] == []
    assert X.functions(df).count() == 7 and X.classes(df).count() == 2 and X.imports(df).count() == 2 and X.tables(df).count() == 0


def test_sql_in_functions(spark):
    js = """function load(id) {
  db.query("SELECT * FROM ships WHERE name = 'it\\'s'");
  return pool.one(`SELECT a FROM port.calls JOIN ${table} ON x = ${f({a: 1})} WHERE b = 1`);
}
class Log { add(x) { sql`INTO nothing DELETE FROM old_calls`; run('INSERT INTO log VALUES (1)'); return 'just FROM words'; } }
"""
    made = X.extract(spark.createDataFrame([(1, "r", "a.js", ".js", js)], "file_id long, repo string, path_rel string, ext string, raw string"))
    rows = {r["name"]: (r["db_reads"], r["db_writes"]) for r in X.db_access(X.functions(made)).collect()}
    assert rows == {"load": (["calls", "ships"], []), "add": ([], ["log", "old_calls"])}
    f = X.facts_of(".js", js)["functions"]
    assert f[0]["sql"][1] == "SELECT a FROM port.calls JOIN $1 ON x = $2 WHERE b = 1"
    from codelode.operators import graph as G

    names = spark.createDataFrame([("r", "load", "lo")], "repo string, name string, alias string")
    assert {tuple(r) for r in G.data_edges(X.db_access(X.functions(made)), names).collect()} == {("r", "lo", "R→", "ships"), ("r", "lo", "R→", "calls")}


def test_documentation_is_found_in_linear_time():
    import time

    text = "".join(f"/** Says {k}. */\nfunction f{k}() {{}}\n" for k in range(3000))
    t = time.process_time()
    f = X.facts_of(".js", text)["functions"]
    assert len(f) == 3000 and all(x["has_doc"] for x in f) and time.process_time() - t < 5
