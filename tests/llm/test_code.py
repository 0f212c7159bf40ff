from codelode.llm import parsing as P
from codelode.llm import provenance as V
from codelode.llm.docpairs import documented_functions, name_words, to_come, useful

FILES = "file_id long, repo string, path_rel string, ext string, raw string, version timestamp, verdict int, doc int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 1, 1) for r in rows], FILES)


def test_verdicts(spark):
    rows = [
        (1, "r", "a.js", ".js", "const a = 1;"), (2, "r", "b.js", ".JS", "def f():\n    return 1\n"), (3, "r", "c.py", ".py", "def f(\n"), (4, "r", "d.go", ".go", ""), (5, "r", "e.sql", ".sql", None), (6, "r", "f.txt", ".txt", "x"),
        (None, "r", "g", ".js", "("), (7, "r", "h.ts", ".ts", "<<<<<<< HEAD\nconst a = 1;\n=======\nconst a = 2;\n>>>>>>> b\n"), (1, "r", "a.js", ".js", "const a = 1;"), (8, "r", "i.js", ".js", "x = [" + "1, " * 200_000 + "]"), (9, "r", "j.js", ".js", "x = [" + "1, " * 200_000),
    ]
    got = [(r["file_id"], r["verdict"], r["parsed_as"], r["has_marker"]) for r in P.parse_files(frame(spark, rows)).collect()]
    assert sorted(got) == [(1, "valid", "js", False), (1, "valid", "js", False), (2, "foreign", "py", False), (3, "corrupt", None, False), (4, "valid", "go", False), (7, "corrupt", None, True), (8, "valid", "js", False), (9, "corrupt", None, False)]
    assert P.parse_files(frame(spark, [])).count() == 0
    rates = {r["lang"]: (r["n_files"], r["n_bad"], r["n_conflict"]) for r in P.rates(P.parse_files(frame(spark, rows))).collect()}
    assert rates["typescript"] == (1, 1, 1) and rates["python"] == (1, 1, 0)
    assert P.rank("package p\nfunc f() { defer x := 1 }")[0] == "go"


def pairs(spark, *texts):
    rows = [(i, "r", "p", ext, raw) for i, (ext, raw) in enumerate(texts)]
    return sorted((r["file_id"], r["func_name"], r["line_no"]) for r in documented_functions(frame(spark, rows)).collect())


def test_pairs(spark):
    js = """/** Adds the two given numbers together. */
export const add = async (a, b) => a + b;
/**
 * Reads every line of a file.
 * @param {string} p the path
 */

function read(p) { return `function no() {}`; }
/** Reads it. */
function short() {}
/** Not the documentation of what follows it. */
// a comment between
function between() {}
class K {
  /** Closes all of the open handles. */
  static async close() { if (x) { y() } }
  /** Not a function, only some field here. */
  field = 1;
  /** Opens one of the handles again. */
  get open() { return 1; }
}
const s = '/** Text in a string says nothing. */ function f() {}';
/** Never closed brackets are not read here. */
const value = 3, g = () => {};
"""
    assert pairs(spark, (".js", js), (".js", "/** Good words about the function here. */ function f( {")) == [(0, "add", 2), (0, "close", 16), (0, "open", 20), (0, "read", 8)]
    ts = "/** Makes a box around the value. */\n@dec({ a: ')' })\nexport class A {}\nclass B {\n  /** Finds the first of the things. */\n  @log('x')\n  private find<T extends { a: string }>(a: T, b = () => 1): Map<string, T> { return b }\n}\n/** Maps all values of the list. */\nexport const map: (x: number) => { a: string } = (x: number): { a: string } => ({ a: `${x}` });\n"
    assert pairs(spark, (".ts", ts)) == [(0, "find", 7), (0, "map", 10)]
    py = 'class A:\n    """Not a function but a class."""\n    @x\n    async def go(self, a="(") -> "B":\n        # first\n        r"""Goes through all of it.\n\n        :param a: more and more words here\n        """\n\n    def no(self):\n        """:param a: more and more words here"""\n    def f(self): "One line with five words."\n    def g(self):\n        f"not a {doc} string at all here"\ns = """\ndef h():\n    "text in a string is none"\n"""\n'
    assert pairs(spark, (".py", py)) == [(0, "f", 13), (0, "go", 4)]
    go = "package p\n\n// Do runs all of the jobs.\n// It waits.\nfunc (s *S) Do(a interface{}) error {\n\treturn nil\n}\n\n// Far away from the function below.\n\nfunc Far() {}\n\n/* Block comments are not line comments here. */\nfunc Block() {}\n"
    assert pairs(spark, (".go", go), (".sql", "-- a b c d e\nCREATE TABLE a (b INT)"), (".go", None)) == [(0, "Do", 5)]


def test_trivial():
    assert name_words("loadHTMLFile_now2") == {"load", "html", "file", "now2"}
    assert not useful("Load file.", "loadFile") and not useful("TODO: document this function before the release", "f") and useful("Splits text at marks. TODO: reuse it", "f")
    assert not useful("@param {string} a one two three four five", "f") and useful("one two three four", "f") and not useful("one two three run", "run")
    assert all(map(to_come, ["Description pending; ask the owner", "Documentation to be added later by the owner", "FIXME - explain parameters", "todo write something useful"]))
    assert not any(map(to_come, ["Documents are read here", "Describes the way that it goes", "Text follows the cursor around"]))


def test_provenance_rules():
    j = lambda text, path="src/a.js", ext=".js": V.judge_text(text, path, ext)
    hand = "import a from './a.js';\n\n// this part generates the list shown to the user; edit with care\nexport function f(a) {\n  return a + 1;\n}\n"
    assert j(hand) == (False,) * 4 and j("") == (False,) * 4 and j("// Copyright 2024 us. MIT licence.\n" + hand) == (False,) * 4
    assert j("export const banner = '// Code generated by x. DO NOT EDIT.';\n" + hand)[0] is False
    assert j("// Code generated by x v1.2. DO NOT EDIT.\n" + hand)[0] and j("import b from 'b';\n// This file was produced automatically by x; manual changes will be lost.\n" + hand)[0]
    assert j("\n".join(f"const $$S{k}_x = [{k}, 'a', 0x1f];" for k in range(6)) + "\n" + hand)[0] and j(hand, "src/a.pb.js")[0]
    assert j(";".join(f"function a{k}(b){{return b.c*{k}+d[{k}]}}" for k in range(40)))[1]
    assert j(hand, "node_modules/x/a.js")[2] and not j(hand, "src/vendors/a.js")[2] and not j(hand, "src/vendor-portal/a.js")[2] and j("// xkit v1.2.3 | (c) the xkit contributors | MIT License\n" + hand)[2]
    small = "function a(b){return b.c};var d=1;function e(f){return f+d}"
    assert all(V.is_minified(small * n, ".js") for n in (1, 4, 8)) and not any(V.is_minified(hand * n, ".js") for n in (1, 4, 8)) and not V.is_minified("run();", ".js")
    rows = "[\n  1, 2, 3,\n  4, 5, 6,\n  7, 8, 9\n]\n"
    assert all(V.is_data(rows * n) for n in (1, 4, 8)) and not any(V.is_data(t * n) for n in (1, 4, 8) for t in ("'use strict';\n", '"""What it is for."""\n', "const a = 1;\nconst b = 'x';\n", ""))
    assert V.is_data("INSERT INTO a_b VALUES (0, 'some words', 3, NULL);\nINSERT INTO a_b (x, y) VALUES (1, 'more', 4);\n") and not V.is_data("CREATE TABLE a (\n  b INT,\n  c TEXT\n);\nINSERT INTO a VALUES (1, 'x');\n")
    assert V.is_data("package data\n\nvar t = []float64{\n" + "  1, 2, 3,\n" * 9 + "}\n")
    assert j("export default [\n" + "  1.5, -2.25, 3.125,\n" * 40 + "];\n")[3] and not j(hand + "const RAW = '" + "word " * 40 + "';\n")[3]


def test_shared_subtrees(spark):
    lib = [("lib/a.js", "a" * 300), ("lib/sub/b.js", "b" * 300)]
    rows = [(i, repo, f"{root}{p}", ".js", t) for i, (repo, root, p, t) in enumerate([("x", "copy/", p, t) for p, t in lib] + [("y", "other/place/", p, t) for p, t in lib] + [("x", "", f"src/{k}.js", f"own{k}" * 90) for k in range(4)] + [("y", "", f"app/{k}.js", f"his{k}" * 90) for k in range(4)] + [("f1", "", f"s/{k}.js", f"fork{k}" * 90) for k in range(3)] + [("f2", "", f"s/{k}.js", f"fork{k}" * 90) for k in range(3)])]
    rows += [(90, "x", None, ".js", "z"), (91, None, "q/a.js", ".js", "z"), (92, "x", "n/e.js", ".js", None)]
    got = {(r["repo"], r["dir"]) for r in V.shared_subtrees(frame(spark, rows)).collect()}
    assert got == {("x", "copy"), ("x", "copy/lib"), ("y", "other"), ("y", "other/place"), ("y", "other/place/lib")} - {("x", "copy"), ("y", "other/place"), ("y", "other")} | {("x", "copy"), ("y", "other/place")}
    assert {r["file_id"] for r in V.vendored_by_tree(frame(spark, rows)).collect()} == {0, 1, 2, 3}
    assert V.shared_subtrees(frame(spark, [])).count() == 0 and V.judge_files(frame(spark, rows)).count() == len(rows)
