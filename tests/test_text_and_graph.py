import pytest
from codelode.functions import text as X
from codelode.operators import analysis as A
from codelode.operators import graph as G
from pyspark.sql import functions as F


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("name,alias", [("SymNode", "SN"), ("SymNodeGraph", "SNG"), ("SymMiniMap", "SMM"), ("togglePin", "tP"), ("autoArrange", "aA"), ("moor", "mo"), ("_tie", "_t"), ("Berth", "bB"), ("A", "aA"), ("readLog", "rL"), ("ab", "ab"), ("SN1", "SN1")])
def test_alias_base(spark, name, alias):
    assert one(spark, name, X.alias_base) == alias


def test_sql_and_mapper_tables(spark):
    sql = "SELECT * FROM public.orders o JOIN products p ON 1 = 1 -- FROM nothing\n"
    assert one(spark, sql, X.sql_reads) == ["orders", "products"]
    assert one(spark, "DELETE FROM users WHERE 1 = 1", X.sql_writes) == ["users"]
    assert one(spark, "DELETE FROM users WHERE 1 = 1", X.sql_reads) == []
    assert one(spark, "INSERT INTO logs VALUES (1)", X.sql_writes) == ["logs"]
    assert one(spark, "DELETE FROM public.users; SELECT * FROM users", X.sql_reads) == ["users"]
    assert one(spark, "SELECT * FROM unnest(a), integer, Users, A1x, USERS_ALL", X.sql_reads) == [] and one(spark, "SELECT * FROM A1x JOIN b.c.d ON true", X.sql_reads) == ["A1x"]


@pytest.mark.parametrize("code,reads,writes", [
    ("prisma.orderItem.findMany(); prisma.user.create({}); prisma.$connect(); prisma.x.unknown()", ["orderItem"], ["user"]),
    ("Order.findOne({}); Product.count(); Order.sum('x'); User.bulkCreate([]); Invoice.destroy()", ["order", "product"], ["invoice", "user"]),
    ("Object.create(null); Buffer.create(1); Response.update(2); Promise.count(); Foo.where(x); Foo.findMany()", [], []),
    ("knex('users').where('a').select('*'); " + " " * 200 + "knex('logs').insert({})", ["users"], ["logs"]),
    ("q.select('*').from('goods').table('more'); q.insert({}).into('orders'); q.from('select')", ["goods", "more"], ["orders"]),
    ("db.query(\"SELECT * FROM accounts WHERE a = \\\"x\\\"\"); s = `INSERT INTO logs VALUES (1)`; t = 'UPDATE stock SET n = 1'; u = '''DELETE FROM old_rows'''", ["accounts"], ["logs", "old_rows", "stock"]),
    ("\"" + "\\\"" * 50_000 + "\"", [], []), ("", [], []),
])
def test_tables_in_code(spark, code, reads, writes):
    assert one(spark, code, lambda c: X.code_tables(c, False)) == reads and one(spark, code, lambda c: X.code_tables(c, True)) == writes


def aliases(names):
    """The aliases of names one after the other: the short form, or it and the first free number."""
    taken, out = set(), {}
    for n in names:
        rest = "".join(c for c in n if not "a" <= c <= "z")
        capital = next((c for c in n if "A" <= c <= "Z"), "")
        base = rest[:3] if len(rest) >= 2 else n[0].lower() + capital if capital else n[:2]
        k = 0
        while (base + str(k) if k else base) in taken:
            k += 1
        out[n] = base + str(k) if k else base
        taken.add(out[n])
    return out


def test_legend_is_unique(spark):
    import random

    rng = random.Random(3)
    names = ["SymNode", "SomeNode", "SymNode1", "SmallNode", "SN1", "SN11", "SuchNode", "SoonNew1"] + ["".join(rng.choice("SNab1") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    names = list(dict.fromkeys(names))
    df = spark.createDataFrame([("r", n, k) for k, n in enumerate(names)] + [("r", None, 0), ("r", "", 1), ("r", names[0], 900), ("q", "SymNode1", 1)], "repo string, name string, ord long")
    got = {(r["repo"], r["name"]): r["alias"] for r in G.legend(df).collect()}
    want = aliases(names)
    assert got.pop(("q", "SymNode1")) == "SN1" and {n: a for (_, n), a in got.items()} == want and len(set(want.values())) == len(want)
    assert G.legend(df.limit(0)).count() == 0


def test_paths(spark):
    f = lambda p, **k: one(spark, p, lambda c: X.excluded(c, **k))
    assert f("node_modules/a/b.js") and f("src/.git/x") and f("src/a.test.js") and not f("src/a.js") and not f("out.js")
    assert f("src/layout.js", ignore=["out"]) and not f("src/a.js", ignore=["# src", ""])
    assert one(spark, "abcde", X.token_estimate, "string") == 2


def graph(spark):
    nodes = spark.createDataFrame(
        [("r", "A", "C", "Berth", None, ["depth", "go"], True, "m.js", 1), ("r", "D", "C", "DryDock", "Berth", ["depth"], True, "m.js", 13), ("r", "f", "F", "free", None, None, None, "u.js", 1), ("r", "g", "F", "got", None, None, False, "u.js", 5), ("r", "h", "F", "here", None, None, True, None, None)],
        "repo string, alias string, kind string, node_name string, extends_name string, methods array<string>, exported boolean, path_rel string, line_no int",
    )
    edges = spark.createDataFrame([("r", "A", "→", "g.x"), ("r", "A", "→", "D"), ("r", "D", "→", "f2"), ("r", "f2", "→", "end.z"), ("r", "A", "F→", "f"), ("r", "D", "R→", "users")], "repo string, src string, op string, dst string")
    return nodes, edges


def test_graph_questions(spark):
    nodes, edges = graph(spark)
    assert [r["alias"] for r in G.orphans(nodes, edges.where("op <> 'F→'")).collect()] == ["f"]
    assert [(r["method_name"], r["members"]) for r in G.duplicate_methods(nodes).collect()] == [("depth", "Berth:1,DryDock:13")]
    deps = {tuple(r) for r in G.dependencies(nodes, edges, "r", "D").collect()}
    assert deps == {("calls", "f2"), ("reads", "users"), ("usedBy", "A")}
    assert {r["src"] for r in G.usages(nodes, edges, "g").collect()} == {"A"}
    assert G.call_chain(edges, "A", "z") == ["A", "D", "f2", "end.z"]
    assert G.call_chain(edges, "A", "nowhere") is None
    got = {(r["alias"], r["depth"]) for r in G.reachable(edges.where("op = '→'"), spark.createDataFrame([("A",)], "start string")).collect()}
    assert got == {("A", 0), ("D", 1), ("g", 1), ("f2", 2), ("end", 3)}
    sk = {r["path_rel"]: r for r in G.skeleton(nodes).collect()}
    assert sk["m.js"]["classes"] == "Berth,DryDock" and sk["m.js"]["n_methods"] == 3 and sk["u.js"]["exported_functions"] == ""
    assert G.graph_stats(nodes, edges).first().asDict() == {"repo": "r", "n_nodes": 5, "n_edges": 6, "n_orphans": 0, "n_duplicates": 1}
    assert G.orphans(nodes.limit(0), edges.limit(0)).count() == 0


def test_legend_tells_collisions_apart(spark):
    names = spark.createDataFrame([("r", "SymNode", 1), ("r", "SubNode", 2), ("r", "SymNode", 3), ("r", None, 4), ("r", "SeaNet", 0)], "repo string, name string, ord int")
    assert {(r["name"], r["alias"]) for r in G.legend(names).collect()} == {("SeaNet", "SN"), ("SymNode", "SN1"), ("SubNode", "SN2")}


def test_rules(spark):
    lines = spark.createDataFrame([(1, "a.js", 1, "var x = 'eval('; eval(y)"), (1, "a.js", 2, "// eval(y)"), (2, "b.min.js", 1, "var z"), (3, "c.py", 1, "eval(1)")], "file_id long, path string, line_no int, line string")
    rules = spark.createDataFrame([("v", 0, "var ", False, "warning", "*.js", ["*.min.js"]), ("e", 1, r"\beval\(", True, "error", "*.js", []), ("w", 2, "var ", False, "info", "*.js", [])], "rule_id string, rank int, pattern string, is_regex boolean, severity string, file_pattern string, exclude array<string>")
    got = {(r["file_id"], r["line_no"], r["rule_id"]) for r in A.check_rules(lines, rules, ["file_id", "path"], "path").collect()}
    assert got == {(1, 1, "v"), (2, 1, "w")}  # the first eval( is in quotes, and only the first place counts


def test_scores(spark):
    f = spark.createDataFrame([("r", 1, "a", "p", ["x", "y"], False, "IF|RET", ["q"]), ("r", 2, "b", "p", ["x", "y"], False, "IF|RET", ["q"]), ("r", 3, "c", "p", ["z"], True, "FOR", [])], "repo string, ord long, name string, path string, params array<string>, is_async boolean, structure string, calls array<string>")
    assert [(r["a_name"], r["b_name"], r["score"]) for r in A.similar_functions(f, 60).collect()] == [("a", "b", 100)]
    assert A.similar_functions(f, 95).count() == 1
    z = F.lit(0)
    score = spark.range(1).select(A.health(F.lit(12), z, F.lit(3), z, z, z, z, z, z, z, z).alias("s")).select("s", A.health_rating(F.col("s"))).first()
    assert tuple(score) == (71, "good")
    files = spark.createDataFrame([("a", 400, 12, 2, 6), ("b", 10, None, None, None)], "p string, n_lines int, n_functions int, n_classes int, n_exports int")
    assert [(r["rating"], r["points"]) for r in A.large_files(files).orderBy("p").collect()] == [("critical", 4), ("ok", 0)]
    cache = spark.createDataFrame([(1, "x"), (2, None)], "id int, hash string")
    assert [r["hit"] for r in A.cache_state(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, hash string"), cache, ["id"]).orderBy("id").collect()] == [True, False, False]


def test_walks_and_lists(spark):
    paths = ["src/a.js", "web/a.js", "src/.x/a.mjs", "src/.a.js", "a.MJS", "src/a.ts", "vendor2/b.js", "lib/b_tank.js", "x/gen/c.js", None, ""]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string")
    got = {r["p"]: (r["w"], r["g"], r["c"]) for r in df.select("p", X.walked(F.col("p")).alias("w"), X.graph_ignored(F.col("p"), ["vendor*", "*_tank.js", "/gen/", "# a", ""]).alias("g"), X.context_ignored(F.col("p"), ["vendor2/", "?.ts", "*.mjs", ""]).alias("c")).collect()}
    assert {p for p, x in got.items() if x[0]} == {"src/a.js", "a.MJS", "vendor2/b.js", "lib/b_tank.js", "x/gen/c.js"}
    assert {p for p, x in got.items() if x[1]} == {"vendor2/b.js", "lib/b_tank.js", "x/gen/c.js"} and {p for p, x in got.items() if x[2]} == {"vendor2/b.js", "src/a.ts", "src/.x/a.mjs"}


def test_symbols_in_full_and_caches(spark):
    nodes = spark.createDataFrame([("r", "B", "C", "Berth", None, ["depth", None], None, True, "b.js", 3), ("r", "f", "F", "free", None, None, ["x"], None, None, None)], "repo string, alias string, kind string, node_name string, extends_name string, methods array<string>, props array<string>, exported boolean, path_rel string, line_no int")
    edges = spark.createDataFrame([("r", "B", "→", "f.x"), ("r", "B", "→", "f"), ("r", "B", "R→", "t")], "repo string, src string, op string, dst string")
    rows = {r["symbol"]: r for r in G.symbol_details(nodes, edges).collect()}
    assert rows["B"]["calls"] == "f,f.x" and rows["B"]["type"] == "class" and rows["f"]["properties"] == "x" and rows["f"]["calls"] == ""
    assert {r["alias"]: r["keys"] for r in G.present_keys(nodes).collect()} == {"B": "t,m,e,f,l", "f": "t,$"}
    assert G.method_source("/** Says. */\nasync depth(a) { if (a) { b(); } }\nother() {}", "depth") == "/** Says. */\nasync depth(a) { if (a) { b(); } }" and G.method_source("x", "depth") == "" and G.method_source("depth() { {", "depth") == "depth() { {"
    times = lambda rows: spark.createDataFrame(rows, "repo string, path_rel string, mtime string")
    valid = G.cache_valid(times([("a", "x", "1"), ("b", "x", "1"), ("c", "x", None), ("d", "y", "1")]), times([("a", "x", "1"), ("b", "x", "2"), ("c", "x", None), ("e", "y", "1")]))
    assert {tuple(r) for r in valid.collect()} == {("a", True), ("b", False), ("c", True), ("d", False), ("e", False)}
