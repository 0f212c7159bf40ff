"""Further questions on the tables: style, context, symbols in full, caches, fixed orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codelode.functions.metadata import validate_text
from codelode.functions.text import CLIENT_READS, CLIENT_WRITES, CONTEXT_IGNORE, KNEX_REACH, MODEL_READS, MODEL_WRITES, NO_MODELS, code_tables, context_ignored, graph_ignored, mapper_tables, token_estimate, walked
from codelode.operators import analysis as A
from codelode.operators import docs as D
from codelode.operators import graph as G
from codelode.plans import analysis_queries as _analysis
from codelode.plans.analysis_queries import db_table_usage, files, large_files, texts
from codelode.plans.graph_queries import edges, nodes
from codelode.sources.tables import current, latest, table
from codelode.streaming.events import event_windows

#: names asked for by bundle_by_suffix
ASKED = ["panel.js", "gate.ts", "index.js", "/score.py", "_tank.go", "-lens.js", "quota.sql"]


def style_findings(spark, folder):
    """Findings of the ten style rules by repo and rule, in JavaScript files; a file's legend stands for its context file."""
    rows = files(spark, folder, ["repo", "ext"], found=A.style_rules(F.col("raw"), F.col("legend"))).where("ext in ('.js', '.mjs')")
    return rows.select("repo", F.explode("found").alias("x")).groupBy("repo", "x.rule").agg(F.count("*").alias("n_files"), F.sum("x.n").alias("n_findings"))


def context_ignore(spark, folder):
    """Files and tokens that the context of a whole project takes and leaves out by its default list, per repo."""
    rows = files(spark, folder, ["repo", "path_rel"], tokens=token_estimate(F.col("raw"))).where("tokens is not null and path_rel is not null and repo is not null").withColumn("out", context_ignored(F.col("path_rel")))
    return rows.groupBy("repo").agg(F.count_if(~F.col("out")).alias("n_taken"), F.count_if("out").alias("n_ignored"), F.coalesce(F.sum(F.when(~F.col("out"), F.col("tokens"))), F.lit(0)).alias("n_tokens"))


def import_span(spark, folder):
    """First and last import line of each file that has any."""
    lines = F.transform(F.split("raw", "\n"), lambda x, k: F.when(F.trim(x).startswith("import "), k + 1))
    rows = files(spark, folder, [], first=F.array_min(lines), last=F.array_max(lines), n=F.size(F.filter(lines, lambda k: k.isNotNull()))).where("first is not null")
    return rows.select("file_id", F.col("first").alias("first_line"), F.col("last").alias("last_line"), F.col("n").alias("n_imports"), (F.col("last") - F.col("first") + 1 > F.col("n")).alias("has_gaps"))


def graph_expand(spark, folder):
    """Every symbol in full."""
    return G.symbol_details(nodes(spark, folder).where("repo is not null and alias is not null"), edges(spark, folder))


def graph_node_keys(spark, folder):
    """Which parts of each node are not empty."""
    return G.present_keys(nodes(spark, folder))


def graph_cache(spark, folder):
    """Whether a graph built from the first scan of each file still fits the last one, per repo."""
    rows = table(spark, folder, "compress_files").where("repo is not null and path_rel is not null")
    at = lambda f: rows.groupBy("repo", "path_rel").agg(f(F.struct("scanned_at", "mtime")).alias("r")).select("repo", "path_rel", "r.mtime")
    return G.cache_valid(at(F.max), at(F.min))


def doc_lookup(spark, folder):
    """Documentation of each file: its legend, else what the graph knows of it, else that there is none; errors of the runs are the notes. As hashes."""
    own = files(spark, folder, ["repo", "path_rel"], text=F.trim(F.coalesce("legend", F.lit("")))).where("repo is not null and path_rel is not null")
    listed = F.concat(F.lit("--- "), "path_rel", F.lit(" ---\n"), F.array_join(F.array_sort(F.collect_set("node_name")), "\n"))
    known = nodes(spark, folder).where("path_rel is not null and node_name is not null").groupBy("repo", "path_rel").agg(listed.alias("text"))
    notes = table(spark, folder, "compact_runs").select("repo", F.explode("errors").alias("e")).groupBy("repo", F.col("e.file_path").alias("path_rel")).agg(F.min("e.error_msg").alias("text"))
    return D.doc_lookup(own, own, known, notes).select("repo", "path_rel", F.length("text").alias("n_chars"), F.md5("text").alias("hash"))


def bundle_by_suffix(spark, folder):
    """Of each repo the first file for each name asked for (a list of names is the feature)."""
    return D.by_suffix(files(spark, folder, ["repo", "path_rel"]).where("repo is not null and path_rel is not null"), ASKED)


def largest_files(spark, folder):
    """The 30 largest files of those that are rated, by points and lines (a report of fixed length)."""
    return large_files(spark, folder).orderBy(F.desc("points"), F.desc("n_lines"), "repo", "path_rel").limit(30)


def table_usage_order(spark, folder):
    """The 50 tables that are used most (a report of fixed length)."""
    return db_table_usage(spark, folder).orderBy(F.desc("total"), "repo", "table_name").limit(50)


SNIPPETS = [
    (1, "await prisma.orderItem.findMany({}); await prisma.user.create({}); prisma.$connect();"), (2, "Order.findOne({}); Product.count(); Order.sum('x'); User.bulkCreate([]); Invoice.destroy()"),
    (3, "Object.create(null); Buffer.create(1); Response.update(2); Foo.where(x); Foo.findMany()"), (4, "knex('users').where('a').select('*')"), (5, "knex('logs').insert({ a: 1 })"),
    (6, "q.select('*').from('goods').table('more'); q.insert({}).into('orders'); q.from('select')"), (7, 'db.query("SELECT * FROM accounts WHERE active = true"); x = `INSERT INTO logs VALUES (1)`'),
    (8, "t = 'UPDATE stock SET n = 1'; u = \"\"\"DELETE FROM old_rows\"\"\"; v = 'text only'"), (9, "const a = 1;"), (10, "s = `SELECT a FROM shop.carts JOIN lines ON true`; knex('t1').where(1)"),
]


def mapper_scan(spark, folder):
    """Tables read and written by a fixed set of snippets, through mappers and in strings: the tables have no such code."""
    rows = spark.createDataFrame(SNIPPETS, "snippet int, code string")
    made = lambda f, w: F.array_join(f(F.col("code"), w), ",")
    return rows.select("snippet", made(mapper_tables, False).alias("mapper_reads"), made(mapper_tables, True).alias("mapper_writes"), made(code_tables, False).alias("table_reads"), made(code_tables, True).alias("table_writes"))


def similar_orders(spark, folder):
    """Pairs of orders of one customer that score 60 or more by the similarity of functions: parts are the parameters, line states the control flow, suppliers the calls."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    text = lambda c: F.transform("l", lambda x: x[c].cast("string"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("repo"), (F.col("o_orderstatus") == "F").alias("is_async"))
    own = orders.join(lines, "l_orderkey").select(
        "repo", F.col("l_orderkey").alias("ord"), F.col("l_orderkey").cast("string").alias("name"), F.lit("orders").alias("path"), text("l_partkey").alias("params"), "is_async",
        F.array_join(text("l_linestatus"), "|").alias("structure"), F.array_distinct(text("l_suppkey")).alias("calls"),
    )
    return A.similar_functions(own).select(F.col("repo").alias("custkey"), F.col("a_ord").alias("first_order"), F.col("b_ord").alias("second_order"), "score")


def view_before_purchase(spark, folder):
    """For each purchase the user's last view at or before it, if that is at most two days old."""
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    rows = e.withColumn("viewed_at", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w)).where("event_type = 'purchase'")
    return rows.where(F.col("viewed_at") >= F.col("ts") - F.expr("interval 2 days")).select("event_id", "user_id", "viewed_at")


def markup_depth(spark, folder):
    """How deep the tags of each document nest, by a running sum over its tags, and what is left open at the end."""
    tags = F.regexp_extract_all("text", F.lit(r"<(/?)(?:div|span|p|b|i|em|strong|table|tr|td|ul|li|a)\b"), F.lit(1))
    rows = latest(table(spark, folder, "documents").select("doc_id", "loaded_at", tags.alias("tags")), "doc_id", "loaded_at", ["tags"])
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    depth = rows.select("doc_id", F.posexplode("tags").alias("n", "t")).withColumn("depth", F.sum(F.when(F.col("t") == "", 1).otherwise(-1)).over(w))
    return depth.groupBy("doc_id").agg(F.count("*").alias("n_tags"), F.max("depth").alias("deepest"), F.max_by("depth", "n").alias("left_open"))


METADATA = [
    (1, '{"version": 1, "stories": [{"id": "a", "beats": [{"nodes": ["X"]}]}]}'), (2, '{"version": 0, "clusters": [{"color": "red"}], "hiddenNodes": {}}'), (3, "[1]"), (4, "no json"),
    (5, '{"stories": [{"beats": []}, 3], "nodeDescriptions": []}'), (6, None),
]


def metadata_errors(spark, folder):
    """What is wrong in a fixed set of metadata documents."""
    check = F.udf(validate_text, "array<string>")
    return spark.createDataFrame(METADATA, "doc int, text string").select("doc", F.explode_outer(check("text")).alias("error"))


def scan_walk(spark, folder):
    """JavaScript files per repo that the plain walk takes, those the analyses take, and what an ignore list of the graph leaves of them."""
    rows = files(spark, folder, ["repo", "path_rel"]).where("path_rel is not null")
    path = F.col("path_rel")
    walk = walked(path)
    plain = walk & ~path.rlike(r"\.(?:css|tpl|min|test|spec)\.js$")
    return rows.groupBy("repo").agg(F.count_if(walk).alias("n_walked"), F.count_if(plain).alias("n_analysed"), F.count_if(plain & ~graph_ignored(path, IGNORED)).alias("n_in_graph"))


IGNORED = ["vendor*", "*_tank.js", "/gen/", "panel.js", "# note", " "]


def graph_chain(spark, folder):
    """Number of steps of a shortest chain of calls from the first caller of the largest repo to its most used symbol; null if there is none."""
    own = edges(spark, folder).where((F.col("repo") == "harbor-suite") & (F.col("op") == G.CALL))
    start = own.agg(F.min("src")).first()[0]
    chain = G.call_chain(own, start, "PS") if start else None
    return spark.createDataFrame([(start, "PS", len(chain) - 1 if chain else None)], "start string, goal string, n_steps int")


def stream_windows(spark, folder):
    """Events by hour and type, by the operator that runs on streams."""
    rows = event_windows(table(spark, folder, "events"))
    return rows.select("start", "event_type", "n_events", F.round("total_value", 3).alias("total_value"))


def context_entries(spark, folder):
    """Functions that the legends of files describe: parameters, descriptions."""
    rows = texts(spark, folder)
    keyed = rows.where("file_id is not null").select(F.struct("file_id", "version").alias("path"), F.col("legend").alias("text"))
    made = D.ctx_entries(keyed).select("path.file_id", "path.version", "line_no", "exported", "name", F.size("params").alias("n_params"), "description")
    return current(made, rows, "file_id", "version")


QUERIES = {f.__name__: f for f in (style_findings, context_ignore, import_span, graph_expand, graph_node_keys, graph_cache, doc_lookup, bundle_by_suffix, largest_files, table_usage_order, mapper_scan, similar_orders, view_before_purchase, markup_depth, metadata_errors, scan_walk, graph_chain, stream_windows, context_entries)}


def _pattern(p: str) -> str:
    """One ignore pattern as a condition on path_rel."""
    if p.endswith("/"):
        return f"starts_with(path_rel, '{p[:-1]}') OR contains(path_rel, '/{p[:-1]}')"
    r = "^" + p.replace(".", "[.]").replace("*", ".*") + "$"
    return f"regexp_matches(path_rel, '{r}') OR regexp_matches(split_part(path_rel, '/', -1), '{r}')"


_F = "WITH f AS (SELECT r.* FROM (SELECT arg_max(compress_files, scanned_at) AS r FROM compress_files GROUP BY file_id))"
_N = "WITH n AS (SELECT r.* FROM (SELECT arg_max(graph_nodes, loaded_at) AS r FROM graph_nodes GROUP BY node_id) WHERE r.seen_to IS NULL), e AS (SELECT r.* FROM (SELECT arg_max(graph_edges, loaded_at) AS r FROM graph_edges GROUP BY edge_id) WHERE r.src IS NOT NULL AND r.dst IS NOT NULL)"
_OUT = " OR ".join(f"({_pattern(p)})" for p in CONTEXT_IGNORE)
_WORD = r"regexp_matches(c, '(?:^|[^a-zA-Z_$])' || replace(x, '$', '\$') || '(?:[^a-zA-Z0-9_$]|$)')"
_BARE = "raw"
for _p, _to in ((r"// @ctx [^\n]*", ""), (r"import[^;]+;", ""), (r'"(?:[^"\\\n]|\\.)*"', '""'), (r"''(?:[^''\\\n]|\\.)*''", "''''"), (r"`[^`]*`", "``")):
    _BARE = f"regexp_replace({_BARE}, '{_p}', '{_to}', 'g')"
_IMPORTS = "len(list_filter(l, lambda x: starts_with(trim(x), 'import ')))"
_LONG = "len(list_filter(ids, lambda x: NOT list_contains(ex, x)))"
_RULES = {
    "missing-ctx-header": "CASE WHEN starts_with(CASE WHEN starts_with(trim(l[1]), '#!') THEN trim(coalesce(l[2], '')) ELSE trim(l[1]) END, '// @ctx ') THEN 0 ELSE 1 END",
    "missing-ctx-file": "CASE WHEN c IS NULL THEN 1 ELSE 0 END",
    "incomplete-ctx": f"coalesce(len(string_split(c, '{{DESCRIBE}}')) + len(string_split(c, '(auto-documented)')) - 2, 0) + CASE WHEN c IS NULL THEN 0 ELSE len(list_filter(ex, lambda x: NOT {_WORD})) END",
    "single-line-blob": "CASE WHEN c IS NOT NULL AND len(list_filter(l, lambda x: NOT starts_with(x, '// @ctx ') AND NOT starts_with(x, '#!'))) <= 2 AND len(string_split(s, ';')) - 1 > 3 THEN 1 ELSE 0 END",
    "ctx-minified-params": "len(list_filter(sg, lambda x: length(regexp_replace(x, '[?=:].*', '')) = 1))",
    "ctx-untyped-params": "len(list_filter(sg, lambda x: x <> '' AND NOT contains(x, ':')))",
    "ctx-coverage": f"CASE WHEN c IS NULL THEN 0 ELSE len(list_filter(fn, lambda x: NOT {_WORD})) END",
    "multi-line-imports": f"CASE WHEN {_IMPORTS} > 1 THEN {_IMPORTS} ELSE 0 END",
    "indented-lines": r"len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]')))",
    "long-names": f"CASE WHEN {_LONG} > 3 THEN {_LONG} ELSE 0 END",
}
_FOUND = " UNION ALL ".join(f"SELECT repo, '{rule}' AS rule, ({n})::BIGINT AS n FROM d" for rule, n in _RULES.items())
_longest_first = lambda words: "|".join(sorted(words, key=len, reverse=True))
_MAPPERS = " UNION ALL ".join([
    *[rf"SELECT file_id, '{w}' AS k, unnest(regexp_extract_all(code, '\bprisma\.(\w+)\.(?:{_longest_first(v)})\s*\(', 1)) AS t, true AS named FROM v" for w, v in (("r", CLIENT_READS), ("w", CLIENT_WRITES))],
    *[rf"SELECT file_id, '{w}', lower(t), true FROM (SELECT file_id, unnest(regexp_extract_all(code, '\b([A-Z][a-zA-Z]+)\.(?:{_longest_first(v)})\s*\(', 1)) AS t FROM v) WHERE NOT list_contains(string_split('{' '.join(NO_MODELS)}', ' '), t)" for w, v in (("r", MODEL_READS), ("w", MODEL_WRITES))],
    r"SELECT file_id, CASE WHEN regexp_matches(t, '(?i)\.(insert|update|del|delete|truncate)\s*\(') THEN 'w' ELSE 'r' END, regexp_extract(t, '^knex\s*\(\s*[\x22\x27](\w+)[\x22\x27]\s*\)', 1), false FROM k",
    *[rf"SELECT file_id, '{w}', unnest(regexp_extract_all(code, '\.(?:{v})\s*\(\s*[\x22\x27](\w+)[\x22\x27]\s*\)', 1)), false FROM v" for w, v in (("r", "from|table"), ("w", "into"))],
])
ORACLE = {
    "style_findings": _F + f", a AS (SELECT file_id, repo, raw, CASE WHEN trim(legend) <> '' THEN legend END AS c, string_split(raw, chr(10)) AS l, {_BARE} AS s FROM f WHERE raw IS NOT NULL AND ext IN ('.js', '.mjs'))" + r""",
d AS (SELECT *, list_filter(list_distinct(list_concat(regexp_extract_all(raw, '(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)', 1),
 list_transform(flatten(list_transform(regexp_extract_all(raw, '(?m)^export\s*\{([^}]*)\}', 1), lambda x: string_split(x, ','))), lambda x: regexp_extract(x, '([\w$]+)\s*$', 1)))), lambda x: x <> '') AS ex,
 list_distinct(regexp_extract_all(s, '(?:const|let|var|function)\s+([a-zA-Z_$][a-zA-Z0-9_$]{2,})', 1)) AS ids, list_distinct(regexp_extract_all(s, '(?m)(?:^|[;{}\s])function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(', 1)) AS fn,
 flatten(list_transform(regexp_extract_all(coalesce(c, ''), '(?m)^export\s+\w+\(([^)]+)\)', 1), lambda x: list_transform(string_split(x, ','), lambda y: trim(y)))) AS sg FROM a)""" + f", r AS ({_FOUND}) SELECT repo, rule, count(*) AS n_files, sum(n)::BIGINT AS n_findings FROM r WHERE n > 0 GROUP BY ALL",
    "context_ignore": _F + f", x AS (SELECT repo, ceil(length(raw) / 4)::BIGINT AS t, ({_OUT}) AS o FROM f WHERE raw IS NOT NULL AND path_rel IS NOT NULL AND repo IS NOT NULL) SELECT repo, count(*) FILTER (NOT o) AS n_taken, count(*) FILTER (o) AS n_ignored, coalesce(sum(t) FILTER (NOT o), 0)::BIGINT AS n_tokens FROM x GROUP BY 1",
    "import_span": _F + """, l AS (SELECT file_id, generate_subscripts(x, 1) AS k, unnest(x) AS line FROM (SELECT file_id, string_split(raw, chr(10)) AS x FROM f WHERE raw IS NOT NULL))
SELECT file_id, min(k)::INT AS first_line, max(k)::INT AS last_line, count(*)::INT AS n_imports, max(k) - min(k) + 1 > count(*) AS has_gaps FROM l WHERE starts_with(trim(line), 'import ') GROUP BY 1""",
    "graph_expand": _N + """, k AS (SELECT repo, src AS alias, string_agg(DISTINCT dst, ',' ORDER BY dst) AS calls FROM e WHERE op = '→' GROUP BY ALL),
o AS (SELECT DISTINCT repo, alias, node_name, CASE kind WHEN 'C' THEN 'class' WHEN 'F' THEN 'function' ELSE kind END AS type, path_rel, line_no, extends_name, coalesce(exported, false) AS exported, array_to_string(list_sort(list_distinct(coalesce(methods, []))), ',') AS methods,
 array_to_string(list_sort(list_distinct(coalesce(props, []))), ',') AS properties FROM n WHERE repo IS NOT NULL AND alias IS NOT NULL)
SELECT o.repo, o.alias AS symbol, node_name AS full_name, type, path_rel, line_no, extends_name, exported, methods, properties, coalesce(calls, '') AS calls FROM o LEFT JOIN k ON k.repo = o.repo AND k.alias = o.alias""",
    "graph_node_keys": _N + " SELECT DISTINCT repo, alias, node_name, concat_ws(',', CASE WHEN kind IS NOT NULL THEN 't' END, CASE WHEN extends_name IS NOT NULL THEN 'x' END, CASE WHEN len(methods) > 0 THEN 'm' END, CASE WHEN len(props) > 0 THEN '$' END, CASE WHEN exported IS NOT NULL THEN 'e' END, CASE WHEN path_rel IS NOT NULL THEN 'f' END, CASE WHEN line_no IS NOT NULL THEN 'l' END) AS keys FROM n",
    "graph_cache": "WITH x AS (SELECT repo, path_rel, arg_max(coalesce(mtime, TIMESTAMP '1900-01-01'), scanned_at) AS b, arg_min(coalesce(mtime, TIMESTAMP '1900-01-01'), scanned_at) AS a FROM compress_files WHERE repo IS NOT NULL AND path_rel IS NOT NULL GROUP BY ALL) SELECT repo, bool_and(a = b) AS valid FROM x GROUP BY 1",
    "doc_lookup": _F + ", " + _N.removeprefix("WITH ") + """, own AS (SELECT repo, path_rel, min(trim(legend)) FILTER (trim(legend) <> '') AS text FROM f WHERE repo IS NOT NULL AND path_rel IS NOT NULL GROUP BY ALL),
k AS (SELECT repo, path_rel, '--- ' || path_rel || ' ---' || chr(10) || string_agg(DISTINCT node_name, chr(10) ORDER BY node_name) AS text FROM n WHERE path_rel IS NOT NULL AND node_name IS NOT NULL GROUP BY repo, path_rel),
m AS (SELECT repo, e.file_path AS path_rel, min(e.error_msg) AS text FROM (SELECT repo, unnest(errors) AS e FROM compact_runs) GROUP BY ALL),
t AS (SELECT own.repo, own.path_rel, coalesce(own.text, trim(k.text), 'No documentation found for: ' || own.path_rel) || coalesce(chr(10) || chr(10) || trim(m.text), '') AS text FROM own LEFT JOIN k ON k.repo = own.repo AND k.path_rel = own.path_rel LEFT JOIN m ON m.repo = own.repo AND m.path_rel = own.path_rel AND trim(m.text) <> '')
SELECT repo, path_rel, length(text)::INT AS n_chars, md5(text) AS hash FROM t""",
    "bundle_by_suffix": _F + " SELECT repo, asked, min(path_rel) AS path_rel FROM f JOIN (VALUES " + ", ".join(f"('{a}')" for a in ASKED) + ") v(asked) ON ends_with(path_rel, asked) WHERE repo IS NOT NULL GROUP BY ALL",
    "largest_files": _analysis.ORACLE["large_files"] + " ORDER BY points DESC, n_lines DESC, repo, path_rel LIMIT 30",
    "table_usage_order": _analysis.ORACLE["db_table_usage"] + " ORDER BY total DESC, repo, table_name LIMIT 50",
    "mapper_scan": "WITH v(file_id, code) AS (VALUES " + ", ".join("({}, '{}')".format(k, c.replace("'", "''")) for k, c in SNIPPETS) + ")" + r""", e AS (SELECT file_id, code, regexp_replace(code, '\\[\\''\x22`]', '##', 'g') AS bare FROM v),
quoted AS (SELECT file_id, unnest(list_concat(regexp_extract_all(code, '\x22{3}([\s\S]*?)\x22{3}', 1), regexp_extract_all(code, '`([\s\S]*?)`', 1), regexp_extract_all(bare, '\x22([^\x22]*)\x22', 1), regexp_extract_all(bare, '\x27([^\x27]*)\x27', 1))) AS q FROM e),
s AS (SELECT file_id, trim(regexp_replace(q, '\s+', ' ', 'g')) AS q FROM quoted WHERE regexp_matches(q, '(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|WITH|CREATE\s+TABLE)\b'))""" + _analysis._NAMED + f""",
p AS (SELECT file_id, string_split(code, 'knex') AS p FROM v),
k AS (SELECT file_id, unnest(list_transform(range(2, len(p) + 1), lambda i: substr('knex' || array_to_string(p[i:], 'knex'), 1, {KNEX_REACH}))) AS t FROM p),
m AS ({_MAPPERS}),
n AS (SELECT DISTINCT file_id, k, t FROM m WHERE t <> '' AND (named OR length(t) >= 2 AND lower(t) NOT IN ({_analysis._STOP}) AND NOT regexp_matches(t, '^[A-Z][A-Z_]*$') AND NOT regexp_matches(t, '^[A-Z][a-z]') AND NOT regexp_matches(t, '^(pg_|jsonb_|array_|string_|regexp_)'))),
u AS (SELECT DISTINCT file_id, k, t FROM (SELECT file_id, k, t FROM n UNION ALL SELECT file_id, k, t FROM d)),
x AS (SELECT file_id, string_agg(t, ',' ORDER BY t) FILTER (k = 'r') AS r, string_agg(t, ',' ORDER BY t) FILTER (k = 'w') AS w FROM n GROUP BY 1), y AS (SELECT file_id, string_agg(t, ',' ORDER BY t) FILTER (k = 'r') AS r, string_agg(t, ',' ORDER BY t) FILTER (k = 'w') AS w FROM u GROUP BY 1)
SELECT v.file_id AS snippet, coalesce(x.r, '') AS mapper_reads, coalesce(x.w, '') AS mapper_writes, coalesce(y.r, '') AS table_reads, coalesce(y.w, '') AS table_writes FROM v LEFT JOIN x USING (file_id) LEFT JOIN y USING (file_id)""",
    "similar_orders": """WITH l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) AS p, list(l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) AS t, list_distinct(list(l_suppkey)) AS c FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS custkey, l.*, o_orderstatus = 'F' AS f, array_to_string(t, '|') AS s FROM orders JOIN l ON k = o_orderkey),
j AS (SELECT a.custkey, a.k AS first_order, b.k AS second_order, CASE WHEN len(a.p) = len(b.p) THEN 30 ELSE 0 END + floor(20 * len(list_filter(a.p, lambda x: list_contains(b.p, x))) / greatest(len(a.p), len(b.p)) + 0.5) + CASE WHEN a.f = b.f THEN 10 ELSE 0 END
 + CASE WHEN a.s = b.s THEN 25 ELSE floor(25 * len(list_filter(a.t, lambda x: list_contains(b.t, x))) / greatest(len(a.t), len(b.t)) + 0.5) END + floor(15 * len(list_filter(a.c, lambda x: list_contains(b.c, x))) / greatest(len(a.c), len(b.c)) + 0.5) AS score
 FROM o a JOIN o b ON a.custkey = b.custkey AND a.k < b.k WHERE NOT (length(a.s) < 3 AND length(b.s) < 3))
SELECT custkey, first_order, second_order, score::INT AS score FROM j WHERE score >= 60""",
    "view_before_purchase": "SELECT e.event_id, e.user_id, v.ts AS viewed_at FROM events e ASOF JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type = 'purchase' AND v.ts >= e.ts - INTERVAL 2 DAY",
    "markup_depth": r"""WITH d AS (SELECT doc_id, arg_max(text, loaded_at) AS text FROM documents GROUP BY 1), x AS (SELECT doc_id, regexp_extract_all(text, '<(/?)(?:div|span|p|b|i|em|strong|table|tr|td|ul|li|a)\b', 1) AS t FROM d WHERE text IS NOT NULL),
y AS (SELECT doc_id, generate_subscripts(t, 1) AS n, unnest(t) AS t FROM x), z AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY n) AS depth FROM y)
SELECT doc_id, count(*) AS n_tags, max(depth)::BIGINT AS deepest, arg_max(depth, n)::BIGINT AS left_open FROM z GROUP BY 1""",
    "scan_walk": _F + r""", p AS (SELECT repo, path_rel, string_split(path_rel, '/')[:-2] AS d, split_part(path_rel, '/', -1) AS b FROM f WHERE path_rel IS NOT NULL),
w AS (SELECT *, regexp_matches(lower(b), '[.](js|mjs)$') AND NOT starts_with(b, '.') AND len(list_filter(d, lambda x: list_contains(['node_modules', '.git', 'vendor', '.context', 'dev-docs', '.agent', '.agents', '.expanded', 'web'], x) OR starts_with(x, '.'))) = 0 AS walk FROM p),
a AS (SELECT *, walk AND NOT regexp_matches(path_rel, '[.](css|tpl|min|test|spec)[.]js$') AS plain FROM w)
SELECT repo, count(*) FILTER (walk) AS n_walked, count(*) FILTER (plain) AS n_analysed, count(*) FILTER (plain AND NOT (starts_with(path_rel, 'vendor') OR starts_with(b, 'vendor') OR ends_with(path_rel, '_tank.js') OR contains(path_rel, '/gen/') OR contains(path_rel, 'panel.js'))) AS n_in_graph FROM a GROUP BY 1""",
    "graph_chain": _N.replace("WITH n AS", "WITH RECURSIVE n AS") + """, c AS (SELECT DISTINCT src, dst, split_part(dst, '.', 1) AS base FROM e WHERE repo = 'harbor-suite' AND op = '→'), s AS (SELECT min(src) AS start FROM c),
w(here, depth) USING KEY (here) AS (SELECT start AS here, 0 AS depth FROM s UNION SELECT x.base, x.depth + 1 FROM (SELECT c.base, min(w.depth) AS depth FROM w JOIN c ON c.src = w.here GROUP BY ALL) x WHERE NOT EXISTS (SELECT 1 FROM recurring.w k WHERE k.here = x.base))
SELECT (SELECT start FROM s) AS start, 'PS' AS goal, (SELECT min(depth) + 1 FROM w JOIN c ON c.src = w.here WHERE c.dst = 'PS' OR c.base = 'PS' OR ends_with(c.dst, '.PS'))::INT AS n_steps""",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n_events, round(sum(value), 3) AS total_value FROM events GROUP BY ALL",
    "context_entries": _F + r""", x AS (SELECT file_id, string_split(replace(legend, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM f WHERE legend IS NOT NULL), y AS (SELECT file_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM x),
z AS (SELECT *, regexp_extract(line, '^(export )?(?:async )?([A-Za-z_$][\w$]*)\((.*?)\)(?:→([^→|]*))?(?:→([^|]*))?(?:\|(.*))?$', ['e', 'name', 'params', 'r', 'c', 'd']) AS m FROM y
 WHERE regexp_matches(line, '^(export )?(?:async )?([A-Za-z_$][\w$]*)\((.*?)\)(?:→([^→|]*))?(?:→([^|]*))?(?:\|(.*))?$') AND NOT starts_with(line, 'class ') AND NOT starts_with(line, ' '))
SELECT file_id, line_no::INT AS line_no, m.e <> '' AS exported, m.name AS name, len(list_filter(string_split(m.params, ','), lambda p: trim(p) <> ''))::INT AS n_params, CASE WHEN trim(m.d) IN ('{DESCRIBE}', '(auto-documented)') THEN '' ELSE trim(m.d) END AS description FROM z""",
}
