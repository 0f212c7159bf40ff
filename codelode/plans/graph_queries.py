"""The graph operators on the tables of the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators import graph as G
from codelode.sources.tables import latest, table

NODE = ["repo", "alias", "kind", "node_name", "extends_name", "methods", "props", "exported", "path_rel", "line_no", "seen_from", "seen_to"]


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the last load that are still there."""
    return latest(table(spark, folder, "graph_nodes"), "node_id", "loaded_at", NODE).where("seen_to is null")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "graph_edges"), "edge_id", "loaded_at", ["repo", "src", "op", "dst", "observed_at"]).where("src is not null and dst is not null")


_CTE = """
WITH n AS (SELECT r.* FROM (SELECT arg_max(graph_nodes, loaded_at) AS r FROM graph_nodes GROUP BY node_id) WHERE r.seen_to IS NULL),
e AS (SELECT r.* FROM (SELECT arg_max(graph_edges, loaded_at) AS r FROM graph_edges GROUP BY edge_id) WHERE r.src IS NOT NULL AND r.dst IS NOT NULL),
t AS (SELECT DISTINCT repo, split_part(dst, '.', 1) AS alias FROM e),
o AS (SELECT DISTINCT repo, alias, node_name FROM n WHERE kind = 'F' AND NOT coalesce(exported, false) AND NOT EXISTS (SELECT 1 FROM t WHERE t.repo = n.repo AND t.alias = n.alias)),
m AS (SELECT repo, method_name, node_name, min(line_no) AS line_no FROM (SELECT repo, unnest(methods) AS method_name, node_name, line_no FROM n WHERE kind = 'C') WHERE method_name IS NOT NULL GROUP BY ALL),
d AS (SELECT repo, method_name, count(*) AS n_classes, string_agg(x, ',' ORDER BY x) AS members FROM (SELECT *, node_name || ':' || coalesce(line_no::VARCHAR, '?') AS x FROM m) GROUP BY ALL HAVING count(*) > 1)
"""


def graph_orphans(spark, folder):
    return G.orphans(nodes(spark, folder), edges(spark, folder))


def graph_duplicate_methods(spark, folder):
    return G.duplicate_methods(nodes(spark, folder))


def graph_usage_counts(spark, folder):
    return G.usage_counts(nodes(spark, folder), edges(spark, folder))


def graph_deps(spark, folder):
    """Dependencies of the symbol that is used most in the largest repo, by prefix."""
    return G.dependencies(nodes(spark, folder), edges(spark, folder), "harbor-suite", "PS")


def graph_usages(spark, folder):
    return G.usages(nodes(spark, folder), edges(spark, folder), "Pipe").select("repo", "src", "node_name")


def _calls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(links, starts): calls between aliases of one repo, and every 20th node."""
    name = lambda alias: F.concat("repo", F.lit("/"), alias)
    own = edges(spark, folder).where(F.col("op") == G.CALL).select(name(F.col("src")).alias("src"), name(G.target_base("dst")).alias("dst"))
    return own, table(spark, folder, "graph_nodes").where("node_id % 20 = 0 and repo is not null and alias is not null").select(name(F.col("alias")).alias("start"))


def graph_reachable(spark, folder):
    """Aliases reached along calls from every 20th node, all repos, three steps as in its SQL; graph_closure has all of them."""
    return G.reach(*_calls(spark, folder), steps=3).select("start", "alias", "depth")


def graph_closure(spark, folder):
    """Aliases reached along calls from every 20th node, all repos, in any number of steps.

    What stands before the first slash of a name is the same at both ends of a call, also where repos or aliases have slashes themselves.
    """
    links, starts = _calls(spark, folder)
    root = lambda c: F.substring_index(c, "/", 1).alias("root")
    return G.closure(links.select(root("src"), "src", "dst"), starts.select(root("start"), "start")).select("start", "alias", "depth")


def graph_skeleton(spark, folder):
    return G.skeleton(nodes(spark, folder))


def graph_stats(spark, folder):
    return G.graph_stats(nodes(spark, folder), edges(spark, folder))


def graph_legend(spark, folder):
    """Aliases for the names of each repo, in order of the records."""
    names = latest(table(spark, folder, "graph_nodes"), "node_id", "loaded_at", ["repo", "node_name"])
    return G.legend(names.where("repo is not null").select("repo", F.col("node_name").alias("name"), F.col("node_id").alias("ord"))).select("repo", "name", "alias")


def graph_call_edges(spark, folder):
    """The stored calls of classes by name, with new aliases: classes first, then functions, then methods, each in order of line and name."""
    own = nodes(spark, folder).where("repo is not null and node_name is not null")
    place = lambda rank: F.concat(F.lit(rank), F.lpad(F.coalesce("line_no", F.lit(0)).cast("string"), 10, "0"), "node_name")
    names = own.select("repo", F.col("node_name").alias("name"), F.when(F.col("kind") == "C", place("0")).otherwise(place("1")).alias("ord"))
    names = names.unionByName(own.where("kind = 'C'").select("repo", F.explode("methods").alias("name"), place("2").alias("ord")))
    called = edges(spark, folder).where(F.col("op") == G.CALL).select("repo", F.col("src").alias("alias"), G.target_base("dst").alias("target"), F.expr("nullif(substring(dst, length(substring_index(dst, '.', 1)) + 2), '')").alias("member"))
    known = own.select("repo", F.col("alias").alias("target"), F.col("node_name").alias("target_name")).distinct()
    calls = called.join(own.where("kind = 'C'").select("repo", "alias", "node_name").distinct(), ["repo", "alias"]).join(known, ["repo", "target"])
    calls = calls.select("repo", F.col("node_name").alias("name"), F.array(F.concat_ws(".", "target_name", "member")).alias("calls"))
    return G.call_edges(calls, G.legend(names))


def graph_inheritance(spark, folder):
    """Classes with the number of classes that extend them, and whether the parent is known in the repo."""
    own = nodes(spark, folder).where("kind = 'C'")
    known = own.select("repo", F.col("node_name").alias("extends_name")).distinct().withColumn("known", F.lit(True))
    return (
        own.where("extends_name is not null").groupBy("repo", "extends_name").agg(F.count_distinct("node_name").alias("n_children"))
        .join(known, ["repo", "extends_name"], "left").select("repo", "extends_name", "n_children", F.coalesce("known", F.lit(False)).alias("known"))
    )


def focus_zone(spark, folder):
    """Classes in the five files of each repo that were scanned last."""
    files = table(spark, folder, "compress_files").where("repo is not null and path_rel is not null").groupBy("repo", "path_rel").agg(F.max("scanned_at").alias("at"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("at").desc_nulls_last(), "path_rel"))
    return G.focus_zone(nodes(spark, folder), files.withColumn("n", n).where("n <= 5").select("repo", "path_rel"))


QUERIES = {f.__name__: f for f in (graph_orphans, graph_duplicate_methods, graph_usage_counts, graph_deps, graph_usages, graph_reachable, graph_closure, graph_skeleton, graph_stats, graph_legend, graph_call_edges, graph_inheritance, focus_zone)}
#: the names of each repo one after the other, with a list of what is taken
_LEGEND = """ordered AS (SELECT repo, name, row_number() OVER (PARTITION BY repo ORDER BY ord, name) AS i, CASE WHEN length(rest) >= 2 THEN substr(rest, 1, 3) WHEN cap <> '' THEN lower(substr(name, 1, 1)) || cap ELSE substr(name, 1, 2) END AS b
  FROM (SELECT *, regexp_replace(name, '[a-z]', '', 'g') AS rest, regexp_extract(name, '[A-Z]') AS cap FROM first)),
w AS (SELECT DISTINCT repo, 0::BIGINT AS i, ''::VARCHAR AS name, ''::VARCHAR AS alias, []::VARCHAR[] AS taken FROM first
  UNION ALL SELECT repo, i, name, alias, list_append(taken, alias) FROM (SELECT o.repo, o.i, o.name, w.taken,
    list_filter(list_prepend(o.b, list_transform(range(1, len(list_filter(w.taken, lambda t: starts_with(t, o.b))) + 2), lambda k: o.b || k::VARCHAR)), lambda x: NOT list_contains(w.taken, x))[1] AS alias
    FROM w JOIN ordered o ON o.repo = w.repo AND o.i = w.i + 1)),
legend AS (SELECT repo, name, alias FROM w WHERE i > 0)
"""
ORACLE = {
    "graph_orphans": _CTE + "SELECT * FROM o",
    "graph_duplicate_methods": _CTE + "SELECT * FROM d",
    "graph_usage_counts": _CTE + """, own AS (SELECT DISTINCT repo, alias FROM n),
a AS (SELECT repo, src AS alias, count(*) FILTER (op = '→') AS n_calls, count(*) FILTER (op IN ('R→', 'W→')) AS n_tables FROM e GROUP BY ALL),
b AS (SELECT repo, split_part(dst, '.', 1) AS alias, count(DISTINCT src) AS n_used_by FROM e WHERE op <> 'F→' GROUP BY ALL)
SELECT own.repo, own.alias, coalesce(n_calls, 0) AS n_calls, coalesce(n_tables, 0) AS n_tables, coalesce(n_used_by, 0) AS n_used_by FROM own LEFT JOIN a USING (repo, alias) LEFT JOIN b USING (repo, alias)""",
    "graph_deps": _CTE + """SELECT DISTINCT CASE op WHEN '→' THEN 'calls' WHEN 'R→' THEN 'reads' WHEN 'W→' THEN 'writes' WHEN 'F→' THEN 'files' ELSE 'elements' END AS relation, dst AS name FROM e WHERE repo = 'harbor-suite' AND src = 'PS'
UNION SELECT DISTINCT 'usedBy', src FROM e WHERE repo = 'harbor-suite' AND starts_with(dst, 'PS') AND op <> 'F→'""",
    "graph_usages": _CTE + "SELECT DISTINCT e.repo, e.src, n.node_name FROM e JOIN n ON n.repo = e.repo AND n.alias = e.src AND n.kind = 'C' WHERE op = '→' AND contains(dst, 'Pipe')",
    "graph_reachable": _CTE.replace("WITH n AS", "WITH RECURSIVE n AS") + """, l AS (SELECT DISTINCT repo || '/' || src AS src, repo || '/' || split_part(dst, '.', 1) AS dst FROM e WHERE op = '→'),
s AS (SELECT DISTINCT repo || '/' || alias AS start FROM graph_nodes WHERE node_id % 20 = 0 AND repo IS NOT NULL AND alias IS NOT NULL),
w AS (SELECT start, start AS alias, 0 AS depth FROM s UNION SELECT w.start, l.dst, depth + 1 FROM w JOIN l ON l.src = w.alias AND l.src <> l.dst WHERE depth < 3)
SELECT start, alias, min(depth) AS depth FROM w GROUP BY ALL""",
    "graph_closure": _CTE.replace("WITH n AS", "WITH RECURSIVE n AS") + """, l AS (SELECT DISTINCT repo || '/' || src AS src, repo || '/' || split_part(dst, '.', 1) AS dst FROM e WHERE op = '→'),
s AS (SELECT DISTINCT repo || '/' || alias AS start FROM graph_nodes WHERE node_id % 20 = 0 AND repo IS NOT NULL AND alias IS NOT NULL),
w(start, alias, depth) USING KEY (start, alias) AS (SELECT start, start AS alias, 0 AS depth FROM s UNION SELECT x.start, x.dst, x.depth + 1 FROM (SELECT w.start, l.dst, min(w.depth) AS depth FROM w JOIN l ON l.src = w.alias AND l.src <> l.dst GROUP BY ALL) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.w k WHERE k.start = x.start AND k.alias = x.dst))
SELECT start, alias, depth FROM w""",
    "graph_skeleton": _CTE + """, f AS (SELECT DISTINCT repo, path_rel, kind, node_name, coalesce(exported, false) AS exported, coalesce(len(methods), 0) AS n_methods FROM n WHERE path_rel IS NOT NULL)
SELECT repo, path_rel, coalesce(string_agg(DISTINCT node_name, ',' ORDER BY node_name) FILTER (kind = 'C'), '') AS classes, coalesce(string_agg(DISTINCT node_name, ',' ORDER BY node_name) FILTER (kind = 'F' AND exported), '') AS exported_functions,
count(*) FILTER (kind = 'C') AS n_classes, count(*) FILTER (kind = 'F') AS n_functions, coalesce(sum(n_methods) FILTER (kind = 'C'), 0)::BIGINT AS n_methods FROM f GROUP BY ALL""",
    "graph_stats": _CTE + """SELECT coalesce(a.repo, b.repo) AS repo, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_duplicates, 0) AS n_duplicates
FROM (SELECT repo, count(DISTINCT alias) AS n_nodes FROM n GROUP BY 1) a FULL JOIN (SELECT repo, count(*) AS n_edges FROM e GROUP BY 1) b ON a.repo = b.repo
LEFT JOIN (SELECT repo, count(DISTINCT alias) AS n_orphans FROM o GROUP BY 1) c ON c.repo = coalesce(a.repo, b.repo) LEFT JOIN (SELECT repo, count(*) AS n_duplicates FROM d GROUP BY 1) x ON x.repo = coalesce(a.repo, b.repo)""",
    "graph_legend": """WITH RECURSIVE first AS (SELECT repo, name, min(ord) AS ord FROM (SELECT arg_max(repo, loaded_at) AS repo, arg_max(node_name, loaded_at) AS name, node_id AS ord FROM graph_nodes GROUP BY node_id) WHERE repo IS NOT NULL AND name IS NOT NULL AND name <> '' GROUP BY ALL),
""" + _LEGEND + "SELECT * FROM legend",
    "graph_call_edges": _CTE.replace("WITH n AS", "WITH RECURSIVE n AS") + """, p AS (SELECT repo, node_name, kind, methods, lpad(coalesce(line_no, 0)::VARCHAR, 10, '0') || node_name AS place FROM n WHERE repo IS NOT NULL AND node_name IS NOT NULL),
first AS (SELECT repo, name, min(ord) AS ord FROM (SELECT repo, node_name AS name, CASE WHEN kind = 'C' THEN '0' ELSE '1' END || place AS ord FROM p UNION ALL SELECT repo, unnest(methods), '2' || place FROM p WHERE kind = 'C') WHERE name IS NOT NULL AND name <> '' GROUP BY ALL),
""" + _LEGEND + """, c AS (SELECT DISTINCT e.repo, s.node_name AS caller, g.node_name AS target, nullif(substr(e.dst, length(split_part(e.dst, '.', 1)) + 2), '') AS member FROM e JOIN n s ON s.repo = e.repo AND s.alias = e.src AND s.kind = 'C' JOIN n g ON g.repo = e.repo AND g.alias = split_part(e.dst, '.', 1) WHERE e.op = '→')
SELECT DISTINCT c.repo, a.alias AS src, '→' AS op, CASE WHEN c.member IS NULL THEN b.alias ELSE b.alias || '.' || coalesce(m.alias, c.member) END AS dst FROM c JOIN legend a ON a.repo = c.repo AND a.name = c.caller
JOIN legend b ON b.repo = c.repo AND b.name = c.target LEFT JOIN legend m ON m.repo = c.repo AND m.name = c.member""",
    "graph_inheritance": _CTE + """SELECT repo, extends_name, count(DISTINCT node_name) AS n_children, EXISTS (SELECT 1 FROM n k WHERE k.kind = 'C' AND k.repo = n.repo AND k.node_name = n.extends_name) AS known
FROM n WHERE kind = 'C' AND extends_name IS NOT NULL GROUP BY ALL""",
    "focus_zone": _CTE + """, f AS (SELECT repo, path_rel, max(scanned_at) AS ts FROM compress_files WHERE repo IS NOT NULL AND path_rel IS NOT NULL GROUP BY ALL),
r AS (SELECT repo, path_rel FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC NULLS LAST, path_rel) <= 5)
SELECT n.repo, n.alias, n.node_name, bool_or(r.path_rel IS NOT NULL) AS expanded FROM (SELECT DISTINCT repo, alias, node_name, path_rel FROM n WHERE kind = 'C') n LEFT JOIN r ON r.repo = n.repo AND r.path_rel = n.path_rel GROUP BY ALL""",
}
