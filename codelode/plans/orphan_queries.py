"""References of the code graph: problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.references import PARENT, REF, merge_references, orphan_counts, table_key
from codelode.sources.tables import latest, table


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, parents, the keys of all rows of edges, repeated ones included)."""
    edges = latest(table(spark, folder, "graph_edges"), "edge_id", "loaded_at", ["repo", "src", "op", "dst", "observed_at"])
    nodes = latest(table(spark, folder, "graph_nodes"), "node_id", "loaded_at", ["repo", "alias", "path_rel", "seen_from", "seen_to"])
    tables = latest(table(spark, folder, "db_tables"), "table_id", "loaded_at", ["repo", "table_name", "file_path", "seen_from", "seen_to"])
    files = table(spark, folder, "compress_files").select("repo", "path_rel").distinct()

    def ref(name, field, kind, key):
        return F.struct(F.lit(name).alias("ref_field"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(field).alias("_f"))

    base = F.substring_index("dst", ".", 1)
    is_node, is_table = F.col("op").isin("→", "E→"), F.col("op").isin("R→", "W→")
    target = F.struct(
        F.lit("dst").alias("ref_field"),
        F.when(is_table, "table").otherwise("node").alias("kind"),
        F.when(is_node, base).when(is_table, table_key(F.col("dst"))).alias("key"),
    )
    source = F.struct(F.lit("src").alias("ref_field"), F.lit("node").alias("kind"), F.col("src").alias("key"))
    split = lambda df: df.withColumn("r", F.explode(F.array(source, target)))
    edge_refs = split(edges).select(
        F.lit("graph_edges").alias("ref_table"), F.col("edge_id").alias("row_id"), "r.ref_field", "r.kind", "repo", "r.key",
        # an edge of unknown time sees nothing that existed then
        F.coalesce("observed_at", F.lit("0001-01-01").cast("timestamp")).alias("at"),
    )
    counted = split(table(spark, folder, "graph_edges").select("repo", "src", "op", "dst")).select("r.kind", "repo", "r.key")

    def path_refs(df, name, key, field):
        return df.select(F.lit(name).alias("ref_table"), F.col(key).alias("row_id"), F.lit(field).alias("ref_field"),
                         F.lit("file").alias("kind"), "repo", F.col(field).alias("key"), F.col("seen_from").alias("at"))

    refs = edge_refs.unionByName(path_refs(nodes, "graph_nodes", "node_id", "path_rel")).unionByName(path_refs(tables, "db_tables", "table_id", "file_path"))
    always = F.lit(None).cast("timestamp")
    parents = (
        nodes.where("seen_from is not null").select(F.lit("node").alias("kind"), "repo", F.col("alias").alias("key"), F.col("seen_from").alias("valid_from"), F.col("seen_to").alias("valid_to"))
        .unionByName(tables.where("seen_from is not null").select(F.lit("table").alias("kind"), "repo", table_key(F.col("table_name")).alias("key"), F.col("seen_from").alias("valid_from"), F.col("seen_to").alias("valid_to")))
        .unionByName(files.select(F.lit("file").alias("kind"), "repo", F.col("path_rel").alias("key"), always.alias("valid_from"), always.alias("valid_to")))
    )
    return refs.select(*REF), parents.select(*PARENT), counted


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    refs, parents, counted = _references(spark, folder)
    return merge_references(refs, parents, counted=counted)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference to nothing, once per record and field."""
    return _judged(spark, folder).where("status <> 'ok'").select("ref_table", "row_id", "ref_field")


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field, month and status."""
    return orphan_counts(_judged(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}

_SQL = r"""
WITH e AS (SELECT edge_id, arg_max(struct_pack(repo := repo, src := src, op := op, dst := dst, observed_at := observed_at), loaded_at) AS r FROM graph_edges GROUP BY edge_id),
n AS (SELECT node_id, arg_max(struct_pack(repo := repo, alias := alias, path_rel := path_rel, seen_from := seen_from, seen_to := seen_to), loaded_at) AS r FROM graph_nodes GROUP BY node_id),
t AS (SELECT table_id, arg_max(struct_pack(repo := repo, file_path := file_path, k := split_part(regexp_replace(lower(table_name), '[\s"''`]', '', 'g'), '.', -1), seen_from := seen_from, seen_to := seen_to), loaded_at) AS r FROM db_tables GROUP BY table_id),
refs AS (
  SELECT 'graph_edges' AS ref_table, edge_id AS row_id, 'src' AS ref_field, 'node' AS kind, r.repo AS repo, r.src AS k, r.observed_at AS ts FROM e
  UNION ALL SELECT 'graph_edges', edge_id, 'dst', 'node', r.repo, split_part(r.dst, '.', 1), r.observed_at FROM e WHERE r.op IN ('→', 'E→')
  UNION ALL SELECT 'graph_edges', edge_id, 'dst', 'table', r.repo, split_part(regexp_replace(lower(r.dst), '[\s"''`]', '', 'g'), '.', -1), r.observed_at FROM e WHERE r.op IN ('R→', 'W→')
  UNION ALL SELECT 'graph_nodes', node_id, 'path_rel', 'file', r.repo, r.path_rel, r.seen_from FROM n
  UNION ALL SELECT 'db_tables', table_id, 'file_path', 'file', r.repo, r.file_path, r.seen_from FROM t),
parents AS (
  SELECT 'node' AS kind, r.repo AS repo, r.alias AS k, r.seen_from AS f, coalesce(r.seen_to, TIMESTAMP '9999-12-31') AS u FROM n
  UNION ALL SELECT 'table', r.repo, r.k, r.seen_from, coalesce(r.seen_to, TIMESTAMP '9999-12-31') FROM t
  UNION ALL SELECT DISTINCT 'file', repo, path_rel, TIMESTAMP '0001-01-01', TIMESTAMP '9999-12-31' FROM compress_files),
judged AS (
  SELECT refs.ref_table, refs.row_id, refs.ref_field, refs.ts,
    count(*) FILTER (p.k IS NOT NULL AND (refs.kind = 'file' OR (p.f <= refs.ts AND refs.ts < p.u))) AS n_ok,
    count(p.k) AS n_known, count(*) FILTER (p.f <= refs.ts) AS n_begun
  FROM refs LEFT JOIN parents p ON p.kind = refs.kind AND p.repo = refs.repo AND p.k = refs.k
  WHERE refs.k IS NOT NULL GROUP BY ALL)
"""
ORACLE = {
    "p1_found": _SQL + "SELECT ref_table, row_id, ref_field FROM judged WHERE n_ok = 0",
    "p1_counts": _SQL + """SELECT ref_table, ref_field, strftime(ts, '%Y-%m') AS month,
      CASE WHEN n_known = 0 THEN 'missing' WHEN n_begun = 0 THEN 'late' ELSE 'deleted' END AS status, count(*) AS n_orphans
      FROM judged WHERE n_ok = 0 GROUP BY ALL""",
}
