"""Problem 3 on the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import neardup as N
from codelode.sources.tables import latest, spread, table

#: files: 60 words are at least 1 distinct run of five; duplicate records: at least 5 classes
FILES, DUPS = N.Plan(0.6, 1), N.Plan(0.7, 5)
FILE_WORDS = 60


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = spread(table(spark, folder, "compress_files").select(F.col("file_id").alias("id"), F.col("raw").alias("text"), F.col("scanned_at").alias("version")), "id")
    return N.near_duplicates(N.sketch_texts(rows, FILES, 5, FILE_WORDS), rows, lambda p: N.verify_texts(p, rows, FILES), FILES)


def _dups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = latest(table(spark, folder, "graph_duplicates"), "dup_id", "built_at", ["members"])
    names = F.transform("members", lambda m: F.regexp_replace(F.substring_index(m, ":", 1), r"\s", ""))
    names = F.filter(names, lambda n: n != "")
    sets = rows.select(F.col("dup_id").alias("id"), F.transform(names, lambda n: F.xxhash64(n)).alias("elements"), F.col("built_at").alias("version"))
    return N.near_duplicates(N.sketch_sets(sets, DUPS), sets, lambda p: N.verify_sets(p, sets, DUPS), DUPS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of similar files and of similar duplicate records."""
    out = None
    for kind, found in (("file", _files(spark, folder)), ("dup", _dups(spark, folder))):
        part = N.expand(*found).select(F.lit(kind).alias("rec_kind"), "id_a", "id_b")
        out = part if out is None else out.unionByName(part)
    return out


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record that has a near duplicate or copy: its class, its group and its number of links to other classes."""
    out = None
    for kind, (pairs, members) in (("file", _files(spark, folder)), ("dup", _dups(spark, folder))):
        pairs = N.cut(pairs)
        groups = N.components(pairs)
        links = pairs.select(F.explode(F.array("id_a", "id_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        copies = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
        part = (
            members.join(copies, "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left").join(links, "rep", "left")
            .where("n_copies > 1 or group is not null")
            .select(F.lit(kind).alias("rec_kind"), "id", F.col("rep").alias("class_id"), F.coalesce("group", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
        )
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
_SETS = """
WITH f AS (SELECT file_id AS id, regexp_extract_all(arg_max(raw, scanned_at), '[A-Za-z0-9_]+') AS w FROM compress_files WHERE raw IS NOT NULL GROUP BY file_id),
fs AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda k: hash(array_to_string(w[k:k + 4], ' '))))) AS e FROM f WHERE len(w) >= 60),
d AS (SELECT dup_id AS id, list_distinct(list_filter(list_transform(arg_max(members, built_at), lambda m: regexp_replace(split_part(m, ':', 1), '\\s', '', 'g')), lambda m: m IS NOT NULL AND m <> '')) AS m FROM graph_duplicates GROUP BY dup_id),
s AS (SELECT 'file' AS rec_kind, id, e FROM fs UNION ALL SELECT 'dup', id, unnest(list_transform(m, lambda x: hash(x))) FROM d WHERE len(m) >= 5),
n AS (SELECT rec_kind, id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.rec_kind, a.id AS id_a, b.id AS id_b, count(*) AS shared FROM s a JOIN s b ON a.rec_kind = b.rec_kind AND a.e = b.e AND a.id < b.id GROUP BY ALL)
"""
ORACLE = {
    "p3_found": _SETS + """SELECT c.rec_kind, id_a, id_b FROM c JOIN n x ON x.rec_kind = c.rec_kind AND x.id = id_a JOIN n y ON y.rec_kind = c.rec_kind AND y.id = id_b
    WHERE shared >= CASE c.rec_kind WHEN 'file' THEN 0.6 ELSE 0.7 END * (x.n + y.n - shared) - 1e-9""",
    "p3_groups": _SETS.replace("\nWITH f AS", "\nWITH RECURSIVE f AS") + """, p AS (SELECT c.rec_kind, id_a, id_b, shared = x.n AND shared = y.n AS same FROM c JOIN n x ON x.rec_kind = c.rec_kind AND x.id = id_a JOIN n y ON y.rec_kind = c.rec_kind AND y.id = id_b
    WHERE shared >= CASE c.rec_kind WHEN 'file' THEN 0.6 ELSE 0.7 END * (x.n + y.n - shared) - 1e-9),
i AS (SELECT rec_kind, id_a AS id FROM p UNION SELECT rec_kind, id_b FROM p),
m AS (SELECT i.rec_kind, i.id, least(i.id, coalesce(min(p.id_a), i.id)) AS rep FROM i LEFT JOIN p ON p.rec_kind = i.rec_kind AND p.id_b = i.id AND p.same GROUP BY i.rec_kind, i.id),
l AS (SELECT DISTINCT p.rec_kind, a.rep AS u, b.rep AS v FROM p JOIN m a ON a.rec_kind = p.rec_kind AND a.id = id_a JOIN m b ON b.rec_kind = p.rec_kind AND b.id = id_b WHERE a.rep <> b.rep),
e AS (SELECT rec_kind, u, v FROM l UNION SELECT rec_kind, v, u FROM l),
w AS (SELECT rec_kind, u AS first_id, u AS near FROM e UNION SELECT w.rec_kind, w.first_id, e.v FROM w JOIN e ON e.rec_kind = w.rec_kind AND e.u = w.near),
g AS (SELECT rec_kind, first_id AS rep, min(near) AS group_id FROM w GROUP BY ALL), k AS (SELECT rec_kind, u AS rep, count(*) AS n_links FROM e GROUP BY ALL), q AS (SELECT rec_kind, rep, count(*) AS n_copies FROM m GROUP BY ALL)
SELECT m.rec_kind, m.id, m.rep AS class_id, coalesce(g.group_id, m.rep) AS group_id, coalesce(n_links, 0) AS n_links, n_copies FROM m JOIN q ON q.rec_kind = m.rec_kind AND q.rep = m.rep LEFT JOIN g ON g.rec_kind = m.rec_kind AND g.rep = m.rep LEFT JOIN k ON k.rec_kind = m.rec_kind AND k.rep = m.rep""",
}
