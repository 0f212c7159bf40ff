"""Problem 6 on the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.leakage import leaks
from codelode.sources.tables import current, table


def _leaks(spark: SparkSession, folder: str, max_edits: int = 0) -> DataFrame:
    documents = table(spark, folder, "documents")
    texts = documents.select("doc_id", "text", F.col("loaded_at").alias("version"))
    found = leaks(texts, table(spark, folder, "eval_items"), max_edits=max_edits)
    return current(found, texts, "doc_id", "version")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items of which they hold at least 12 consecutive words."""
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p6_edited(spark: SparkSession, folder: str) -> DataFrame:
    """The same within two edits (characters put in, left out or changed) for the whole run, with its length and first word."""
    return _leaks(spark, folder, 2).select("doc_id", "item_id", "run_words", "word_from")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each test item with the documents that leak it; items that nobody leaks have 0."""
    items = table(spark, folder, "eval_items").select("item_id", "suite").distinct()
    found = _leaks(spark, folder).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("run_words").alias("longest_run"))
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


QUERIES = {"p6_found": p6_found, "p6_edited": p6_edited, "p6_items": p6_items}
_SQL = r"""
WITH d AS (SELECT doc_id, arg_max(text, loaded_at) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
iw AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM dw),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM iw)
"""
#: windows that follow each other on one diagonal are one run
_RUNS = r"""
WITH d AS (SELECT doc_id, arg_max(text, loaded_at) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM d),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: struct_pack(k := k, g := array_to_string(w[k:k + 11], ' ')))) AS x FROM dw),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: struct_pack(k := k, g := array_to_string(w[k:k + 11], ' ')))) AS y FROM iw),
h AS (SELECT DISTINCT doc_id, item_id, x.k AS k, x.k - y.k AS diagonal FROM dg JOIN ig ON x.g = y.g),
r AS (SELECT doc_id, item_id, count(*) + 11 AS run FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k) AS island FROM h) GROUP BY doc_id, item_id, diagonal, island),
n AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(run)::INT AS longest_run FROM r GROUP BY 1)
SELECT i.item_id, i.suite, coalesce(n_docs, 0) AS n_docs, coalesce(longest_run, 0) AS longest_run FROM (SELECT DISTINCT item_id, suite FROM eval_items) i LEFT JOIN n USING (item_id)"""
ORACLE = {"p6_items": _RUNS, "p6_found": _SQL + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"}
