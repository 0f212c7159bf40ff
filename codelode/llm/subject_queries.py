"""Problem 8 on the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.subjects import assign_subjects, train
from codelode.sources.tables import current, spread, table


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    texts = spread(table(spark, folder, "documents").select("doc_id", "text", F.col("loaded_at").alias("version")), "doc_id")
    models = train(texts, table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))
    return current(assign_subjects(texts, models), texts, "doc_id", "version")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects that at least three sentences of a document treat."""
    return _assigned(spark, folder).select("doc_id", "subject").distinct()


def p8_makeup(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by subject: documents and sentences that treat it, and its share of all assignments; every subject has a row."""
    found = _assigned(spark, folder).groupBy("subject").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))
    total = found.agg(F.sum("n_docs").alias("total"))
    rows = table(spark, folder, "subjects").select("subject").distinct().join(found, "subject", "left").join(F.broadcast(total))
    zero = F.lit(0)
    return rows.select("subject", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("n_sentences", zero).alias("n_sentences"), F.round(F.coalesce(F.col("n_docs") / F.col("total"), zero), 4).alias("share"))


QUERIES = {"p8_found": p8_found, "p8_makeup": p8_makeup}
ORACLE = {}
