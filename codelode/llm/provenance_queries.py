"""Problem 4 on the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.code_queries import files
from codelode.llm.provenance import judge_files, vendored_by_tree
from codelode.sources.tables import current, table


def _reasons(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file with its reasons."""
    rows = files(spark, folder)
    by_tree = current(vendored_by_tree(rows), rows, "file_id", "version").withColumn("by_tree", F.lit(True))
    by_text = current(judge_files(rows), rows, "file_id", "version")
    by_text = by_text.groupBy("file_id").agg(F.max("repo").alias("repo"), F.max("path_rel").alias("path_rel"), *[F.bool_or(c).alias(c) for c in ("generated", "minified", "vendored", "data")])
    return by_text.join(by_tree, "file_id", "left").withColumn("vendored", F.col("vendored") | F.coalesce("by_tree", F.lit(False))).drop("by_tree")


def _foreign(reasons: DataFrame) -> DataFrame:
    return reasons.where("generated or minified or vendored or data")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that nobody of the project wrote by hand."""
    return _foreign(_reasons(spark, folder)).select("file_id")


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """These files with the reasons."""
    return _foreign(_reasons(spark, folder))


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """For each run of the compactor: files listed, of these known, and hand-written. Listed paths are brought to one spelling first."""
    runs = table(spark, folder, "compact_runs").where("run_id is not null").groupBy("run_id", "repo").agg(F.flatten(F.collect_set(F.coalesce("file_list", F.array().cast("array<string>")))).alias("f"))
    bare = F.regexp_replace(F.regexp_replace(F.trim("p"), r"\\", "/"), r"^(\./)+", "")
    listed = runs.select("run_id", "repo", F.explode_outer("f").alias("p")).select("run_id", "repo", bare.alias("p"))
    tail = F.when(F.instr("p", F.concat(F.lit("/"), F.col("repo"), F.lit("/"))) > 0, F.expr("substring(p, instr(p, concat('/', repo, '/')) + length(repo) + 2)")).otherwise(F.regexp_replace("p", "^/+", ""))
    listed = listed.select("run_id", "repo", tail.alias("path_rel")).distinct()
    known = _reasons(spark, folder).select("repo", "path_rel", (F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data")).alias("other"))
    return (
        listed.join(known, ["repo", "path_rel"], "left").groupBy("run_id", "repo")
        .agg(F.count("path_rel").alias("n_listed"), F.count("other").alias("n_known"), F.count_if(~F.col("other")).alias("n_hand_written"))
    )


QUERIES = {"p4_found": p4_found, "p4_reasons": p4_reasons, "p4_runs": p4_runs}
ORACLE = {}
