"""Problem 7 on the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.mixing import mix, report
from codelode.sources.tables import spread, table


def _mix(spark: SparkSession, folder: str):
    documents = table(spark, folder, "documents").select("doc_id", "source", "text", F.col("loaded_at").alias("version"))
    return mix(spread(documents, "doc_id"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: how often each document is taken."""
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Targets and the shares really reached."""
    return report(*_mix(spark, folder))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE = {}
