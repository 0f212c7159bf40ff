"""Problems 2 and 5 on the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.docpairs import documented_functions
from codelode.llm.parsing import parse_files, rates
from codelode.sources.tables import current, spread, table


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "compress_files").select("file_id", "repo", "path_rel", "ext", "raw", F.col("scanned_at").alias("version")), "file_id")


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = files(spark, folder)
    return current(parse_files(rows), rows, "file_id", "version")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that do not parse in the language of their extension."""
    rows = files(spark, folder)
    bad = parse_files(rows).where("verdict in ('foreign', 'corrupt')").select("file_id", "version")
    return current(bad, rows, "file_id", "version")


def p2_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Each file that does not parse, or is too deep to tell, with all grammars that take it and the languages its tokens speak for."""
    rows = files(spark, folder)
    return current(parse_files(rows).where("verdict <> 'valid'"), rows, "file_id", "version")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of such files per repo and language."""
    return rates(_verdicts(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions whose documentation is not trivial."""
    rows = files(spark, folder)
    found = documented_functions(rows).select("file_id", "func_name", "line_no", "version")
    return current(found, rows, "file_id", "version")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs themselves: signature, body and documentation."""
    rows = files(spark, folder)
    return current(documented_functions(rows).drop("useful"), rows, "file_id", "version")


QUERIES = {"p2_found": p2_found, "p2_verdicts": p2_verdicts, "p2_rates": p2_rates, "p5_found": p5_found, "p5_pairs": p5_pairs}
ORACLE = {}
