"""Documentation and rewriting of the scanned files."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.extract import facts as X
from codelode.operators import docs as D
from codelode.functions.text import token_estimate
from codelode.plans.analysis_queries import files, texts
from codelode.plans.code_facts_queries import facts
from codelode.sources.tables import current


def doc_dialect(spark, folder):
    """The symbols of each file in short form."""
    x = facts(spark, folder)
    return D.dialect(X.functions(x), X.classes(x))


def doc_interface_hashes(spark, folder):
    """The hash of each file's interface, and how many files share it."""
    x = facts(spark, folder)
    sig = D.interface_hash(X.functions(x), X.classes(x), ["file_id"])
    return sig.groupBy("sig").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file"))


def doc_context_totals(spark, folder):
    """Tokens of the short form of each repo against its files."""
    original = files(spark, folder, ["repo"], tokens=token_estimate(F.col("raw"))).where("tokens is not null and repo is not null")
    return D.context_totals(doc_dialect(spark, folder).where("repo is not null"), original)


def _rewritten(spark, folder, how):
    """(file_id, n_before, n_after, error) of the last version of each file: rewritten where it is read, only sizes are moved."""
    rows = texts(spark, folder)
    return current(D.rewrite(rows, how).drop("text"), rows, "file_id", "version")


def minify_savings(spark, folder):
    """Characters of JavaScript and TypeScript files before and after they are minified, per extension."""
    out = _rewritten(spark, folder, "minify").join(files(spark, folder, ["ext"]), "file_id")
    return out.groupBy("ext").agg(F.count("*").alias("n_files"), F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"), F.count("error").alias("n_errors"))


def strip_docs(spark, folder):
    """Files after their documentation blocks are taken out: sizes."""
    return _rewritten(spark, folder, "strip_docs").select("file_id", "n_before", "n_after", "error")


QUERIES = {f.__name__: f for f in (doc_dialect, doc_interface_hashes, doc_context_totals, minify_savings, strip_docs)}
ORACLE = {}
