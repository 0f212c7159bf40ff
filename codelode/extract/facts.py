"""Fact tables of files: one pass over the texts, one row of arrays for each file, exploded by plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.extract.ecma_facts import facts as ecma_facts
from codelode.extract.other_facts import EMPTY, go_facts, python_facts, sql_tables
from codelode.functions.text import sql_reads, sql_writes
from codelode.syntax.groups import Bad

FUNCTION = "struct<name:string,owner:string,line:int,n_lines:int,params:array<string>,is_async:boolean,exported:boolean,returns:string,calls:array<string>,complexity:int,structure:string,has_doc:boolean,doc_params:array<string>,doc_returns:boolean,has_return:boolean,accessor:string,sql:array<string>>"
CLASS = "struct<name:string,extends:string,line:int,methods:array<string>,properties:array<string>,calls:array<string>,exported:boolean,has_doc:boolean>"
TABLE = "struct<name:string,line:int,columns:array<struct<name:string,type:string>>>"
FACTS = (
    f"file_id long, repo string, path_rel string, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<struct<source:string,names:array<string>,line:int,asked:array<string>>>, exports array<string>, "
    f"findings array<struct<rule:string,severity:string,line:int>>, unused_imports array<string>, unused_variables array<string>, tables array<{TABLE}>, parse_error string, uses array<string>, named_exports array<string>, version timestamp"
)


def facts_of(ext: str, text: str) -> dict:
    """The facts of one file; of a language without an extractor there are none."""
    text = text.replace("\r\n", "\n")
    if ext in (".js", ".mjs", ".ts", ".tsx"):
        return ecma_facts(text, ext in (".ts", ".tsx"), ext == ".tsx")
    if ext == ".py":
        return python_facts(text)
    if ext == ".go":
        return go_facts(text)
    return dict(EMPTY, tables=sql_tables(text)) if ext == ".sql" else EMPTY


def extract(files: DataFrame) -> DataFrame:
    """FACTS of files(file_id, repo, path_rel, ext, raw) or also version, which is null if not given.

    A file whose text can't be read has empty facts and a ``parse_error``. Null texts count as empty, null ids are left out, further columns are
    ignored. Functions come in order of their place, so do the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, repo, path, ext, raw, version in pdf.itertuples(index=False, name=None):
                error = None
                try:
                    x = facts_of(ext, raw)
                    for i in x["imports"]:
                        i.setdefault("asked", i["names"])
                except (Bad, RecursionError) as e:
                    x, error = EMPTY, f"not closed: {e}"[:200]
                rows.append((f, repo, path, x["functions"], x["classes"], x["imports"], x["exports"], x["findings"], x["unused_imports"], x["unused_variables"], x.get("tables", []), error, x.get("uses", []), x.get("named_exports", []), version))
            yield pd.DataFrame(rows, columns=["file_id", "repo", "path_rel", "functions", "classes", "imports", "exports", "findings", "unused_imports", "unused_variables", "tables", "parse_error", "uses", "named_exports", "version"])

    version = (F.col("version") if "version" in files.columns else F.lit(None)).cast("timestamp").alias("version")
    rows = files.where("file_id is not null").select("file_id", "repo", "path_rel", F.coalesce(F.lower("ext"), F.lit("")).alias("ext"), F.coalesce("raw", F.lit("")).alias("raw"), version)
    return rows.mapInPandas(run, FACTS)


def functions(facts: DataFrame) -> DataFrame:
    return facts.select("file_id", "repo", "path_rel", F.posexplode("functions").alias("ord", "f")).select("file_id", "repo", "path_rel", "ord", "f.*")


def db_access(functions: DataFrame) -> DataFrame:
    """functions with ``db_reads`` and ``db_writes``: the tables of the SQL in each, distinct and sorted; of methods the class is the name's owner."""
    texts = F.coalesce("sql", F.expr("cast(array() as array<string>)"))
    of = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(texts, f))))
    return functions.withColumn("db_reads", of(sql_reads)).withColumn("db_writes", of(sql_writes))


def classes(facts: DataFrame) -> DataFrame:
    return facts.select("file_id", "repo", "path_rel", F.posexplode("classes").alias("ord", "c")).select("file_id", "repo", "path_rel", "ord", "c.*")


def imports(facts: DataFrame) -> DataFrame:
    return facts.select("file_id", "repo", "path_rel", F.posexplode("imports").alias("ord", "i")).select("file_id", "repo", "path_rel", "ord", "i.*")


def tables(facts: DataFrame) -> DataFrame:
    return facts.select("file_id", "repo", "path_rel", F.explode("tables").alias("t")).select("file_id", "repo", "path_rel", F.col("t.name").alias("table_name"), "t.line", F.explode_outer("t.columns").alias("c")).select("file_id", "repo", "path_rel", "table_name", "line", F.col("c.name").alias("col_name"), F.col("c.type").alias("col_type"))
