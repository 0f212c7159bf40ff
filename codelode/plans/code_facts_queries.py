"""Questions on the facts of the scanned files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.extract import facts as X
from codelode.operators import analysis as A
from codelode.plans.analysis_queries import files, n_lines, texts
from codelode.session import cut
from codelode.sources.tables import current, latest, spread, table

def facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts of files as last scanned: every text is parsed once, where it is read, and what is found is written before it is asked."""
    rows = spread(table(spark, folder, "compress_files").select("file_id", "repo", "path_rel", "ext", "raw", F.col("scanned_at").alias("version")), "file_id")
    x = X.extract(rows)
    return cut(latest(x, "file_id", "version", [c for c in x.columns if c not in ("file_id", "version")]))


def code_functions(spark, folder):
    """Functions and methods with parameters, calls and complexity."""
    f = X.functions(facts(spark, folder))
    return f.select("file_id", "ord", "name", "owner", "line", F.array_join("params", ",").alias("params"), "is_async", "exported", F.array_join("calls", ",").alias("calls"), "complexity", "structure")


def code_classes(spark, folder):
    c = X.classes(facts(spark, folder))
    return c.select("file_id", "ord", "name", "extends", "line", F.array_join("methods", ",").alias("methods"), F.array_join("properties", ",").alias("properties"), "exported")


def code_imports(spark, folder):
    """Sources by how many files import them, per repo."""
    return X.imports(facts(spark, folder)).groupBy("repo", "source").agg(F.count_distinct("file_id").alias("n_files"), F.count("*").alias("n_imports"))


def code_complexity(spark, folder):
    """Ratings of functions per repo."""
    return A.complexity_summary(X.functions(facts(spark, folder)), ["repo"])


def code_undocumented(spark, folder):
    """What documentation lacks, per repo, level, type of symbol and reason."""
    x = facts(spark, folder)
    return A.undocumented(X.functions(x), X.classes(x)).groupBy("repo", "level", "type", "reason").agg(F.count("*").alias("n_symbols"))


def code_doc_mismatch(spark, folder):
    """Documentation that does not fit: counts by kind and severity per repo."""
    return A.doc_mismatches(X.functions(facts(spark, folder))).groupBy("repo", "kind", "severity").agg(F.count("*").alias("n_functions"))


def code_outdated(spark, folder):
    """Outdated patterns by rule and severity."""
    x = facts(spark, folder).select("repo", "file_id", F.explode("findings").alias("f"))
    return x.groupBy("repo", "f.rule", "f.severity").agg(F.count("*").alias("n_hits"), F.count_distinct("file_id").alias("n_files"))


def code_dead(spark, folder):
    """Dead code per file: functions that are not exported and that nothing in the repo calls, unused imports and variables, classes and exports (``dead_classes_and_exports``)."""
    return dead_code(facts(spark, folder))


def dead_classes_and_exports(x: DataFrame) -> DataFrame:
    """(repo, path_rel, type, name) of JavaScript and TypeScript files, as for these languages only.

    class: neither exported nor, anywhere in the repo, exported by that name, called, made, or given as an argument; a class that is only extended
    counts as dead, as in the reference. export: a named export that no relative import of the repo asks for and its own file does not use; a namespace import
    asks for no name. Tests are left out, style and template files for classes. Paths are compared without their extension; a folder is its index.
    """
    bare = lambda p: F.regexp_replace(p, r"(?:\.d)?\.(?:[jt]sx?|[cm][jt]s)$", "")
    own = x.where(F.col("repo").isNotNull() & F.col("path_rel").rlike(r"\.(?:[jt]sx?|mjs)$"))
    path = F.regexp_replace("path_rel", r"^(?:\./|/)+", "")
    kept = own.where(~F.col("path_rel").contains(".test.") & ~F.col("path_rel").contains("/tests/"))
    names = lambda c: own.select("repo", F.explode(c).alias("name"))
    used = names("uses").unionByName(names("exports")).unionByName(names("named_exports")).distinct()
    shown = X.classes(kept.where(~F.col("path_rel").rlike(r"\.(?:css|tpl)\.js$"))).where("not exported")
    dead = shown.join(used, ["repo", "name"], "left_anti").select("repo", "path_rel", F.lit("class").alias("type"), "name")
    asked = own.select("repo", F.array_append(F.slice(F.split(path, "/+"), F.lit(1), F.size(F.split(path, "/+")) - 1), F.lit("")).alias("at"), F.explode("imports").alias("i")).where("startswith(i.source, '.')")
    # a/b + ../c: empty and . segments go, .. takes the segment before
    steps = F.concat("at", F.split("i.source", "/+"))
    target = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    asked = asked.select("repo", bare(F.array_join(target, "/")).alias("target"), F.explode("i.asked").alias("name"))
    asked = asked.unionByName(asked.withColumn("target", F.regexp_replace(F.concat_ws("/", F.when(F.col("target") != "", F.col("target")), F.lit("index")), "^/", ""))).distinct()
    open_names = kept.withColumn("target", bare(path)).select("repo", "path_rel", "target", "uses", F.explode("named_exports").alias("name")).where(~F.array_contains("uses", F.col("name")))
    return dead.unionByName(open_names.join(asked, ["repo", "target", "name"], "left_anti").select("repo", "path_rel", F.lit("export").alias("type"), "name"))


def dead_code(x: DataFrame) -> DataFrame:
    """All five kinds of dead code in facts."""
    called = X.functions(x).select("repo", F.explode("calls").alias("c")).unionByName(X.classes(x).select("repo", F.explode("calls").alias("c"))).select("repo", F.substring_index("c", ".", -1).alias("name")).distinct()
    functions = X.functions(x).where("owner is null and not exported and not startswith(name, '_')").join(called, ["repo", "name"], "left_anti").select("repo", "path_rel", F.lit("function").alias("type"), "name")
    listed = lambda col, kind: x.select("repo", "path_rel", F.explode(col).alias("name")).select("repo", "path_rel", F.lit(kind).alias("type"), "name")
    return functions.unionByName(listed("unused_imports", "import")).unionByName(listed("unused_variables", "variable")).unionByName(dead_classes_and_exports(x))


def code_similar_shapes(spark, folder):
    """Functions that agree in parameters, control flow and calls: groups by repo."""
    f = X.functions(facts(spark, folder)).where("size(params) > 0 and structure <> ''").withColumn("ord", F.xxhash64("file_id", "ord"))
    return A.shape_classes(f).groupBy("repo", "shape").agg(F.count("*").alias("n_functions"))


def _place(df: DataFrame, c: str, x: str) -> DataFrame:
    """An ord of ``comparable`` told by file and number."""
    return df.select("*", F.col(f"{c}.file_id").alias(f"{x}file_id"), F.col(f"{c}.ord").alias(f"{x}n")).drop(c)


def code_similar_functions(spark, folder):
    """All pairs of functions that score 60 or more, told by pairs of classes of equal shape (code_similar_members), with the number of such pairs of functions."""
    links, _ = A.similar_classes(A.comparable(X.functions(facts(spark, folder))), told="named_struct('file_id', ord.file_id, 'ord', ord.ord)")
    return _place(_place(links, "a_rep", "a_"), "b_rep", "b_")


def code_similar_members(spark, folder):
    """The class of each function that code_similar_functions compares: file and number of its first function."""
    members = A.class_members(A.comparable(X.functions(facts(spark, folder))))
    return _place(_place(members, "rep", "class_"), "ord", "").select("repo", "class_file_id", "class_n", "file_id", "n", "name")


def ddl_columns(spark, folder):
    """Columns of the tables that scripts create."""
    return X.tables(facts(spark, folder)).select("file_id", "table_name", "line", "col_name", "col_type")


_NAMES = "code_functions code_classes code_imports code_complexity code_undocumented code_doc_mismatch code_outdated code_dead code_similar_shapes code_similar_functions code_similar_members ddl_columns".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLE = {
    # the text behind each CREATE TABLE, up to the next; the lines before it are those of the pieces before
    "ddl_columns": r"""WITH f AS (SELECT r.* FROM (SELECT arg_max(compress_files, scanned_at) AS r FROM compress_files GROUP BY file_id)),
s AS (SELECT file_id, regexp_split_to_array(regexp_replace(raw, '--[^\n]*', '', 'g'), '(?i)\bCREATE\s+TABLE\b') AS p FROM f WHERE lower(ext) = '.sql' AND raw IS NOT NULL),
q AS (SELECT file_id, unnest(list_transform(range(2, len(p) + 1), lambda k: struct_pack(line := 1 + len(string_split(array_to_string(p[1:k - 1], ' '), chr(10))) - 1, x := p[k]))) AS t FROM s),
b AS (SELECT file_id, t.line AS line, regexp_extract(t.x, '^\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w."`\[\]]+)\s*\(((?:[^()]|\([^()]*\))*)\)', ['name', 'body'], 'i') AS m FROM q),
c AS (SELECT file_id, line, trim(split_part(m.name, '.', -1), '"`[]') AS table_name, unnest(string_split(regexp_replace(m.body, ',(\s*\d+\s*\))', '#\1', 'g'), ',')) AS col FROM b WHERE m.name <> '')
SELECT file_id, table_name, line::INT AS line, trim(regexp_extract(col, '^\s*([\w"`\[\]]+)\s+(\w+(?:\s*\([^)]*\))?)', 1), '"`[]') AS col_name, replace(regexp_replace(regexp_extract(col, '^\s*([\w"`\[\]]+)\s+(\w+(?:\s*\([^)]*\))?)', 2), '\s+', '', 'g'), '#', ',') AS col_type
FROM c WHERE regexp_extract(col, '^\s*([\w"`\[\]]+)\s+(\w+)', 1) <> '' AND lower(regexp_extract(col, '^\s*([\w"`\[\]]+)\s+(\w+)', 1)) NOT IN ('primary', 'foreign', 'unique', 'check', 'constraint', 'key', 'index', 'exclude', 'like')""",
}


def code_full_analysis(spark, folder):
    """Score and worst topics of each repo from the facts."""
    x = facts(spark, folder)
    sized = files(spark, folder, ["repo"], n_lines=n_lines()).where("n_lines is not null and repo is not null")
    parts = x.select("file_id", F.size("functions").alias("n_functions"), F.size("classes").alias("n_classes"), F.size("exports").alias("n_exports"))
    rated = A.large_files(sized.join(parts, "file_id", "left")).select("repo", "rating")
    findings = x.select("repo", F.explode("findings").alias("f")).select("repo", "f.severity")
    return A.full_analysis(X.functions(x), dead_code(x), findings, rated).select("repo", "dead", "undocumented", "critical", "high", "doc_errors", "similar", "score", "rating", "topics")


def code_db_access(spark, folder):
    """Tables that functions read and write by SQL in their texts."""
    rows = X.db_access(X.functions(facts(spark, folder))).where("size(db_reads) > 0 or size(db_writes) > 0")
    return rows.select("file_id", "ord", "name", F.array_join("db_reads", ",").alias("db_reads"), F.array_join("db_writes", ",").alias("db_writes"))


def code_summary(spark, folder):
    """The partial score of each repo from what its files tell one by one: complexity and documentation; what takes several files counts as nothing."""
    return A.summary_only(X.functions(facts(spark, folder)))


def code_components(spark, folder):
    """Classes that listen, dispatch or register elements."""
    from codelode.operators.web import components

    x = facts(spark, folder)
    rows = components(texts(spark, folder).where("file_id is not null"), X.classes(x), X.imports(x)).dropDuplicates(["file_id", "name"])
    return rows.select("file_id", "name", "tag", F.array_join("children", ",").alias("children"))


QUERIES |= {f.__name__: f for f in (code_full_analysis, code_summary, code_components, code_db_access)}
