"""The analyses on the tables: files, checks, runs, tables of the database, tool events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions.text import EXCLUDED_DIRS, SQL_STOPLIST, alias_base, code_tables, content_hash, excluded, sql_reads, sql_writes, strip_code_comments, token_estimate
from codelode.operators import analysis as A
from codelode.operators.references import table_key
from codelode.plans.graph_queries import edges
from codelode.sources.tables import current, latest, table

FILE = ["repo", "path_rel", "ext", "lang", "raw", "legend", "original", "expanded", "compressed", "content_hash", "mtime"]


def files(spark: SparkSession, folder: str, columns: list[str], **made: Column) -> DataFrame:
    """Files of the last scan: columns, and what is made of each row before anything is moved. Texts are made into something narrow, never moved."""
    rows = table(spark, folder, "compress_files").select("file_id", "scanned_at", *columns, *[c.alias(n) for n, c in made.items()])
    return latest(rows, "file_id", "scanned_at", [*columns, *made])


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of files with their version, for work row by row whose results go through ``current``."""
    return table(spark, folder, "compress_files").select("file_id", "repo", "path_rel", "ext", "raw", "legend", F.col("scanned_at").alias("version"))


def n_lines() -> Column:
    return F.when(F.col("raw").isNotNull(), F.size(F.split("raw", "\n")))


_F = "WITH f AS (SELECT file_id, r.* FROM (SELECT file_id, arg_max(compress_files, scanned_at) AS r FROM compress_files GROUP BY file_id))".replace("file_id, r.*", "r.*")
_E = """, e AS (SELECT r.* FROM (SELECT arg_max(graph_edges, loaded_at) AS r FROM graph_edges GROUP BY edge_id) WHERE r.src IS NOT NULL AND r.dst IS NOT NULL)"""
_KEY = r"split_part(regexp_replace(lower({}), '[\s\"''`]', '', 'g'), '.', -1)"
_T = ", t AS (SELECT r.* FROM (SELECT arg_max(db_tables, loaded_at) AS r FROM db_tables GROUP BY table_id) WHERE r.seen_to IS NULL AND r.repo IS NOT NULL AND r.table_name IS NOT NULL)"


def file_inventory(spark, folder):
    raw = F.col("raw")
    rows = files(spark, folder, [], n_lines=n_lines(), n_characters=F.length(raw), n_tokens=token_estimate(raw), hash=content_hash(raw))
    return rows.where("hash is not null").select("file_id", "n_lines", "n_characters", "n_tokens", "hash")


def lang_router(spark, folder):
    """Languages by extension beside what the table says."""
    rows = files(spark, folder, ["ext", "lang"])
    e = F.col("ext")
    by = F.when(e.isin(".js", ".mjs"), "javascript").when(e.isin(".ts", ".tsx"), "typescript").when(e == ".py", "python").when(e == ".go", "go").when(e == ".sql", "sql")
    return rows.groupBy(by.alias("routed"), "lang").agg(F.count("*").alias("n_files"))


def scan_filter(spark, folder):
    """Files that a scan with the default filters takes, per repo."""
    rows = files(spark, folder, ["repo", "path_rel"]).where("path_rel is not null")
    return rows.groupBy("repo").agg(F.count("*").alias("n_files"), F.count_if(~excluded(F.col("path_rel"))).alias("n_scanned"), F.count_if(~excluded(F.col("path_rel"), ignore=["vendor", "*.gen.js", "# note", ""])).alias("n_not_ignored"))


def content_hash_dups(spark, folder):
    """Texts that several files share."""
    rows = files(spark, folder, [], hash=content_hash(F.col("raw"))).where("hash is not null")
    return rows.groupBy("hash").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file")).where("n_files > 1")


def file_lines(spark, folder):
    """Line lengths of every file."""
    lines = F.split(F.regexp_replace("raw", "\r\n?", "\n"), "\n")
    rows = files(spark, folder, [], n_lines=F.size(lines).cast("long"), longest=F.array_max(F.transform(lines, F.length)), n_blank=F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long"))
    return rows.where("longest is not null").select("file_id", "n_lines", "longest", "n_blank")


def compress_savings(spark, folder):
    """Sizes and savings of each language, recomputed from the sizes of the files."""
    rows = files(spark, folder, ["ext", "original", "compressed"]).where("original is not null and compressed is not null")
    return rows.groupBy("ext").agg(F.count("*").alias("n_files"), F.sum(F.col("original").cast("long")).alias("original"), F.sum(F.col("compressed").cast("long")).alias("compressed")).withColumn(
        "savings", F.when(F.col("original") > 0, F.round(100 * (1 - F.col("compressed") / F.col("original")), 2)))


def comment_strip_savings(spark, folder):
    """Estimated tokens before and after comments are stripped the plain way."""
    raw = F.regexp_replace("raw", "\r", "")
    rows = files(spark, folder, ["ext"], before=token_estimate(raw), after=token_estimate(strip_code_comments(raw))).where("before is not null and ext in ('.js', '.mjs', '.ts', '.tsx')")
    return rows.groupBy("ext").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


def files_by_dir(spark, folder):
    rows = files(spark, folder, ["repo", "path_rel"]).where("path_rel is not null")
    top = F.when(F.instr("path_rel", "/") > 0, F.substring_index("path_rel", "/", 1)).otherwise(".")
    return rows.groupBy("repo", top.alias("dir")).agg(F.count_distinct("path_rel").alias("n_files"), F.min("path_rel").alias("first_path"))


def cache_hits(spark, folder):
    """Whether the stored hash of each file still fits its text."""
    rows = files(spark, folder, ["content_hash"], hash=content_hash(F.col("raw"))).where("hash is not null")
    state = A.cache_state(rows.select("file_id", "hash"), rows.select("file_id", F.substring("content_hash", 1, 8).alias("hash")), ["file_id"])
    return state.agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def large_files(spark, folder):
    """Ratings by lines and by the numbers of functions, classes and exports in the graph."""
    from codelode.plans.graph_queries import nodes

    rows = files(spark, folder, ["repo", "path_rel"], n_lines=n_lines()).where("n_lines is not null").groupBy("repo", "path_rel").agg(F.max("n_lines").alias("n_lines"))
    n = nodes(spark, folder).select("repo", "path_rel", "kind", "node_name", F.coalesce("exported", F.lit(False)).alias("exported")).distinct()
    counts = n.groupBy("repo", "path_rel").agg(F.count_if(F.col("kind") == "F").alias("n_functions"), F.count_if(F.col("kind") == "C").alias("n_classes"), F.count_if(F.col("exported")).alias("n_exports"))
    out = A.large_files(rows.join(counts, ["repo", "path_rel"], "left")).where("rating <> 'ok'")
    return out.select("repo", "path_rel", "n_lines", "points", "rating", "reasons")


def rule_hits(spark, folder):
    """Hits of a few rules in all lines of all files, by rule and severity."""
    rules = spark.createDataFrame(
        [("no-var", 0, "var ", False, "warning", "*.js", ["*.min.js"]), ("no-eval", 1, "eval(", False, "error", "*.js", []), ("no-console", 2, "console.", False, "info", "*s", []),
         ("no-todo", 3, "TODO", False, "info", "*", []), ("no-global", 4, "globalThis.", False, "warning", "*.ts", []), ("throw-error", 5, "throw new Error", False, "info", "*.js", ["*.mjs"])],
        "rule_id string, rank int, pattern string, is_regex boolean, severity string, file_pattern string, exclude array<string>",
    )
    rows = texts(spark, folder)
    lines = A.lines_of(rows.where("file_id is not null and raw is not null and path_rel is not null"), ["file_id", "path_rel", "version"])
    hits = current(A.check_rules(lines, rules, ["file_id", "path_rel", "version"], "path_rel"), rows, "file_id", "version")
    return hits.groupBy("rule_id", "severity").agg(F.count("*").alias("n_hits"), F.count_distinct("file_id").alias("n_files"))


def db_schema(spark, folder):
    rows = _tables(spark, folder)
    return rows.groupBy("repo").agg(F.count_distinct("table_name").alias("n_tables"), F.coalesce(F.sum(F.size("cols")), F.lit(0)).cast("long").alias("n_columns"))


def _tables(spark, folder):
    rows = latest(table(spark, folder, "db_tables"), "table_id", "loaded_at", ["repo", "table_name", "cols", "file_path", "seen_to"])
    return rows.where("seen_to is null and repo is not null and table_name is not null").withColumn("table_name", table_key(F.col("table_name")))


def db_table_usage(spark, folder):
    return A.table_usage(edges(spark, folder).where("repo is not null"), table_key(F.col("dst")))


def db_dead_tables(spark, folder):
    return A.dead_tables(_tables(spark, folder), db_table_usage(spark, folder)).select("repo", "table_name", F.size("cols").alias("n_columns")).distinct()


def db_dead_columns(spark, folder):
    """Columns of used tables that are no name of a used table, as the simple analysis has it."""
    return A.dead_columns(_tables(spark, folder).where("cols is not null"), db_table_usage(spark, folder))


def db_column_types(spark, folder):
    """Columns by type, sizes dropped."""
    c = _tables(spark, folder).select(F.explode("cols").alias("c"))
    return c.groupBy(F.upper(F.regexp_replace("c.col_type", r"\(.*$", "")).alias("col_type")).agg(F.count("*").alias("n_columns"))


def sql_text_scan(spark, folder):
    """Tables read and written by the scripts."""
    s = files(spark, folder, ["ext"], table_reads=F.array_join(sql_reads(F.col("raw")), ","), table_writes=F.array_join(sql_writes(F.col("raw")), ",")).where("ext = '.sql'")
    return s.select("file_id", "table_reads", "table_writes").where("table_reads <> '' or table_writes <> ''")


def code_table_scan(spark, folder):
    """Tables read and written by strings of code in five quote styles and through mappers, in files of all languages."""
    s = files(spark, folder, [], table_reads=F.array_join(code_tables(F.col("raw"), False), ","), table_writes=F.array_join(code_tables(F.col("raw"), True), ","))
    return s.select("file_id", "table_reads", "table_writes").where("table_reads <> '' or table_writes <> ''")


def pipeline_verdict(spark, folder):
    """Each run with its findings by stage; a run passes if no syntax finding and no error was noted."""
    checks = latest(table(spark, folder, "pipeline_checks"), "check_id", "checked_at", ["run_id", "stage", "rule_code"])
    n = checks.groupBy("run_id").agg(F.count_if(F.col("stage") == "ast").alias("n_ast"), F.count_if(F.col("stage") == "style").alias("n_style"))
    runs = table(spark, folder, "compact_runs").select("run_id", "repo", F.coalesce(F.size("errors"), F.lit(0)).alias("n_errors"), F.size(F.coalesce("file_list", F.expr("cast(array() as array<string>)"))).alias("n_listed"))
    runs = runs.withColumn("n_errors", F.greatest("n_errors", F.lit(0)))
    zero = F.lit(0)
    out = runs.join(n, "run_id", "left").select("run_id", "repo", "n_errors", "n_listed", F.coalesce("n_ast", zero).alias("n_ast"), F.coalesce("n_style", zero).alias("n_style"))
    return out.withColumn("verdict", F.when((F.col("n_errors") == 0) & (F.col("n_ast") == 0), "PASS").otherwise("FAIL"))


def style_summary(spark, folder):
    """Style findings by rule and repo with the grand totals."""
    checks = latest(table(spark, folder, "pipeline_checks"), "check_id", "checked_at", ["repo", "stage", "rule_code", "file_path"])
    return checks.where("stage = 'style' and rule_code is not null and repo is not null").rollup("rule_code", "repo").agg(F.count("*").alias("n_findings"), F.count_distinct("file_path").alias("n_files"))


def run_errors(spark, folder):
    """Errors of runs by kind of message: quotes and places taken out."""
    e = table(spark, folder, "compact_runs").select("run_id", F.explode("errors").alias("e"))
    kind = F.trim(F.regexp_replace(F.regexp_replace("e.error_msg", r"\(\d+:\d+\)", ""), "'[^']*'", "'x'"))
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_errors"), F.count_distinct("run_id").alias("n_runs"))


def severity_order(spark, folder):
    """The 50 most urgent findings: syntax before style, then by repo, path and number (a report of fixed length)."""
    checks = latest(table(spark, folder, "pipeline_checks"), "check_id", "checked_at", ["repo", "file_path", "stage", "rule_code"])
    rank = F.when(F.col("stage") == "ast", 0).otherwise(1)
    return checks.where("repo is not null and file_path is not null").withColumn("rank", rank).orderBy("rank", "repo", "file_path", "check_id").limit(50)


def staleness(spark, folder):
    """Legends of files against their texts: unknown if the legend names no function, stale if any of its functions is not in the text, else fresh."""
    names = F.array_distinct(F.regexp_extract_all("legend", F.lit(r"(?m)^(?:export |async )*([A-Za-z_$][A-Za-z0-9_$]*)\("), F.lit(1)))
    gone = F.filter(names, lambda n: ~F.contains(F.col("raw"), n))
    status = F.when(F.col("raw").isNotNull(), F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) == 0, "unknown").when(F.size(gone) > 0, "stale").otherwise("fresh"))
    rows = files(spark, folder, ["ext"], status=status, n_gone=F.when(F.size(gone) > 0, F.size(gone)).otherwise(0)).where("status is not null and ext in ('.js', '.mjs', '.ts', '.tsx')")
    return rows.groupBy("status").agg(F.count("*").alias("n_files"), F.sum(F.col("n_gone").cast("long")).alias("n_gone"))


def checklist_summary(spark, folder):
    """Checklists in documents: items by state and progress, per repo."""
    items = _checklist(spark, folder)
    n = items.groupBy("repo").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "pending")])
    return n.withColumn("progress", F.floor(100 * (F.col("passed") + F.col("failed")) / F.col("total") + 0.5).cast("long"))


def _checklist(spark, folder):
    """Items of the checklists in documents, numbered within their feature and document."""
    from codelode.operators.docs import checklist_lines, number_items

    rows = table(spark, folder, "documents").select("doc_id", "repo", "source", "text", F.col("loaded_at").alias("version"))
    lists = rows.where("doc_id is not null and lower(trim(source)) = 'checklist' and text is not null and repo is not null")
    return number_items(current(checklist_lines(lists, ["doc_id", "repo", "version"]), rows, "doc_id", "version"), ["doc_id"])


def checklist_ids(spark, folder):
    """Items numbered within their feature and document."""
    return _checklist(spark, folder).select("doc_id", "line_no", "feature", "status", "item")


def doc_sections(spark, folder):
    """Lines of documents under their last heading, counted; 0 is what stands before the first."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    marked = F.transform(lines, lambda x, k: F.when(x.rlike("^#{1,6} "), k + 1))
    heads = F.filter(marked, lambda k: k.isNotNull())
    parts = F.arrays_zip(F.concat(F.array(F.lit(0)), heads).alias("section"), F.concat(heads, F.array(F.size(lines) + 1)).alias("next"))
    rows = latest(table(spark, folder, "documents").select("doc_id", "loaded_at", parts.alias("parts")), "doc_id", "loaded_at", ["parts"])
    out = rows.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.section", (F.col("p.next") - F.greatest("p.section", F.lit(1))).cast("long").alias("n_lines"))
    return out.where("n_lines > 0")


def ai_context_tokens(spark, folder):
    """Estimated tokens of all files of a repo, and of the files that the default filters leave."""
    rows = files(spark, folder, ["repo", "path_rel"], t=token_estimate(F.col("raw"))).where("t is not null and path_rel is not null and repo is not null")
    t = F.col("t")
    out = rows.groupBy("repo").agg(F.sum(t).alias("all_tokens"), F.coalesce(F.sum(F.when(~excluded(F.col("path_rel")), t)), F.lit(0)).alias("kept_tokens"))
    return out.withColumn("savings", F.when(F.col("all_tokens") > 0, F.round(100 * (1 - F.col("kept_tokens") / F.col("all_tokens")), 2)))


def tool_event_windows(spark, folder):
    """Events and errors of each hour and type."""
    e = table(spark, folder, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n_events"), F.max("value").alias("most_value"), F.count_distinct("user_id").alias("n_users"))


def asof_latest(spark, folder):
    """For each event the user's last sign-up at or before it."""
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    at = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w)
    return e.withColumn("signup_at", at).where("signup_at is not null").select("event_id", "signup_at")


def complexity_ratings(spark, folder):
    """Ratings of orders by their number of lines, which stand for decisions, per status."""
    n = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("complexity"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    return A.complexity_summary(n.join(o, "l_orderkey"), ["status"])


def complexity_topk(spark, folder):
    """The 30 most complex (a report of fixed length)."""
    n = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("complexity"))
    return n.withColumn("rating", A.complexity_rating(F.col("complexity"))).orderBy(F.desc("complexity"), "l_orderkey").limit(30)


def dead_exports(spark, folder):
    """Exported nodes that nothing of another file refers to, in two steps: not a target at all, then not a target from elsewhere."""
    from codelode.plans.graph_queries import nodes

    own = nodes(spark, folder).where("exported and repo is not null and alias is not null").select("repo", "alias", "node_name", "path_rel").distinct()
    place = nodes(spark, folder).select("repo", F.col("alias").alias("src"), F.col("path_rel").alias("src_path")).distinct()
    use = edges(spark, folder).where(F.col("op").isin("→", "E→")).select("repo", "src", F.substring_index("dst", ".", 1).alias("alias")).distinct().join(place, ["repo", "src"], "left")
    elsewhere = own.join(use, ["repo", "alias"]).where(F.col("src_path").isNull() | F.col("path_rel").isNull() | (F.col("src_path") != F.col("path_rel"))).select("repo", "alias").distinct()
    return own.join(elsewhere, ["repo", "alias"], "left_anti").select("repo", "alias", "node_name").distinct()


def health_score(spark, folder):
    """A score for each repo from its orphans, large files and findings of the checks, as its SQL has it.

    Undocumented functions, similar pairs, complexity and documentation, up to 65 points, are not in it; code_full_analysis has them.
    """
    from codelode.operators.graph import orphans
    from codelode.plans.graph_queries import nodes

    repos = files(spark, folder, ["repo"]).where("repo is not null").select("repo").distinct()
    n = nodes(spark, folder)
    dead = orphans(n, edges(spark, folder)).groupBy("repo").agg(F.count("*").alias("dead"))
    sized = files(spark, folder, ["repo"], lines=n_lines()).where("lines is not null").groupBy("repo").agg(F.count_if(F.col("lines") > 500).alias("critical_files"), F.count_if((F.col("lines") > 300) & (F.col("lines") <= 500)).alias("warning_files"))
    checks = latest(table(spark, folder, "pipeline_checks"), "check_id", "checked_at", ["repo", "stage"]).groupBy("repo").agg(F.count_if(F.col("stage") == "ast").alias("errors"), F.count_if(F.col("stage") == "style").alias("warnings"))
    out = repos.join(dead, "repo", "left").join(sized, "repo", "left").join(checks, "repo", "left").na.fill(0)
    z = F.lit(0)
    score = A.health(F.col("dead"), z, z, z, z, F.col("critical_files"), F.col("warning_files"), F.col("errors"), F.col("warnings"), z, z)
    return out.select("repo", score.alias("score"), A.health_rating(score).alias("rating"))


def set_operations(spark, folder):
    """Repos by which of the tables know them."""
    side = lambda name: table(spark, folder, name).select("repo").where("repo is not null")
    a, b = side("graph_edges"), side("documents")
    mark = lambda df, how: df.select(F.lit(how).alias("how"), "repo")
    return mark(a.intersect(b), "both").unionByName(mark(a.distinct().exceptAll(b.distinct()), "edges only")).unionByName(mark(a.union(b).distinct(), "any"))


def contract_check(spark, folder):
    """Files noted in runs' errors against findings of the syntax stage: which side knows them."""
    noted = table(spark, folder, "compact_runs").select("repo", F.explode("errors").alias("e")).select("repo", F.col("e.file_path").alias("file_path")).distinct().withColumn("noted", F.lit(True))
    found = latest(table(spark, folder, "pipeline_checks"), "check_id", "checked_at", ["repo", "file_path", "stage"]).where("stage = 'ast'").select("repo", "file_path").distinct().withColumn("found", F.lit(True))
    side = F.when(F.col("noted") & F.col("found"), "both").when(F.col("noted"), "run only").otherwise("check only")
    return noted.join(found, ["repo", "file_path"], "full").groupBy(side.alias("side")).agg(F.count("*").alias("n_files"))


def alias_bases(spark, folder):
    """How many names of customers' nations and parts fall on each short form."""
    names = table(spark, folder, "part").select(F.col("p_name").alias("name")).union(table(spark, folder, "nation").select("n_name")).union(table(spark, folder, "graph_nodes").select("node_name")).where("name is not null and name <> ''").distinct()
    return names.groupBy(alias_base(F.col("name")).alias("base")).agg(F.count("*").alias("n_names"))


_NAMES = """file_inventory lang_router scan_filter content_hash_dups file_lines compress_savings comment_strip_savings files_by_dir cache_hits large_files rule_hits db_schema db_table_usage db_dead_tables
db_dead_columns db_column_types sql_text_scan code_table_scan pipeline_verdict style_summary run_errors severity_order staleness checklist_summary checklist_ids doc_sections ai_context_tokens tool_event_windows asof_latest
complexity_ratings complexity_topk dead_exports health_score set_operations contract_check alias_bases""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
_DIRS = ", ".join(f"'{d}'" for d in EXCLUDED_DIRS)
_OUT = f"""(list_has_any(string_split(path_rel, '/')[:-2], [{_DIRS}]) OR len(list_filter(string_split(path_rel, '/')[:-2], lambda p: starts_with(p, '.') AND length(p) > 1)) > 0
 OR regexp_matches(string_split(path_rel, '/')[-1], '(\\.test\\.js|\\.spec\\.js|\\.min\\.js|\\.bundle\\.js|\\.d\\.ts)$'))"""
_CHECK = """, c AS (SELECT r.* FROM (SELECT arg_max(pipeline_checks, checked_at) AS r FROM pipeline_checks GROUP BY check_id))"""
_DOC = "WITH d AS (SELECT r.* FROM (SELECT arg_max(documents, loaded_at) AS r FROM documents GROUP BY doc_id) WHERE r.text IS NOT NULL)"
_LINES = """, l AS (SELECT doc_id, repo, source, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT *, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM d))"""
_ITEMS = _DOC + _LINES + """, m AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '^#{1,2} ') THEN regexp_matches(line, '^## Tests\\b') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), false) AS tests FROM l), i AS (SELECT doc_id, repo, line_no, regexp_extract(line, '^- \\[[ x!]\\] ([^:]+): ', 1) AS feature, CASE regexp_extract(line, '^- \\[([ x!])\\] [^:]+: ', 1) WHEN 'x' THEN 'passed' WHEN '!' THEN 'failed' ELSE 'pending' END AS status
 FROM m WHERE tests AND lower(trim(source)) = 'checklist' AND repo IS NOT NULL AND regexp_matches(line, '^- \\[[ x!]\\] [^:]+: '))"""
_STRIP = """length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(raw, chr(13), ''), '/\\*[\\s\\S]*?\\*/', '', 'g'), '(?m)^[ \\t]*//[^\\n]*$', '', 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{2,}', chr(10), 'g')))"""
_USED = _F + _E + f""", u AS (SELECT repo, table_name, n_readers, n_writers, n_readers + n_writers AS total FROM (SELECT repo, {_KEY.format('dst')} AS table_name, count(DISTINCT src) FILTER (op = 'R→') AS n_readers, count(DISTINCT src) FILTER (op = 'W→') AS n_writers
 FROM e WHERE op IN ('R→', 'W→') AND repo IS NOT NULL GROUP BY ALL))""" + _T + f", k AS (SELECT *, {_KEY.format('table_name')} AS name FROM t)"
_NODES = ", n AS (SELECT r.* FROM (SELECT arg_max(graph_nodes, loaded_at) AS r FROM graph_nodes GROUP BY node_id) WHERE r.seen_to IS NULL)"
_RULES = """(VALUES ('no-var', 0, 'var ', 'warning', '.js', '.min.js'), ('no-eval', 1, 'eval(', 'error', '.js', '#'), ('no-console', 2, 'console.', 'info', 's', '#'), ('no-todo', 3, 'TODO', 'info', '', '#'),
 ('no-global', 4, 'globalThis.', 'warning', '.ts', '#'), ('throw-error', 5, 'throw new Error', 'info', '.js', '.mjs')) r(rule_id, rank, pattern, severity, tail, ex)"""
_STOP = ", ".join(f"'{w}'" for w in SQL_STOPLIST)
_BARE = """trim(regexp_replace(regexp_replace(regexp_replace({}, '--[^\\n]*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'), '\\s+', ' ', 'g'))"""
#: DuckDB has no look-ahead: a name behind FROM or JOIN is taken with what follows, and those before a parenthesis are dropped
_NAMED = f""", a AS (SELECT file_id, q, 'r' AS k, unnest(regexp_extract_all(q, '(?i)\\b(?:FROM|JOIN)\\s+([a-zA-Z_]\\w*(?:\\.[a-zA-Z_]\\w*)?\\s*\\(?)', 1)) AS t FROM s
 UNION ALL SELECT file_id, q, 'w', unnest(regexp_extract_all(q, '(?i)\\b(?:INSERT\\s+INTO|UPDATE|DELETE\\s+FROM)\\s+([a-zA-Z_]\\w*(?:\\.[a-zA-Z_]\\w*)?)', 1)) FROM s),
b AS (SELECT DISTINCT file_id, q, k, split_part(trim(t), '.', -1) AS t FROM a WHERE NOT (k = 'r' AND ends_with(t, '('))),
c AS (SELECT * FROM b WHERE length(t) >= 2 AND lower(t) NOT IN ({_STOP}) AND NOT regexp_matches(t, '^[A-Z][A-Z_]*$') AND NOT regexp_matches(t, '^[A-Z][a-z]') AND NOT regexp_matches(t, '^(pg_|jsonb_|array_|string_|regexp_)')),
d AS (SELECT DISTINCT file_id, k, t FROM c WHERE NOT (k = 'r' AND t = regexp_extract(q, '(?i)\\bDELETE\\s+FROM\\s+([a-zA-Z_]\\w*)', 1) AND EXISTS (SELECT 1 FROM c w WHERE w.k = 'w' AND w.file_id = c.file_id AND w.q = c.q AND w.t = c.t))),
both_ AS (SELECT file_id, string_agg(t, ',' ORDER BY t) FILTER (k = 'r') AS table_reads, string_agg(t, ',' ORDER BY t) FILTER (k = 'w') AS table_writes FROM d GROUP BY 1)"""
ORACLE = {
    "file_inventory": _F + "SELECT file_id, len(string_split(raw, chr(10))) AS n_lines, length(raw) AS n_characters, ceil(length(raw) / 4)::BIGINT AS n_tokens, substr(md5(raw), 1, 8) AS hash FROM f WHERE raw IS NOT NULL",
    "lang_router": _F + "SELECT CASE WHEN ext IN ('.js', '.mjs') THEN 'javascript' WHEN ext IN ('.ts', '.tsx') THEN 'typescript' WHEN ext = '.py' THEN 'python' WHEN ext = '.go' THEN 'go' WHEN ext = '.sql' THEN 'sql' END AS routed, lang, count(*) AS n_files FROM f GROUP BY ALL",
    "scan_filter": _F + f"SELECT repo, count(*) AS n_files, count(*) FILTER (NOT {_OUT}) AS n_scanned, count(*) FILTER (NOT ({_OUT} OR contains(path_rel, 'vendor') OR regexp_matches(path_rel, '[^/]*\\.gen\\.js$'))) AS n_not_ignored FROM f WHERE path_rel IS NOT NULL GROUP BY repo",
    "content_hash_dups": _F + "SELECT substr(md5(raw), 1, 8) AS hash, count(*) AS n_files, min(file_id) AS first_file FROM f WHERE raw IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "file_lines": _F + ", l AS (SELECT file_id, unnest(string_split(regexp_replace(raw, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM f) SELECT file_id, count(*) AS n_lines, max(length(line)) AS longest, count(*) FILTER (trim(line) = '') AS n_blank FROM l GROUP BY 1",
    "compress_savings": _F + "SELECT *, CASE WHEN original > 0 THEN round(100 * (1 - compressed / original), 2) END AS savings FROM (SELECT ext, count(*) AS n_files, sum(original)::BIGINT AS original, sum(compressed)::BIGINT AS compressed FROM f WHERE original IS NOT NULL AND compressed IS NOT NULL GROUP BY 1)",
    "comment_strip_savings": _F + f"SELECT ext, sum(ceil(length(replace(raw, chr(13), '')) / 4))::BIGINT AS before, sum(ceil({_STRIP} / 4))::BIGINT AS after FROM f WHERE ext IN ('.js', '.mjs', '.ts', '.tsx') AND raw IS NOT NULL GROUP BY 1",
    "files_by_dir": _F + "SELECT repo, CASE WHEN contains(path_rel, '/') THEN split_part(path_rel, '/', 1) ELSE '.' END AS dir, count(DISTINCT path_rel) AS n_files, min(path_rel) AS first_path FROM f WHERE path_rel IS NOT NULL GROUP BY ALL",
    "cache_hits": _F + "SELECT count(*) FILTER (coalesce(substr(md5(raw), 1, 8) = substr(content_hash, 1, 8), false)) AS hits, count(*) FILTER (NOT coalesce(substr(md5(raw), 1, 8) = substr(content_hash, 1, 8), false)) AS misses FROM f WHERE raw IS NOT NULL",
    "large_files": _F + _NODES + """, a AS (SELECT repo, path_rel, max(len(string_split(raw, chr(10)))) AS n_lines FROM f WHERE raw IS NOT NULL GROUP BY ALL),
c AS (SELECT repo, path_rel, count(*) FILTER (kind = 'F') AS x, count(*) FILTER (kind = 'C') AS y, count(*) FILTER (exported) AS z FROM (SELECT DISTINCT repo, path_rel, kind, node_name, coalesce(exported, false) AS exported FROM n) GROUP BY ALL),
p AS (SELECT a.*, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z FROM a LEFT JOIN c USING (repo, path_rel)),
q AS (SELECT *, CASE WHEN n_lines > 500 THEN 2 WHEN n_lines > 300 THEN 1 ELSE 0 END + CASE WHEN x > 15 THEN 2 WHEN x > 10 THEN 1 ELSE 0 END + CASE WHEN y > 3 THEN 2 WHEN y > 1 THEN 1 ELSE 0 END + CASE WHEN z > 10 THEN 2 WHEN z > 5 THEN 1 ELSE 0 END AS points FROM p)
SELECT repo, path_rel, n_lines, points, CASE WHEN points >= 4 THEN 'critical' ELSE 'warning' END AS rating, concat_ws(', ', CASE WHEN n_lines > 300 THEN n_lines || ' lines' END, CASE WHEN x > 10 THEN x || ' functions' END, CASE WHEN y > 1 THEN y || ' classes' END, CASE WHEN z > 5 THEN z || ' exports' END) AS reasons FROM q WHERE points >= 2""",
    "rule_hits": _F + f""", l AS (SELECT file_id, path_rel, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT *, string_split(regexp_replace(raw, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM f WHERE raw IS NOT NULL AND path_rel IS NOT NULL)),
h AS (SELECT l.*, r.*, instr(line, pattern) AS pos, substr(line, 1, instr(line, pattern) - 1) AS before FROM l JOIN {_RULES} ON ends_with(path_rel, tail) AND NOT ends_with(path_rel, ex) AND contains(line, pattern)),
g AS (SELECT file_id, line_no, pattern, arg_min(rule_id, rank) AS rule_id, arg_min(severity, rank) AS severity FROM h WHERE (instr(line, '//') = 0 OR instr(line, '//') >= pos) AND (length(before) - length(replace(before, '''', ''))) % 2 = 0
 AND (length(before) - length(replace(before, '"', ''))) % 2 = 0 AND (length(before) - length(replace(before, '`', ''))) % 2 = 0 GROUP BY ALL)
SELECT rule_id, severity, count(*) AS n_hits, count(DISTINCT file_id) AS n_files FROM g GROUP BY ALL""",
    "db_schema": _USED + " SELECT repo, count(DISTINCT name) AS n_tables, coalesce(sum(len(cols)), 0)::BIGINT AS n_columns FROM k GROUP BY 1",
    "db_table_usage": _USED + " SELECT * FROM u",
    "db_dead_tables": _USED + " SELECT DISTINCT repo, name AS table_name, len(cols) AS n_columns FROM k WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.repo = k.repo AND u.table_name = k.name)",
    "db_dead_columns": _USED + """, c AS (SELECT repo, name AS table_name, unnest(cols).col_name AS col_name FROM k WHERE EXISTS (SELECT 1 FROM u WHERE u.repo = k.repo AND u.table_name = k.name))
SELECT DISTINCT * FROM c WHERE col_name NOT IN ('id', 'uuid', 'created_at', 'updated_at') AND NOT EXISTS (SELECT 1 FROM u WHERE u.repo = c.repo AND u.table_name = c.col_name)""",
    "db_column_types": _USED + " SELECT upper(regexp_replace(c.col_type, '\\(.*$', '')) AS col_type, count(*) AS n_columns FROM (SELECT unnest(cols) AS c FROM k) GROUP BY 1",
    "sql_text_scan": _F + f""", s AS (SELECT file_id, {_BARE.format('raw')} AS q FROM f WHERE ext = '.sql' AND raw IS NOT NULL)""" + _NAMED + """
SELECT file_id, coalesce(table_reads, '') AS table_reads, coalesce(table_writes, '') AS table_writes FROM both_""",
    "code_table_scan": _F + f""", bare AS (SELECT file_id, raw, regexp_replace(raw, '\\\\[\\\\''\"`]', '##', 'g') AS e FROM f WHERE raw IS NOT NULL),
quoted AS (SELECT file_id, unnest(list_concat(regexp_extract_all(raw, '\"\"\"([\\s\\S]*?)\"\"\"', 1), regexp_extract_all(raw, '''''''([\\s\\S]*?)''''''', 1), regexp_extract_all(raw, '`([\\s\\S]*?)`', 1), regexp_extract_all(e, '\"([^\"]*)\"', 1), regexp_extract_all(e, '''([^'']*)''', 1))) AS q FROM bare),
s AS (SELECT file_id, {_BARE.format('q')} AS q FROM quoted WHERE regexp_matches(q, '(?i)^\\s*(SELECT|INSERT|UPDATE|DELETE|WITH|CREATE\\s+TABLE)\\b'))""" + _NAMED + """
SELECT file_id, coalesce(table_reads, '') AS table_reads, coalesce(table_writes, '') AS table_writes FROM both_""",
    "pipeline_verdict": "WITH x AS (SELECT 1)" + _CHECK + """, n AS (SELECT run_id, count(*) FILTER (stage = 'ast') AS n_ast, count(*) FILTER (stage = 'style') AS n_style FROM c GROUP BY 1)
SELECT r.run_id, r.repo, coalesce(len(errors), 0) AS n_errors, coalesce(len(file_list), 0) AS n_listed, coalesce(n_ast, 0) AS n_ast, coalesce(n_style, 0) AS n_style, CASE WHEN coalesce(len(errors), 0) = 0 AND coalesce(n_ast, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM compact_runs r LEFT JOIN n USING (run_id)""",
    "style_summary": "WITH x AS (SELECT 1)" + _CHECK + " SELECT rule_code, repo, count(*) AS n_findings, count(DISTINCT file_path) AS n_files FROM c WHERE stage = 'style' AND rule_code IS NOT NULL AND repo IS NOT NULL GROUP BY ROLLUP (rule_code, repo)",
    "run_errors": "SELECT trim(regexp_replace(regexp_replace(e.error_msg, '\\(\\d+:\\d+\\)', '', 'g'), '''[^'']*''', '''x''', 'g')) AS kind, count(*) AS n_errors, count(DISTINCT run_id) AS n_runs FROM (SELECT run_id, unnest(errors) AS e FROM compact_runs) GROUP BY 1",
    "severity_order": "WITH x AS (SELECT 1)" + _CHECK + " SELECT check_id, checked_at, repo, file_path, stage, rule_code, CASE stage WHEN 'ast' THEN 0 ELSE 1 END AS rank FROM c WHERE repo IS NOT NULL AND file_path IS NOT NULL ORDER BY rank, repo, file_path, check_id LIMIT 50",
    "staleness": _F + """, x AS (SELECT raw, list_distinct(regexp_extract_all(coalesce(legend, ''), '(?m)^(?:export |async )*([A-Za-z_$][A-Za-z0-9_$]*)\\(', 1)) AS k FROM f WHERE raw IS NOT NULL AND ext IN ('.js', '.mjs', '.ts', '.tsx')),
y AS (SELECT len(k) AS n, len(list_filter(k, lambda n: NOT contains(raw, n))) AS gone FROM x)
SELECT CASE WHEN n = 0 THEN 'unknown' WHEN gone > 0 THEN 'stale' ELSE 'fresh' END AS status, count(*) AS n_files, sum(gone)::BIGINT AS n_gone FROM y GROUP BY 1""",
    "checklist_summary": _ITEMS + " SELECT *, floor(100 * (passed + failed) / total + 0.5)::BIGINT AS progress FROM (SELECT repo, count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM i GROUP BY 1)",
    "checklist_ids": _ITEMS + " SELECT doc_id, line_no, feature, status, feature || '.' || (row_number() OVER (PARTITION BY doc_id, feature ORDER BY line_no) - 1) AS item FROM i",
    "doc_sections": _DOC + _LINES + ", s AS (SELECT doc_id, coalesce(last_value(CASE WHEN regexp_matches(line, '^#{1,6} ') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS section FROM l) SELECT doc_id, section, count(*) AS n_lines FROM s GROUP BY ALL",
    "ai_context_tokens": _F + f", x AS (SELECT repo, sum(ceil(length(raw) / 4))::BIGINT AS all_tokens, coalesce(sum(ceil(length(raw) / 4)) FILTER (NOT {_OUT}), 0)::BIGINT AS kept_tokens FROM f WHERE raw IS NOT NULL AND path_rel IS NOT NULL AND repo IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN all_tokens > 0 THEN round(100 * (1 - kept_tokens / all_tokens), 2) END AS savings FROM x",
    "tool_event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, max(value) AS most_value, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL",
    "asof_latest": "SELECT e.event_id, s.ts AS signup_at FROM events e ASOF JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts",
    "complexity_ratings": """WITH n AS (SELECT o_orderstatus AS status, count(*) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderstatus, l_orderkey)
SELECT status, count(*) AS total, count(*) FILTER (c <= 5) AS low, count(*) FILTER (c > 5 AND c <= 10) AS moderate, count(*) FILTER (c > 10 AND c <= 20) AS high, count(*) FILTER (c > 20) AS critical, round(avg(c), 1) AS average FROM n GROUP BY 1""",
    "complexity_topk": "SELECT l_orderkey, count(*) AS complexity, CASE WHEN count(*) <= 5 THEN 'low' WHEN count(*) <= 10 THEN 'moderate' WHEN count(*) <= 20 THEN 'high' ELSE 'critical' END AS rating FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
    "dead_exports": _F + _E + _NODES + """, own AS (SELECT DISTINCT repo, alias, node_name, path_rel FROM n WHERE exported AND repo IS NOT NULL AND alias IS NOT NULL),
u AS (SELECT DISTINCT e.repo, split_part(e.dst, '.', 1) AS alias, p.path_rel AS src_path FROM e LEFT JOIN (SELECT DISTINCT repo, alias, path_rel FROM n) p ON p.repo = e.repo AND p.alias = e.src WHERE op IN ('→', 'E→')),
x AS (SELECT DISTINCT own.repo, own.alias FROM own JOIN u USING (repo, alias) WHERE u.src_path IS NULL OR own.path_rel IS NULL OR u.src_path <> own.path_rel)
SELECT DISTINCT repo, alias, node_name FROM own WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.repo = own.repo AND x.alias = own.alias)""",
    "health_score": _F + _E + _NODES + _CHECK + """, t AS (SELECT DISTINCT repo, split_part(dst, '.', 1) AS alias FROM e),
o AS (SELECT repo, count(*) AS dead FROM (SELECT DISTINCT repo, alias, node_name FROM n WHERE kind = 'F' AND NOT coalesce(exported, false) AND NOT EXISTS (SELECT 1 FROM t WHERE t.repo = n.repo AND t.alias = n.alias)) GROUP BY 1),
s AS (SELECT repo, count(*) FILTER (x > 500) AS cf, count(*) FILTER (x > 300 AND x <= 500) AS wf FROM (SELECT repo, len(string_split(raw, chr(10))) AS x FROM f WHERE raw IS NOT NULL) GROUP BY 1),
k AS (SELECT repo, count(*) FILTER (stage = 'ast') AS er, count(*) FILTER (stage = 'style') AS wa FROM c GROUP BY 1),
z AS (SELECT r.repo, coalesce(dead, 0) AS dead, coalesce(cf, 0) AS cf, coalesce(wf, 0) AS wf, coalesce(er, 0) AS er, coalesce(wa, 0) AS wa FROM (SELECT DISTINCT repo FROM f WHERE repo IS NOT NULL) r LEFT JOIN o USING (repo) LEFT JOIN s USING (repo) LEFT JOIN k USING (repo)),
y AS (SELECT repo, floor(greatest(0, least(100, 100 - least(2 * dead, 20) - least(4 * cf + wf, 10) - least(3 * er + wa, 10))) + 0.5)::INT AS score FROM z)
SELECT repo, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'warning' ELSE 'critical' END AS rating FROM y""",
    "set_operations": """WITH a AS (SELECT DISTINCT repo FROM graph_edges WHERE repo IS NOT NULL), b AS (SELECT DISTINCT repo FROM documents WHERE repo IS NOT NULL)
SELECT 'both' AS how, repo FROM (SELECT repo FROM a INTERSECT SELECT repo FROM b) UNION ALL SELECT 'edges only', repo FROM (SELECT repo FROM a EXCEPT SELECT repo FROM b) UNION ALL SELECT 'any', repo FROM (SELECT repo FROM a UNION SELECT repo FROM b)""",
    "contract_check": "WITH x AS (SELECT 1)" + _CHECK + """, a AS (SELECT DISTINCT repo, e.file_path AS file_path FROM (SELECT repo, unnest(errors) AS e FROM compact_runs)), b AS (SELECT DISTINCT repo, file_path FROM c WHERE stage = 'ast')
SELECT CASE WHEN a.file_path IS NOT NULL AND b.file_path IS NOT NULL THEN 'both' WHEN a.file_path IS NOT NULL THEN 'run only' ELSE 'check only' END AS side, count(*) AS n_files FROM a FULL JOIN b ON a.repo = b.repo AND a.file_path = b.file_path GROUP BY 1""",
    "alias_bases": """WITH n AS (SELECT p_name AS name FROM part UNION SELECT n_name FROM nation UNION SELECT node_name FROM graph_nodes), x AS (SELECT name, regexp_replace(name, '[a-z]', '', 'g') AS rest, regexp_extract(name, '[A-Z]') AS cap FROM n WHERE name IS NOT NULL AND name <> '')
SELECT CASE WHEN length(rest) >= 2 THEN substr(rest, 1, 3) WHEN cap <> '' THEN lower(substr(name, 1, 1)) || cap ELSE substr(name, 1, 2) END AS base, count(*) AS n_names FROM x GROUP BY 1""",
}
