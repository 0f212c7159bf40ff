"""Analyses: ratings, rules, documentation, usage of tables, health. All are plans over facts; no row leaves the executors before its result is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import content_hash, glob_regex, token_estimate
from codelode.operators import similar as S
from codelode.session import cut

#: rules are rows: bounded by the rule files, so they are broadcast; more than this many are refused
MOST_RULES = 5000


def complexity_rating(c: Column) -> Column:
    return F.when(c <= 5, "low").when(c <= 10, "moderate").when(c <= 20, "high").otherwise("critical")


def complexity_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by rating and the average (one decimal) of rows(keys, complexity)."""
    r = rows.withColumn("rating", complexity_rating(F.col("complexity")))
    return r.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("rating") == x).alias(x) for x in ("low", "moderate", "high", "critical")], F.round(F.avg("complexity"), 1).alias("average"))


def size_points(lines: Column, functions: Column, classes: Column, exports: Column) -> Column:
    step = lambda c, two, one: F.when(c > two, 2).when(c > one, 1).otherwise(0)
    return step(lines, 500, 300) + step(functions, 15, 10) + step(classes, 3, 1) + step(exports, 10, 5)


def size_rating(points: Column) -> Column:
    return F.when(points >= 4, "critical").when(points >= 2, "warning").otherwise("ok")


def large_files(files: DataFrame) -> DataFrame:
    """files(.., n_lines, n_functions, n_classes, n_exports) with points, rating and the reasons, worst first is left to the caller."""
    p = size_points(*[F.coalesce(c, F.lit(0)) for c in ("n_lines", "n_functions", "n_classes", "n_exports")])
    reasons = [F.when(F.col(c) > least, F.concat(F.col(c).cast("string"), F.lit(f" {word}"))) for c, least, word in (("n_lines", 300, "lines"), ("n_functions", 10, "functions"), ("n_classes", 1, "classes"), ("n_exports", 5, "exports"))]
    return files.withColumn("points", p).withColumn("rating", size_rating(p)).withColumn("reasons", F.concat_ws(", ", *reasons))


def lines_of(files: DataFrame, key: list[str], text: str = "raw") -> DataFrame:
    """(key, line_no from 1, line) of every line of every text. A text without line ends is one line; null texts have none."""
    return files.select(*key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("n", "line")).select(*key, (F.col("n") + 1).alias("line_no"), "line")


def check_rules(lines: DataFrame, rules: DataFrame, key: list[str], path: str) -> DataFrame:
    """Hits of rules on lines(key, line_no, line): (key, line_no, match, rule_id, severity, rank).

    rules(rule_id, rank, pattern, is_regex, severity, file_pattern, exclude array): one hit for each rule and line, the first. A hit behind the line's
    first // or inside quotes does not count. Of rules that match the same text on a line the first by rank counts. File patterns and
    excludes are tests of the path's end.
    """
    n = rules.count()
    if n > MOST_RULES:
        raise ValueError(f"{n} rules; at most {MOST_RULES} can go to every task")
    end = F.regexp_replace("file_pattern", r"\*", "")
    joined = lines.join(F.broadcast(rules), F.col(path).endswith(end) & ~F.exists(F.coalesce("exclude", F.expr("cast(array() as array<string>)")), lambda x: F.col(path).endswith(F.regexp_replace(x, r"\*", ""))))
    place = F.when(F.col("is_regex"), F.expr("regexp_instr(line, pattern)")).otherwise(F.instr("line", F.col("pattern")))
    text = F.when(F.col("is_regex"), F.expr("regexp_substr(line, pattern)")).otherwise(F.col("pattern"))
    hit = joined.withColumn("at", place).where("at > 0").withColumn("match", text)
    comment = F.instr("line", "//")
    before = F.substring("line", F.lit(1), F.col("at") - 1)
    odd = lambda q: (F.length(before) - F.length(F.regexp_replace(before, q, ""))) % 2 == 1
    hit = hit.where(((comment == 0) | (comment >= F.col("at"))) & ~odd("'") & ~odd('"') & ~odd("`"))
    one = hit.groupBy(*key, "line_no", "match").agg(F.min_by(F.struct("rule_id", "severity", "rank"), F.struct("rank", "rule_id")).alias("r"))
    return one.select(*key, "line_no", "match", "r.rule_id", "r.severity", "r.rank")


def severity_rank(c: Column) -> Column:
    return F.when(c == "error", 0).when(c == "warning", 1).otherwise(2)


def detect_rulesets(sets: DataFrame, dependencies: DataFrame, files: DataFrame, first_files: int = 50) -> DataFrame:
    """(repo, ruleset, reason): sets(ruleset, packages, imports, patterns, always) that fit a project, by its packages, else by text of its first files, or always.

    Looking at the first files only is what the detection does; the order is that of the paths.
    """
    repos = files.select("repo").where("repo is not null").distinct()
    always = repos.join(F.broadcast(sets.where("always").select("ruleset"))).withColumn("reason", F.lit("always"))
    packages = sets.select("ruleset", F.explode("packages").alias("name")).join(dependencies.select("repo", "name").distinct(), "name").select("repo", "ruleset", F.concat(F.lit("package.json: "), "name").alias("reason"))
    w = Window.partitionBy("repo").orderBy("path_rel")
    head = files.where(F.col("path_rel").endswith(".js")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= first_files)
    signs = sets.select("ruleset", F.explode(F.concat("imports", "patterns")).alias("sign"))
    texts = head.join(F.broadcast(signs), F.col("raw").contains(F.col("sign"))).groupBy("repo", "ruleset").agg(F.concat(F.lit("source: "), F.min("sign")).alias("reason"))
    rank = lambda df, k: df.withColumn("k", F.lit(k))
    found = rank(packages, 0).unionByName(rank(texts, 1)).unionByName(rank(always, 2))
    return found.groupBy("repo", "ruleset").agg(F.min_by("reason", F.struct("k", "reason")).alias("reason"))


def upsert_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rules of both; of a (ruleset, rule_id) the new one."""
    return old.join(new.select("ruleset", "rule_id"), ["ruleset", "rule_id"], "left_anti").unionByName(new)


def delete_rule(rules: DataFrame, ruleset: str, rule_id: str) -> DataFrame:
    return rules.where(~((F.col("ruleset") == ruleset) & (F.col("rule_id") == rule_id)))


def table_usage(edges: DataFrame, name: Column) -> DataFrame:
    """Readers and writers (distinct), in total, of each table of a repo: edges(repo, src, op, dst)."""
    e = edges.where(F.col("op").isin("R→", "W→")).select("repo", "src", "op", name.alias("table_name"))
    return (
        e.groupBy("repo", "table_name")
        .agg(F.count_distinct(F.when(F.col("op") == "R→", F.col("src"))).alias("n_readers"), F.count_distinct(F.when(F.col("op") == "W→", F.col("src"))).alias("n_writers"))
        .withColumn("total", F.col("n_readers") + F.col("n_writers"))
    )


def dead_tables(tables: DataFrame, used: DataFrame) -> DataFrame:
    """tables(repo, table_name, ..) that used(repo, table_name) does not have."""
    return tables.join(used.select("repo", "table_name").distinct(), ["repo", "table_name"], "left_anti")


def dead_columns(tables: DataFrame, used: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(repo, table_name, col_name) of used tables whose column nobody refers to.

    The columns id, uuid, created_at and updated_at always live. Without ``words`` a column lives if it is the name of a used table (all that the simple
    analysis knows); with words(repo, col_name) if it is among them.
    """
    names = used.select("repo", "table_name").distinct()
    columns = tables.join(names, ["repo", "table_name"], "left_semi").select("repo", "table_name", F.explode("cols").alias("c")).select("repo", "table_name", F.col("c.col_name").alias("col_name"))
    live = words.select("repo", "col_name").distinct() if words is not None else names.select("repo", F.col("table_name").alias("col_name"))
    return columns.where(~F.col("col_name").isin("id", "uuid", "created_at", "updated_at")).join(live, ["repo", "col_name"], "left_anti").select("repo", "table_name", "col_name").distinct()


def cache_state(files: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """files(key, hash) with hit: whether cache(key, hash) knows the same content. Files that the cache lacks, and null hashes, are misses."""
    known = cache.select(*key, F.col("hash").alias("cached")).dropDuplicates(key)
    return files.join(known, key, "left").withColumn("hit", F.coalesce(F.col("hash") == F.col("cached"), F.lit(False))).drop("cached")


def staleness(files: DataFrame, docs: DataFrame, key: list[str]) -> DataFrame:
    """Status of each documented file: fresh, stale, or unknown if one side has no signature. docs(key, doc_sig), files(key, sig)."""
    status = F.when(F.col("doc_sig").isNull() | F.col("sig").isNull(), "unknown").when(F.col("doc_sig") == F.col("sig"), "fresh").otherwise("stale")
    return docs.join(files.select(*key, "sig"), key, "left").withColumn("status", status)


def health(dead: Column, undocumented: Column, similar: Column, critical: Column, high: Column, critical_files: Column, warning_files: Column, errors: Column, warnings: Column, doc_errors: Column, doc_warnings: Column) -> Column:
    """The score: 100 less capped penalties, rounded, within 0 and 100."""
    cap = lambda c, most: F.least(c, F.lit(float(most)))
    lost = cap(2.0 * dead, 20) + cap(0.5 * undocumented, 15) + cap(3.0 * similar, 15) + cap(5.0 * critical + 2.0 * high, 20) + cap(4.0 * critical_files + warning_files, 10) + cap(3.0 * errors + warnings, 10) + cap(2.0 * doc_errors + doc_warnings, 15)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost)) + 0.5).cast("int")


def health_rating(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "warning").otherwise("critical")


def similarity(threshold: int = 60, a: str = "a", b: str = "b") -> Column:
    """Score of two functions a_* and b_*: 30 for equal parameter counts, 20 shared parameter names, 10 both async or not, 25 control flow, 15 shared calls.

    Columns: name, path, params array, is_async, structure (tokens joined by |), calls array. What is shared counts repeats of the left side only.
    """
    share = lambda p, q, most: F.when(F.greatest(F.size(p), F.size(q)) > 0, F.floor(most * F.size(F.filter(p, lambda x: F.array_contains(q, x))) / F.greatest(F.size(p), F.size(q)) + 0.5)).otherwise(0)
    tokens = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    structure = F.when((F.col(f"{a}_structure") == F.col(f"{b}_structure")) & (F.col(f"{a}_structure") != ""), 25).otherwise(share(tokens(F.col(f"{a}_structure")), tokens(F.col(f"{b}_structure")), 25))
    return (
        F.when(F.size(f"{a}_params") == F.size(f"{b}_params"), 30).otherwise(0) + share(F.col(f"{a}_params"), F.col(f"{b}_params"), 20) + F.when(F.col(f"{a}_is_async") == F.col(f"{b}_is_async"), 10).otherwise(0)
        + structure + share(F.col(f"{a}_calls"), F.col(f"{b}_calls"), 15)
    ).cast("int")


#: what functions of one class have in common
SHAPE = ["params", "is_async", "structure", "calls"]


def shaped(functions: DataFrame) -> DataFrame:
    """functions(repo, ord, name, path, params, is_async, structure, calls) with ``rep``, the least ord of their class; params and calls are sorted. Rows with a null repo are left out."""
    own = functions.where("repo is not null").select("repo", "ord", "name", "path", F.array_sort("params").alias("params"), "is_async", "structure", F.array_sort("calls").alias("calls"))
    return own.withColumn("rep", F.min("ord").over(Window.partitionBy("repo", *SHAPE)))


def class_members(functions: DataFrame) -> DataFrame:
    """(repo, rep, ord, name, path) of every function with its class, as ``similar_classes`` has them; no pair is compared for it."""
    return shaped(functions).select("repo", "rep", "ord", "name", "path")


def similar_classes(functions: DataFrame, threshold: int = 60, most_in_block: int = 8000, told: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(links, members): all pairs of functions of one repo whose score reaches the threshold, told by classes.

    functions(repo, ord, name, path, params, is_async, structure, calls); ord is unique in a repo and may be of any type that can be compared. A
    class has the same parameters, async flag, control flow and calls; its name is its least ord, or what ``told`` makes of it. members(repo, rep, ord, name, path) has every function.
    links(repo, a_rep, b_rep, score, back_score, n_links): a_rep <= b_rep; score if the function of a comes first, back_score if that of b does (they
    differ where control flow is repeated); n_links pairs of functions reach the threshold. Pairs of the same path and name are not counted. Classes are
    compared in pairs of blocks of a repo, so no task has a whole large repo; none is left out. Rows with a null repo are. Two functions
    without control flow to speak of are not compared, whatever else they share.
    """
    own = cut(shaped(functions))
    return S.similar_links(_told(own, told), SHAPE, threshold, most_in_block), own.select("repo", "rep", "ord", "name", "path")


def similar_counts(functions: DataFrame, threshold: int = 60, most_in_block: int = 8000) -> DataFrame:
    """(repo, similar): the number of pairs that ``similar_classes`` tells; repos without any have no row."""
    own = functions.where("repo is not null").withColumns({"params": F.array_sort("params"), "calls": F.array_sort("calls")})
    return S.similar_totals(_told(own, "cast(null as int)"), SHAPE, threshold, most_in_block)


def _told(own: DataFrame, told: str) -> DataFrame:
    return own.select("repo", "ord", F.expr(told).alias("told"), "name", "path", *SHAPE)


def comparable(functions: DataFrame) -> DataFrame:
    """Functions as the similarity wants them, in order of path and place: declarations and public methods, without constructors and accessors."""
    method = F.col("owner").isNotNull()
    out = functions.where(~(method & (F.col("name").startswith("_") | F.coalesce(F.col("accessor").isin("get", "set", "constructor"), F.lit(False)))))
    return out.select("repo", F.struct("path_rel", "file_id", "ord").alias("ord"), "name", F.col("path_rel").alias("path"), "params", "is_async", "structure", "calls")


def similar_functions(functions: DataFrame, threshold: int = 60) -> DataFrame:
    """Pairs of functions of one repo whose score reaches the threshold: (repo, a_ord, b_ord, a_name, b_name, score), a before b.

    ``similar_classes`` with every pair written out, so the rows grow with the square of a class.
    """
    links, members = similar_classes(functions, threshold)
    half = lambda x: members.select("repo", *[F.col(c).alias(f"{x}_{c}") for c in ("rep", "ord", "name", "path")])
    pairs = links.join(half("a"), ["repo", "a_rep"]).join(half("b"), ["repo", "b_rep"])
    pairs = pairs.where(((F.col("a_rep") != F.col("b_rep")) | (F.col("a_ord") < F.col("b_ord"))) & ~(F.col("a_name").eqNullSafe(F.col("b_name")) & F.col("a_path").eqNullSafe(F.col("b_path"))))
    first = F.col("a_ord") < F.col("b_ord")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select("repo", pick("a_ord", "b_ord").alias("a_ord"), pick("b_ord", "a_ord").alias("b_ord"), pick("a_name", "b_name").alias("a_name"), pick("b_name", "a_name").alias("b_name"), pick("score", "back_score").alias("score")).where(F.col("score") >= threshold)


def shape_classes(functions: DataFrame) -> DataFrame:
    """Functions grouped by what the score compares exactly (parameters, async, control flow, calls): (repo, shape, ord, n). Linear in the functions; equal shapes score 100."""
    shape = F.xxhash64(F.array_sort("params"), "is_async", "structure", F.array_sort(F.array_distinct("calls")))
    w = Window.partitionBy("repo", "shape")
    return functions.withColumn("shape", shape).withColumn("n", F.count("*").over(w)).where("n > 1").select("repo", "shape", "ord", "n")


def inventory(files: DataFrame, text: str = "raw") -> DataFrame:
    """Files with lines, characters, estimated tokens and content hash."""
    return files.withColumns({"n_lines": F.size(F.split(F.col(text), "\n")), "n_characters": F.length(text), "n_tokens": token_estimate(F.col(text)), "hash": content_hash(F.col(text))})


def glob_filter(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def inside_context(lines: DataFrame, key: list[str], tag: str) -> DataFrame:
    """Lines with ``inside``: whether more <tag> than </tag> have come up to and with them. Rules that need a context are checked on these lines only."""
    count = lambda p: F.size(F.split(F.col("line"), p)) - 1
    w = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("inside", F.sum(count(rf"<{tag}\b") - count(rf"</{tag}>")).over(w) > 0)


def style_rules(raw: Column, context: Column) -> Column:
    """array<struct<rule, n>>: the ten style rules for compact sources, of a text and its context file (null or blank: there is none).

    missing-ctx-header: the first line, behind a #! line, is no ``// @ctx`` comment; missing-ctx-file; incomplete-ctx: placeholders, or exports the context
    lacks; single-line-blob: more than three statements on at most two lines; ctx-minified-params, ctx-untyped-params: parameters of exported
    functions in the context of one letter, or without a type; ctx-coverage: declared functions it lacks; multi-line-imports: more than one
    import line; indented-lines: lines that begin with a blank; long-names: more than three declared names of three or more letters that are not exported.
    n counts what was found. Null texts have no findings. Declarations are found by patterns outside of strings and imports, not parsed.
    """
    context = F.when(F.trim(context) != "", context)
    lines = F.split(raw, "\n")
    first = F.trim(F.element_at(lines, 1))
    head = F.when(first.startswith("#!"), F.trim(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))).otherwise(first)
    all_of = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(1)))
    named = F.transform(F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(r"(?m)^export\s*\{([^}]*)\}"), F.lit(1)), lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"([\w$]+)\s*$", 1))
    exported = F.filter(F.array_distinct(F.concat(all_of(raw, r"(?m)^export\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)"), named)), lambda x: x != "")
    lacks = lambda names: F.filter(names, lambda n: ~_is_word(context, n))
    bare = raw
    for pattern, to in ((r"// @ctx [^\n]*", ""), (r"import[^;]+;", ""), (r'"(?:[^"\\\n]|\\.)*"', '""'), (r"'(?:[^'\\\n]|\\.)*'", "''"), (r"`[^`]*`", "``")):
        bare = F.regexp_replace(bare, pattern, to)
    long = F.array_except(all_of(bare, r"(?:const|let|var|function)\s+([a-zA-Z_$][a-zA-Z0-9_$]{2,})"), exported)
    functions = all_of(bare, r"(?m)(?:^|[;{}\s])function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(")
    signed = F.flatten(F.transform(F.regexp_extract_all(context, F.lit(r"(?m)^export\s+\w+\(([^)]+)\)"), F.lit(1)), lambda x: F.transform(F.split(x, ","), F.trim)))
    code_lines = F.filter(lines, lambda x: ~x.startswith("// @ctx ") & ~x.startswith("#!"))
    statements = F.size(F.split(bare, ";")) - 1
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    imports = count(F.filter(lines, lambda x: F.trim(x).startswith("import ")))
    marks = F.coalesce(F.size(F.split(context, r"\{DESCRIBE\}")) + F.size(F.split(context, r"\(auto-documented\)")) - 2, F.lit(0))
    rules = [
        ("missing-ctx-header", F.when(~head.startswith("// @ctx "), 1).otherwise(0)), ("missing-ctx-file", F.when(context.isNull(), 1).otherwise(0)), ("incomplete-ctx", marks + count(lacks(exported))),
        ("single-line-blob", F.when(context.isNotNull() & (F.size(code_lines) <= 2) & (statements > 3), 1).otherwise(0)), ("ctx-minified-params", count(F.filter(signed, lambda x: F.length(F.regexp_replace(x, "[?=:].*", "")) == 1))),
        ("ctx-untyped-params", count(F.filter(signed, lambda x: (x != "") & ~x.contains(":")))), ("ctx-coverage", count(lacks(functions))), ("multi-line-imports", F.when(imports > 1, imports).otherwise(0)),
        ("indented-lines", count(F.filter(lines, lambda x: x.rlike(r"^[ \t]")))), ("long-names", F.when(F.size(long) > 3, F.size(long)).otherwise(0)),
    ]
    found = F.array(*[F.struct(F.lit(r).alias("rule"), n.cast("long").alias("n")) for r, n in rules])
    return F.when(raw.isNotNull(), F.filter(found, lambda x: x["n"] > 0))


def _is_word(text: Column, name: Column) -> Column:
    """Whether a name stands in the text, apart from longer names."""
    return F.regexp_like(text, F.concat(F.lit(r"(?:^|[^a-zA-Z_$])"), F.replace(name, F.lit("$"), F.lit(r"\$")), F.lit(r"(?:[^a-zA-Z0-9_$]|$)")))


# ---- fixed values: methods that the platform calls and nobody documents ----
LIFECYCLE = ["constructor", "connectedCallback", "disconnectedCallback", "attributeChangedCallback", "renderCallback"]


def undocumented(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(repo, path_rel, level, type, name, line, reason) of functions, methods and classes whose documentation lacks something at a level.

    tests: nothing is asked of those without documentation; params: @param and @returns must be there; all: a description, too, and classes need
    documentation. Private names, accessors and methods the platform calls are left out. A documented symbol is never asked for a description.
    """
    own = functions.where(~F.col("name").startswith("_") & ~(F.col("owner").isNotNull() & (F.col("name").isin(LIFECYCLE) | F.coalesce(F.col("accessor").isin("get", "set"), F.lit(False)))))
    deep = F.col("level") != "tests"
    reasons = F.concat_ws(", ", F.when(~F.col("has_doc") & (F.col("level") == "all"), "description"), F.when(deep & (F.size("doc_params") == 0), "@param"), F.when(deep & ~F.col("doc_returns"), "@returns"))
    levels = lambda df: df.withColumn("level", F.explode(F.array(*map(F.lit, ("tests", "params", "all")))))
    f = levels(own).select("repo", "path_rel", "level", F.when(F.col("owner").isNull(), "function").otherwise("method").alias("type"), F.concat_ws(".", "owner", "name").alias("name"), "line", reasons.alias("reason"))
    c = classes.where(~F.col("has_doc")).select("repo", "path_rel", F.lit("all").alias("level"), F.lit("class").alias("type"), "name", "line", F.lit("No JSDoc").alias("reason"))
    return f.where("reason <> ''").unionByName(c)


def doc_mismatches(functions: DataFrame) -> DataFrame:
    """(repo, path_rel, name, line, kind, severity) of documented functions: another number or other names of parameters are errors, an undescribed return value a
    warning. Only named parameters are compared; without @param there is nothing to compare."""
    bare = F.transform("params", lambda p: F.regexp_extract(p, r"^(?:\.\.\.)?([A-Za-z_$][\w$]*)", 1))
    pairs = F.arrays_zip(bare.alias("p"), F.col("doc_params").alias("d"))
    wrong = F.exists(pairs, lambda z: z["p"].isNotNull() & z["d"].isNotNull() & ~z["p"].isin("options", "args", "param") & (z["p"] != z["d"]))
    some = F.size("doc_params") > 0
    kinds = F.filter(F.array(F.when(some & (F.size("params") != F.size("doc_params")), "count"), F.when(some & wrong, "name"), F.when(F.col("has_return") & ~F.col("doc_returns"), "returns")), lambda k: k.isNotNull())
    rows = functions.where("has_doc").select("repo", "path_rel", "name", "line", F.explode(kinds).alias("kind"))
    return rows.withColumn("severity", F.when(F.col("kind") == "returns", "warning").otherwise("error"))


def summary_only(functions: DataFrame) -> DataFrame:
    """(repo, functions, undocumented, doc_issues, score, rating): the score of what single files tell; parts across files count as none."""
    f = functions.groupBy("repo").agg(
        F.count("*").alias("functions"), F.count_if(F.col("complexity") > 20).alias("critical"), F.count_if((F.col("complexity") > 10) & (F.col("complexity") <= 20)).alias("high"),
        F.count_if(~F.col("has_doc") & ~F.col("name").startswith("_")).alias("undocumented"),
        F.count_if(F.col("has_doc") & (F.size("doc_params") > 0) & (F.size("doc_params") != F.size("params"))).alias("doc_errors"), F.count_if(F.col("has_doc") & F.col("has_return") & ~F.col("doc_returns")).alias("doc_warnings"),
    )
    z, c = F.lit(0), F.col
    score = health(z, c("undocumented"), z, c("critical"), c("high"), z, z, z, z, c("doc_errors"), c("doc_warnings"))
    return f.withColumn("score", score).select("repo", "functions", "undocumented", (c("doc_errors") + c("doc_warnings")).alias("doc_issues"), "score", health_rating(c("score")).alias("rating"))


# ---- fixed values: packages that the platform has made redundant, what replaces them and since when ----
REDUNDANT = {
    "node-fetch": ("fetch()", "Node 18"), "cross-fetch": ("fetch()", "Node 18"), "isomorphic-fetch": ("fetch()", "Node 18"), "uuid": ("crypto.randomUUID()", "Node 19"), "deep-clone": ("structuredClone()", "Node 17"),
    "lodash.clonedeep": ("structuredClone()", "Node 17"), "abort-controller": ("AbortController (global)", "Node 15"), "form-data": ("FormData (global)", "Node 18"), "web-streams-polyfill": ("ReadableStream (global)", "Node 18"),
    "url-parse": ("URL (global)", "Node 10"), "querystring": ("URLSearchParams", "Node 10"), "rimraf": ("fs.rm({ recursive: true })", "Node 14"), "mkdirp": ("fs.mkdir({ recursive: true })", "Node 10"),
    "recursive-readdir": ("fs.readdir({ recursive: true })", "Node 20"), "glob": ("fs.glob()", "Node 22"),
}


def redundant_dependencies(dependencies: DataFrame) -> DataFrame:
    """(repo, name, replacement, since) of dependencies(repo, name) that the platform itself has by now."""
    known = F.create_map(*[F.lit(x) for k, v in REDUNDANT.items() for x in (k, "|".join(v))])
    rows = dependencies.select("repo", "name", known[F.col("name")].alias("k")).where("k is not null").distinct()
    return rows.select("repo", "name", F.substring_index("k", "|", 1).alias("replacement"), F.substring_index("k", "|", -1).alias("since"))


def outdated_summary(findings: DataFrame, most: int = 50) -> DataFrame:
    """The most urgent findings(path_rel, rule, severity, line): errors before warnings before infos, then by path and line; a report of fixed length."""
    return findings.orderBy(severity_rank(F.col("severity")), "path_rel", "line", "rule").limit(most)


def full_analysis(functions: DataFrame, dead: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each repo: the parts, score, rating and the up to five worst topics.

    functions as extracted, dead(repo), findings(repo, severity), files(repo, rating of size). Similar pairs are those of ``similar_classes`` at 70.
    """
    f = functions.groupBy("repo").agg(
        F.count_if(F.col("complexity") > 20).alias("critical"), F.count_if((F.col("complexity") > 10) & (F.col("complexity") <= 20)).alias("high"),
        F.count_if(~F.col("has_doc") & ~F.col("name").startswith("_")).alias("undocumented"),
        F.count_if(F.col("has_doc") & (F.size("doc_params") > 0) & (F.size("doc_params") != F.size("params"))).alias("doc_errors"), F.count_if(F.col("has_doc") & F.col("has_return") & ~F.col("doc_returns")).alias("doc_warnings"),
    )
    d = dead.groupBy("repo").agg(F.count("*").alias("dead"))
    p = findings.groupBy("repo").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    s = files.groupBy("repo").agg(F.count_if(F.col("rating") == "critical").alias("critical_files"), F.count_if(F.col("rating") == "warning").alias("warning_files"))
    m = similar_counts(comparable(functions), 70)
    rows = s.join(f, "repo", "left").join(m, "repo", "left").join(d, "repo", "left").join(p, "repo", "left").na.fill(0)
    c = F.col
    score = health(c("dead"), c("undocumented"), c("similar"), c("critical"), c("high"), c("critical_files"), c("warning_files"), c("errors"), c("warnings"), c("doc_errors"), c("doc_warnings"))
    topics = [("dead", 2.0, "dead code"), ("undocumented", 0.5, "undocumented functions"), ("similar", 3.0, "similar pairs"), ("critical", 5.0, "critical complexity"), ("critical_files", 4.0, "critical files"), ("errors", 3.0, "outdated patterns"), ("doc_errors", 2.0, "documentation that does not fit")]
    worst = F.slice(F.reverse(F.array_sort(F.filter(F.array(*[F.struct((c(n) * w).alias("w"), F.concat(c(n).cast("string"), F.lit(f" {t}")).alias("t")) for n, w, t in topics]), lambda x: x["w"] > 0))), 1, 5)
    return rows.withColumn("score", score).withColumn("rating", health_rating(c("score"))).withColumn("topics", F.array_join(F.transform(worst, lambda x: x["t"]), "; "))
