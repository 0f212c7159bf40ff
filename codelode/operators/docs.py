"""Documentation and context: context files, checklists, bundles, contracts, and rewriting of whole projects. Nothing is written in place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import compact as C
from codelode.functions.text import signature_hash, token_estimate
from codelode.syntax.groups import Bad

CTX = r"^(export )?(?:async )?([A-Za-z_$][\w$]*)\((.*?)\)(?:→([^→|]*))?(?:→([^|]*))?(?:\|(.*))?$"


def ctx_entries(files: DataFrame) -> DataFrame:
    """Functions of context files(path, text): (path, line_no, exported, name, params, returns, calls, description). Class lines and headers are none.

    A return type is kept only if it looks like one; placeholders are empty descriptions.
    """
    lines = files.where("text is not null").select("path", F.posexplode(F.split("text", r"\r\n|\n")).alias("n", "line"))
    g = lambda k: F.regexp_extract("line", CTX, k)
    found = lines.where(F.col("line").rlike(CTX) & ~F.col("line").startswith("class ") & ~F.col("line").startswith(" "))
    kind = F.trim(g(4))
    text = F.trim(g(6))
    return found.select(
        "path", (F.col("n") + 1).alias("line_no"), (g(1) != "").alias("exported"), g(2).alias("name"), F.filter(F.transform(F.split(g(3), ","), F.trim), lambda p: p != "").alias("params"),
        F.when(kind.rlike(r"^[A-Za-z][\w<>\[\]|., ]*$"), kind).alias("returns"), F.filter(F.transform(F.split(g(5), ","), F.trim), lambda p: p != "").alias("calls"),
        F.when(text.isin("{DESCRIBE}", "(auto-documented)"), "").otherwise(text).alias("description"),
    )


def checklist_lines(files: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Items of checklists(key, text): (key, line_no, feature, action, expected, status, fail_reason). Only lines below a heading Tests count; items before any heading are none.

    Made row by row, in time that grows with the lines: only the items of a text leave it.
    """
    p = r"(?s)^- \[([ x!])\] ([^:]+): \s*(.*?)(?:\s*→\s*(.*?))?(?:\s*\(FAILED: (.*)\))?$"
    head = lambda x, k: F.when(x.rlike("^#{1,2} "), F.struct((k + 1).alias("n"), x.rlike(r"^## Tests(?![A-Za-z0-9_])").alias("tests")))
    own = files.select(*key, F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n").alias("_lines"))
    own = own.select(*key, "_lines", F.filter(F.transform("_lines", head), lambda h: h.isNotNull()).alias("_heads"))
    # each heading with the line of the next, or the one behind the last line; what stands before the first is below none
    nexts = F.concat(F.transform(F.filter("_heads", lambda h, k: k > 0), lambda h: h["n"]), F.array(F.size("_lines") + 1))
    below = F.filter(F.arrays_zip(F.col("_heads").alias("h"), nexts.alias("next")), lambda s: s["h"]["tests"])
    listed = lambda s: F.transform(F.slice("_lines", s["h"]["n"] + 1, s["next"] - s["h"]["n"] - 1), lambda x, k: F.struct((s["h"]["n"] + k + 1).alias("n"), x.alias("line")))
    items = F.filter(F.flatten(F.transform(below, listed)), lambda i: i["line"].rlike(r"^- \[[ x!]\] [^:]+: "))
    found = own.select(*key, F.explode(items).alias("i")).select(*key, "i.n", "i.line")
    g = lambda k: F.regexp_extract("line", p, k)
    status = F.when(g(1) == "x", "passed").when(g(1) == "!", "failed").otherwise("pending")
    return found.select(*key, F.col("n").alias("line_no"), g(2).alias("feature"), g(3).alias("action"), g(4).alias("expected"), status.alias("status"), F.when(g(5) != "", g(5)).alias("fail_reason"))


def number_items(items: DataFrame, key: list[str]) -> DataFrame:
    """Items with their name: the feature and the number within it, from 0."""
    k = F.row_number().over(Window.partitionBy(*key, "feature").orderBy("line_no")) - 1
    return items.withColumn("item", F.concat("feature", F.lit("."), k.cast("string")))


def checklist(files: DataFrame, text: str = "text") -> DataFrame:
    """Numbered items of checklists(path, text)."""
    return number_items(checklist_lines(files, ["path"], text), ["path"])


def checklist_totals(items: DataFrame, keys: list[str]) -> DataFrame:
    out = items.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "pending")])
    return out.withColumn("progress", F.floor(100 * (F.col("passed") + F.col("failed")) / F.col("total") + 0.5).cast("int"))


def mark_item(text: Column, feature: str, index: int, passed: bool, reason: str = "") -> Column:
    """The text with the n-th item of a feature marked; a list without it stays as it is."""
    mark = "x" if passed else "!"
    lines = F.split(text, "\n")
    prefix = r"^\s*- \[[ x!]\] " + _quote(feature) + ":"
    count = F.transform(lines, lambda x, k: F.struct(x.alias("x"), F.when(x.rlike(prefix), F.size(F.filter(F.slice(lines, F.lit(1), k + 1), lambda y: y.rlike(prefix)))).otherwise(0).alias("c")))
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*\(FAILED: .*\)$", ""), r"- \[[ x!]\]", f"- [{mark}]")
    return F.array_join(F.transform(count, lambda s: F.when(s["c"] == index + 1, F.concat(clean(s["x"]), F.lit("" if passed or not reason else f" (FAILED: {reason})"))).otherwise(s["x"])), "\n")


def reset_items(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?m)\s*\(FAILED: .*\)$", ""), r"(?m)^(\s*)- \[[x!]\]", "$1- [ ]")


def _quote(s: str) -> str:
    import re

    return re.escape(s)


def interface_hash(functions: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sig): the hash of a file's interface. Signatures of one file are as many as it has symbols."""
    f = functions.where("owner is null").select(*keys, F.concat(F.lit("F:"), F.col("exported").cast("int").cast("string"), F.lit(":"), "name", F.lit("("), F.array_join("params", ","), F.lit(")")).alias("s"))
    c = classes.select(*keys, F.concat(F.lit("C:"), "name", F.lit(":"), F.coalesce("extends", F.lit("")), F.lit(":"), F.array_join(F.array_sort("methods"), ",")).alias("s"))
    return f.unionByName(c).groupBy(*keys).agg(signature_hash(F.collect_list("s")).alias("sig"))


def dialect(functions: DataFrame, classes: DataFrame, most_calls: int = 5) -> DataFrame:
    """(repo, path_rel, text): a file's symbols in short form, one line each, calls cut after a few."""
    cut_calls = lambda c: F.when(F.size(c) > 0, F.concat(F.lit("→"), F.array_join(F.slice(c, 1, most_calls), ","), F.when(F.size(c) > most_calls, F.concat(F.lit(" +"), (F.size(c) - most_calls).cast("string"), F.lit(" more"))).otherwise(""))).otherwise("")
    f = functions.where("owner is null").select("repo", "path_rel", F.col("line"), F.concat(F.when(F.col("exported"), "export ").otherwise(""), "name", F.lit("("), F.array_join("params", ","), F.lit(")"), cut_calls(F.col("calls"))).alias("s"))
    c = classes.select("repo", "path_rel", F.col("line"), F.concat(F.lit("class "), "name", F.when(F.col("extends").isNotNull(), F.concat(F.lit(" extends "), "extends")).otherwise(""), F.lit("|"), F.size("methods").cast("string"), F.lit("m,"), F.size("properties").cast("string"), F.lit("$")).alias("s"))
    rows = f.unionByName(c).groupBy("repo", "path_rel").agg(F.array_sort(F.collect_list(F.struct("line", "s"))).alias("l"))
    return rows.select("repo", "path_rel", F.concat(F.lit("--- "), "path_rel", F.lit(" ---\n"), F.array_join(F.transform("l", lambda x: x["s"]), "\n")).alias("text"))


def context_totals(parts: DataFrame, original: DataFrame) -> DataFrame:
    """(repo, n_tokens, original_tokens, savings) of parts(repo, text) against original(repo, text); either may have its ``tokens`` counted already."""
    count = lambda df: F.sum(F.col("tokens") if "tokens" in df.columns else token_estimate(F.col("text")))
    a = parts.groupBy("repo").agg(count(parts).alias("n_tokens"))
    b = original.groupBy("repo").agg(count(original).alias("original_tokens"))
    return b.join(a, "repo", "left").select("repo", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "original_tokens").withColumn("savings", F.when(F.col("original_tokens") > 0, F.round(100 * (1 - F.col("n_tokens") / F.col("original_tokens")), 2)))


def contracts(entries: DataFrame, functions: DataFrame, strict: bool = False) -> DataFrame:
    """Violations of context entries(path, name, params, exported) against functions(path, name, params, exported): (path, name, severity, message).

    A missing function is an error if exported; other parameter counts are errors, other names warnings, another export flag a warning; with strict, functions
    without an entry are infos.
    """
    bare = lambda c: F.transform(c, lambda p: F.regexp_extract(p, r"^(?:\.\.\.)?([\w$]+)", 1))
    e = entries.select("path", "name", F.col("params").alias("e_params"), F.col("exported").alias("e_exported"), F.lit(True).alias("e"))
    f = functions.select("path", "name", F.col("params").alias("f_params"), F.col("exported").alias("f_exported"), F.lit(True).alias("f"))
    j = e.join(f, ["path", "name"], "full")
    both = F.col("e") & F.col("f")
    issue = lambda when, severity, message: F.when(when, F.struct(severity.alias("severity"), message.alias("message")))
    lit = F.lit
    found = F.array(
        issue(F.col("f").isNull(), F.when(F.col("e_exported"), "error").otherwise("warning"), lit("documented function is missing")),
        issue(both & (F.size("e_params") != F.size("f_params")), lit("error"), F.concat(lit("parameters: "), F.size("e_params").cast("string"), lit(" documented, "), F.size("f_params").cast("string"), lit(" in the source"))),
        issue(both & (F.size("e_params") == F.size("f_params")) & (bare(F.col("e_params")) != bare(F.col("f_params"))), lit("warning"), lit("parameter names differ")),
        issue(both & (F.col("e_exported") != F.col("f_exported")), lit("warning"), lit("export flags differ")),
        issue(F.col("e").isNull() & lit(strict), lit("info"), lit("function is not documented")),
    )
    return j.select("path", "name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("path", "name", "i.severity", "i.message")


def rewrite(files: DataFrame, how: str) -> DataFrame:
    """(file_id, text, n_before, n_after, error, version) of files(file_id, ext, raw) or also version, which is null if not given, after ``minify``, ``beautify`` or ``strip_docs``; a text that cannot be read stays as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f, ext, raw, version in pdf.itertuples(index=False, name=None):
                text, error = raw, None
                try:
                    r = getattr(C, how)(raw, ext == ".tsx")
                    text = r[0] if isinstance(r, tuple) else r
                except (Bad, RecursionError) as e:
                    error = str(e) or "not read"
                out.append((f, text, len(raw), len(text), error, version))
            yield pd.DataFrame(out, columns=["file_id", "text", "n_before", "n_after", "error", "version"])

    if how not in ("minify", "beautify", "strip_docs"):
        raise ValueError(f"unknown rewriting {how}")
    version = (F.col("version") if "version" in files.columns else F.lit(None)).cast("timestamp").alias("version")
    rows = files.where("file_id is not null and raw is not null").select("file_id", F.lower("ext").alias("ext"), "raw", version).where(F.col("ext").isin(".js", ".mjs", ".ts", ".tsx"))
    return rows.mapInPandas(run, "file_id long, text string, n_before long, n_after long, error string, version timestamp")


def generate_context(functions: DataFrame, classes: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(path_rel, text): context files from facts. Descriptions of old entries(path, name, description) are kept; new symbols get a placeholder."""
    kept = old.where("description <> ''").groupBy(F.col("path").alias("path_rel"), "name").agg(F.min("description").alias("description")) if old is not None else None
    rows = functions.where("owner is null").select("path_rel", "name", "line", F.concat(F.when(F.col("exported"), "export ").otherwise(""), "name", F.lit("("), F.array_join("params", ","), F.lit(")"), F.when(F.size("calls") > 0, F.concat(F.lit("→→"), F.array_join(F.slice("calls", 1, 6), ","))).otherwise("")).alias("s"))
    more = classes.select("path_rel", "name", "line", F.concat(F.lit("class "), "name", F.when(F.col("extends").isNotNull(), F.concat(F.lit(" extends "), "extends")).otherwise("")).alias("s"))
    rows = rows.unionByName(more)
    rows = rows.join(kept, ["path_rel", "name"], "left") if kept is not None else rows.withColumn("description", F.lit(None).cast("string"))
    line = F.concat("s", F.lit("|"), F.coalesce("description", F.lit("{DESCRIBE}")))
    out = rows.groupBy("path_rel").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("x")))).alias("l"))
    return out.select("path_rel", F.concat(F.lit("--- "), "path_rel", F.lit(" ---\n"), F.array_join(F.transform("l", lambda v: v["x"]), "\n")).alias("text"))


def doc_lookup(files: DataFrame, docs: DataFrame, sections: DataFrame, notes: DataFrame) -> DataFrame:
    """(repo, path_rel, text) for files(repo, path_rel): the file's own context, else its section of the generated text, else a line that says that there is
    none; notes are put behind. docs, sections and notes are (repo, path_rel, text); blank texts count as none, notes without content, too."""
    of = lambda df, name: df.where(F.trim("text") != "").groupBy("repo", "path_rel").agg(F.min(F.trim("text")).alias(name))
    rows = files.select("repo", "path_rel").distinct().join(of(docs, "own"), ["repo", "path_rel"], "left").join(of(sections, "section"), ["repo", "path_rel"], "left")
    filled = notes.where(~F.col("text").rlike(r"^#[^\n]*\n+## Notes\n+## Follow-ups\n+## Decisions\s*$"))
    rows = rows.join(of(filled, "note"), ["repo", "path_rel"], "left")
    text = F.coalesce("own", "section", F.concat(F.lit("No documentation found for: "), "path_rel"))
    return rows.select("repo", "path_rel", F.concat_ws("\n\n", text, "note").alias("text"))


#: names asked for go to every task
MOST_NAMES = 5000


def by_suffix(files: DataFrame, names: list[str]) -> DataFrame:
    """(repo, asked, path_rel): of each repo and each name asked for the first path, in order, that ends with it. At most ``MOST_NAMES`` names."""
    if len(names) > MOST_NAMES:
        raise ValueError(f"{len(names)} names; at most {MOST_NAMES} can go to every task")
    asked = files.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string")
    hits = files.select("repo", "path_rel").join(F.broadcast(asked), F.col("path_rel").endswith(F.col("asked")))
    return hits.groupBy("repo", "asked").agg(F.min("path_rel").alias("path_rel"))
