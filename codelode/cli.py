"""python -m codelode.cli COMMAND ROOT [ARGUMENT...]: the operators on a source tree, as JSON lines."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.extract import facts as X
from codelode.operators import analysis as A
from codelode.operators import docs as D
from codelode.operators import graph as G
from codelode.plans.code_facts_queries import dead_code
from codelode.session import get_session
from codelode.sources.project import all_files, base_of, changed_files, diagnostics, package_dependencies, source_files, sub_projects


class Project:
    """The facts of one tree, extracted once."""

    def __init__(self, root: str):
        self.spark = get_session("codelode")
        self.spark.sparkContext.setLogLevel("ERROR")
        self.root, self.files = root, source_files(self.spark, root)
        self.facts = X.extract(self.files).cache()
        self.functions, self.classes = X.functions(self.facts), X.classes(self.facts)
        own = self.functions.where("owner is null")
        names = own.select("repo", "name", "path_rel", "ord").unionByName(self.classes.select("repo", "name", "path_rel", "ord"))
        self.legend = G.legend(names.select("repo", "name", F.concat_ws("/", "path_rel", F.lpad(F.col("ord").cast("string"), 6, "0")).alias("ord")))
        alias = self.legend.select("repo", F.col("name").alias("node_name"), "alias")
        c = self.classes.select("repo", F.lit("C").alias("kind"), F.col("name").alias("node_name"), F.col("extends").alias("extends_name"), "methods", "exported", "path_rel", F.col("line").alias("line_no"))
        f = own.select("repo", F.lit("F").alias("kind"), F.col("name").alias("node_name"), F.lit(None).cast("string").alias("extends_name"), F.lit(None).cast("array<string>").alias("methods"), "exported", "path_rel", F.col("line").alias("line_no"))
        self.nodes = c.unionByName(f).join(alias, ["repo", "node_name"])
        self.edges = G.call_edges(self.classes, self.legend)


COMMANDS = {
    "skeleton": lambda p: G.skeleton(p.nodes),
    "stats": lambda p: G.graph_stats(p.nodes, p.edges),
    "legend": lambda p: p.legend,
    "deps": lambda p, symbol: G.dependencies(p.nodes, p.edges, p.files.first()["repo"], symbol),
    "usages": lambda p, name: G.usages(p.nodes, p.edges, name),
    "orphans": lambda p: G.orphans(p.nodes, p.edges),
    "duplicates": lambda p: G.duplicate_methods(p.nodes),
    "complexity": lambda p, least="1": p.functions.where(F.col("complexity") >= int(least)).select("path_rel", "name", "line", "complexity", A.complexity_rating(F.col("complexity")).alias("rating")).orderBy(F.desc("complexity"), "path_rel", "line").limit(30),
    "similar": lambda p, threshold="60": A.similar_functions(p.functions.withColumn("ord", F.xxhash64("path_rel", "ord")).withColumnRenamed("path_rel", "path"), int(threshold)).orderBy(F.desc("score"), "a_name").limit(20),
    "undocumented": lambda p: p.functions.where("not has_doc and not startswith(name, '_')").select("path_rel", "name", "line"),
    "outdated": lambda p: p.facts.select("path_rel", F.explode("findings").alias("f")).select("path_rel", "f.*"),
    "tables": lambda p: X.tables(p.facts),
    "inventory": lambda p: A.inventory(p.files).select("path_rel", "n_lines", "n_characters", "n_tokens", "hash"),
    "subprojects": lambda p: sub_projects(all_files(p.spark, p.root)),
    "dialect": lambda p: D.dialect(p.functions, p.classes),
    "minify": lambda p: D.rewrite(p.files, "minify").select("file_id", "n_before", "n_after", "error"),
    "beautify": lambda p: D.rewrite(p.files, "beautify").select("file_id", "n_before", "n_after", "error"),
    "expand": lambda p, symbol: G.expand_symbol(p.nodes.withColumn("props", F.lit(None).cast("array<string>")), p.edges, p.files, p.files.first()["repo"], symbol, p.legend),
    "summary": lambda p: A.summary_only(p.functions),
    "redundant": lambda p: A.redundant_dependencies(package_dependencies(p.spark.read.text(f"{p.root}/package.json", wholetext=True).select(F.lit(base_of(p.root)).alias("repo"), F.col("value").alias("text")))),
    "style": lambda p: p.files.where("ext in ('.js', '.mjs')").select("path_rel", F.explode(A.style_rules(F.col("raw"), F.lit(None).cast("string"))).alias("x")).select("path_rel", "x.*"),
    "changed": lambda p, back="5": changed_files(p.spark, p.root, int(back)),
    "edges": lambda p: p.edges.select("repo", "src", "op", "dst"),
    "classes": lambda p: p.classes.select("path_rel", "name", "extends", "line", "methods", "properties", "exported"),
    "functions": lambda p: p.functions.select("path_rel", "owner", "name", "line", "params", "is_async", "exported", "calls", "complexity"),
    "imports": lambda p: X.imports(p.facts).select("path_rel", "source", "names", "line"),
    "dead": lambda p: dead_code(p.facts),
    "types": lambda p, log: diagnostics(p.spark.read.text(log)),
}


def call_chain(project: Project, start: str, goal: str) -> list[str] | None:
    return G.call_chain(project.edges, start, goal)


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in {*COMMANDS, "call-chain"}:
        print(__doc__, "\nCommands:", *sorted([*COMMANDS, "call-chain"]))
        return 2
    project = Project(args[1])
    if args[0] == "call-chain":
        print(json.dumps(call_chain(project, *args[2:4])))
        return 0
    out: DataFrame = COMMANDS[args[0]](project, *args[2:])
    for row in out.toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
