"""Sources of a project's tree: files, packages, rules, context files. The file system is read by the executors; only lists that a rule set or a root bounds come to the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.config import Filters
from codelode.functions.text import base_name, content_hash

EXTENSIONS = [".js", ".mjs", ".ts", ".tsx", ".py", ".go", ".sql"]
# ---- fixed values: folders of a monorepo that hold sub-projects ----
MONOREPO = "packages|apps|services|modules|libs|plugins"


def _relative(root: str):
    """The path below the root, of the file's address."""
    bare = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/")
    return F.expr(f"substring(p, instr(p, '{_sql(root)}') + {len(root) + 1})"), bare


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def all_files(spark: SparkSession, root: str) -> DataFrame:
    """(path_rel, size, mtime) of every file that is not hidden; contents are not read."""
    root = root.rstrip("/")
    rel, bare = _relative(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(bare.alias("p"), "length", "modificationTime").select(rel.alias("path_rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def source_files(spark: SparkSession, root: str, repo: str | None = None, filters: Filters | None = None, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """(file_id, repo, path_rel, ext, raw, content_hash, mtime) of the source files that the filters leave; template and style modules are left out."""
    root = root.rstrip("/")
    rel, bare = _relative(root)
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(bare.alias("p"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("mtime"))
    files = texts.select(rel.alias("path_rel"), "raw", "mtime").withColumn("ext", F.regexp_extract("path_rel", r"(\.[A-Za-z]+)$", 1))
    files = files.where(F.col("ext").isin(extensions) & ~F.col("path_rel").rlike(r"\.(css|tpl)\.js$") & ~(filters or Filters()).excluded(F.col("path_rel")))
    return files.select(F.xxhash64("path_rel").alias("file_id"), F.lit(repo or base_of(root)).alias("repo"), "path_rel", "ext", "raw", content_hash(F.col("raw")).alias("content_hash"), "mtime")


def base_of(root: str) -> str:
    return root.rstrip("/").rsplit("/", 1)[-1]


def sub_projects(paths: DataFrame) -> DataFrame:
    """(name, path) of the sub-projects: folders of a monorepo that hold a package.json."""
    p = rf"^((?:{MONOREPO})/([^/]+))/package\.json$"
    return paths.where(F.col("path_rel").rlike(p)).select(F.regexp_extract("path_rel", p, 2).alias("name"), F.regexp_extract("path_rel", p, 1).alias("path"))


def with_sub_projects(files: DataFrame, subs: DataFrame) -> DataFrame:
    """files(path_rel, ..) with ``sub_project`` and ``sub_path``, the path below it: of a recursive scan each file belongs to the sub-project whose folder
    holds it, to none (null, its own path) outside of all. subs(name, path) as ``sub_projects`` gives them, two segments each."""
    two = F.substring_index("path_rel", "/", 2)
    known = subs.select(F.col("name").alias("sub_project"), F.col("path").alias("_folder"))
    joined = files.withColumn("_folder", F.when(F.size(F.split("path_rel", "/")) > 2, two)).join(known, "_folder", "left")
    below = F.expr("substring(path_rel, length(_folder) + 2)")
    return joined.withColumn("sub_path", F.when(F.col("sub_project").isNotNull(), below).otherwise(F.col("path_rel"))).drop("_folder")


def changed_files(spark: SparkSession, root: str, back: int | None = 5) -> DataFrame:
    """(path_rel) of the files that git says were changed in the last ``back`` commits; with None of all tracked and untracked ones. Not a repository: none.

    The list is made on the driver, as git works there.
    """
    import subprocess

    what = ["ls-files", "--cached", "--others", "--exclude-standard"] if back is None else ["diff", "--name-only", f"HEAD~{back}"]
    try:
        out = subprocess.run(["git", "-C", root, *what], check=True, capture_output=True, text=True).stdout
    except (subprocess.CalledProcessError, FileNotFoundError):
        out = ""
    return spark.createDataFrame([(p,) for p in out.splitlines() if p], "path_rel string").distinct()


def package_dependencies(packages: DataFrame) -> DataFrame:
    """(repo, name, version) of packages(repo, text): dependencies and development dependencies of package.json texts; texts that are no JSON have none."""
    parsed = packages.select("repo", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    both = F.concat(F.coalesce(F.map_entries("j.dependencies"), F.expr("array()")), F.coalesce(F.map_entries("j.devDependencies"), F.expr("array()")))
    return parsed.select("repo", F.explode(both).alias("e")).select("repo", F.col("e.key").alias("name"), F.col("e.value").alias("version")).distinct()


RULE_FILE = "name string, description string, alwaysApply boolean, detect struct<packageJson:array<string>,imports:array<string>,patterns:array<string>>, rules array<struct<id:string,name:string,description:string,pattern:string,patternType:string,replacement:string,severity:string,filePattern:string,exclude:array<string>,contextRequired:string,docs:string>>"


def rule_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sets, rules) of a folder of rule files; a file that is no JSON is left out. Sets: ruleset, packages, imports, patterns, always. Rules as check_rules takes them, in order of the files' names."""
    raw = spark.read.schema(RULE_FILE).option("multiLine", "true").json(folder).where("name is not null")
    empty = F.expr("cast(array() as array<string>)")
    sets = raw.select(F.col("name").alias("ruleset"), *[F.coalesce(F.col(f"detect.{c}"), empty).alias(n) for c, n in (("packageJson", "packages"), ("imports", "imports"), ("patterns", "patterns"))], F.coalesce("alwaysApply", F.lit(False)).alias("always"))
    rules = raw.select(F.col("name").alias("ruleset"), F.posexplode("rules").alias("k", "r")).select(
        "ruleset", F.col("r.id").alias("rule_id"), "k", F.col("r.pattern").alias("pattern"), (F.coalesce("r.patternType", F.lit("string")) == "regex").alias("is_regex"), F.coalesce("r.severity", F.lit("warning")).alias("severity"),
        F.coalesce("r.filePattern", F.lit("*.js")).alias("file_pattern"), F.coalesce("r.exclude", empty).alias("exclude"), F.col("r.replacement").alias("replacement"), F.col("r.contextRequired").alias("context"))
    from pyspark.sql import Window

    return sets, rules.withColumn("rank", F.row_number().over(Window.orderBy("ruleset", "k"))).drop("k")


def context_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, target, text): context files, the folder .context first; ``target`` is the source they belong to, without extension. One of a target counts, in this order."""
    root = root.rstrip("/")
    rel, bare = _relative(root)
    read = lambda at: spark.read.text(at, wholetext=True, recursiveFileLookup=True).select(bare.alias("p"), "value")
    texts = read(root)
    try:  # folders whose name begins with a dot are read only if they are named
        texts = texts.unionByName(read(f"{root}/.context"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    texts = texts.select(rel.alias("path"), F.col("value").alias("text")).where(F.col("path").rlike(r"\.ctx(\.md)?$"))
    target = F.regexp_replace(F.regexp_replace("path", r"^\.context/", ""), r"\.ctx(\.md)?$", "")
    ranked = texts.withColumn("target", target).withColumn("k", F.when(F.col("path").startswith(".context/"), 0).otherwise(1))
    one = ranked.groupBy("target").agg(F.min_by(F.struct("path", "text"), F.struct("k", "path")).alias("r"))
    name = base_name(F.col("path"))
    return one.select("r.path", "target", "r.text").orderBy(F.when(name == "project.ctx", 0).when(name.startswith("_"), 1).otherwise(2), "path")


def diagnostics(lines: DataFrame) -> DataFrame:
    """(file, line, col, severity, code, message) of a type checker's output lines(value)."""
    p = r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$"
    g = lambda k: F.regexp_extract("value", p, k)
    return lines.where(F.col("value").rlike(p)).select(g(1).alias("file"), g(2).cast("int").alias("line"), g(3).cast("int").alias("col"), g(4).alias("severity"), g(5).alias("code"), g(6).alias("message"))
