"""Generated, minified, vendored and data files.

Two sources of evidence:

* Merkle hashes of directory trees (``shared_subtrees``), computed bottom-up, one level at a time: the hash of a directory combines the
  hashes of (name, hash) of its entries by XOR, which is commutative, so that a directory with very many entries is aggregated before
  the shuffle and never collected. Subtrees with the same hash in unrelated repositories are vendored copies;
* header and layout rules on each file (``judge_text``) and on its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.neardup import components
from codelode.session import cut

REASONS = "file_id long, repo string, path_rel string, generated boolean, minified boolean, vendored boolean, data boolean, version timestamp"
# ---- fixed values: names of directories that hold copies of other projects, whole path segments ----
VENDOR_DIRS = {
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "deps", "extern",
    "external", "externals", "site-packages", "Godeps", "Pods", "Carthage",
}
GENERATED_DIRS = {"gen", "generated", "__generated__", "autogen", "codegen"}
#: endings that code generators give to names
GENERATED_NAME = re.compile(r"(?:\.(?:pb|gen|generated|g|designer)\.\w+|_pb2(?:_grpc)?\.py|_generated\.\w+|\.pb\.gw\.go|_gen\.go|_string\.go)$", re.I)
MINIFIED_NAME = re.compile(r"[.-]min\.\w+$", re.I)
VERSIONED_DIR = re.compile(r"^@?[\w.-]+@v?\d+\.\d+[\w.+-]*$")
GENERATED_TEXT = re.compile(
    r"""(?:^|\W)@generated\b|<auto-?generated\b|\bauto-?generated\b(?!\s+(?:figures|reports?|values|ids?))|\bautomatically\s+(?:generated|produced|created|written)\b|\b(?:generated|produced|created|written)\s+automatically\b
    |\bmachine[- ](?:written|generated|made|produced)\b|\bcode\s+generated\b|\b(?:file|code|module|source|script|class|document)\s+(?:is|was|has\s+been|gets)\s+(?:\w+\s+)?(?:generated|produced|created|written)\s+(?:by|from|with|using|automatically)\b
    |\bgenerated\s+(?:by|from|with|using)\s+\S.*\b(?:do\s+not|don't|never)\s+(?:edit|modify|change|touch)\b|\boutput\s+of\s+\S+.*\b(?:regenerate|rebuild|re-?run)\b
    |\bdo\s+not\s+(?:edit|modify)\s*(?:[.!*/-]|$)|\bmanual\s+(?:changes|edits)\s+(?:will\s+be|are|get)\s+(?:lost|overwritten)\b|\bregenerate\s+(?:it|this|rather)\b""",
    re.I | re.X,
)
VENDORED_TEXT = re.compile(
    r"""\bthird[- ]party\s+(?:library|code|module|component|package|software|source)\b|\bbundled\s+(?:copy|version)\s+of\b|\bvendored\s+(?:from|copy|version|in)\b|\b(?:copied|taken|imported|adapted)\s+(?:verbatim|unchanged|as\s+is|unmodified)\b
    |\bupstream\s+(?:project|version|source|release|repository)\s*:|\bto\s+the\s+upstream\s+project\b|\blocal\s+patches\s*:
    |^\W*[\w@/.-]+\s+v?\d+\.\d+(?:\.\d+)?[\w.+-]*\s*(?:\||-|,|\()\s*(?:\(c\)|copyright|released\s+under|licen[sc]ed|mit\b|bsd\b|apache\b|isc\b|https?:)
    |^\W*\(c\)\s+(?:the\s+)?[\w.-]+\s+(?:contributors|authors|project)\b.*\blicen[sc]e\b""",
    re.I | re.X | re.M,
)
COMMENT_LINE = re.compile(r"^\s*(?://|#|--|/\*|\*)")
IMPORT_LINE = re.compile(r"^\s*(?:import\b|from\s+\S+\s+import\b|package\s+\w+|export\s*(?:\*|\{).*\bfrom\b|['\"]use strict['\"]|(?:const|let|var)\s+[\w{},\s$]+=\s*require\(|\}\s*from\b|[)\}];?\s*$|\(\s*$|[\"'][\w./@-]+[\"']\s*,?\s*$|\w+,?\s*$)")
LITERALS = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|\b\d[\w.]*')
FILLER = dict.fromkeys(map(ord, " \t\n\r\f\v,;:[]{}()-+"))
NO_VALUE = re.compile(r"\b(?:null|none|nil|true|false)\b", re.I)
INSERT_HEAD = re.compile(r"^insert\s+into\s+[\w.\"`\[\]]+\s*(?:\([\w\s,\"`]*\)\s*)?values\b", re.I)
STATEMENT = re.compile(r"""^[ \t]*(?:'''[^\n]*'''|\"{3}[^\n]*\"{3}|'[^'\n]*'|"[^"\n]*");?[ \t]*$""", re.M)
COMMENTS = re.compile(r"/\*[\s\S]*?\*/|^[ \t]*//.*$", re.M)
JOINED = re.compile(r"[;{}](?=[^\s;{}),\]])")
APART = re.compile(r"[;{}](?=\s|$)")
NUMBERED = re.compile(r"^(?:export\s+)?(?:(?:const|var|let|static|final)\s+)?([$A-Za-z_]*?)(\d+)(\w*)\s*(?::\s*\w+\s*)?(?::?=)\s*[\[({'\"\d-]", re.M)


def head_comments(text: str) -> str:
    """The comments before the first code that is no import."""
    out, block, doc = [], False, None
    for line in text.removeprefix(chr(0xFEFF)).split("\n"):
        s = line.strip()
        if doc:
            if doc in s:
                doc = None
        elif block:
            out.append(s)
            if "*/" in s:
                block = False
        elif not s:
            continue
        elif s.startswith("/*"):
            out.append(s)
            end = s.find("*/", 2)
            block = end < 0
            if end >= 0 and s[end + 2 :].strip():
                break
        elif s.startswith(("//", "#", "--")):
            out.append(s)
        elif s.startswith(('"""', "'''")):
            if s[3:].find(s[:3]) < 0:
                doc = s[:3]
        elif not IMPORT_LINE.match(s):
            break
    return "\n".join(out)


def is_minified(text: str, ext: str) -> bool:
    """Statements joined without blanks: outside of literals and comments more of the marks ; { } are followed by further code at once than by white
    space or the end, and white space makes less than ``0.12`` of the code.

    Both are ratios, so a text of any length is judged alike, also one repeated.
    """
    if ext not in (".js", ".mjs", ".ts", ".tsx", ".cjs", ".jsx", ".css"):
        return False
    code = COMMENTS.sub("", LITERALS.sub("'", text)).strip()
    if not code or len(code) - len("".join(code.split())) >= 0.12 * len(code):
        return False
    return len(JOINED.findall(code)) > len(APART.findall(code))


def is_data(text: str) -> bool:
    """Whether lines of mere data make more than half of the characters, comments and outer blanks left out, or literals nearly all of the text.

    A line of data has literals and nothing besides but separators, null and truth values, or is a row of an INSERT statement. A line that is a
    single literal without a separator (a directive, a documentation string) is none and not counted. All are ratios, of texts of any length.
    """
    total = data = 0
    for line in text.split("\n"):
        s = line.strip()
        if not s or COMMENT_LINE.match(s):
            continue
        total += len(s)
        if "," in s or ":" in s:
            row = INSERT_HEAD.sub("", s) if s[0] in "iI" else s
            rest = LITERALS.sub("", row)
            if len(rest) < len(row) and ("," in rest or ":" in rest) and not NO_VALUE.sub("", rest).translate(FILLER):
                data += len(s)
    if 2 * data > total:
        return True
    text = STATEMENT.sub("", text)
    rest = LITERALS.sub("", text)
    return len(text) - len(rest) > 0.4 * len(text) and len(rest.translate(FILLER)) < 0.12 * len(text)


def numbered_tables(text: str, least: int = 4) -> bool:
    """Top-level constants that a program numbered: the same name around 0, 1, 2 and so on."""
    runs: dict[tuple[str, bool], int] = {}
    for m in NUMBERED.finditer(text):
        key = (m.group(1), m.group(3).startswith("_"))
        if int(m.group(2)) == runs.get(key, 0) and (key[1] or not m.group(3)):
            runs[key] = runs.get(key, 0) + 1
            if runs[key] >= least:
                return True
    return False


def judge_text(text: str, path: str, ext: str) -> tuple[bool, bool, bool, bool]:
    """(generated, minified, vendored, data) by header, layout and path."""
    parts = path.replace("\\", "/").split("/")
    name, dirs = parts[-1], parts[:-1]
    head = head_comments(text)
    blank = not text.strip()
    generated = bool(GENERATED_TEXT.search(head)) or not blank and (bool(GENERATED_NAME.search(name)) or any(d in GENERATED_DIRS for d in dirs) or numbered_tables(text))
    vendored = bool(VENDORED_TEXT.search(head)) or any(d in VENDOR_DIRS or VERSIONED_DIR.match(d) for d in dirs)
    minified = is_minified(text, ext) or not blank and bool(MINIFIED_NAME.search(name)) and text.count("\n") < 3 + len(text) / 200
    return generated, minified, vendored, is_data(text)


def judge_files(files: DataFrame) -> DataFrame:
    """REASONS for each row of files(file_id, repo, path_rel, ext, raw, version).

    Rows with a null id are left out; a null text or path counts as empty. Further columns are ignored, whatever their names; repeated rows
    give repeated rows; an empty table gives none. Texts are read whole.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(f, repo, path, *judge_text(raw.replace("\r\n", "\n"), path or "", ext), v) for f, repo, path, ext, raw, v in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame(out, columns=["file_id", "repo", "path_rel", "generated", "minified", "vendored", "data", "version"])

    rows = files.select("file_id", "repo", "path_rel", F.coalesce(F.lower("ext"), F.lit("")).alias("ext"), F.coalesce("raw", F.lit("")).alias("raw"), "version")
    return rows.where("file_id is not null").mapInPandas(judge, REASONS)


def leaves(files: DataFrame) -> DataFrame:
    """(repo, parts, h1, h2): each file's path in segments and two hashes of its text. A path counts once."""
    return (
        files.where("repo is not null and path_rel is not null and raw is not null")
        .select("repo", F.split(F.regexp_replace("path_rel", r"^(\./|/)+", ""), "/+").alias("parts"), F.xxhash64("raw").alias("h1"), F.hash("raw").cast("long").alias("h2"), F.length("raw").alias("n_chars"))
        .groupBy("repo", "parts")
        .agg(F.min_by(F.struct("h1", "h2", "n_chars"), "h1").alias("t"))
        .select("repo", "parts", "t.h1", "t.h2", "t.n_chars")
    )


def directory_hashes(files: DataFrame, checkpoint_every: int = 8, shallow: int = 48) -> DataFrame:
    """(repo, parts, h1, h2, n_files, n_chars) of every file (its leaf, hashed with its name) and every directory, the root (no segments) among them, bottom-up.

    One aggregation for each level, from the deepest path up. The lineage is cut every few levels, so the plan does not grow with the depth; the
    levels below ``shallow`` are worked off on the few paths that reach so deep.
    """
    name = F.element_at("parts", -1)
    tree = cut(leaves(files).select("repo", "parts", F.size("parts").alias("depth"), F.lit(1).cast("long").alias("n_files"), F.col("n_chars").cast("long").alias("n_chars"), F.xxhash64(name, "h1", "h2").alias("h1"), F.xxhash64(F.lit(7), "h2", name, "h1").alias("h2")))
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    columns = ["repo", "parts", "h1", "h2", "n_files", "n_chars"]
    deep = cut(tree.where(F.col("depth") > shallow)) if deepest > shallow else tree
    below, part, done = None, [], [tree.select(columns)]
    for depth in range(deepest, 0, -1):
        level = (deep if depth > shallow else tree).where(F.col("depth") == depth).select(columns)
        if below is not None:
            level = level.unionByName(below)
        up = level.groupBy("repo", F.slice("parts", F.lit(1), F.lit(depth - 1)).alias("parts")).agg(F.bit_xor("h1").alias("e1"), F.bit_xor("h2").alias("e2"), F.sum("n_files").alias("n_files"), F.sum("n_chars").alias("n_chars"))
        # the entries of a directory, and the name under which it stands in its own parent
        below = up.select("repo", "parts", F.xxhash64(name, "e1", "e2").alias("h1"), F.xxhash64(F.lit(7), "e2", name, "e1").alias("h2"), "n_files", "n_chars")
        part.append(up.select("repo", "parts", F.col("e1").alias("h1"), F.col("e2").alias("h2"), "n_files", "n_chars"))
        if len(part) == checkpoint_every and depth > 1:
            below, part = cut(below), [cut(_union(part))]
            if len(part) + len(done) > 16:
                done = [cut(_union(done))]
            done, part = done + part, []
    return _union(done + part)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def shared_subtrees(files: DataFrame, least_chars: int = 200, least_files: int = 2, single_owners: int = 3, related_share: float = 0.5) -> DataFrame:
    """(repo, dir): directories, and files, whose whole subtree also stands in an unrelated repository.

    A subtree is told by the names and texts below it, a file by its own name and text; the name of the directory itself does not count. It is
    vendored where at least two unrelated families of repositories (``families``: forks and moves are one) own it; one of fewer than
    ``least_files`` files only if ``single_owners`` families do, since single files are copied by hand, too. Subtrees of fewer than ``least_chars``
    characters say nothing. In a repository of which the subtree makes more than ``related_share`` it is the project itself, not a copy, with all below it.
    """
    dirs = cut(directory_hashes(files))
    size = dirs.where(F.size("parts") == 0).select("repo", F.col("n_files").alias("repo_files"))
    key = ["h1", "h2", "n_files"]
    big = dirs.where(F.col("n_chars") >= least_chars)
    groups = big.select(*key, "repo").distinct().groupBy(*key).agg(F.count("*").alias("n_repos")).where("n_repos > 1").drop("n_repos")
    shared = cut(big.join(groups, key).select(*key, "repo", F.array_join("parts", "/").alias("dir")))
    if shared.isEmpty():
        return shared.select("repo", "dir")
    own = shared.join(families(files, shared.select("repo").distinct(), related_share), "repo", "left").withColumn("family", F.coalesce("family", "repo"))
    owners = own.select(*key, "family").distinct().groupBy(*key).agg(F.count("*").alias("n_families")).where("n_families >= 2")
    foreign = cut(shared.join(owners, key).join(size, "repo"))
    origin = foreign.where(F.col("n_files") > related_share * F.col("repo_files")).groupBy("repo").agg(F.min_by("dir", F.length("dir")).alias("origin"))
    below = (F.col("origin") == "") | (F.col("dir") == F.col("origin")) | F.startswith("dir", F.concat("origin", F.lit("/")))
    enough = (F.col("n_files") >= least_files) | (F.col("n_families") >= single_owners)
    return foreign.where(enough).join(origin, "repo", "left").where(F.col("origin").isNull() | ~below).select("repo", "dir").distinct()


def families(files: DataFrame, repos: DataFrame, related_share: float = 0.5, bands: int = 48) -> DataFrame:
    """(repo, family) of those repos(repo) that have a relative: forks, moves and their forks again.

    Two repositories are related if more than ``related_share`` of the texts of the larger one stand in the other one, too, wherever that is.
    Candidates agree in a band of two min-hashes of their texts (minima, so a repository with very many files is aggregated before the
    shuffle), each is linked with the first repository of the band, and the links are verified on the texts themselves. At a share of exactly
    0.5 two repositories of equal size are missed by all of 48 bands with a chance of 0.4 %, and the more they share the more rarely.
    """
    texts = cut(files.where("repo is not null and path_rel is not null and raw is not null").select("repo", F.xxhash64("raw").alias("t")).distinct().join(repos, "repo", "left_semi"))
    mins = texts.groupBy("repo").agg(F.count("*").alias("n"), *[F.min(F.xxhash64(F.lit(k), "t")).alias(f"m{k}") for k in range(2 * bands)])
    sketch = cut(mins.select("repo", "n", F.array(*[F.xxhash64(F.lit(k), f"m{2 * k}", f"m{2 * k + 1}") for k in range(bands)]).alias("bands")))
    banded = sketch.select("repo", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("repo").alias("hub"), F.max("repo").alias("last")).where("hub <> last").select("band", "hub")
    links = banded.join(hubs, "band").where("repo <> hub").select("repo", "hub").distinct()
    n = sketch.select("repo", "n")
    both = links.join(texts, "repo").join(texts.withColumnRenamed("repo", "hub"), ["hub", "t"]).groupBy("repo", "hub").agg(F.count("*").alias("both"))
    kept = both.join(n, "repo").join(n.select(F.col("repo").alias("hub"), F.col("n").alias("hub_n")), "hub").where(F.col("both") > related_share * F.greatest("n", "hub_n"))
    return components(kept.select(F.col("repo").alias("id_a"), F.col("hub").alias("id_b"))).select(F.col("id").alias("repo"), F.col("group").alias("family"))


def vendored_by_tree(files: DataFrame) -> DataFrame:
    """(file_id, version) of the files that are or stand below a shared subtree: a path is joined with itself and each of its directories."""
    dirs = shared_subtrees(files)
    parts = F.split(F.regexp_replace("path_rel", r"^(\./|/)+", ""), "/+")
    above = (
        files.where("file_id is not null and repo is not null and path_rel is not null")
        .select("file_id", "version", "repo", parts.alias("p"))
        .select("file_id", "version", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("dir"))
    )
    return above.join(dirs, ["repo", "dir"]).select("file_id", "version").distinct()
