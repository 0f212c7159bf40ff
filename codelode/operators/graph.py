"""The code graph: legend, nodes, edges and questions on them.

nodes(repo, alias, kind, node_name, extends_name, methods, exported, path_rel, line_no); edges(repo, src, op, dst). Everything is per repo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import alias_base
from codelode.operators.skew import hot_keys
from codelode.session import cut

CALL, ELEMENT, FILE, READ, WRITE = "→", "E→", "F→", "R→", "W→"


def target_base(dst):
    """The alias of a target: what stands before the first dot."""
    return F.substring_index(dst, ".", 1)


def legend(names: DataFrame, keys: list[str] = ("repo",)) -> DataFrame:
    """(keys, name, ord, alias) for names(keys, name, ord): each name, in order of ord, gets its short form or, if that is taken, the first free number behind it.

    Null and empty names get no alias; a repeated name counts once, at its first place. A short form and a number can be another short form (SN1), so
    the names of short forms that differ in digits at the end alone are numbered together: in one pass in order, of which only a counter for each
    short form is kept (there are at most some hundred with the same letters). All others are numbered by a window.
    """
    keys = list(keys)
    first = names.where("name is not null and name <> ''").groupBy(*keys, "name").agg(F.min("ord").alias("ord"))
    based = first.withColumn("base", alias_base(F.col("name"))).withColumn("root", F.regexp_replace("base", "[0-9]+$", ""))
    mixed = based.groupBy(*keys, "root").agg(F.min("base").alias("a"), F.max("base").alias("b")).where("a <> b").select(*keys, "root", F.lit(True).alias("mixed"))
    based = based.join(mixed, [*keys, "root"], "left")
    n = F.row_number().over(Window.partitionBy(*keys, "base").orderBy("ord", "name")) - 1
    plain = based.where("mixed is null").withColumn("n", n)
    ordered = based.where("mixed").select(*keys, "root", "name", "ord", "base", F.lit(0).cast("long").alias("n")).repartition(*keys, "root").sortWithinPartitions(*keys, "root", "ord", "name")
    counted = ordered.mapInPandas(_number(len(keys)), ordered.schema)
    number = F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat("base", F.col("n").cast("string"))).alias("alias")
    return plain.select(*keys, "name", "ord", number).unionByName(counted.select(*keys, "name", "ord", number))


def _number(n_keys: int):
    """Numbers rows(keys, root, name, ord, base, n) that come sorted: n is the least for which the base, or the base and n, is free.

    All numbers of a base below its counter are taken, by itself or by others, so the counters tell what is taken.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, next_free = None, {}

        def taken(alias: str) -> bool:
            return any(k and (alias == b or alias.startswith(b) and (rest := alias[len(b) :]).isdigit() and rest[0] != "0" and int(rest) < k) for b, k in next_free.items())

        for pdf in batches:
            numbers = []
            for row in pdf.itertuples(index=False, name=None):
                if row[: n_keys + 1] != group:
                    group, next_free = row[: n_keys + 1], {}
                base = row[n_keys + 3]
                k = next_free.get(base, 0)
                while taken(f"{base}{k}" if k else base):
                    k += 1
                numbers.append(k)
                next_free[base] = k + 1
            yield pdf.assign(n=numbers)

    return run


def call_edges(classes: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, src, op, dst) of classes(repo, name, calls array): calls to known names. Of A.b both parts are looked up; an unknown member stays as it is."""
    calls = classes.select("repo", F.col("name").alias("caller"), F.explode("calls").alias("call")).distinct()
    parts = calls.withColumn("first", F.substring_index("call", ".", 1)).withColumn("member", F.when(F.instr("call", ".") > 0, F.expr("substring(call, instr(call, '.') + 1)")))
    look = names.select("repo", "name", "alias")
    out = (
        parts.join(look.select("repo", F.col("name").alias("caller"), F.col("alias").alias("src")), ["repo", "caller"])
        .join(look.select("repo", F.col("name").alias("first"), F.col("alias").alias("base")), ["repo", "first"])
        .join(look.select("repo", F.col("name").alias("member"), F.col("alias").alias("short")), ["repo", "member"], "left")
    )
    dst = F.when(F.col("member").isNull(), F.col("base")).otherwise(F.concat_ws(".", "base", F.coalesce("short", "member")))
    return out.select("repo", "src", F.lit(CALL).alias("op"), dst.alias("dst")).distinct()


def data_edges(functions: DataFrame, names: DataFrame) -> DataFrame:
    """R→ and W→ edges of functions(repo, name, db_reads, db_writes)."""
    look = names.select("repo", "name", F.col("alias").alias("src"))
    side = lambda col, op: functions.select("repo", "name", F.explode(col).alias("dst")).join(look, ["repo", "name"]).select("repo", "src", F.lit(op).alias("op"), "dst")
    return side("db_reads", READ).unionByName(side("db_writes", WRITE)).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that are not exported and not the target of any edge. A null flag counts as not exported."""
    targets = edges.select("repo", target_base("dst").alias("alias")).distinct()
    own = nodes.where((F.col("kind") == "F") & ~F.coalesce("exported", F.lit(False)))
    return own.join(targets, ["repo", "alias"], "left_anti").select("repo", "alias", "node_name").distinct()


def duplicate_methods(nodes: DataFrame) -> DataFrame:
    """Method names of more than one class of a repo, with the classes.

    The members are counted before they are listed, so a name that only one class has costs nothing; a list is as long as its answer.
    """
    one = nodes.where("kind = 'C'").select("repo", F.explode("methods").alias("method_name"), "node_name", "line_no").where("method_name is not null")
    one = one.groupBy("repo", "method_name", "node_name").agg(F.min("line_no").alias("line_no"))
    many = one.groupBy("repo", "method_name").agg(F.count("*").alias("n_classes")).where("n_classes > 1")
    member = F.concat("node_name", F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit("?")))
    return one.join(many, ["repo", "method_name"]).groupBy("repo", "method_name", "n_classes").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))


def usage_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each alias: its targets and sources by kind of edge, exact matches."""
    out = edges.groupBy("repo", F.col("src").alias("alias")).agg(F.count_if(F.col("op") == CALL).alias("n_calls"), F.count_if(F.col("op").isin(READ, WRITE)).alias("n_tables"))
    into = edges.where(F.col("op") != FILE).groupBy("repo", target_base("dst").alias("alias")).agg(F.count_distinct("src").alias("n_used_by"))
    own = nodes.select("repo", "alias").distinct()
    zero = F.lit(0)
    return own.join(out, ["repo", "alias"], "left").join(into, ["repo", "alias"], "left").select("repo", "alias", *[F.coalesce(c, zero).alias(c) for c in ("n_calls", "n_tables", "n_used_by")])


def dependencies(nodes: DataFrame, edges: DataFrame, repo: str, symbol: str, exact: bool = False) -> DataFrame:
    """(relation, name) of one symbol: imports are left to the facts; calls, tables, files, elements, and who uses it. Users are matched by prefix unless exact."""
    own = edges.where(F.col("repo") == repo)
    hit = (target_base("dst") == symbol) if exact else F.col("dst").startswith(symbol)
    used = own.where(hit & (F.col("op") != FILE)).select(F.lit("usedBy").alias("relation"), F.col("src").alias("name"))
    kinds = F.create_map(*[F.lit(x) for x in (CALL, "calls", READ, "reads", WRITE, "writes", FILE, "files", ELEMENT, "elements")])
    out = own.where(F.col("src") == symbol).select(kinds[F.col("op")].alias("relation"), F.col("dst").alias("name"))
    return out.unionByName(used).where("name is not null").distinct()


def usages(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Classes any of whose calls contains the name."""
    classes = nodes.where("kind = 'C'").select("repo", F.col("alias").alias("src"), "node_name").distinct()
    return edges.where((F.col("op") == CALL) & F.col("dst").contains(name)).select("repo", "src").distinct().join(classes, ["repo", "src"])


def reachable(edges: DataFrame, starts: DataFrame, steps: int | None = None, most_steps: int = 1000, keep_every: int = 4) -> DataFrame:
    """(start, alias, depth): least number of steps along edges(src, dst) from each start, breadth first. See ``reach``."""
    return reach(edges.select("src", target_base("dst").alias("dst")), starts, steps, most_steps, keep_every)


def reach(links: DataFrame, starts: DataFrame, steps: int | None = None, most_steps: int = 1000, keep_every: int = 4) -> DataFrame:
    """``reachable`` along links(src, dst) whose targets are taken as they are.

    Each step joins the frontier with the links and removes what is known; the lineage is cut every few steps. Ends when nothing new comes, or
    after ``steps`` where the question is about so many. Without, ``most_steps`` is a guard: a wider closure raises, it is never cut.
    """
    links = cut(links.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    known = cut(starts.select("start", F.col("start").alias("alias"), F.lit(0).alias("depth")).distinct())
    frontier = known
    for step in range(1, (most_steps if steps is None else steps) + 1):
        new = frontier.select("start", F.col("alias").alias("src")).join(links, "src").select("start", F.col("dst").alias("alias")).distinct()
        new = cut(new.join(known.select("start", "alias"), ["start", "alias"], "left_anti").withColumn("depth", F.lit(step)))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        if step % keep_every == 0:
            known = cut(known)
        frontier = new
    else:
        if steps is None:
            raise RuntimeError(f"the closure goes on after {most_steps} steps")
    return known


#: at once go so many starts through a part that their bits for all its links or aliases are at most BITS; at most CELLS bits are told at a time
BITS, CELLS, LEAST_ROWS = 1 << 27, 1 << 19, 1 << 15


def closure(links: DataFrame, starts: DataFrame, own: int = 64, most_parts: int = 16, most_links: int = 4_000_000) -> DataFrame:
    """``reach`` in any number of steps along links(root, src, dst) from starts(root, start), where no alias stands under two roots.

    All links of a root come to one place, so a link is moved once and what is reached is never moved; it is told as it is found. A root with more than
    ``own`` starts (and a thousandth of all) is taken to up to ``most_parts`` places, each with a part of its starts. Roots with more than ``most_links`` links,
    which no single place should hold, go through ``reach``. Rows with a null are dropped.
    """
    links = cut(links.select("root", "src", "dst").where("root is not null and src is not null and dst is not null and src <> dst").distinct())
    starts = cut(starts.select("root", "start").where("root is not null and start is not null").distinct())
    spark, far = links.sparkSession, None
    wide = hot_keys(links, ["root"], most_links, 1 << 40)  # at most a most_links-th of the links
    if wide is not None:
        key = F.broadcast(wide.select("root"))
        far = reach(links.join(key, "root", "left_semi"), starts.join(key, "root", "left_semi"))
        links, starts = links.join(key, "root", "left_anti"), starts.join(key, "root", "left_anti")
    many = hot_keys(starts, ["root"], own)
    if many is None:
        parted = lambda df: df.withColumn("parts", F.lit(1))
    else:
        parts = F.broadcast(many.select("root", F.least(F.ceil(F.col("n_rows") / own), F.lit(most_parts)).cast("int").alias("parts")))
        parted = lambda df: df.join(parts, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = parted(links).select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src", "dst")
    rows = rows.unionByName(parted(starts).select("root", F.pmod(F.xxhash64("start"), F.col("parts")).cast("int").alias("part"), F.col("start").alias("src"), F.lit(None).cast("string").alias("dst")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(n, "root", "part").sortWithinPartitions("root", "part", F.col("dst").isNull())
    near = rows.mapInArrow(_closures, "start string, alias string, depth int")
    return near if far is None else near.unionByName(far)


def _closures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, alias, depth) of rows(root, part, src, dst) that come sorted, in each part the links and then the starts as src without dst."""

    def parts() -> Iterator[list[pa.RecordBatch]]:
        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            root, part = b.column(0), b.column(1)
            other = pc.or_(pc.not_equal(root[1:], root[:-1]), pc.not_equal(part[1:], part[:-1])).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(other) + 1).tolist(), b.num_rows]
            for i, j in zip(bounds, bounds[1:]):
                at = (root[i].as_py(), part[i].as_py())
                if held and at != key:
                    yield held
                    held = []
                key = at
                held.append(b.slice(i, j - i))
        if held:
            yield held

    few, n = [], 0
    for p in parts():
        for out in _closure(p):
            few.append(out)
            n += out.num_rows
            if n >= LEAST_ROWS:
                yield from pa.Table.from_batches(few).combine_chunks().to_batches()
                few, n = [], 0
    if few:
        yield from pa.Table.from_batches(few).combine_chunks().to_batches()


def _closure(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All starts of one part, many at a time: a row of bits for each alias has a bit for each start, and a step joins the rows of new bits along the links."""
    rows = pa.Table.from_batches(batches)
    n_starts = rows["dst"].null_count
    n_links = len(rows) - n_starts
    if not n_starts:
        return
    coded = pa.chunked_array(rows["src"].chunks + rows["dst"].slice(0, n_links).chunks, rows["src"].type).dictionary_encode().unify_dictionaries()
    names, codes = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    src, starts, dst = codes[:n_links], codes[n_links : len(rows)], codes[len(rows) :]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    place = np.full(len(names), -1)
    step = 64 * max(1, min(BITS // max(len(names), n_links), 4096) // 64)
    for first in range(0, n_starts, step):
        own = starts[first : first + step]
        words, k = -(-len(own) // 64), np.arange(len(own))
        seen = np.zeros((len(names), words), np.uint64)
        seen[own, k >> 6] = np.uint64(1) << (k & 63).astype(np.uint64)
        found, bits, depth, called = own, seen[own], 0, names.take(pa.array(own))
        while len(found):
            yield from _told(names, called, found, bits, depth)
            place[found] = np.arange(len(found))
            at = place[src]
            place[found] = -1
            use = np.flatnonzero(at >= 0)
            if not len(use):
                break
            to = dst[use]
            begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            bits = np.bitwise_or.reduceat(bits[at[use]], begin, axis=0)
            found = to[begin]
            bits &= ~seen[found]
            some = bits.any(axis=1)
            found, bits = found[some], bits[some]
            seen[found] |= bits
            depth += 1


def _told(names: pa.Array, starts: pa.Array, found: np.ndarray, bits: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """The bits of the found aliases as rows."""
    width = 64 * bits.shape[1]
    span = max(1, CELLS // width)
    for k in range(0, len(found), span):
        hits = np.flatnonzero(np.unpackbits(bits[k : k + span].reshape(-1).view(np.uint8), bitorder="little").view(bool))
        row = hits // width
        cols = [starts.take(pa.array(hits - row * width)), names.take(pa.array(found[k : k + span][row])), pa.array(np.full(len(hits), depth, np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["start", "alias", "depth"])


def call_chain(edges: DataFrame, start: str, goal: str, most_steps: int = 1000) -> list[str] | None:
    """A shortest chain of aliases from start to goal (an alias, a full target or a member), or None.

    The reached aliases stay distributed with their predecessors; only the one chain comes to the driver, a row for each step. None means that
    nothing new was reached; ``most_steps`` is a guard that raises.
    """
    links = cut(edges.select("src", "dst", target_base("dst").alias("base")).where("src is not null and dst is not null").distinct())
    spark = edges.sparkSession
    known = spark.createDataFrame([(start, None, 0)], "alias string, before string, depth int")
    frontier = known
    hit = (F.col("dst") == goal) | (F.col("base") == goal) | F.col("dst").endswith("." + goal)
    for step in range(1, most_steps + 1):
        reached = frontier.select(F.col("alias").alias("src")).join(links, "src")
        end = reached.where(hit).orderBy("src", "dst").select("src", "dst").first()
        if end:
            chain, at = [end["dst"]], end["src"]
            while at is not None:
                chain.append(at)
                at = known.where(F.col("alias") == at).orderBy("depth").first()["before"]
            return chain[::-1]
        new = reached.groupBy(F.col("base").alias("alias")).agg(F.min("src").alias("before")).join(known.select("alias"), "alias", "left_anti").withColumn("depth", F.lit(step))
        new = cut(new)
        if new.isEmpty():
            return None
        known, frontier = cut(known.unionByName(new)), new
    raise RuntimeError(f"the search goes on after {most_steps} steps")


def skeleton(nodes: DataFrame) -> DataFrame:
    """One row for each file: its classes with methods, its exported functions, and counts; nodes without a path are left out."""
    own = nodes.where("path_rel is not null").select("repo", "path_rel", "kind", "node_name", F.coalesce("exported", F.lit(False)).alias("exported"), F.size(F.coalesce("methods", F.expr("cast(array() as array<string>)"))).alias("n_methods")).distinct()
    is_class, is_open = F.col("kind") == "C", (F.col("kind") == "F") & F.col("exported")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("node_name")))), ",")
    return own.groupBy("repo", "path_rel").agg(
        names(is_class).alias("classes"), names(is_open).alias("exported_functions"), F.count_if(is_class).alias("n_classes"),
        F.count_if(F.col("kind") == "F").alias("n_functions"), F.coalesce(F.sum(F.when(is_class, F.col("n_methods"))), F.lit(0)).alias("n_methods"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per repo: nodes, edges, orphans, duplicated method names."""
    n = nodes.groupBy("repo").agg(F.count_distinct("alias").alias("n_nodes"))
    e = edges.groupBy("repo").agg(F.count("*").alias("n_edges"))
    o = orphans(nodes, edges).groupBy("repo").agg(F.count_distinct("alias").alias("n_orphans"))
    d = duplicate_methods(nodes).groupBy("repo").agg(F.count("*").alias("n_duplicates"))
    zero = F.lit(0)
    return n.join(e, "repo", "full").join(o, "repo", "left").join(d, "repo", "left").select("repo", *[F.coalesce(c, zero).alias(c) for c in ("n_nodes", "n_edges", "n_orphans", "n_duplicates")])


def focus_zone(nodes: DataFrame, recent_files: DataFrame) -> DataFrame:
    """(repo, alias, node_name, expanded): classes of recently changed files(repo, path_rel) in full, the other classes to expand on demand."""
    own = nodes.where("kind = 'C'").select("repo", "alias", "node_name", "path_rel").distinct()
    recent = recent_files.select("repo", "path_rel", F.lit(True).alias("r")).distinct()
    return own.join(recent, ["repo", "path_rel"], "left").groupBy("repo", "alias", "node_name").agg(F.coalesce(F.bool_or("r"), F.lit(False)).alias("expanded"))


def symbol_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every symbol in full: (repo, symbol, full_name, type, path_rel, line_no, extends_name, exported, methods, properties, calls). Lists are sorted, empty where there is nothing."""
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))), ",")
    calls = edges.where(F.col("op") == CALL).groupBy("repo", F.col("src").alias("alias")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("calls"))
    kind = F.when(F.col("kind") == "C", "class").when(F.col("kind") == "F", "function").otherwise(F.col("kind"))
    own = nodes.select("repo", "alias", "node_name", kind.alias("type"), "path_rel", "line_no", "extends_name", F.coalesce("exported", F.lit(False)).alias("exported"), listed(F.col("methods")).alias("methods"), listed(F.col("props")).alias("properties")).distinct()
    return own.join(calls, ["repo", "alias"], "left").select("repo", F.col("alias").alias("symbol"), F.col("node_name").alias("full_name"), "type", "path_rel", "line_no", "extends_name", "exported", "methods", "properties", F.coalesce("calls", F.lit("")).alias("calls"))


def expand_symbol(nodes: DataFrame, edges: DataFrame, files: DataFrame, repo: str, symbol: str, names: DataFrame | None = None) -> DataFrame:
    """One symbol in full, or of Alias.member the source of the method: ``symbol_details`` with ``code``.

    files(repo, path_rel, raw); names(name, alias), if given, says what a member's alias stands for. An unknown symbol gives no row. The code is the method with
    the documentation block before it, up to the brace that closes its body; it is empty if the file does not have it.
    """
    alias, _, member = symbol.partition(".")
    own = symbol_details(nodes.where((F.col("repo") == repo) & (F.col("alias") == alias)), edges.where(F.col("repo") == repo))
    if not member:
        return own.withColumn("code", F.lit(None).cast("string"))
    known = names.where(F.col("alias") == member).select("name").first() if names is not None else None
    method = known["name"] if known else member
    classes = own.where("type = 'class'")
    texts = files.where(F.col("repo") == repo).select("path_rel", "raw").join(F.broadcast(classes.select("path_rel").distinct()), "path_rel")
    cut_out = F.pandas_udf(lambda t: t.map(lambda x: method_source(x or "", method)), "string")
    return classes.join(texts.select("path_rel", cut_out("raw").alias("code")), "path_rel", "left").withColumn("full_name", F.concat("full_name", F.lit("." + method)))


def method_source(text: str, name: str) -> str:
    """The source of the first method of that name, with the documentation block before it; empty if there is none."""
    head = re.search(rf"((?:/\*\*(?:(?!\*/)[\s\S])*\*/\s*)?)(?:async\s+)?\b{re.escape(name)}\s*\([^)]*\)\s*\{{", text)
    if not head:
        return ""
    depth, at = 0, head.end() - 1
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return text[head.start() : m.end()]
    return text[head.start() :]


def present_keys(nodes: DataFrame) -> DataFrame:
    """(repo, alias, node_name, keys): which parts of a node go into its short form; empty ones are dropped."""
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    parts = [("t", F.col("kind").isNotNull()), ("x", F.col("extends_name").isNotNull()), ("m", has(F.col("methods"))), ("$", has(F.col("props"))), ("e", F.col("exported").isNotNull()), ("f", F.col("path_rel").isNotNull()), ("l", F.col("line_no").isNotNull())]
    return nodes.select("repo", "alias", "node_name", F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in parts]).alias("keys")).distinct()


def cache_valid(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(repo, valid): whether a graph that was built from cached(repo, path_rel, mtime) still fits files(repo, path_rel, mtime): the same paths, and the
    same time for each. Two null times are the same; a repo of only one side is not valid."""
    a = files.select("repo", "path_rel", "mtime", F.lit(True).alias("a")).distinct()
    b = cached.select("repo", "path_rel", F.col("mtime").alias("old"), F.lit(True).alias("b")).distinct()
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("mtime").eqNullSafe(F.col("old"))
    return a.join(b, ["repo", "path_rel"], "full").groupBy("repo").agg(F.bool_and(same).alias("valid"))
