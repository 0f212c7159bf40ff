"""Similar functions: pairs of classes of equal shape, compared in blocks by arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: pairs of classes that are scored at once
CELLS = 1 << 21


class Side:
    """The classes of a block: numbers for what they have, and their members as offsets into sorted places."""

    def __init__(self, classes: pa.StructArray):
        f = lambda name: classes.field(name)
        self.n, self.told = len(classes), f("told")
        self.rep = f("rep").to_numpy(zero_copy_only=False)
        self.n_params = np.diff(f("params").offsets.to_numpy())
        self.is_async = f("is_async").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) + 2 * f("is_async").is_null().to_numpy(zero_copy_only=False)
        self.structure = f("structure")
        members = f("members")
        self.starts = members.offsets.to_numpy().astype(np.int64) - members.offsets[0].as_py()
        flat = members.flatten()
        self.size = np.diff(self.starts)
        self.owner = np.repeat(np.arange(self.n), self.size)
        self.place, self.same = flat.field("at").to_numpy(zero_copy_only=False), flat.field("same").to_numpy(zero_copy_only=False)
        self.lists = {c: (np.repeat(np.arange(self.n), np.diff(f(c).offsets.to_numpy())), f(c).flatten()) for c in ("params", "calls")}

    def members_before(self, cls: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many members of each class come before a place."""
        most = int(max(self.place.max(initial=0), place.max(initial=0))) + 1
        keys = self.owner * most + self.place
        return np.searchsorted(keys, cls * most + place) - self.starts[cls]


def numbered(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Both as numbers of one list of distinct values."""
    codes = pa.concat_arrays([a, b]).dictionary_encode()
    k = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return k[: len(a)], k[len(a) :], codes.dictionary


def share(most: int, c: np.ndarray, longest: np.ndarray) -> np.ndarray:
    return np.floor(most * c / longest + 0.5).astype(np.int16)


class Shared:
    """For lists of two sides how many entries of the one are in the other, for rows of the left side."""

    def __init__(self, a: Side, b: Side, column: str):
        (ra, va), (rb, vb) = a.lists[column], b.lists[column]
        ka, kb, values = numbered(va, vb)
        self.la, self.lb, self.n_b = np.bincount(ra, minlength=a.n), np.bincount(rb, minlength=b.n), b.n
        n = len(values) + 1
        # distinct (value, class) with how often it is there, in order of the value or of the class
        ea, self.times_a = np.unique(ra * n + ka, return_counts=True)
        eb, times_b = np.unique(kb * max(b.n, 1) + rb, return_counts=True)
        self.row, self.value = ea // n, ea % n
        self.first = np.searchsorted(eb // max(b.n, 1), np.arange(n + 1))
        self.col, self.times_b = eb % max(b.n, 1), times_b
        self.repeated = bool((self.times_a > 1).any() or (times_b > 1).any())

    def add(self, low: int, high: int, most: int, scores: np.ndarray, backs: np.ndarray) -> None:
        """Adds to scores and backs of the rows from low to high, flat arrays, their shares."""
        i, j = np.searchsorted(self.row, [low, high])
        n = self.first[self.value[i:j] + 1] - self.first[self.value[i:j]]
        if not n.sum():
            return
        at = np.repeat(self.first[self.value[i:j]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        cell = np.repeat(self.row[i:j] - low, n) * self.n_b + self.col[at]
        for out, times in ((scores, np.repeat(self.times_a[i:j], n)), (backs, self.times_b[at])):
            if out is scores or self.repeated:
                c = np.bincount(cell, weights=times, minlength=len(scores))
                hit = np.flatnonzero(c)
                add = share(most, c[hit], np.maximum(self.la[low + hit // self.n_b], self.lb[hit % self.n_b]))
            out[hit] += add


def base_scores(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kinds of a, kinds of b, score by kinds, back score by kinds): what parameter counts, async flags and control flow give; -1000 for pairs that are not compared."""
    sa, sb, texts = numbered(a.structure, b.structure)
    texts = texts.to_pylist()
    tokens = [[t for t in x.split("|") if t] for x in texts]
    kind = lambda s, side: np.unique(np.stack([s, side.n_params, side.is_async], 1), axis=0, return_inverse=True)
    (ua, ka), (ub, kb) = kind(sa, a), kind(sb, b)
    used_a, used_b = np.unique(ua[:, 0]), np.unique(ub[:, 0])
    words = {t: k for k, t in enumerate(dict.fromkeys(t for x in tokens for t in x))}
    bags = np.zeros((len(texts), len(words)))
    for k, x in enumerate(tokens):
        for t in x:
            bags[k, words[t]] += 1
    n, has = bags.sum(1), (bags > 0).astype(float)
    longest = np.maximum(np.maximum.outer(n[used_a], n[used_b]), 1)
    short = np.array([len(x) < 3 for x in texts], bool)
    skipped = np.logical_and.outer(short[used_a], short[used_b])
    equal = np.equal.outer(used_a, used_b) & np.array([x != "" for x in texts], bool)[used_a][:, None]
    out = []
    for common in (bags[used_a] @ has[used_b].T, has[used_a] @ bags[used_b].T):
        flow = np.where(skipped, -1000, np.where(equal, 25, share(25, common, longest))).astype(np.int16)
        flow = flow[np.searchsorted(used_a, ua[:, 0])][:, np.searchsorted(used_b, ub[:, 0])]
        # of unknown flags none equals another
        alike = np.equal.outer(ua[:, 2], ub[:, 2]) & (ua[:, 2] < 2)[:, None]
        out.append(flow + 30 * np.equal.outer(ua[:, 1], ub[:, 1]).astype(np.int16) + 10 * alike.astype(np.int16))
    return ka.reshape(-1), kb.reshape(-1), out[0], out[1]


def same_pairs(a: Side, b: Side, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """(twice the cell, and one more if the function of a comes first; their number) for pairs of functions of the same name and path."""
    order = np.argsort(b.same, kind="stable")
    low, high = np.searchsorted(b.same[order], a.same, "left"), np.searchsorted(b.same[order], a.same, "right")
    n = high - low
    x = np.repeat(np.arange(len(n)), n)
    y = order[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(n) else x
    i, j, first = a.owner[x], b.owner[y], a.place[x] < b.place[y]
    # a class beside itself has each pair once
    keep = (a.place[x] != b.place[y]) & ((i != j) | first if own else True)
    key, count = np.unique((i * b.n + j)[keep] * 2 + first[keep], return_counts=True)
    return key, count


def compare(a: Side, b: Side, own: bool, threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(class of a, class of b, score, back score, number of pairs) of all pairs of classes with pairs of functions that reach the threshold."""
    if not a.n or not b.n:
        return
    ka, kb, forth, back = base_scores(a, b)
    shared = [(20, Shared(a, b, "params")), (15, Shared(a, b, "calls"))]
    one_way = not any(s.repeated for _, s in shared) and bool((forth == back).all())
    key, count = same_pairs(a, b, own)

    def same(cell: np.ndarray, first: int) -> np.ndarray:
        if not len(key):
            return np.zeros(len(cell), np.int64)
        k = np.minimum(np.searchsorted(key, cell * 2 + first), len(key) - 1)
        return np.where(key[k] == cell * 2 + first, count[k], 0)

    step = max(1, CELLS // b.n)
    for low in range(0, a.n, step):
        high = min(low + step, a.n)
        scores = forth[ka[low:high]][:, kb].reshape(-1)
        backs = back[ka[low:high]][:, kb].reshape(-1)
        for most, s in shared:
            s.add(low, high, most, scores, backs)
        hit = np.flatnonzero(scores >= threshold if one_way else (scores >= threshold) | (backs >= threshold))
        i, j = hit // b.n + low, hit % b.n
        if own:
            once = (a.rep[i] < b.rep[j]) | ((i == j) & (a.size[i] > 1))
            hit, i, j = hit[once], i[once], j[once]
        score, rear = scores[hit], backs[hit]
        cell = i * b.n + j
        self = (i == j) & own
        every = np.where(self, a.size[i] * (a.size[i] - 1) // 2, a.size[i] * b.size[j])
        n = every - same(cell, 0) - same(cell, 1)
        apart = np.flatnonzero((score >= threshold) != (rear >= threshold))
        if len(apart):
            # only pairs in the order that reaches the threshold
            p, q, forward = i[apart], j[apart], score[apart] >= threshold
            times = a.size[p]
            x = np.repeat(a.starts[p] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            before = b.members_before(np.repeat(q, times), a.place[x])
            later = np.add.reduceat(np.repeat(b.size[q], times) - before, np.r_[0, np.cumsum(times)[:-1]])
            c = cell[apart]
            n[apart] = np.where(forward, later - same(c, 1), every[apart] - later - same(c, 0))
        some = n > 0
        yield i[some], j[some], score[some], rear[some], n[some]


def blocks(own: DataFrame, keys: list[str], most_in_block: int) -> DataFrame:
    """(repo, p, q, a, b) for each pair of blocks p <= q of the classes of a repo; b is empty where it is a block beside itself."""
    w = Window.partitionBy("repo")
    own = own.withColumn("at", F.row_number().over(w.orderBy("ord")).cast("long")).withColumn("same", F.min("at").over(Window.partitionBy("repo", "name", "path")))
    classes = own.groupBy("repo", *keys).agg(F.min("at").alias("first"), F.min_by("told", "at").alias("told"), F.array_sort(F.collect_list(F.struct("at", "same"))).alias("members"))
    n = classes.groupBy("repo").agg(F.count("*").alias("n"))
    # large repos go to at least a few tasks
    n_blocks = F.greatest(F.ceil(F.col("n") / most_in_block), F.least(F.ceil(F.col("n") / 1000), F.lit(6))).cast("int")
    row = classes.join(n.select("repo", n_blocks.alias("n_blocks")), "repo").withColumn("block", F.pmod(F.xxhash64("first"), F.col("n_blocks")).cast("int"))
    row = row.groupBy("repo", "n_blocks", "block").agg(F.collect_list(F.struct(F.col("first").alias("rep"), "told", *keys, "members")).alias("c"))
    one = row.select("repo", F.col("block").alias("p"), F.col("block").alias("q"), F.lit(True).alias("left"), "c")
    left = row.where("block < n_blocks - 1").select("repo", F.col("block").alias("p"), F.explode(F.sequence(F.col("block") + 1, F.col("n_blocks") - 1)).alias("q"), F.lit(True).alias("left"), "c")
    right = row.where("block > 0").select("repo", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("p"), F.col("block").alias("q"), F.lit(False).alias("left"), "c")
    # a number that is given keeps few and narrow blocks, which are long work, apart
    parts = 12 * own.sparkSession.sparkContext.defaultParallelism
    sides = one.unionByName(left).unionByName(right).repartition(parts, "repo", "p", "q")
    return sides.groupBy("repo", "p", "q").agg(F.flatten(F.collect_list(F.when(F.col("left"), F.col("c")))).alias("a"), F.flatten(F.collect_list(F.when(~F.col("left"), F.col("c")))).alias("b"))


def similar_links(own: DataFrame, keys: list[str], threshold: int, most_in_block: int) -> DataFrame:
    """(repo, a_rep, b_rep, score, back_score, n_links) of functions(repo, ord, told, name, path, keys); a_rep and b_rep are what the first function of a class has as ``told``."""
    told = own.schema["told"].dataType
    schema = T.StructType([T.StructField("repo", T.StringType()), T.StructField("a_rep", told), T.StructField("b_rep", told), T.StructField("score", T.IntegerType()), T.StructField("back_score", T.IntegerType()), T.StructField("n_links", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for repo, a, b, own_block in pairs_of_blocks(batches):
            for i, j, score, back, n in compare(a, b, own_block, threshold):
                turned = a.rep[i] > b.rep[j]
                both = pa.concat_arrays([a.told, b.told])
                x, y = np.where(turned, j + a.n, i), np.where(turned, i, j + a.n)
                for k in range(0, len(i), 100_000):
                    s = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(repo, pa.string()), len(x[s])), both.take(pa.array(x[s])), both.take(pa.array(y[s])), pa.array(np.where(turned, back, score)[s].astype(np.int32)), pa.array(np.where(turned, score, back)[s].astype(np.int32)), pa.array(n[s])],
                        names=schema.names)

    return blocks(own, keys, most_in_block).mapInArrow(run, schema)


def similar_totals(own: DataFrame, keys: list[str], threshold: int, most_in_block: int) -> DataFrame:
    """(repo, similar): the sum of n_links of each repo; no link leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for repo, a, b, own_block in pairs_of_blocks(batches):
            n = sum(int(x[4].sum()) for x in compare(a, b, own_block, threshold))
            yield pa.RecordBatch.from_arrays([pa.array([repo], pa.string()), pa.array([n], pa.int64())], names=["repo", "n"])

    return blocks(own, keys, most_in_block).mapInArrow(run, "repo string, n long").groupBy("repo").agg(F.sum("n").alias("similar")).where("similar > 0")


def pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Side, Side, bool]]:
    for batch in batches:
        for k in range(batch.num_rows):
            side = lambda c: Side(pa.concat_arrays([batch.column(c).slice(k, 1).flatten()]))  # noqa: E731, B023
            own = batch.column("p")[k].as_py() == batch.column("q")[k].as_py()
            a = side("a")
            yield batch.column("repo")[k].as_py(), a, a if own else side("b"), own
