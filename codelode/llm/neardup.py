"""Near-duplicate records: banded min-hashing for candidates, sequential Bayesian verification, exact verification of the survivors.

1. ``sketch``: each record's set of elements becomes a signature of min-hashes, of which bands of ``rows`` hashes are the candidate keys; the number
   of bands follows from the threshold and the admitted probability to miss a pair at the threshold.
2. Records with equal sets form a class; one representative of each goes on.
3. ``candidates``: representatives that share a band. Only keys seen at least twice go on; the members of a key that is seen very often are
   spread over blocks, and pairs of blocks over tasks, so that no task holds an unbounded group and none is cut off.
4. ``survivors``: signatures are compared in batches of ``batch`` hashes; after each a pair is dropped when the posterior probability that its similarity
   reaches the threshold, given the matches so far and a uniform prior, is below ``miss``.
5. ``verify``: the similarity of the sets themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators.skew import hot_keys
from codelode.session import cut

WORD = re.compile(r"[A-Za-z0-9_]+")
SKETCH = "id long, n int, fp1 long, fp2 long, bands array<int>, sig binary, version timestamp"
MIX = np.uint64(0xFF51AFD7ED558CCD)


class Plan:
    """The numbers of a run; ``sizes`` (elements) below ``least`` are not compared."""

    def __init__(self, threshold: float, least: int, rows: int = 4, miss: float = 1e-4, batch: int = 16, seed: int = 7):
        self.threshold, self.least, self.rows, self.miss, self.batch = threshold, least, rows, miss, batch
        self.bands = max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))
        self.hashes = self.bands * rows
        r = np.random.RandomState(seed)
        self.a = r.randint(0, 1 << 31, self.hashes).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = r.randint(0, 1 << 31, self.hashes).astype(np.uint32) * np.uint32(2) + r.randint(0, 2, self.hashes).astype(np.uint32)

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, matches below which a pair is dropped). Signatures keep 8 bits, so unlike hashes agree once in 256."""
        t = self.threshold + (1 - self.threshold) / 256
        out = []
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            # with a uniform prior, P(similarity >= t | m of n match) is the chance of at most m hits in n + 1 trials of chance t
            below, m = 0.0, 0
            while True:
                below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
                if below >= self.miss or m >= n:
                    break
                m += 1
            out.append((n, m))
        return out


_known: dict[str, int] = {}


def word_shingles(text: str, size: int, least_words: int) -> np.ndarray | None:
    """Hashes of the distinct runs of ``size`` consecutive words; None if there are fewer words than asked for."""
    words = WORD.findall(text)
    if len(words) < max(least_words, size):
        return None
    if len(_known) > 1_000_000:
        _known.clear()
    try:
        codes = [_known[w] for w in words]
    except KeyError:
        for w in set(words):
            if w not in _known:
                _known[w] = xxhash.xxh64_intdigest(w)
        codes = [_known[w] for w in words]
    c = np.array(codes, dtype=np.uint64)
    n = len(c) - size + 1
    with np.errstate(over="ignore"):
        h = c[:n].copy()
        for k in range(1, size):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += c[k : k + n]
        h ^= h >> np.uint64(33)
        h *= MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signatures(sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """Min-hashes, a row for each set; none of the sets is empty."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), plan.hashes), dtype=np.uint32)
    v = np.empty_like(x)
    with np.errstate(over="ignore"):
        for k in range(plan.hashes):
            np.multiply(x, plan.a[k], out=v)
            np.add(v, plan.b[k], out=v)
            out[:, k] = np.minimum.reduceat(v, starts)
    return out


def _sketches(pdf: pd.DataFrame, sets: list[np.ndarray | None], plan: Plan) -> Iterator[pd.DataFrame]:
    chosen = [k for k, s in enumerate(sets) if s is not None and len(s)]
    at = 0
    while at < len(chosen):
        part, total = [], 0
        while at < len(chosen) and (not part or total < 200_000):
            part.append(chosen[at])
            total += len(sets[chosen[at]])
            at += 1
        own = [sets[k] for k in part]
        sig = signatures(own, plan)
        with np.errstate(over="ignore"):
            key = np.zeros((len(part), plan.bands), dtype=np.uint64)
            for r in range(plan.rows):
                key = (key ^ sig[:, r :: plan.rows].astype(np.uint64)) * MIX
                key ^= key >> np.uint64(31)
            small = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            fp1 = [int(np.bitwise_xor.reduce(s)) for s in own]
            fp2 = [int(np.add.reduce(s * MIX)) for s in own]
        sign = lambda v: v - (1 << 64) if v >= 1 << 63 else v
        yield pd.DataFrame({
            "id": pdf["id"].to_numpy()[part], "n": [len(s) for s in own], "fp1": [sign(v) for v in fp1], "fp2": [sign(v) for v in fp2],
            "bands": list((key >> np.uint64(32)).astype(np.uint32).view(np.int32)), "sig": [r.tobytes() for r in small], "version": pdf["version"].to_numpy()[part],
        })


def sketch_texts(texts: DataFrame, plan: Plan, size: int = 5, least_words: int = 0) -> DataFrame:
    """Sketches of texts(id, text, version): sets of ``size`` consecutive words. Shorter and null texts get none."""

    def run(batches):
        for pdf in batches:
            sets = [word_shingles(t, size, least_words) for t in pdf["text"]]
            yield from _sketches(pdf, [s if s is not None and len(s) >= plan.least else None for s in sets], plan)

    return texts.select("id", "text", "version").where("id is not null and text is not null").mapInPandas(run, SKETCH)


def sketch_sets(sets: DataFrame, plan: Plan) -> DataFrame:
    """Sketches of sets(id, elements array<long>, version); elements are hashes, repeats and nulls count for nothing."""

    def run(batches):
        for pdf in batches:
            own = [np.unique(np.asarray(e, dtype=np.int64).view(np.uint64)) for e in pdf["elements"]]
            yield from _sketches(pdf, [s if len(s) >= plan.least else None for s in own], plan)

    good = F.filter("elements", lambda e: e.isNotNull())
    return sets.where("id is not null and elements is not null").select("id", good.alias("elements"), "version").mapInPandas(run, SKETCH)


def classes(sketches: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives(id, version), members(rep, id)) of the last version of each record.

    records(id, version) has all rows, also those without a sketch: a record whose last version is too short is no member. Only the narrow columns are moved.
    """
    narrow = sketches.select("id", _version(), "n", "fp1", "fp2")
    last = records.where("id is not null").groupBy("id").agg(F.max(_version()).alias("version"))
    one = narrow.join(last, ["id", "version"]).distinct()
    reps = one.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("id", "version")).alias("r"))
    members = cut(one.join(reps, ["fp1", "fp2", "n"]).select(F.col("r.id").alias("rep"), "id", "version"))
    return members.where("rep = id").select("id", "version"), members.select("rep", "id")


def _version():
    return F.coalesce("version", F.lit("0001-01-01").cast("timestamp")).alias("version")


def pairs_within(members: DataFrame, keys: list[str], block_rows: int = 2000) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of members that share the keys.

    Keys with more members than ``block_rows`` and a thousandth of all are known before anything is moved (``hot_keys``): their members go to blocks, and
    pairs of blocks to tasks, so none of their groups ever stands in one partition. The other keys meet in their partition, those with more than
    ``block_rows`` members in pairs of blocks, too. No pair is left out.
    """
    rows = members.select(*keys, "id")
    hot = hot_keys(rows, keys, block_rows)
    cold = rows if hot is None else rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    cold = cold.repartition(*keys)
    many = cold.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").withColumn("blocks", F.ceil(F.col("c") / block_rows).cast("int"))
    out = _block_pairs(cold.join(many.drop("c"), keys), keys)
    if hot is None:
        return out
    return out.unionByName(_block_pairs(rows.join(F.broadcast(hot.select(*keys, F.ceil(F.col("n_rows") / block_rows).cast("int").alias("blocks"))), keys), keys))


def _block_pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of members(keys, id, blocks) with the same keys: each row is sent to all pairs of blocks that its own block is in."""
    own = members.withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = own.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = spread.where("x <= y").select(*keys, F.col("x").alias("i"), F.col("y").alias("j"), F.col("id").alias("p"))
    right = spread.where("y <= x").select(*keys, F.col("y").alias("i"), F.col("x").alias("j"), F.col("id").alias("q"))
    # within one block each pair comes twice, between two blocks once
    both = left.join(right, [*keys, "i", "j"]).where("p <> q and (i <> j or p < q)")
    return both.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def candidates(sketches: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs of representatives that share a band."""
    own = sketches.select("id", _version(), "bands").join(reps, ["id", "version"])
    banded = own.select("id", F.posexplode("bands").alias("band", "key"))
    key = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return pairs_within(banded.select(key.alias("key"), "id"), ["key"]).distinct()


def survivors(pairs: DataFrame, sketches: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """Pairs that the sequential test keeps."""
    table = plan.least_matches()
    ratio = plan.threshold
    own = sketches.select("id", _version(), "n", "sig").join(reps, ["id", "version"]).groupBy("id").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    side = lambda x: own.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    known = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    # the sizes alone bound the similarity
    known = known.where(F.least("n_a", "n_b") >= F.lit(ratio) * F.greatest("n_a", "n_b") - 1e-9)

    def test(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            a = np.frombuffer(b"".join(pdf["sig_a"]), dtype=np.uint8).reshape(len(pdf), -1)
            b = np.frombuffer(b"".join(pdf["sig_b"]), dtype=np.uint8).reshape(len(pdf), -1)
            alive, matches, done = np.arange(len(pdf)), np.zeros(len(pdf), dtype=np.int64), 0
            for n, least in table:
                matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
                keep = matches >= least
                alive, matches, done = alive[keep], matches[keep], n
                if not len(alive):
                    break
            if len(alive):
                yield pdf[["id_a", "id_b"]].iloc[alive]

    return known.select("id_a", "id_b", "sig_a", "sig_b").mapInPandas(test, "id_a long, id_b long")


class IdFilter:
    """A Bloom filter of ids with a fixed number of bits, whatever their number: false positives cost work, nothing else."""

    LOG_WORDS, PROBES = 17, 4

    def __init__(self, ids: DataFrame):
        """Bits are set where the ids are and united before they come to the driver: at most 2 ** LOG_WORDS words of 64 bits, one megabyte."""
        hashes = [F.xxhash64(F.lit(k), "id") for k in range(self.PROBES)]
        places = ids.select(F.explode(F.array(*hashes)).alias("h")).select(F.shiftrightunsigned("h", 64 - self.LOG_WORDS).cast("int").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        words = places.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
        table = np.zeros(1 << self.LOG_WORDS, dtype=np.int64)
        table[[r["word"] for r in words]] = [r["bits"] for r in words]
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def probes(self):
        """The column the Python side is given: the hashes of the id."""
        return F.array(*[F.xxhash64(F.lit(k), "id") for k in range(self.PROBES)])

    def has(self, probes) -> np.ndarray:
        h = np.array(list(probes), dtype=np.int64).reshape(-1, self.PROBES).view(np.uint64)
        word = self.table.value.view(np.uint64)[(h >> np.uint64(64 - self.LOG_WORDS)).astype(np.int64)]
        return ((word >> (h & np.uint64(63))) & np.uint64(1)).all(axis=1)


def verify_texts(pairs: DataFrame, texts: DataFrame, plan: Plan, size: int = 5) -> DataFrame:
    """(id_a, id_b, similarity) of pairs of texts whose similarity reaches the threshold.

    Texts are turned into sets where they are read, and only those that the Bloom filter of the paired ids lets through; no text is ever shuffled. The
    sets of paired ids of the last version are moved to their pairs.
    """
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    known = IdFilter(ids)

    def hashed(batches):
        for pdf in batches:
            pdf = pdf[known.has(pdf["probes"])] if len(pdf) else pdf
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "version": pdf["version"], "s": [b"" if (s := word_shingles(t, size, 0)) is None else s.tobytes() for t in pdf["text"]]})

    sets = texts.where("text is not null and id is not null").select("id", "version", "text", known.probes().alias("probes")).mapInPandas(hashed, "id long, version timestamp, s binary")
    last = texts.where("id is not null").select("id", _version()).groupBy("id").agg(F.max("version").alias("version")).join(ids, "id", "left_semi")
    own = sets.select("id", _version(), "s").join(last, ["id", "version"]).groupBy("id").agg(F.first("s").alias("s"))
    return _exact(pairs, cut(own), plan)


def verify_sets(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    def hashed(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "s": [np.unique(np.asarray(e, dtype=np.int64)).tobytes() for e in pdf["elements"]]})

    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    own = sets.select("id", F.filter("elements", lambda e: e.isNotNull()).alias("elements")).where("elements is not null").join(ids, "id", "left_semi").dropDuplicates(["id"])
    return _exact(pairs, own.mapInPandas(hashed, "id long, s binary"), plan)


def _exact(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    t = plan.threshold

    def similar(batches):
        for pdf in batches:
            js, last, sa = [], None, None
            for ia, a, b in zip(pdf["id_a"], pdf["s_a"], pdf["s_b"], strict=True):
                if ia != last:
                    last, sa = ia, np.frombuffer(a, dtype=np.uint64)
                sb = np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                js.append(both / max(1, len(sa) + len(sb) - both))
            out = pdf[["id_a", "id_b"]].assign(similarity=js)
            yield out[out["similarity"] >= t - 1e-12]

    side = lambda x: sets.select(F.col("id").alias(f"id_{x}"), F.col("s").alias(f"s_{x}"))
    return pairs.join(side("a"), "id_a").join(side("b"), "id_b").mapInPandas(similar, "id_a long, id_b long, similarity double")


def near_duplicates(sketches: DataFrame, records: DataFrame, verify, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives with their similarity, members(rep, id)).

    records(id, version): all rows; of a record the last version counts. ``verify`` is given the surviving pairs. Empty tables give empty results. Links between different sets are all there (but for the admitted
    probability); copies are told by membership.
    """
    kept = cut(sketches)
    reps, members = classes(kept, records)
    kept_pairs = cut(survivors(candidates(kept, reps), kept, reps, plan))
    return verify(kept_pairs), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids: those between classes and those within one."""
    side = lambda x: members.select(F.col("rep").alias(f"r_{x}"), F.col("id").alias(x))
    between = pairs.select(F.col("id_a").alias("r_p"), F.col("id_b").alias("r_q")).join(side("p"), "r_p").join(side("q"), "r_q")
    return between.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).unionByName(pairs_within(members, ["rep"]))


def components(links: DataFrame) -> DataFrame:
    """(id, group) for each id in links(id_a, id_b): the group is its least id. Alternates large-star and small-star until nothing changes.

    Neighbourhoods are only aggregated (minimum), never collected. The number of rounds grows with the logarithm of the links.
    """
    edges = cut(links.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())
