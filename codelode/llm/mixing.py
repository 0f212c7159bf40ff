"""Mixing sources to target weights by the cube method.

``plan_mix`` finds the largest total for which every source that has both a target and documents reaches its share within its cap: source
i is used r_i = share_i * total / size_i <= max_repeat_i times. Each of its documents is taken floor(r_i) times in full, and the fraction that
is left, the inclusion probability of one more copy, is decided by balanced sampling: the flight phase moves vectors of probabilities
through the null-space of the balancing constraints (number of documents, tokens) until a probability is 0 or 1. Blocks of bounded size fly
independently of each other, which leaves at most two undecided documents each (one for each constraint); these are put together into new blocks and fly again, until one
block for each source is left, whose last undecided documents (at most two) land.
"""

from __future__ import annotations

import importlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import cut
from codelode.sources.tables import current

#: targets are a table of shares that go to every task and to the plan
MOST_TARGETS = 100_000
UNITS = "source string, doc_id long, tokens long, p double"


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary file is: the installed package of vocabulary files, else its usual folder."""
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(source, doc_id, tokens, version) of documents(doc_id, source, text, version): byte-level BPE tokens of the whole text; null texts have none."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        coder = tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"source": pdf["source"], "doc_id": pdf["doc_id"], "tokens": [len(coder.encode_ordinary(t)) if t else 0 for t in pdf["text"]], "version": pdf["version"]})

    return documents.select("source", "doc_id", "text", "version").where("doc_id is not null").mapInPandas(count, "source string, doc_id long, tokens long, version timestamp")


def source_key(c):
    """One spelling of a source's name: without outer blanks and case."""
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def wanted_sources(targets: DataFrame) -> DataFrame:
    """(source) of the targets, to be broadcast: more than ``MOST_TARGETS`` are refused."""
    names = targets.select(source_key(F.col("source_name")).alias("source")).where("source is not null and source <> ''").distinct()
    n = names.count()
    if n > MOST_TARGETS:
        raise ValueError(f"{n} targets; at most {MOST_TARGETS} can go to every task")
    return F.broadcast(names)


def plan_mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, list[dict]]:
    """(sized documents, plan): for each source its size, target, times to be used and what limits it.

    Shares are those of the sources that have documents, scaled to sum to one; sources without a target are not used. With ``total_tokens`` a
    source whose cap does not allow its share is used as often as allowed, and the shares reached say so. The plan has a row for each target: bounded by
    the table of targets.
    """
    sizes = {r["source"]: (r["n"], r["size"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("size")).join(
        wanted_sources(targets), "source", "left_semi").collect()}
    wanted = {}
    for r in targets.select(source_key(F.col("source_name")).alias("source"), "target_share", "max_repeat").where("source_name is not null").orderBy("source").collect():
        wanted.setdefault(r["source"], (float(r["target_share"] or 0.0), max(0, int(r["max_repeat"] or 0))))
    usable = {s: w for s, w in wanted.items() if w[0] > 0 and w[1] > 0 and sizes.get(s, (0, 0))[1]}
    scale = sum(w[0] for w in usable.values())
    largest = min((w[1] * sizes[s][1] / (w[0] / scale) for s, w in usable.items()), default=0.0)
    total = largest if total_tokens is None else float(total_tokens)
    plan = []
    for s, (share, cap) in sorted(wanted.items()):
        n, size = sizes.get(s, (0, 0))
        times = min(cap, share / scale * total / size) if s in usable else 0.0
        plan.append({"source": s, "target_share": share, "scaled_share": share / scale if s in usable else 0.0, "max_repeat": cap, "n_docs": n, "tokens": size or 0, "times": times})
    return sized, plan


def fly(p: list[float], x: list[tuple[float, float]], rng: random.Random, eps: float = 1e-9) -> tuple[list[float], list[int]]:
    """Flight phase for probabilities p balanced on two variables: the probabilities afterwards and who is undecided (at most two).

    Three undecided units are held at a time: two constraints on three units leave a null-space of one dimension, along which a step to either
    side is chosen so that expectations stay.
    """
    p = list(p)
    held: list[int] = []
    for k in range(len(p)):
        if p[k] <= eps or p[k] >= 1 - eps:
            p[k] = round(p[k])
            continue
        held.append(k)
        while len(held) == 3:
            (a1, b1), (a2, b2), (a3, b3) = (x[h] for h in held)
            u = (a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1)
            size = max(map(abs, u))
            if size < 1e-12:  # the three are alike: any move that keeps the number
                u, size = (1.0, -1.0, 0.0), 1.0
            up = down = float("inf")
            for h, v in zip(held, u, strict=True):
                v /= size
                if v > 1e-15:
                    up, down = min(up, (1 - p[h]) / v), min(down, p[h] / v)
                elif v < -1e-15:
                    up, down = min(up, -p[h] / v), min(down, (p[h] - 1) / v)
            step = up if rng.random() * (up + down) < down else -down
            for h, v in zip(held, u, strict=True):
                p[h] += step * v / size
            keep = []
            for h in held:
                if p[h] <= eps or p[h] >= 1 - eps:
                    p[h] = float(round(p[h]))
                else:
                    keep.append(h)
            held = keep
    return p, held


def land(p: list[float], size: list[float], held: list[int]) -> None:
    """Decides the last units: of all ways the one whose number and size come nearest to what is expected."""
    if not held:
        return
    want_n, want = sum(p[h] for h in held), sum(p[h] * size[h] for h in held)
    mean = max(1.0, sum(size[h] for h in held) / len(held))
    best = min(range(1 << len(held)), key=lambda m: (abs(sum(size[h] for k, h in enumerate(held) if m >> k & 1) - want) / mean + 0.1 * abs(bin(m).count("1") - want_n), m))
    for k, h in enumerate(held):
        p[h] = float(best >> k & 1)


def decide(units: DataFrame, block: int = 4000, seed: int = 11) -> DataFrame:
    """UNITS with p 0 or 1, from units whose p lies between, balanced for each source. Each round leaves a two-thousandth of the units."""

    def flight(last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", kind="stable")
            size = [float(t) for t in pdf["tokens"]]
            mean = max(1.0, sum(size) / max(1, len(size)))
            rng = random.Random(f"{seed}/{key[0]}/{key[1]}/{len(size)}")
            p, held = fly(list(pdf["p"]), [(1.0, s / mean) for s in size], rng)
            if last:
                land(p, size, held)
            return pd.DataFrame({"source": pdf["source"], "doc_id": pdf["doc_id"], "tokens": pdf["tokens"], "p": p})

        return run

    done = None
    left = cut(units.select("source", "doc_id", "tokens", "p"))
    while True:
        largest = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        last = largest <= block
        blocks = max(1, -(-largest // block))
        numbered = left.withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)) if not last else F.lit(0).cast("long"))
        flown = cut(numbered.groupBy("source", "b").applyInPandas(flight(last), UNITS))
        if last:
            return flown if done is None else done.unionByName(flown)
        sure = flown.where("p = 0 or p = 1")
        done = sure if done is None else done.unionByName(sure)
        left, seed = flown.where("p > 0 and p < 1"), seed + 1


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str | None = None, block: int = 4000) -> tuple[DataFrame, list[dict]]:
    """(source, doc_id, tokens, copies) of all documents that are used, and the plan.

    documents(doc_id, source, text, version): of repeated ids the last version counts, with its source; null and blank sources have no target and are not used; texts without tokens are not used, they
    would change no share. Tokens are counted where the texts are read: only (source, id, tokens, version) are moved. Without targets or documents the mixture is empty.
    """
    spark = documents.sparkSession
    named = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text", "version")
    sized = count_tokens(named.join(wanted_sources(targets), "source", "left_semi"), path)
    sized = current(sized, documents, "doc_id", "version").where("tokens > 0")
    sized = cut(sized.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("r")).select("r.source", "doc_id", "r.tokens"))
    _, plan = plan_mix(sized, targets, total_tokens)
    used = [(r["source"], float(r["times"])) for r in plan if r["times"] > 0]
    if not used:
        return spark.createDataFrame([], "source string, doc_id long, tokens long, copies int"), plan
    times = spark.createDataFrame(used, "source string, times double")
    chosen = sized.join(F.broadcast(times), "source").withColumn("whole", F.floor(F.col("times") + 1e-9).cast("int")).withColumn("p", F.greatest(F.col("times") - F.col("whole"), F.lit(0.0)))
    decided = decide(chosen.where("p > 1e-9"), block).select("doc_id", F.col("p").cast("int").alias("extra"))
    out = chosen.join(decided, "doc_id", "left").select("source", "doc_id", "tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))
    return out.where("copies > 0"), plan


def report(mixture: DataFrame, plan: list[dict]) -> DataFrame:
    """The shares really reached, a row for each target."""
    spark = mixture.sparkSession
    rows = [(r["source"], r["target_share"], r["scaled_share"], r["max_repeat"], r["n_docs"], r["tokens"], float(round(r["times"], 6))) for r in plan]
    planned = spark.createDataFrame(rows, "source string, target_share double, scaled_share double, max_repeat int, n_docs long, source_tokens long, times double")
    got = mixture.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mix_tokens").alias("total"))
    zero = F.lit(0)
    return (
        planned.join(got, "source", "left").join(F.broadcast(total))
        .select(*planned.columns, F.coalesce("copies", zero).alias("copies"), F.coalesce("mix_tokens", zero).alias("mix_tokens"), F.coalesce("most_copies", zero).alias("most_copies"),
                F.coalesce(F.col("mix_tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"))
    )
