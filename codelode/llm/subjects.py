"""Subject areas of documents, by interpolated n-gram language models.

A subject's model and the background model give each sentence two cross-entropies per token; a sentence treats the subject if the
difference passes the subject's margin, and a document is assigned each subject that enough of its sentences treat.

* Background counts of words and word pairs are taken over all documents (hashed into a fixed number of buckets, so their size is bounded).
* The sentences without a subject have a model of their own, fitted with those of the subjects.
* The subject models are fitted on labelled documents, at most ``most_labelled`` of them, chosen by hash. Labels are noisy and say nothing about
  which sentences they mean, so the sentences of labelled documents are weighted by expectation-maximisation between the document's
  labels, the other subjects at a low prior, and the background.
* The margins are calibrated on labelled documents that a first fit leaves out (one in four): for each subject the one that separates labelled from unlabelled documents best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import cut

UNI, BI = 1 << 17, 1 << 19
SENTENCE_END = re.compile(r"(?<=[.!?])[\s\"'*_)]+|\n\s*(?:[-*+#>]|\d+[.)]|\[)|\n\s*\n|</?\w+[^>\n]{0,80}>|```")
TOKEN = re.compile(r"`[^`\n]*`|[^\W_]+(?:-[^\W\d_]+)*|[:\]\[{}();=#→]")
CAMEL = re.compile(r"[a-zß-ÿ][A-Z]|^[A-Z][a-z]+[A-Z]")
SCORES = "doc_id long, subject string, n_sentences int, gain double, version timestamp"


def repair(text: str) -> str:
    """Undoes UTF-8 that was read as Latin-1, wherever it occurs; the rest stays."""
    if chr(0xC3) not in text and chr(0xC2) not in text and chr(0xE2) not in text:
        return text

    def back(m):
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group()

    return re.sub("[" + chr(0xC2) + "-" + chr(0xF4) + "][" + chr(0x80) + "-" + chr(0xBF) + "]{1,3}", back, text)


class Codes(dict):
    """The code of each token; the table is emptied when it holds many, what a token's code is does not depend on it."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        w = word.lower()
        if word[0] == "`" or CAMEL.search(word):
            w = "<name>"
        elif w[0].isdigit():
            w = "<number>"
        c = self[word] = xxhash.xxh32_intdigest(w)
        return c


_codes = Codes()


def sentences(text: str) -> list[list[int]]:
    """Token codes of each sentence; code names and numbers are one token each, pieces without a word are left out."""
    out = []
    for part in SENTENCE_END.split(repair(text).replace(chr(0xA0), " ")):
        t = [_codes[w] for w in TOKEN.findall(part)]
        if len(t) >= 3:
            out.append(t)
    return out


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and pair buckets of all tokens, where each sentence starts, and the text each sentence is of."""
    words, starts, owner = [], [], []
    first = []
    for k, text in enumerate(texts):
        for s in sentences(text):
            starts.append(len(words))
            owner.append(k)
            words.extend(s)
            first.append(starts[-1])
    w = np.array(words, dtype=np.uint64)
    before = np.zeros_like(w)
    if len(w):
        before[1:] = w[:-1]
        before[np.array(first)] = 1
    with np.errstate(over="ignore"):
        uni = (w * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(47)).astype(np.int64)
        pair = ((w + before * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB) >> np.uint64(45)).astype(np.int64)
        hist = (before * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(47)).astype(np.int64)
    return np.stack([uni, pair, hist]), np.array(starts, dtype=np.int64), np.array(owner, dtype=np.int64), np.diff(np.append(starts, len(words)))


def token_kinds(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct columns of t, which of them each token is): probabilities are worked out once for each."""
    keys, kind = np.unique((t[0] << 36) | (t[1] << 17) | t[2], return_inverse=True)
    return np.stack([keys >> 36, (keys >> 17) & (BI - 1), keys & (UNI - 1)]), kind


class Background:
    """Interpolated word-pair model of the whole corpus, in buckets.

    Pairs get the weight 0.8 n / (n + 4) of a history seen n times; the rest goes to the words.
    """

    def __init__(self, uni: np.ndarray, pair: np.ndarray, hist: np.ndarray):
        self.uni = (uni + 0.05) / (uni.sum() + 0.05 * UNI)
        self.pair, self.hist = pair, hist

    def prob(self, t: np.ndarray) -> np.ndarray:
        n = self.hist[t[2]]
        weight = 0.8 * n / (n + 4.0)
        return weight * self.pair[t[1]] / np.maximum(n, 1) + (1 - weight) * self.uni[t[0]]


def corpus_counts(documents: DataFrame) -> DataFrame:
    """(kind, bucket, n) over all documents(text): kind 0 words, 1 word pairs, 2 histories. At most UNI + BI + UNI rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(UNI, dtype=np.int64), np.zeros(BI, dtype=np.int64), np.zeros(UNI, dtype=np.int64)]
        for pdf in batches:
            t = encode(list(pdf["text"]))[0]
            for k, size in enumerate((UNI, BI, UNI)):
                sums[k] += np.bincount(t[k], minlength=size)
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pd.DataFrame({"kind": np.full(len(at), k, dtype=np.int32), "bucket": at.astype(np.int32), "n": s[at]})

    counted = documents.select("text").where("text is not null").mapInPandas(count, "kind int, bucket int, n long")
    return counted.groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


class SubjectModels:
    """The models of all subjects.

    Word pairs get the weight 0.85 n / (n + rare) of a history seen n times; of the rest the subject's words get the share ``own``, the background
    what is left, so that an everyday word that the few sentences of a subject happen not to have costs a sentence little.
    """

    def __init__(self, subjects: list[str], background: Background, own: float = 0.5, rare: float = 3.0, least_sentences: int = 3):
        self.subjects, self.background, self.own, self.rare = subjects, background, own, rare
        self.margins, self.least_sentences = np.full(len(subjects), 0.05), least_sentences

    def gains(self, t: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kinds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Cross-entropy by the model of sentences without a subject less that by each subject, summed over the tokens: a row for each sentence, a column for each subject."""
        if not len(starts):
            return np.zeros((0, len(self.subjects)))
        t, kind = kinds or token_kinds(t)
        bg = self.background.prob(t)
        out = np.empty((len(starts), len(self.subjects) + 1))
        for s in range(len(self.subjects) + 1):
            n = self.hist[s][t[2]]
            weight = 0.85 * n / (n + self.rare)
            p = weight * self.pair[s][t[1]] / np.maximum(n, 1e-3) + (1 - weight) * (self.own * self.uni[s][t[0]] + (1 - self.own) * bg)
            out[:, s] = np.add.reduceat(np.log(p / bg)[kind], starts)
        # the background is the corpus or its sentences without a subject, whichever fits the sentence less: the corpus holds the subjects, too
        return out[:, :-1] - np.minimum(out[:, -1:], 0.0)

    def estimate(self, kinds: tuple[np.ndarray, np.ndarray], owner: np.ndarray, weight: np.ndarray) -> None:
        """Counts from sentences weighted by subject, and last from what is left: sentences without one. owner: the sentence of each token."""
        t, kind = kinds
        self.uni, self.pair, self.hist = [], [], []
        rest = np.maximum(0.0, 1.0 - weight.sum(axis=1))
        for s in range(len(self.subjects) + 1):
            w = np.bincount(kind, weights=weight[owner, s] if s < len(self.subjects) else rest[owner], minlength=t.shape[1])
            u = np.bincount(t[0], weights=w, minlength=UNI)
            self.uni.append(((u + 1e-4 * self.background.uni) / (u.sum() + 1e-4)).astype(np.float32))
            self.pair.append(np.bincount(t[1], weights=w, minlength=BI).astype(np.float32))
            self.hist.append(np.bincount(t[2], weights=w, minlength=UNI).astype(np.float32))

    def fit(self, texts: list[str], labels: list[set[int]], rounds: int = 8, other: float = 0.02, held_out: int = 4) -> None:
        """Fits the models and calibrates their margins. The margins come from one in ``held_out`` documents, which a first fit leaves out, if there are
        enough labels for that: at least ``held_out`` fitted and held-out documents for every subject; else from the fitted ones. The last fit is on all."""
        held = np.arange(len(texts)) % held_out == held_out - 1
        enough = all(min(sum(s in ls for ls, h in zip(labels, held, strict=True) if h == side) for side in (True, False)) >= held_out for s in range(len(self.subjects)))
        pick = lambda xs, side: [x for x, h in zip(xs, held, strict=True) if h == side]
        if enough:
            self.expect(pick(texts, False), pick(labels, False), rounds, other)
            t, starts, doc, lengths = encode(pick(texts, True))
            gain = self.gains(t, starts, lengths)
            self.calibrate(gain, lengths, self.judged(gain, doc, int(held.sum()))[0], doc, pick(labels, True))
        gain, lengths, weight, doc = self.expect(texts, labels, rounds, other)
        if not enough:
            self.calibrate(gain, lengths, weight, doc, labels)

    def judged(self, gain: np.ndarray, doc: np.ndarray, n_texts: int, generic: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the subjects for each sentence of texts without labels."""
        prior = np.full((n_texts, len(self.subjects)), 1.0 / len(self.subjects))
        weight, theta = gain, prior
        for _ in range(4):
            weight, theta = self.posterior(gain, doc, prior, theta, generic)
        return weight, theta

    def expect(self, texts: list[str], labels: list[set[int]], rounds: int, other: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expectation-maximisation: gains, lengths, weights and texts of the sentences."""
        t, starts, doc, lengths = encode(texts)
        n, owner = len(self.subjects), np.repeat(np.arange(len(starts)), lengths)
        prior = np.full((len(texts), n), other)
        for k, ls in enumerate(labels):
            prior[k, list(ls)] = 1.0
        prior /= prior.sum(axis=1, keepdims=True)
        # to begin with, a subject's words are those its documents have more of than the corpus
        bg = self.background.uni
        weight = np.zeros((len(starts), n))
        for s in range(n):
            inside = (prior[doc, s] > 0.2).astype(float)
            u = np.bincount(t[0], weights=inside[owner], minlength=UNI)
            own = u / max(1.0, u.sum())
            ratio = np.log(np.maximum((own + 1e-6) / (bg + 1e-6), 1.0)) * (u >= 3)
            score = np.maximum.reduceat(ratio[t[0]], starts) if len(starts) else np.zeros(0)
            high = np.percentile(ratio[ratio > 0], 80) if (ratio > 0).any() else 1.0
            weight[:, s] = inside * np.clip(score / high * 2 - 1.2, 0, 1)
        theta, kinds = prior.copy(), token_kinds(t)
        for r in range(rounds):
            self.estimate(kinds, owner, weight)
            gain = self.gains(t, starts, lengths, kinds)
            weight, theta = self.posterior(gain, doc, prior, theta)
        return gain, lengths, weight, doc

    def posterior(self, gain: np.ndarray, doc: np.ndarray, prior: np.ndarray, theta: np.ndarray, generic: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the subjects for each sentence (what is left is background), and the subjects' shares of each document."""
        if not len(gain):
            return gain, theta
        x = np.log((1 - generic) * theta[doc] + 1e-9) + gain
        top = np.maximum(x.max(axis=1), np.log(generic))
        e = np.exp(x - top[:, None])
        w = e / (e.sum(axis=1) + np.exp(np.log(generic) - top))[:, None]
        share = prior * 2.0
        np.add.at(share, doc, w)
        return w, share / share.sum(axis=1, keepdims=True)

    def calibrate(self, gain, lengths, weight, doc, labels) -> None:
        """The margin per token of each subject: where the rates of labelled and unlabelled documents with enough such sentences differ most."""
        per_token = gain / lengths[:, None]
        best = weight.argmax(axis=1)
        for s in range(len(self.subjects)):
            labelled = np.array([s in ls for ls in labels])
            if not labelled.any() or labelled.all():
                continue
            top = np.full(len(labels), -9.0)  # the gain of the last sentence that is needed
            mine = np.flatnonzero(best == s)
            mine = mine[np.lexsort((-per_token[mine, s], doc[mine]))]
            first = np.r_[True, np.diff(doc[mine]) != 0] if len(mine) else np.zeros(0, dtype=bool)
            place = np.arange(len(mine)) - np.maximum.accumulate(np.where(first, np.arange(len(mine)), 0)) if len(mine) else mine
            needed = mine[place == self.least_sentences - 1]
            top[doc[needed]] = per_token[needed, s]
            grid = np.linspace(0.0, 0.5, 21)
            score = [(top[labelled] > g).mean() - (top[~labelled] > g).mean() for g in grid]
            good = grid[np.array(score) >= max(score) - 0.01]
            self.margins[s] = good[0]

    def assign(self, texts: list[str], generic: float = 0.5) -> Iterator[tuple[int, int, int, float]]:
        """(text, subject, sentences that treat it, mean gain per token)."""
        t, starts, doc, lengths = encode(texts)
        if not len(starts):
            return
        gain = self.gains(t, starts, lengths)
        weight, _ = self.judged(gain, doc, len(texts), generic)
        best = weight.argmax(axis=1)
        at = np.arange(len(best))
        per_token = gain[at, best] / lengths
        treats = (per_token > self.margins[best]) & (weight[at, best] > 0.5)
        keys, row = np.unique(doc[treats] * len(self.subjects) + best[treats], return_inverse=True)
        n = np.bincount(row, minlength=len(keys))
        gain = np.bincount(row, weights=per_token[treats], minlength=len(keys))
        for k, m, g in zip(keys, n, gain, strict=True):
            yield int(k) // len(self.subjects), int(k) % len(self.subjects), int(m), float(g / m)

    def packed(self) -> dict:
        """What the tasks need: only rows of buckets that some subject has."""
        sparse = lambda tables: (at := np.flatnonzero(np.max(tables, axis=0) > 1e-12).astype(np.int32), np.stack([x[at] for x in tables]))
        b = self.background
        return {"subjects": self.subjects, "own": self.own, "rare": self.rare, "margins": self.margins, **{k: sparse(getattr(self, k)) for k in ("uni", "pair", "hist")},
                "bg": tuple(x.astype(np.float32) for x in (b.uni, b.pair, b.hist))}

    @staticmethod
    def unpacked(p: dict) -> "SubjectModels":
        b = Background.__new__(Background)
        b.uni, b.pair, b.hist = p["bg"]
        m = SubjectModels(p["subjects"], b, p["own"], p["rare"])
        m.margins = p["margins"]
        for name, size in (("uni", UNI), ("pair", BI), ("hist", UNI)):
            at, values = p[name]
            tables = []
            for v in values:
                x = np.zeros(size, dtype=np.float32)
                x[at] = v
                tables.append(x)
            setattr(m, name, tables)
        return m


def spelled(subject):
    """One spelling of a subject's name."""
    return F.lower(F.trim(F.regexp_replace(subject, r"\s+", " ")))


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, most_labelled: int = 20_000, most_chars: int = 200_000_000) -> SubjectModels | None:
    """Models from documents(doc_id, text), labels(doc_id, subject) and subjects(subject); None without subjects or labelled texts.

    The sample the models are fitted on: at most ``most_labelled`` documents, chosen by hash, and of these, in the same order, as many as have ``most_chars``
    characters together. Both bound what the driver holds. The counts of the background cover all documents.
    """
    names = sorted({r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect()})
    if not names:
        return None
    number = {" ".join(n.lower().split()): k for k, n in enumerate(names)}
    counts = corpus_counts(documents).toPandas()
    tables = []
    for k, size in enumerate((UNI, BI, UNI)):
        x = np.zeros(size)
        part = counts[counts["kind"] == k]
        x[part["bucket"].to_numpy()] = part["n"].to_numpy()
        tables.append(x)
    given = labels.select("doc_id", spelled(F.col("subject")).alias("s")).where(F.col("doc_id").isNotNull() & F.col("s").isin(list(number))).distinct()
    ids = given.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    given = given.join(ids, "doc_id").groupBy("doc_id").agg(F.collect_set("s").alias("s"))
    # the sample is bounded by most_labelled and most_chars, so it is broadcast, and no text is moved but those of the sample
    known = cut(documents.where("text is not null").select("doc_id", "text").join(F.broadcast(given), "doc_id"))
    sizes = known.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    total = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # numbers of the sample alone
    chosen = sizes.withColumn("total", total).where(F.col("total") <= most_chars).select("doc_id")
    rows = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("s").alias("s")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return None
    m = SubjectModels(names, Background(*tables))
    m.fit([r["text"] for r in rows], [{number[s] for s in r["s"]} for r in rows])
    return m


def assign_subjects(documents: DataFrame, models: SubjectModels | None, least_sentences: int = 3) -> DataFrame:
    """SCORES of documents(doc_id, text, version): subjects that at least ``least_sentences`` sentences treat.

    Null texts treat nothing, as do all texts if there are no models; repeated rows give repeated rows; texts are read whole.
    """
    if models is None:
        return documents.sparkSession.createDataFrame([], SCORES)
    shared = documents.sparkSession.sparkContext.broadcast(models.packed())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = SubjectModels.unpacked(shared.value)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                ids, versions = part["doc_id"].to_numpy(), part["version"].to_numpy()
                rows = [(ids[k], m.subjects[s], n, g, versions[k]) for k, s, n, g in m.assign(list(part["text"])) if n >= least_sentences]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "subject", "n_sentences", "gain", "version"])

    return documents.select("doc_id", "text", "version").where("doc_id is not null and text is not null").mapInPandas(run, SCORES)
