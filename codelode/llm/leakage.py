"""Evaluation texts that leak into training text: the q-gram lemma as a filter, banded alignment as the proof.

A passage window of ``min_words`` words that occurs in a text with at most ``max_edits`` edits shares at least
L + 1 - q * (max_edits + 1) of its q-grams with it (L: length of the window), all on diagonals (position in the text
minus position in the passage) that differ by at most ``max_edits``. So the shared q-grams are counted in diagonal bands
that overlap by ``max_edits``; bands that reach the bound of the shortest window are verified by an alignment within the band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import cut

WORD = re.compile(r"[^\W_]+")
LEAKS = "doc_id long, item_id long, run_words int, word_from int, version timestamp"
BLANK = ord(" ")


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case."""
    return WORD.findall(text.casefold())


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, built by doubling: log q vector steps."""
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        part = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(29)
        out, done, length, power = None, 0, 1, base
        while True:
            if q & length:
                if out is None:
                    out, done = part, length
                else:  # the part read so far, followed by this longer one
                    n = len(part) - done
                    out = out[:n] * power + part[done : done + n]
                    done += length
            length *= 2
            if length > q:
                break
            half, n = length // 2, len(part) - length // 2
            part = part[:n] * power + part[half : half + n]
            power = power * power
        n = max(0, len(codes) - q + 1)
        return out[:n] ^ (out[:n] >> np.uint64(31))


class PassageIndex:
    """The q-grams of a block of passages."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, max_edits: int, q: int, band: int):
        self.min_words, self.max_edits, self.band = min_words, max_edits, max(band, 2 * max_edits + 1)
        self.items = [(i, w) for i, p in items if p is not None and len(w := words(p)) >= min_words]
        shortest = [min(len(" ".join(w[k : k + min_words])) for k in range(len(w) - min_words + 1)) for _, w in self.items]
        # q small enough that the bound is at least one for the shortest window of all
        self.q = max(1, min([q, *(s // (max_edits + 1) for s in shortest)]))
        self.least = np.array([max(1, s + 1 - self.q * (max_edits + 1)) for s in shortest], dtype=np.int64)
        grams, owner, place = [], [], []
        self.coded = [_codes(" ".join(w)) for _, w in self.items]
        self.words = []
        for _, w in self.items:
            end = np.cumsum([len(x) + 1 for x in w]) - 1
            self.words.append(np.stack([end - [len(x) for x in w], end], axis=1))
        for k, c in enumerate(self.coded):
            h = qgram_hashes(c, self.q)
            grams.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        if self.items:
            g, o, p = np.concatenate(grams), np.concatenate(owner), np.concatenate(place)
            order = np.argsort(g, kind="stable")
            self.owner, self.place = o[order], p[order]
            self.keys, self.start = np.unique(g[order], return_index=True)
            self.end = np.append(self.start[1:], len(g))
            self.bits = np.zeros(1 << 20, dtype=bool)
            self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item_id, longest run in words, its first word) for each text and item that leaks."""
        if not self.items or not texts:
            return
        joined = [" ".join(t) for t in texts]
        begins = np.cumsum([0] + [len(j) + 1 for j in joined])
        codes = _codes("\n".join(joined) + "\n")
        h = qgram_hashes(codes, self.q)
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        real = self.keys[k] == h[at]
        at, k = at[real], k[real]
        n = self.end[k] - self.start[k]
        if not n.sum():
            return
        entry = np.repeat(self.start[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        text = np.searchsorted(begins, at, side="right") - 1
        item, pos, place = self.owner[entry], at - begins[text], self.place[entry]
        diagonal = pos - place + (1 << 40)
        band = diagonal // self.band
        again = (diagonal % self.band) < self.max_edits  # also the end of the band before
        text, item, pos, place, band = (np.concatenate([x, x[again]]) for x in (text, item, pos, place, band))
        band[len(band) - int(again.sum()) :] -= 1
        order = np.lexsort((pos, band, item, text))
        text, item, pos, place, band = (x[order] for x in (text, item, pos, place, band))
        first = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(band) != 0)])
        last = np.append(first[1:], len(text))
        enough = (last - first) >= self.least[item[first]]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for f, e in zip(first[enough], last[enough], strict=True):
            t, i = int(text[f]), int(item[f])
            own = codes[begins[t] : begins[t] + len(joined[t])]
            shared = place[f:e]
            if self.max_edits:
                low = int(band[f]) * self.band - (1 << 40)
                lines, starts = np.arange(low, low + self.band + self.max_edits), self.promising(i, shared)
                if not len(starts):
                    continue
            else:  # every q-gram of a run is shared, on its own diagonal
                lines, starts = np.unique(pos[f:e] - shared), None
            found = banded_alignment(self.coded[i], self.words[i], own, lines, self.max_edits, starts)
            if found and found[0] >= self.min_words:
                run = (found[0], -joined[t].count(" ", 0, found[1]))
                if run > best.get((t, i), (0, 0)):
                    best[t, i] = run
        for (t, i), (run, neg) in sorted(best.items()):
            yield t, self.items[i][0], run, -neg


    def promising(self, i: int, shared: np.ndarray) -> np.ndarray:
        """The words of the passage at which a window begins that shares enough q-grams by its own bound: no run within the budget begins elsewhere."""
        places, w = np.unique(shared), self.words[i]
        begin, end = w[: len(w) - self.min_words + 1, 0], w[self.min_words - 1 :, 1]
        count = np.searchsorted(places, end - self.q, side="right") - np.searchsorted(places, begin)
        return np.flatnonzero(count >= np.maximum(1, end - begin + 1 - self.q * (self.max_edits + 1)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def banded_alignment(passage: np.ndarray, words: np.ndarray, text: np.ndarray, diagonals: np.ndarray, edits: int, starts: np.ndarray | None = None) -> tuple[int, int] | None:
    """(words, begin in the text) of the longest run of whole words of the passage that the text holds within the budget of edits, on the diagonals
    (place in the text less place in the passage; ascending, without gaps if there is a budget). ``starts``: words at which runs within a budget may begin,
    by default all.

    passage, text: codes of characters, words apart by one blank; words: begin and end of each word of the passage. A run begins and ends at the
    ends of words of the text, too. Of equal runs the first in the passage counts.
    """
    if not edits:
        return _without_edits(passage, words, text, diagonals)
    best, low, high, covered = None, int(diagonals[0]), int(diagonals[-1]) + 1, set()
    for k in range(len(words)) if starts is None else starts.tolist():
        if k in covered:
            continue
        if best and len(words) - k <= best[0]:
            break
        found = _within_edits(passage, words, text, low, high, edits, k, covered)
        if found and (best is None or found[0] > best[0]):
            best = found
    return best


def _without_edits(passage, words, text, diagonals):
    """Without a budget the alignment can't leave a diagonal: the runs of equal characters on each."""
    best = None
    for d in diagonals.tolist():
        x0, x1 = max(0, -d), min(len(passage), len(text) - d)
        if x1 <= x0:
            continue
        same = np.zeros(x1 - x0 + 2, dtype=bool)
        same[1:-1] = text[x0 + d : x1 + d] == passage[x0:x1]
        edge = np.flatnonzero(same[1:] != same[:-1]) + x0
        for x, y in edge.reshape(-1, 2).tolist():  # the run is [x, y) in the passage
            a, b = np.searchsorted(words[:, 0], x), np.searchsorted(words[:, 1], y, side="right")
            if a < b and d + words[a, 0] > 0 and text[d + words[a, 0] - 1] != BLANK:
                a += 1  # the text's word begins earlier
            if a < b and d + words[b - 1, 1] < len(text) and text[d + words[b - 1, 1]] != BLANK:
                b -= 1
            if a < b and (best is None or b - a > best[0]):
                best = int(b - a), int(d + words[a, 0])
    return best


def _within_edits(passage, words, text, low, high, edits, first, covered):
    """The longest run from one word on: one row of costs for each character of the passage, a column for each diagonal of the band.

    Words that the run reaches without an edit, and goes beyond, are added to ``covered``: a run that begins there ends no later and is shorter.
    """
    free_ends = []
    wide = np.arange(low - edits, high + edits)
    begin = int(words[first, 0])
    at = wide + begin
    free = (at >= 0) & (at <= len(text)) & (wide >= low) & (wide < high)
    free &= (at == 0) | (text[np.clip(at - 1, 0, len(text) - 1)] == BLANK)
    cost = np.where(free, 0, edits + 1)
    origin = at.copy()
    cost, origin = _only_in_text(cost, origin, wide + begin, len(text), edits)
    best, ends = None, {int(e): k for k, e in enumerate(words[first:, 1], 1)}
    for p in range(begin, len(passage)):
        at = wide + p
        inside = (at >= 0) & (at < len(text))
        new = cost + np.where(inside, text[np.clip(at, 0, len(text) - 1)] != passage[p], edits + 1)
        source = origin.copy()
        # a character of the passage that the text lacks: from the next diagonal
        skip = np.append(cost[1:] + 1, edits + 1)
        less = skip < new
        new, source = np.where(less, skip, new), np.where(less, np.append(origin[1:], 0), source)
        cost, origin = _only_in_text(new, source, wide + p + 1, len(text), edits)
        if cost.min() > edits:
            break
        k = ends.get(p + 1)
        if k:
            stop = wide + p + 1
            whole = (cost <= edits) & (stop <= len(text)) & ((stop >= len(text)) | (text[np.clip(stop, 0, len(text) - 1)] == BLANK))
            if whole.any():
                best = k, int(origin[np.flatnonzero(whole)[np.argmin(cost[whole])]])
                if (cost[whole] == 0).any():
                    free_ends.append(first + k)
    if best:
        covered.update(k for k in free_ends if k < first + best[0])
    return best


def _only_in_text(cost, origin, at, length, edits):
    """Characters that only the text has: from the diagonal before, at most as many as there are edits."""
    for _ in range(edits):
        more = np.append(edits + 1, cost[:-1] + 1)
        less = (more < cost) & (at <= length)
        if not less.any():
            break
        cost, origin = np.where(less, more, cost), np.where(less, np.append(0, origin[:-1]), origin)
    return cost, origin


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, max_edits: int = 0, q: int = 16, band: int = 16, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, run_words, word_from, version) of every document that holds ``min_words`` consecutive words of an item.

    documents: doc_id, text, version; items: item_id, passage. The items are the stated query set: their size is measured, and up to
    ``block_chars`` characters of them go to the tasks at once, in one pass over the documents. More are worked off in blocks of about that size, one
    after the other: the rows of a block are written and its broadcast is given up before the next begins. The run and where it begins are those of
    the longest run that is within the budget.
    Null texts and passages and passages of fewer words hold nothing; repeated rows give repeated results; no items give no rows.
    """
    spark = documents.sparkSession
    items = items.select("item_id", "passage").where("passage is not null and item_id is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    out = None
    for b in range(blocks):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(sorted(part))

        def scan(batches, shared=shared):
            index = PassageIndex(shared.value, min_words, max_edits, q, band)
            for pdf in batches:
                for s in range(0, len(pdf), 500):
                    part = pdf.iloc[s : s + 500]
                    texts = [words(t) for t in part["text"]]
                    ids, versions = part["doc_id"].to_numpy(), part["version"].to_numpy()
                    rows = [(ids[t], i, n, w, versions[t]) for t, i, n, w in index.search(texts)]
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_words", "word_from", "version"])

        found = documents.select("doc_id", "text", "version").where("text is not null and doc_id is not null").mapInPandas(scan, LEAKS)
        if blocks > 1:
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out
