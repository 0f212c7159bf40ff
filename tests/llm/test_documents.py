import random

import numpy as np
import pytest
from codelode.llm import leakage as L
from codelode.llm import mixing as M
from codelode.llm import subjects as S

DOC = "doc_id long, text string, version timestamp, item_id string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "clash", s) for i, t, s in rows], DOC)


def brute(texts, items, n=12):
    grams = lambda t: {tuple(w[k : k + n]) for w in [L.words(t)] for k in range(len(w) - n + 1)}
    return {(d, i) for d, t in texts if t for i, p in items if p and grams(t) & grams(p)}


def test_leaks_as_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "i", "to", "Straße", "lens", "orbit", "x1", "été", "grain", "zum", "of"]
    items = [(k, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(rng.randint(8, 40)))) for k in range(30)] + [(98, None), (99, "too short")]
    texts = []
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(30)]
        k = rng.randrange(30)
        p = L.words(items[k][1])
        cut = p[(s := rng.randint(0, 4)) : s + rng.randint(9, 16)]
        texts.append((d, " ".join(w[:15]) + "_" + rng.choice([" ", "\n// ", "**", "\u00a0"]).join(x.upper() if d % 2 else x for x in cut) + "; " + " ".join(w[15:])))
    texts += [(500, None), (501, ""), (502, "word " * 100_000 + items[0][1] * 3)]
    want = brute(texts, items)
    df, it = docs(spark, [(d, t, "s") for d, t in texts]), spark.createDataFrame([(i, p, "x") for i, p in items] + [(0, items[0][1], "x")], "item_id long, passage string, text string")
    for block in (8_000_000, 300):
        got = {(r["doc_id"], r["item_id"]) for r in L.leaks(df, it, block_chars=block).collect()}
        assert got == want and len(want) > 20
    assert L.leaks(df.limit(0), it).count() == 0 and L.leaks(df, it.limit(0)).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def spans(words):
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    return np.stack([end - [len(w) for w in words], end], axis=1)


def test_alignment_as_brute_force():
    rng = random.Random(6)
    some = 0
    for _ in range(120):
        passage = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 6))]
        text = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))] + passage[rng.randint(0, 2) :] + ["cc"]
        if rng.random() < 0.6:
            k = rng.randrange(len(text))
            text[k] = text[k][:-1] + rng.choice(["", "b", "ca"]) or "a"
        joined = " ".join(text)
        for edits in range(3):
            got = L.banded_alignment(L._codes(" ".join(passage)), spans(passage), L._codes(joined), np.arange(-40, 60), edits)
            want = max((n for i in range(len(passage)) for n in range(1, len(passage) - i + 1) if any(edit(" ".join(passage[i : i + n]), " ".join(text[x:y])) <= edits for x in range(len(text)) for y in range(x + 1, len(text) + 1))), default=0)
            assert (got[0] if got else 0) == want, (passage, text, edits, got, want)
            if got:
                assert got[1] == 0 or joined[got[1] - 1] == " "
                some += 1
    assert some > 200


def test_edits():
    passage = "the quick brown fox jumps over the lazy dog and then it sleeps for days"
    index = L.PassageIndex([(1, passage)], 12, 2, 16, 16)
    found = list(index.search([L.words("so the quick brwn fox jumps over the lazy dog and then it slept"), L.words("the quick cat jumps over a lazy cow and then it sleeps")]))
    assert found == [(0, 1, 12, 1)]
    exact = L.PassageIndex([(1, passage)], 12, 0, 16, 16)
    assert list(exact.search([L.words("x the quick brown fox jumps over the lazy dog and then it sleeps"), L.words("athe quick brown fox jumps over the lazy dog and then itt")])) == [(0, 1, 13, 1)]


def test_token_counts(spark):
    df = docs(spark, [(1, "hello world", " A "), (2, None, "a"), (3, "", "b"), (4, "x" * 50_000, "b"), (5, "don't <|endoftext|>", None)])
    got = {r["doc_id"]: r["tokens"] for r in M.count_tokens(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1000 and got[5] > 5


@pytest.mark.parametrize("block", [50, 4000])
def test_mixture_reaches_its_shares(spark, block):
    rng = random.Random(8)
    rows = [(k, "word " * rng.randint(1, 200), s) for k, s in enumerate(["big"] * 600 + [" Mid"] * 200 + ["SMALL"] * 12 + ["none"] * 5 + [None] * 3)] + [(900, None, "big"), (901, "", "big"), (0, "word", "big")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small ", 0.1, 4), ("absent", 0.1, 2), (None, 0.2, 1)], "source_name string, target_share double, max_repeat int")
    mixture, plan = M.mix(docs(spark, rows), targets, block=block)
    got = {r["source"]: r for r in M.report(mixture, plan).collect()}
    assert set(got) == {"big", "mid", "small", "absent"} and got["absent"]["copies"] == 0
    for r in got.values():
        assert abs(r["reached_share"] - r["scaled_share"]) < 0.01 and r["most_copies"] <= r["max_repeat"]
    assert mixture.select("doc_id").distinct().count() == mixture.count()


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source_name string, target_share double, max_repeat int")
    for d, t in ((docs(spark, []), targets), (docs(spark, [(1, "x", "a")]), targets.limit(0)), (docs(spark, [(1, None, "a")]), targets)):
        mixture, plan = M.mix(d, t)
        assert mixture.count() == 0 and M.report(mixture, plan).count() == len(plan)


def test_flight_keeps_totals_and_expectations():
    rng = random.Random(9)
    p = [rng.uniform(0.05, 0.95) for _ in range(200)]
    size = [float(rng.randint(1, 50)) for _ in p]
    taken = np.zeros(200)
    for _ in range(300):
        q, held = M.fly(p, [(1.0, s / 25) for s in size], rng)
        assert len(held) <= 2 and abs(sum(q) - sum(p)) < 1e-6 and abs(np.dot(q, size) - np.dot(p, size)) < 1e-4
        taken += q
    assert np.abs(taken / 300 - p).mean() < 0.04


WORDS = {"law": "court judge appeal statute verdict tort bail counsel".split(), "music": "chord violin choir sonata rhythm cello fugue tempo".split(), "sport": "referee goal league match tackle medal coach sprint".split()}
FRAMES = ["The {} table now links each {} to one entry.", "Users asked why the {} and the {} disagree.", "A {} without {} is kept but marked.", "Reports group by {} and then by {}, oldest first.", "When a {} is missing, we use the last {}."]
PLAIN = ["Please read the next section first.", "This was changed after review number 12.", "Both variants stay available until the end of the year.", "Thanks to everyone who replied so quickly."]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        chosen = rng.sample(list(WORDS), rng.choice([0, 1, 1, 2]))
        s = [rng.choice(FRAMES).format(rng.choice(WORDS[c]), rng.choice(WORDS[c])) for c in chosen for _ in range(rng.randint(3, 6))]
        others = [c for c in WORDS if c not in chosen]
        if others and rng.random() < 0.5:
            c = rng.choice(others)
            s.append(rng.choice(FRAMES).format(rng.choice(WORDS[c]), rng.choice(WORDS[c])))
        s += [rng.choice(PLAIN) for _ in range(rng.randint(1, 4))]
        rng.shuffle(s)
        out.append((d, " ".join(s), set(chosen)))
    return out


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(1)
    train, test = corpus(900, 2), corpus(300, 3)
    labels = [(d, (c.upper() if d % 3 else f" {c} ")) for d, _, cs in train[:600] for c in cs] + [(d, rng.choice(list(WORDS))) for d in range(0, 600, 15)] + [(None, "law"), (1, None), (2, "unknown"), (99999, "law")]
    names = spark.createDataFrame([(s, "") for s in WORDS] + [(None, "")], "subject string, descr string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    models = S.train(docs(spark, [(d, t, "s") for d, t, _ in train]), lab, names)
    target = docs(spark, [(d, t, "s") for d, t, _ in test] + [(900, None, "s"), (901, "", "s"), (902, "court " * 50_000, "s")])
    got = {(r["doc_id"], r["subject"]) for r in S.assign_subjects(target, models).collect() if r["doc_id"] < 900}
    want = {(d, c) for d, _, cs in test for c in cs}
    assert len(got & want) / len(got) > 0.93 and len(got & want) / len(want) > 0.93, (len(got & want), len(got), len(want))
    assert S.assign_subjects(target.limit(0), models).count() == 0
    assert S.train(target.limit(0), lab, names) is None and S.train(target, lab, names.limit(0)) is None
    assert S.assign_subjects(target, None).count() == 0


def test_repair_and_sentences():
    assert S.repair("rev\u00c3\u00b3 \u00c3\u00bcber f\u00fcr") == "rev\u00f3 \u00fcber f\u00fcr"
    assert len(S.sentences("One two three. Four five six! \n- seven eight nine\n\nten eleven twelve? x")) == 4
