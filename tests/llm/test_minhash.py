import re

import numpy as np
import pytest

from sparktrail.llm import minhash as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    low = {i: i for i, _ in sets}
    changed = True
    links = [(a, b) for x, (a, p) in enumerate(sets) for b, q in sets[x + 1 :] if p and q and 100 * len(p & q) >= 75 * len(p | q)]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return {i: (len(s), low[i]) for i, s in sets}


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: f"W{rng.integers(0, 400)}"
    rows, base = [], [word() for _ in range(120)]
    for i in range(n):
        kind = i % 6
        if kind < 3:  # near copies of one text, more and more apart
            w = list(base)
            for _ in range(int(rng.integers(0, 12))):
                w[int(rng.integers(0, len(w)))] = word()
        elif kind == 3:
            w = base[:40] + [word() for _ in range(60)]
        else:
            w = [word() for _ in range(int(rng.integers(0, 60)))]
        rows.append((i * 3 + 1, "  ".join(w)))
    rows += [(9001, rows[4][1].upper()), (9002, rows[5][1].replace("  ", "\n")), (9003, None), (9004, ""), (9005, " \t "), (9006, "one two"), (9007, "ONE  two"), (9008, "one")]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_brute_force(spark, seed):
    rows = corpus(seed, 150)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    want = brute(rows)
    out = m.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    kept = m.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_salted_buckets_give_the_same(spark, monkeypatch):
    rows = corpus(3, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(m, "HOT", 10)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.near_duplicates(docs).collect()} == brute(rows)


def test_repeats_nulls_and_nothing(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None), (3, None), (4, "x " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(tuple, m.near_duplicates(docs).collect()), key=str)
    assert (None, 26, None, None) in out and out.count((1, 26, 1, True)) == 2 and (2, 26, 1, False) in out and (4, 1, 4, True) in out
    kept = sorted(((r["doc_id"], r["text"]) for r in m.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, long), (None, long), (3, None), (3, None), (4, "x " * 4000)], key=str)
    assert m.drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(20):
            a, b, c = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (int(1000 * share), 500 - int(500 * share), 500 - int(500 * share)))
            hashes = np.concatenate((a, b, a, c))
            at = np.array([0, len(a) + len(b), 2 * len(a) + len(b) + len(c)])
            sig = m.packed(m.minima(hashes, at))
            errors.append(m.estimate(sig[0], sig[1:])[0] - len(a) / (len(a) + len(b) + len(c)))
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.13


def test_components_in_rounds(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(a) + 1) for a in range(0, 60)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 50, (60, 2)) if a != b]
    df = spark.createDataFrame(links, "a long, b long")
    one = {tuple(r) for r in m.components(df).collect()}
    assert one == {tuple(r) for r in m.components(df, local=16).collect()}
    assert {(i, 0) for i in range(61)} <= one


def test_words_are_told_apart():
    words, first = m.word_hashes([b"Ab  cd\tAB", b"", b"cd", b" "])
    assert first.tolist() == [0, 3, 3, 4, 4] and words[0] == words[2] and words[1] == words[3] and words[0] != words[1]
