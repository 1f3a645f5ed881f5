import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


class Trie:
    """PPM by dictionaries, one symbol at a time."""

    def __init__(self, texts):
        self.next = defaultdict(Counter)
        for t in texts:
            for ctx, s in self.events(t):
                for k in range(lm.ORDER + 1):
                    self.next[ctx[lm.ORDER - k :]][s] += 1

    @staticmethod
    def events(text):
        seq = [256] * lm.ORDER + list(lower(text).encode()) + [256]
        return [(tuple(seq[i - lm.ORDER : i]), seq[i]) for i in range(lm.ORDER, len(seq))]

    def log(self, ctx, s):
        out, excluded = 0.0, set()
        for k in range(lm.ORDER, -1, -1):
            seen = {a: n for a, n in self.next.get(ctx[lm.ORDER - k :], {}).items() if a not in excluded}
            total, discount = sum(seen.values()), lm.LONGEST if k == lm.ORDER else lm.SHORTER
            if s in seen:
                return out + math.log10((seen[s] - discount) / total)
            if seen:
                out += math.log10(len(seen) * discount / total)
            excluded |= set(seen)
        return out - math.log10(257 - len(excluded))

    def score(self, text):
        return sum(self.log(c, s) for c, s in self.events(text))


def base(texts, train):
    count = Counter(w for t in train for w in [*WORD.findall(lower(t)), None])
    n, v = sum(count.values()), len(count)
    rows = []
    for t in texts:
        w = [*WORD.findall(lower(t)), None]
        rows.append((len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return rows


TEXTS = ["The cat  sat on\tthe mat.", None, "", "the CAT sat", "ünï çödé \x00 ÿ 𝄞", "zzzz qqqq", "a", "the the the " * 30, "The cat  sat on\tthe mat.", "x" * 3000]


@pytest.mark.parametrize("batch_bytes", [24 << 20, 40])
def test_brute_force(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(lm, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(lm, "FAN_IN", 256 if batch_bytes > 100 else 3)
    if batch_bytes < 100:  # every bucket is split and texts are cut into pieces
        monkeypatch.setattr(lm, "PART_BYTES", 60)
        monkeypatch.setattr(lm, "PIECE_BYTES", 8)
    rows = [(i, t, i % 3 != 0) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame([(i, t, k, 1.0) for i, t, k in rows], "doc_id long, text string, keep boolean, score double")
    out = {r["doc_id"]: r for r in lm.score_documents(docs, F.col("keep")).collect()}
    train = [t or "" for _, t, k in rows if k]
    trie = Trie(train)
    for (i, t, _), (n, known, total, logs) in zip(rows, base([t or "" for _, t, _ in rows], train), strict=True):
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(logs, abs=1e-9)
        assert r["score"] == pytest.approx(trie.score(t or ""), rel=1e-5, abs=1e-4)


def test_probabilities_sum_to_one():
    trie = Trie(["abracadabra", "abc", "banana"])
    for ctx in [(256,) * 5, tuple(b"abrac"), tuple(b"zzzab"), tuple(b"qqqqq")]:
        assert sum(10 ** trie.log(ctx, s) for s in range(257)) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "ab"), (1, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in lm.score_documents(docs, F.lit(False)).collect()}
    assert out[None]["score"] == pytest.approx(-3 * math.log10(257), rel=1e-6) and out[1]["n_tokens"] == 1 and out[1]["train_tokens"] == 0
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_held_out_beats_the_baseline(spark):
    out = lm.op2_ppm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > out["b"]


def test_packing_of_keys():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm._unpack(lm._pack(keys)) == keys).all()


@pytest.mark.parametrize("limit", [1, 7, 40])
def test_pieces_have_the_keys_of_whole_texts(monkeypatch, limit):
    texts = [(t or "").encode() for t in TEXTS] + [b"  lead and  trail  ", b"A b\tC\n\n" * 20]
    whole = [p for t in texts for p in lm.pieces_of(t)]
    assert len(whole) == len(texts)
    monkeypatch.setattr(lm, "PIECE_BYTES", limit)
    cut = [p for t in texts for p in lm.pieces_of(t)]
    assert b"".join(p.text for p in cut) == b"".join(texts) and sum(p.last for p in cut) == len(texts) < len(cut)
    assert (lm.grams(whole) == lm.grams(cut)).all()
    (_, w1, n1), (_, w2, n2) = lm.text_keys(whole), lm.text_keys(cut)
    assert (w1 == w2).all() and n1.sum() == n2.sum() == len(w1)
    train = [np.array([i % 2 == 0 for i, t in enumerate(texts)]), np.array([i % 2 == 0 for i, t in enumerate(texts) for _ in lm.pieces_of(t)])]
    for one, two in zip(lm.batch_keys(whole, train[0]), lm.batch_keys(cut, train[1]), strict=True):
        assert (one == two).all()


def test_long_texts(spark):
    """A text of several pieces counts and scores as its short copies do together, and one word of megabytes is no trouble."""
    part = "the Cat sat on a mat and öther things happened. "
    n = 120_000
    rows = [(1, part * n), (2, "w" * 3_000_000), (3, part), (None, None)]
    out = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    assert out[1]["n_tokens"] == out[1]["n_known"] == 10 * n + 1 and out[2]["n_tokens"] == 2 and out[3]["n_tokens"] == 11
    assert out[1]["train_tokens"] == sum(r["n_tokens"] for r in out.values())
    counts = Counter(part.lower().split())
    total, kinds = out[1]["train_tokens"], len(counts) + 2
    want = sum(n * c * math.log10((c * (n + 1) + 0.1) / (total + 0.1 * (kinds + 1))) for c in counts.values()) + math.log10(4.1 / (total + 0.1 * (kinds + 1)))
    assert out[1]["base_score"] == pytest.approx(want, rel=1e-9)
    assert out[1]["score"] > -0.2 * len(part) * n
