import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import toxicity as t


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = [words[j] for j in rng.zipf(1.4, rng.integers(5, 60)) % 80]
        if bad:
            text.insert(int(rng.integers(0, len(text))), f"nasty{rng.integers(0, 40)}")
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x, "a") for i, x, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = t.train(docs, labels)
    right = total = 0
    for i, x, y in rows:
        if zlib.crc32(str(i).encode()) % 3 == 1:
            total += 1
            right += (model.score(x.encode()) >= t.THRESHOLD) == bool(y)
    assert right / total > 0.95
    kept = t.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.7 * len(rows) < kept.count() < 0.8 * len(rows)


class Plain:
    """Interpolated Kneser-Ney by its definition, with dictionaries, one probability at a time."""

    def __init__(self, texts, vocabulary, stem_of, stems):
        self.bigrams, self.after, self.contexts = {}, {}, {}
        self.stem_of, self.stems = stem_of, stems
        trigrams, pairs, stem_pairs = set(), set(), set()
        for words, parts in texts:
            for i, w in enumerate(words):
                u = words[i - 2] if i > 1 else "<s>"
                v = words[i - 1] if i else "<s>"
                trigrams.add((u, v, w))
                pairs.add((v, w))
                stem_pairs.add((parts[i - 1] if i else 0, parts[i]))
        for _, v, w in trigrams:
            self.bigrams[v, w] = self.bigrams.get((v, w), 0) + 1
        for _, w in pairs:
            self.after[w] = self.after.get(w, 0) + 1
        for _, s in stem_pairs:
            self.contexts[s] = self.contexts.get(s, 0) + 1

    def p(self, v, w, stem, share, shared):
        def level(counts, key, lower):
            total = sum(counts.values())
            left = 1 - sum(max(n - t.DISCOUNT, 0) for n in counts.values()) / max(1, total)
            return max(counts.get(key, 0) - t.DISCOUNT, 0) / max(1, total), left * lower

        of_stem = sum(level(self.contexts, stem, shared))
        kept, below = level(self.after, w, of_stem * share)
        if w is None:  # a word outside the vocabulary: what the known ones leave, spread by stems
            unigram = below
        else:
            unigram = kept + below
        here = {b: n for (a, b), n in self.bigrams.items() if a == v}
        total = sum(here.values())
        backoff = sum(min(n, t.DISCOUNT) for n in here.values()) / total if total else 1.0
        seen = max(here.get(w, 0) - t.DISCOUNT, 0) / total if total and w is not None else 0.0
        return seen + backoff * unigram


def test_ratio_against_the_definition():
    """Every bigram's log ratio is that of two Kneser-Ney models computed by definition: kept bigrams, those the discount empties, unknown words."""
    rng = np.random.default_rng(1)
    size, stems = 12, 5  # words 1..10, 11 is the start
    stem_of = np.array([0, *[1 + i % 4 for i in range(10)], 0])

    def make(skew):
        out = []
        for _ in range(60):
            words = rng.zipf(skew, 30) % 11
            out.append((words, np.where(words > 0, stem_of[words], rng.integers(0, stems, 30))))
        return out

    toxic, ordinary = make(1.3), make(2.0)
    ratio = t.Ratio(toxic, ordinary, size, stem_of, stems)
    assert 0 < len(ratio.keys) < 11 * 11
    name = lambda w: int(w) if w else None
    plain = [Plain([([name(w) for w in words], parts.tolist()) for words, parts in texts], range(1, 11), stem_of, stems) for texts in (toxic, ordinary)]
    pooled = [sum(m.contexts.get(s, 0) for m in plain) for s in range(stems)]
    shared = [t.SHARED * n / sum(pooled) + (1 - t.SHARED) / stems for n in pooled]
    kinds = {b for m in plain for b in m.bigrams}
    weight = {w: 1 + sum(b == w for _, b in kinds) for w in [None, *range(1, 11), "<s>"]}
    of = {w: 0 if w in (None, "<s>") else int(stem_of[w]) for w in weight}
    for v in ["<s>", None, *range(1, 11)]:
        for w in [None, *range(1, 11)]:
            stem = 3 if w is None else of[w]
            share = 1.0 if w is None else weight[w] / sum(n for k, n in weight.items() if of[k] == stem)
            want = np.log(plain[0].p(v, w, stem, share, shared[stem]) / plain[1].p(v, w, stem, share, shared[stem]))
            if v == "<s>":
                got = ratio.of(np.array([w or 0]), np.array([stem]))[0]
            else:
                got = ratio.of(np.array([v or 0, w or 0]), np.array([0 if v is None else of[v], stem]))[1]
            assert got == pytest.approx(want, abs=1e-5), (v, w)


def test_score_is_the_logistic_curve_of_the_ratios():
    model = t.ToxicityModel([(x.encode(), y) for _, x, y in corpus()])
    for text in (b"w1 w2 w3 w1", b"nasty3 w1 nasty4", b"w9"):
        r = model.ratio.of(*model.ids(text)).tolist()
        pairs = [a + b for a, b in zip(r, r[1:], strict=False)] or r
        x = (np.array([sum(r) / len(r), max(pairs) / 2, np.log(1 + len(r))]) - model.shift) / model.scale
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(model.weights[0] + (x * model.weights[1:]).sum()))), abs=1e-12)


def test_sample_bounded_by_bytes_and_repeated_ids(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(0, "zz " * 50_000), (3, None)] + [(4, f"zz{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    whole, bounded = t.train(docs, labels), t.train(docs, labels, max_bytes=20_000)
    # id 0 counts by the smaller of its texts, and no text is cut; the repeated id is one document
    assert b"zz" not in whole.vocabulary and 0 < len(bounded.vocabulary) <= len(whole.vocabulary)
    assert b"zz0" not in whole.vocabulary
    share = lambda m: np.mean([m.score(x.encode()) for _, x, _ in rows])
    assert abs(share(whole) - share(bounded)) < 0.08


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, None)]])
def test_too_little_to_learn(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "c"), (3, "")], "doc_id long, text string")
    model = t.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = docs.select(t.score_column(spark, model, F.col("text")).alias("s")).collect()
    assert len(out) == 5 and all(0 <= r["s"] <= 1 for r in out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert t.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    """The sample's texts and counts are held by a task: the driver neither fits nor reads a text, and the model is that of a fit beside it."""
    rows = corpus()
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    want = t.ToxicityModel([(x.encode(), y) for i, x, y in rows if zlib.crc32(str(i).encode()) % 3 != 1])

    def never(*_, **__):
        raise AssertionError("on the driver")

    monkeypatch.setattr(t.ToxicityModel, "__init__", never)
    monkeypatch.setattr(type(docs), "toLocalIterator", never)
    monkeypatch.setattr(t, "MODEL_PART", 1000)  # in several rows
    model = t.train(docs, labels)
    assert model.vocabulary == want.vocabulary and len(model.ratio.keys)
    for _, x, _ in rows[:50]:
        assert model.score(x.encode()) == pytest.approx(want.score(x.encode()), abs=1e-12)


def test_edge_texts():
    model = t.ToxicityModel([(x.encode(), y) for _, x, y in corpus()])
    for text in (b"", b"nasty3", b"w1 " * 20000, "é  ñ".encode(), b"..."):
        assert 0 <= model.score(text) <= 1
    assert model.score(b"nasty99 w1") > 0.7 > model.score(b"w1 w2 w3")


def test_bounded_sample_keeps_the_odds_of_all_labels(spark):
    # texts that say nothing of their label: the score is the share of label 1, however much of each class was drawn
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 50, 40)), int(i % 4 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    for toxic, ordinary in ((150, 150), (50, 200), (3000, 7500)):
        model = t.train(docs, labels, toxic, ordinary)
        assert 0.15 < np.mean([model.score(x.encode()) for _, x, _ in rows[:300]]) < 0.36
