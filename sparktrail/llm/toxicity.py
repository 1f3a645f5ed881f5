"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, one of toxic and one of ordinary labelled
documents, back off to their class's continuation counts, from there to the
word's stem (its first bytes, counted by contexts, so that inflected and
unseen words are met) and at last to a distribution that both share (pooled
counts mixed with the uniform one), so that an expression which is rare in
both classes says little.  A text is scored by its length-normalised log-likelihood ratio, of
the whole text and of its most toxic window, and a logistic curve fitted on
cross-fitted ratios turns that into a probability.

Only the classifier is fitted on a sample: at most ``MAX_TOXIC`` and
``MAX_ORDINARY`` labelled documents of at most ``MAX_BYTES`` together in each
class, drawn by a seeded hash of the id, with their whole texts.  One task on
an executor holds that sample and fits; the driver gets the model alone.
Every document is scored over its whole text.
"""

from __future__ import annotations

import itertools
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, discard, id_crc, table, text_bytes, tune, written

MAX_TOXIC, MAX_ORDINARY = 3000, 7500
#: Bytes of text that a class gives to the sample; documents of its draw are taken whole, in the order of the hash, while they fit.
MAX_BYTES = 48 << 20
THRESHOLD = 0.7
#: Absolute discount of bigram, continuation and stem counts: what was seen in this few contexts of a class is no evidence.
DISCOUNT = 3.0
SHARED = 0.05  # weight of the pooled counts in the shared distribution; the rest is uniform
MIN_COUNT = 5  # rarer words are known by their stem alone
STEM = 4  # bytes
WINDOW = 2
#: Bytes of the fitted model in a row that goes to the driver.
MODEL_PART = 4 << 20

#: Letters, digits and bytes above 127 make words here; punctuation parts them.
_PARTS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).translate(_PARTS).split()


class KneserNey:
    """One class: counts over word ids (0 unknown, 1..V words, V+1 the start) and over stem ids."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], size: int, stems: int):
        texts = [t for t in texts if len(t[0])]
        # Bigrams and stems count once for each different left neighbour: copies of a document are no more evidence than one.
        types = [self._types(size, words) for words, _ in texts]
        wide = np.unique(np.concatenate(types)) if types else np.zeros(0, np.int64)
        self.keys, self.counts = np.unique(wide % (size * size), return_counts=True)
        del types, wide
        pairs = [np.unique(np.concatenate(([0], s[:-1])).astype(np.int64) * stems + s) for _, s in texts]
        self.contexts = np.bincount(np.unique(np.concatenate(pairs)) % stems if pairs else np.zeros(0, np.int64), minlength=stems).astype(float)
        before, after = self.keys // size, self.keys % size
        self.total = np.bincount(before, self.counts, size)
        self.held_back = np.bincount(before, np.minimum(self.counts, DISCOUNT), size)
        self.continuations = np.bincount(after, minlength=size).astype(float)

    @staticmethod
    def _types(size: int, words: np.ndarray) -> np.ndarray:
        """The text's distinct trigrams as one number each."""
        w = words.astype(np.int64)
        prev = np.concatenate(([size - 1], w[:-1]))
        before = np.concatenate(([size - 1, size - 1], w[:-2]))[: len(w)]
        return np.unique((before * size + prev) * size + w)

    def backoff(self) -> np.ndarray:
        return np.where(self.total > 0, self.held_back / np.maximum(self.total, 1), 1.0)


def _discounted(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares after the discount, and what is left for the backoff."""
    kept = np.maximum(counts - DISCOUNT, 0) / max(1.0, counts.sum())
    return kept, 1 - kept.sum()


class Ratio:
    """Log-likelihood ratio of a bigram: context part + word part, and a table of the bigrams that a class saw more often than the discount takes away. Of all others nothing is left after the discount, so the two parts are their exact ratio."""

    def __init__(self, toxic: list, ordinary: list, size: int, stem_of: np.ndarray, stems: int):
        self.size, self.stem_of = size, stem_of
        models = KneserNey(toxic, size, stems), KneserNey(ordinary, size, stems)
        one, zero = models
        # What both classes share: how stems are spread, and how a stem's known words are spread.
        pooled = one.contexts + zero.contexts
        shared = SHARED * pooled / max(1.0, pooled.sum()) + (1 - SHARED) / stems
        words = np.bincount(np.union1d(one.keys, zero.keys) % size, minlength=size) + 1.0
        within = words / np.bincount(stem_of, words, stems)[stem_of]
        unigrams, novel = [], []
        for m in models:
            kept, left = _discounted(m.contexts)
            stem = kept + left * shared
            kept, left = _discounted(m.continuations)
            unigrams.append(kept + left * stem[stem_of] * within)
            novel.append(left * stem)
        u1, u0 = unigrams
        b1, b0 = one.backoff(), zero.backoff()
        self.word, self.novel, self.context = np.log(u1 / u0), np.log(novel[0] / novel[1]), np.log(b1 / b0)
        keys = np.union1d(*(m.keys[m.counts > DISCOUNT] for m in models))
        keys = keys[keys % size != 0]
        v, w = keys // size, keys % size

        def p(model: KneserNey, b: np.ndarray, u: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(model.keys, keys), max(0, len(model.keys) - 1))
            seen = np.where(model.keys[at] == keys, model.counts[at], 0) if len(model.keys) else np.zeros(len(keys))
            return np.maximum(seen - DISCOUNT, 0) / np.maximum(model.total[v], 1) + b[v] * u[w]

        self.keys = keys
        self.exact = (np.log(p(one, b1, u1) / p(zero, b0, u0)) if len(keys) else np.zeros(0)).astype(np.float32)

    def of(self, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
        prev = np.concatenate(([self.size - 1], words[:-1]))
        out = self.context[prev] + np.where(words > 0, self.word[words], self.novel[stems])
        if len(self.keys):
            keys = prev.astype(np.int64) * self.size + words
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.exact[at], out)
        return out


def _features(ratio: np.ndarray) -> tuple[float, float, float]:
    n = len(ratio)
    if not n:
        return 0.0, 0.0, 0.0
    sums = np.concatenate(([0.0], np.cumsum(ratio)))
    best = (sums[WINDOW:] - sums[:-WINDOW]).max() if n >= WINDOW else sums[-1]
    return float(sums[-1] / n), float(best / WINDOW), float(np.log1p(n))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, rows: list[tuple[bytes, int]], log_odds: float = 0.0):
        """rows: (text, label); copies with the same label count once. ``log_odds``: how much larger the log odds of label 1 are where the rows were drawn. Without rows of both classes every text scores the smoothed share of label 1."""
        rows = list(dict.fromkeys(rows))
        labels = np.array([y for _, y in rows], dtype=float)
        self.prior = (labels.sum() + 1) / (len(rows) + 2)
        self.ratio = None
        if len(set(labels.tolist())) < 2:
            return
        count = Counter(itertools.chain.from_iterable(_words(t) for t, _ in rows))
        self.vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in count.items() if n >= MIN_COUNT), 1)}
        beginnings: Counter = Counter()
        for w, n in count.items():
            beginnings[w[:STEM]] += n
        self.stems = {w: i for i, w in enumerate(sorted(w for w, n in beginnings.items() if n >= MIN_COUNT), 1)}
        del count, beginnings
        size, stems = len(self.vocabulary) + 2, len(self.stems) + 1
        self.stem_of = np.array([0, *[self.stems.get(w[:STEM], 0) for w in self.vocabulary], 0], np.int32)
        texts = [self.ids(t) for t, _ in rows]
        pick = lambda y, keep: [t for i, (t, (_, label)) in enumerate(zip(texts, rows, strict=True)) if label == y and keep(i)]
        x = np.zeros((len(rows), 3))
        for fold in (0, 1):  # each half is measured by models of the other half
            half = Ratio(pick(1, lambda i, f=fold: i % 2 != f), pick(0, lambda i, f=fold: i % 2 != f), size, self.stem_of, stems)
            for i, t in enumerate(texts):
                if i % 2 == fold and len(t[0]):
                    x[i] = _features(half.of(*t))
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = _logistic(np.column_stack([np.ones(len(x)), (x - self.shift) / self.scale]), labels)
        self.weights[0] += log_odds
        self.ratio = Ratio(pick(1, lambda i: True), pick(0, lambda i: True), size, self.stem_of, stems)

    def ids(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Word ids and stem ids of a text."""
        words = _words(text)
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.int32, len(words))
        stems = self.stem_of[ids]
        for i in np.flatnonzero(ids == 0).tolist():
            stems[i] = self.stems.get(words[i][:STEM], 0)
        return ids, stems

    def score(self, text: bytes) -> float:
        if self.ratio is None:
            return float(self.prior)
        words, stems = self.ids(text)
        x = (np.array(_features(self.ratio.of(words, stems)) if len(words) else (0.0, 0.0, 0.0)) - self.shift) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, seed: int = 5, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    """Fit on labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Null labels and null ids teach nothing; an id with several labels counts
    as its largest, an id with several texts as the smallest of them.  A task
    holds the texts of the sample, ``max_bytes`` of a class at most (a longer
    document is passed over, never cut); the driver holds their ids and sizes
    and then the model.  Where a class is larger than its part of the sample,
    the intercept is corrected to the odds of all labels.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("mark"))
    marks = marks.where(id_crc("id") % 3 != 1).where("mark in (0, 1)")
    labelled = {r["mark"]: r["n"] for r in marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    limits = ((1, max_toxic), (0, max_ordinary))
    drawn = [marks.where(F.col("mark") == y).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n) for y, n in limits]
    sample = drawn[0].unionAll(drawn[1])  # of a fixed number of rows
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    texts = written(texts.groupBy("id", "mark").agg(F.min("text").alias("text")), "toxicity-sample")
    sizes = texts.select("id", "mark", F.octet_length("text").alias("n"), F.xxhash64(F.lit(seed), "id").alias("place")).collect()
    picked, found, taken = set(), {0: 0, 1: 0}, {0: 0, 1: 0}
    room = {0: max_bytes, 1: max_bytes}
    for r in sorted(sizes, key=lambda r: (r["place"], r["id"])):
        found[r["mark"]] += 1
        if r["n"] <= room[r["mark"]]:
            room[r["mark"]] -= r["n"]
            taken[r["mark"]] += 1
            picked.add(r["id"])
    # what one document of the sample stands for, in either class: labels by those drawn, times documents found by those picked
    stands = [labelled.get(y, 0) / max(1, min(labelled.get(y, 0), most)) * (found[y] / taken[y] if taken[y] else 1) for y, most in limits]
    model = _fitted(texts.where(F.octet_length("text") <= max_bytes), picked, float(np.log(stands[0] / stands[1])) if all(stands) else 0.0)
    discard(texts)
    return model


def _fitted(texts: DataFrame, picked: set, log_odds: float) -> ToxicityModel:
    """The model of the rows (id, mark, text) whose id was ``picked``, fitted in one task; the texts never reach the driver."""
    tune(texts.sparkSession)

    def fit(batches):
        rows = []
        for b in batches:
            rows += [r for r in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True) if r[0] in picked]
        model = pickle.dumps(ToxicityModel([(t, y) for _, t, y in sorted(rows)], log_odds))
        for at in range(0, len(model), MODEL_PART):
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "part": pa.array([model[at : at + MODEL_PART]], pa.binary())})

    parts = sorted(texts.select("id", "text", "mark").coalesce(1).mapInArrow(fit, "at long, part binary").collect())
    return pickle.loads(b"".join(bytes(r["part"]) for r in parts)) if parts else ToxicityModel([], log_odds)


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """Probability of label 1 of each whole text; null counts as empty."""
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.score(t) for t in text_bytes(column)], pa.float64())

    return score(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns.

    Texts of any length are scored whole; null and empty ones score as a text
    without words does; equal texts score equally, so repeated rows stay or go
    together; rows without an id are scored like all others; an empty table
    gives no rows, and without labels of both classes the share of label 1 is
    everyone's score.  Columns of any name pass through.
    """
    return docs.where(score_column(docs.sparkSession, train(docs, labels), F.col("text")) < threshold)


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents``: doc_id, held_out, score, predicted.

    One row per row of the table, repeated rows, null ids and null, empty and
    long texts included; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = docs.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), score_column(spark, model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op3_kneser_ney_toxicity": op3_kneser_ney_toxicity}
ORACLES: dict[str, str] = {}
