import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import ann

SF = "/root/testdata/sf0.01"


def recall(found, vectors, ids, queries, k, score):
    hits = total = 0
    by = {}
    for r in found:
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in queries:
        s = score(vectors, vectors[ids.index(q)])
        order = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        hits += len(by[q] & set(order))
        total += len(order)
    return hits / total


@pytest.mark.parametrize("measure", ["inner_product", "l2"])
def test_recall(spark, measure, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 200)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = rows.select("vec_id", "embedding").toPandas()
    ids, x = pdf.vec_id.tolist(), np.array(pdf.embedding.tolist(), np.float64)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = ann.nearest(rows, queries, 20, measure, rerank=60).collect()
    score = {"inner_product": lambda v, q: v @ q, "l2": lambda v, q: -((v - q) ** 2).sum(axis=-1)}[measure]
    assert recall(found, x, ids, [i for i in ids if i % 20 == 0], 20, score) >= 0.9
    for r in found:
        assert r["score"] == pytest.approx(score(x[ids.index(r["vec_id"])], x[ids.index(r["query_id"])]), abs=1e-12)
    ranks = {}
    for r in found:
        ranks.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    assert all(sorted(v) == sorted(v, key=lambda t: t[1:]) and [t[0] for t in sorted(v)] == list(range(1, 21)) for v in ranks.values())


def test_query_recall(spark):
    pdf = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = pdf.vec_id.tolist(), np.array(pdf.embedding.tolist(), np.float64)
    found = ann.op6_additive_quantisation(spark, SF).collect()
    assert recall(found, x, ids, [i for i in ids if i % 20 == 0], 20, lambda v, q: v @ q) >= 0.9


def test_recall_of_a_full_block():
    """One block of production size, of vectors without any structure (the hardest ones), production parameters."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(ann.INDEX_BLOCK, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    aq = ann.AdditiveQuantiser(x[rng.permutation(len(x))[: ann.SAMPLE // 2]])
    codes = aq.encode(x)
    norms = (aq.decode(codes) ** 2).sum(axis=1).astype(np.float64)
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 160)
    index = pa.table({"vec_id": ids, "embedding": pa.array(list(x)), "codes": [c.tobytes() for c in codes], "norm": norms})
    queries = pa.table({"query_id": asked, "query": pa.array(list(x[asked]))})
    found = ann._search(aq, 64, 20, ann.RERANK, "inner_product")(index, queries).to_pylist()
    assert recall(found, x.astype(np.float64), ids.tolist(), asked.tolist(), 20, lambda v, q: v @ q) >= 0.9


def test_ties_copies_and_bad_vectors(spark):
    good = [(i, [1.0, float(i % 3)], "x") for i in range(40, 0, -1)]
    bad = [(100, None, "x"), (101, [0.0, 0.0], "x"), (102, [float("nan"), 1.0], "x"), (103, [None, 1.0], "x"), (104, [float("inf"), 1.0], "x"), (105, [1.0], "x"), (106, [], "x"), (None, [1.0, 1.0], "x"), (7, [1.0, 1.0], "again")]
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, score string")
    queries = spark.createDataFrame([(40, [1.0, 1.0]), (200, [1.0, 2.0]), (300, None)], "query_id long, query array<float>")
    found = ann.nearest(rows, queries, 5).collect()
    by = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (40, 200)}
    assert by[40] == [(k + 1, i, 3.0) for k, i in enumerate((2, 5, 8, 11, 14))]
    assert by[200] == [(k + 1, i, 5.0) for k, i in enumerate((2, 5, 8, 11, 14))]
    few = ann.nearest(rows.where("vec_id <= 3"), queries, 5).collect()
    assert sorted(r["vec_id"] for r in few if r["query_id"] == 200) == [1, 2, 3]


def test_empty(spark):
    rows = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(500, 16)).astype(np.float32)
    aq = ann.AdditiveQuantiser(x, 4, 32)
    error = lambda beam: ((x - aq.decode(aq.encode(x, beam))) ** 2).sum()
    assert error(8) <= error(1) * 1.001 < (x**2).sum()
