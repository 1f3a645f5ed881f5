from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktrail.llm import sharding
from sparktrail.llm.common import numbered


def test_matrix_margins():
    sizes = [0, 5, 17, 100, 3]
    m = sharding.communication_matrix(sizes, 7, 1)
    assert m.sum(axis=1).tolist() == sizes and m.sum() == 125
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()


def test_matrix_law():
    # the rows of the first block in the first shard: hypergeometric with mean 5 and variance 25/19
    draws = np.array([sharding.communication_matrix([10, 10], 2, s)[0, 0] for s in range(4000)])
    assert abs(draws.mean() - 5) < 0.1 and abs(draws.var() - 25 / 19) < 0.12


def test_large_urns():
    rng = np.random.default_rng(0)
    small = [sharding._hypergeometric(rng, 3 * 10**9, 7 * 10**9, 1000) for _ in range(2000)]
    assert abs(np.mean(small) - 300) < 2 and abs(np.std(small) - 14.5) < 1.5


@pytest.mark.parametrize("cells", [1 << 20, 32])
def test_shuffle(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "MAX_CELLS", cells)  # 32: six partitions in two blocks
    rows = spark.range(5000, numPartitions=6).select((F.col("id") % 1700).alias("doc_id"), F.lit("x").alias("shard"), F.lit(3).alias("rank"), F.lit(None).cast("string").alias("text"))
    out = sharding.shuffle_into_shards(rows, 16)
    found = out.collect()
    assert out.columns == ["doc_id", "rank", "text", "shard", "slot"]
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in rows.collect())
    per = Counter(r["shard"] for r in found)
    assert len(per) == 16 and max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n))
    assert [tuple(r) for r in out.orderBy("shard", "slot").collect()] == [tuple(r) for r in out.orderBy("shard", "slot").collect()]


def test_empty(spark):
    assert sharding.shuffle_into_shards(spark.createDataFrame([], "doc_id long")).count() == 0


def test_numbering_by_ranges(spark, monkeypatch):
    monkeypatch.setattr("sparktrail.llm.common.ROWS_PER_GROUP", 100)
    rows = spark.range(2000).select("id", (F.col("id") % 3 > 0).cast("int").alias("g"), F.xxhash64("id").alias("key"))
    found = numbered(rows, ["g"], "key", "id", 2000, "n").collect()
    for g in (0, 1):
        own = sorted((r for r in found if r["g"] == g), key=lambda r: r["key"])
        assert [r["n"] for r in own] == list(range(len(own)))


def test_query(spark):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in sharding.op10_hypergeometric_shards(spark, "/root/testdata/sf0.001").collect():
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
