"""Uniform sharding by a hypergeometric communication matrix (DataFrame functions only).

Law ``rows``: the rows are shuffled uniformly over the shards, whose counts
differ by one at most.

1. Each input partition is a block.  How many of a block's rows go to each
   shard is drawn from the exact law of a uniform shuffle: one row of the
   matrix is a multivariate hypergeometric draw from the room that is left
   in the shards.  Only this matrix is drawn on the driver and broadcast; it
   holds counts, never rows, and at most ``MAX_CELLS`` of them (8 MB): beyond
   65,536 partitions for 16 shards, several partitions make a block.
2. Permute locally: a block's rows are ranked by a seeded hash and the
   ranks are cut at the matrix's running sums.
3. Exchange, and permute again: inside a shard the rows are ordered by a
   second seeded hash, numbered gaplessly by hash ranges, so that no task
   gets a whole shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, table, written

#: Counts in the matrix. 16 shards of 25 billion rows have blocks of some 400,000 rows, sorted by place and hash alone.
MAX_CELLS = 1 << 20


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Marked balls among ``sample`` drawn without replacement; numpy's generator stops at 10^9, so larger
    urns use the ratio-of-uniforms rejection method with log-gamma weights."""
    if not good or not sample:
        return 0
    if not bad:
        return sample
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    p = good / total
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    spread = 1.7156 * math.sqrt((total - sample) * sample * p * (1 - p) / (total - 1) + 0.5) + 0.8989

    def weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(bad - sample + k + 1))

    top, centre = weight(mode), sample * p + 0.5
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(centre + spread * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def communication_matrix(block_sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard; rows sum to the blocks, columns to shard sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(block_sizes)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(block_sizes), shards), dtype=np.int64)
    for b, size in enumerate(block_sizes):
        room = sum(left)
        for s in range(shards):
            room -= left[s]
            got = _hypergeometric(rng, left[s], room, size)
            out[b, s] = got
            left[s] -= got
            size -= got
    return out


def shuffle_into_shards(rows: DataFrame, shards: int = 16, seed: int = 20240917) -> DataFrame:
    """Adds ``shard`` (0 to shards-1) and ``slot`` (gapless from 0) to all rows of ``rows``.

    Rows are told apart by place, not content: repeated rows, null ids and
    ties are ordinary rows.  An empty table gives no rows.  Columns named
    ``shard`` or ``slot`` that the input has are replaced.  The input is
    written to the shared folder once, so a lost executor can't redraw it.
    """
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    base = written(
        rows.select(
            F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
            F.pmod(F.spark_partition_id(), F.lit(max(1, MAX_CELLS // shards))).alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ),
        "shuffle",
    )
    sizes = sorted((r["block"], r["n"]) for r in base.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect())  # MAX_CELLS / shards rows at most
    total = sum(n for _, n in sizes)
    ends = communication_matrix([n for _, n in sizes], shards, seed).cumsum(axis=1)
    plan = spark.createDataFrame([(b, e.tolist()) for (b, _), e in zip(sizes, ends, strict=True)], "block int, ends array<long>")
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "pos", "block"), "pos")))
    sent = ranked.join(F.broadcast(plan), "block").select(
        "row", "pos", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"), F.xxhash64(F.lit(seed + 1), "pos", "block").alias("key")
    )
    out = numbered(sent, ["shard"], "key", "pos", -(-total // shards), "slot")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "shard", "slot")


def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 15 under the law ``rows``. A null text has size 1 and crc 0."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_into_shards(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_hypergeometric_shards": op10_hypergeometric_shards}
ORACLES: dict[str, str] = {}
