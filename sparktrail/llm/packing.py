"""Optimal length buckets.

A histogram of the lengths of all documents is reduced on the cluster; a
dynamic program over it finds the bucket ends that give the least padding
for the allowed number of buckets; batches under a token budget are then
formed inside each bucket.

The histogram is exact.  Documents of d different lengths have more than
d^2 / 2 tokens together, so 30 GB of text have 110,000 different lengths at
the very most, and 100 TB have 7 million; real corpora have far fewer.
"""

from __future__ import annotations

from array import array

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, numbered, table, written

BUCKETS, TOKEN_BUDGET = 16, 65_536


def token_count(text: Column) -> Column:
    """White-space words and one end token; a null or empty text has 1."""
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("long")


def best_buckets(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Ends of at most ``buckets`` buckets with the least padding in total.

    ``histogram``: (length, documents).  With C documents up to a length,
    best[b][j] = min over i of best[b-1][i] + length[j] * (C[j] - C[i]);
    for one b these are lines in length[j], whose lower hull is walked
    once, so the work is buckets x lengths.  Ties take the fewest buckets.
    """
    histogram = sorted((n, c) for n, c in histogram if c > 0)
    if not histogram:
        return []
    lengths = [n for n, _ in histogram]
    upto, total = [], 0
    for _, c in histogram:
        total += c
        upto.append(total)
    size = len(lengths)
    best = [n * c for n, c in zip(lengths, upto, strict=True)]
    back = [array("i", [-1]) * size]
    costs = [best[-1]]
    for _ in range(1, min(buckets, size)):
        hull: list[tuple[int, int, int]] = []  # slope, height, i; slopes fall
        head, now, come = 0, best[:], array("i", [-2]) * size
        for j in range(1, size):
            m, h = -upto[j - 1], best[j - 1]
            while len(hull) - head >= 2 and (h - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                hull.pop()
            hull.append((m, h, j - 1))
            x = lengths[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            cost = hull[head][0] * x + hull[head][1] + x * upto[j]
            if cost < now[j]:
                now[j], come[j] = cost, hull[head][2]
        back.append(come)
        best = now
        costs.append(best[-1])
    level = min(range(len(costs)), key=lambda b: (costs[b], b))
    ends, j = [], size - 1
    while j >= 0:
        ends.append(lengths[j])
        while back[level][j] == -2:  # one bucket less was as good here
            level -= 1
        j = back[level][j]
        level = max(0, level - 1)
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, seed: int = 71) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), position (from 0 in its batch).

    A batch holds max(1, token_budget // bucket_len) documents, so padded it
    stays in the budget unless one document alone is longer; only the last
    batch of a bucket may hold fewer.  Inside a bucket the order is that of a
    seeded hash of the row's place.  Null and empty texts have one token,
    repeated rows are documents of their own, an empty table gives no rows,
    other columns are not looked at.
    """
    base = written(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens"), F.monotonically_increasing_id().alias("pos")), "lengths")
    histogram = [(r["n_tokens"], r["n"]) for r in base.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    total = sum(n for _, n in histogram)
    ends = best_buckets(histogram, buckets)
    bounds = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array(F.lit(1).cast("long"))
    placed = base.select(
        "doc_id", "n_tokens", "pos", F.xxhash64(F.lit(seed), "pos").alias("key"), F.size(F.filter(bounds, lambda e: e < F.col("n_tokens"))).alias("bucket")
    )
    out = numbered(placed, ["bucket"], "key", "pos", total, "slot")
    out = out.withColumn("bucket_len", F.element_at(bounds, F.col("bucket") + 1))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    return out.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("slot") / room).cast("long").alias("batch"), F.pmod(F.col("slot"), room).cast("long").alias("position"))


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 16 optimal buckets, batches of 65,536 padded tokens."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op1_length_buckets": op1_length_buckets}
ORACLES: dict[str, str] = {}
