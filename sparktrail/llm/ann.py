"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of sixteen full-dimensional codewords, one
of each codebook.  Codebooks are fitted on a bounded sample by residual
k-means and rounds of encoding and least squares; encoding is a beam search
over the residuals.  A query scores all codes through a lookup table of its
inner products with the codewords (for Euclidean distance the stored norms of
the approximations are subtracted); the best ``RERANK`` of every block of the
index are ranked again by the exact measure on the original vectors.  As each
block gives its own, the reranked share does not shrink as the index grows.

Index and queries are cut into blocks, and each pair of blocks is one group
of a cogroup, so neither side is ever broadcast or collected.  Equal vectors
are searched once per block and expanded to their smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tune, written

BOOKS, WORDS, BEAM = 16, 256, 4
#: Rounds of encoding the sample and fitting all codewords to its codes.
ROUNDS = 2
#: Vectors that fit the codebooks, drawn by a seeded hash of the id; every vector is indexed.
SAMPLE = 16_384
#: Rows of a block: the index is shipped queries / QUERY_BLOCK times, the queries index / INDEX_BLOCK times.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 8_192
RERANK = 200
NEIGHBOURS = 20


class AdditiveQuantiser:
    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 3):
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        words = max(1, min(words, len(x)))
        self.codebooks = np.zeros((books, words, x.shape[1]), np.float32)
        rest = x.copy()
        for m in range(books):
            centres = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(8):
                near = (2 * rest @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
                count = np.bincount(near, minlength=words)
                for d in range(x.shape[1]):
                    sums = np.bincount(near, rest[:, d], words)
                    centres[:, d] = np.where(count > 0, sums / np.maximum(count, 1), centres[:, d])
            near = (2 * rest @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
            self.codebooks[m] = centres
            rest = rest - centres[near]
        for _ in range(ROUNDS):
            self._refit(x)

    def _refit(self, x: np.ndarray) -> None:
        """Least squares of all codewords for the codes of the sample, by two sweeps of coordinate descent: a codeword moves by the mean of what is left of its vectors."""
        codes = self.encode(x).astype(np.int64)
        rest = x - self.decode(codes)
        words = self.codebooks.shape[1]
        for _ in range(2):
            for m, book in enumerate(self.codebooks):
                own = codes[:, m]
                sums = np.stack([np.bincount(own, rest[:, d], words) for d in range(x.shape[1])], axis=1)
                step = (sums / np.maximum(np.bincount(own, minlength=words), 1)[:, None]).astype(np.float32)
                book += step
                rest -= step[own]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n x books) by beam search over the codebooks in order."""
        books, words, dim = self.codebooks.shape
        norms = (self.codebooks**2).sum(axis=2)
        out = np.zeros((len(x), books), np.uint8 if words <= 256 else np.uint16)
        for start in range(0, len(x), 512):
            part = x[start : start + 512].astype(np.float32)
            rest, error = part[:, None, :], (part**2).sum(axis=1)[:, None]
            codes = np.zeros((len(part), 1, 0), np.int64)
            for m, book in enumerate(self.codebooks):
                inner = (rest.reshape(-1, dim) @ book.T).reshape(len(part), -1, words)
                cost = (error[:, :, None] + norms[m] - 2 * inner).reshape(len(part), -1)
                keep = min(beam, cost.shape[1])
                best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(cost, best, axis=1)
                parent, word = best // words, best % words
                codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None]), axis=2)
                rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
            out[start : start + 512] = codes[np.arange(len(part)), error.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.codebooks[m, codes[:, m]] for m in range(len(self.codebooks)))


def usable(vector: str = "embedding"):
    """Vectors that take part: not null, not empty, all components finite, one of them not zero."""
    finite = F.forall(vector, lambda v: F.coalesce((v == v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(quantiser: AdditiveQuantiser, dim: int, k: int, rerank: int, measure: str):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids = index.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(_matrix(index.column("embedding"), dim)[order])
        codes = np.frombuffer(b"".join(index.column("codes").to_pylist()), quantiser.encode(vectors[:1]).dtype).reshape(len(ids), -1)[order]
        norms = index.column("norm").to_numpy()[order]
        _, first, member = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
        same = np.argsort(member, kind="stable")  # rows by distinct vector, ids rising
        begin = np.searchsorted(member[same], np.arange(len(first) + 1))
        exact, codes, norms = vectors[first].astype(np.float64), codes[first].astype(np.int64), norms[first]
        own, q = queries.column("query_id").to_numpy(), _matrix(queries.column("query"), dim)
        out = []
        for start in range(0, len(own), 32):
            part = q[start : start + 32].astype(np.float32)
            lookup = np.einsum("qd,mwd->qmw", part, quantiser.codebooks, optimize=True)
            rough = np.zeros((len(part), len(first)), np.float32)
            for m in range(lookup.shape[1]):
                rough += lookup[:, m, codes[:, m]]
            if measure == "l2":
                rough = 2 * rough - norms.astype(np.float32)
            take = min(rerank, rough.shape[1])
            best = np.argpartition(-rough, take - 1, axis=1)[:, :take]
            for r in range(len(part)):
                query = q[start + r].astype(np.float64)
                v = exact[best[r]]
                score = (v * query).sum(axis=1) if measure == "inner_product" else -((v - query) ** 2).sum(axis=1)
                top = np.argsort(-score, kind="stable")
                # ties of different vectors at the cut stay in: all as good as the (k+1)th
                top = top[score[top] >= score[top[min(k, take - 1)]]]
                rows = np.concatenate([same[begin[best[r][t]] : min(begin[best[r][t]] + k + 1, begin[best[r][t] + 1])] for t in top])
                values = np.repeat(score[top], [min(k + 1, begin[best[r][t] + 1] - begin[best[r][t]]) for t in top])
                found = ids[rows]
                keep = found != own[start + r]
                found, values = found[keep], values[keep]
                chosen = np.lexsort((found, -values))[:k]
                out.append((np.full(len(chosen), own[start + r]), found[chosen], values[chosen]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, measure: str = "inner_product", rerank: int = RERANK) -> DataFrame:
    """For each query (query_id, query) its ``k`` best rows of ``index`` (vec_id, embedding) but the one of its own id.

    ``measure``: "inner_product" or "l2" (score: minus the squared
    distance).  Vectors that are null, empty, zero or hold null or
    non-finite components, and those of another dimension than most, take no
    part.  A repeated id counts once, with its smallest vector.  Best first,
    ties to the smaller id; an empty index gives no rows.
    """
    spark = index.sparkSession
    tune(spark)
    index = index.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<float>").alias("query")).where(usable("query") & F.col("query_id").isNotNull())
    sizes = index.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    index = index.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = queries.where(F.size("query") == dim).groupBy("query_id").agg(F.min("query").alias("query"))
    drawn = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    quantiser = AdditiveQuantiser(_matrix(drawn.column("embedding"), dim))
    shared = spark.sparkContext.broadcast(quantiser)  # the codebooks alone: 16 x 256 vectors

    def encode(batches):
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            # equal vectors get equal codes whatever batch they are in: each distinct one is encoded on its own row
            codes = shared.value.encode(x)
            norm = (shared.value.decode(codes) ** 2).sum(axis=1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], names=["vec_id", "embedding", "codes", "norm"])

    coded = written(index.mapInArrow(encode, "vec_id long, embedding array<float>, codes binary, norm double"), "ann-index")
    queries = written(queries, "ann-queries")
    blocks, asked = max(1, -(-coded.count() // INDEX_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("asked", every(asked))
    right = queries.withColumn("asked", F.pmod(F.xxhash64("query_id"), F.lit(asked)).cast("int")).withColumn("block", every(blocks))

    def search(one: pa.Table, two: pa.Table) -> pa.Table:
        return _search(shared.value, dim, k, rerank, measure)(one, two)

    found = left.groupBy("block", "asked").cogroup(right.groupBy("block", "asked")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op6_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of each vector of ``embeddings`` whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return nearest(rows, queries)


QUERIES = {"op6_additive_quantisation": op6_additive_quantisation}
ORACLES: dict[str, str] = {}
