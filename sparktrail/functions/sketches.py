"""Provenance sketches: a bit for each range of an attribute that the lineage touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds written into the plan as literals; more are joined as a table.
LITERAL_BOUNDS = 256


def equal_width(table: DataFrame, column: str, ranges: int) -> list[float]:
    """Inner bounds of ``ranges`` ranges of equal width; one row comes to the driver."""
    low, high = table.agg(F.min(column), F.max(column)).first()
    return [] if low is None else [low + (high - low) * i / ranges for i in range(1, ranges)]


def equal_depth(table: DataFrame, column: str, ranges: int, error: float = 0.0001) -> list[float]:
    """Inner bounds with about as many rows in each range."""
    found = table.approxQuantile(column, [i / ranges for i in range(1, ranges)], error) if ranges > 1 else []
    return sorted(set(found))


def bucket(column: str | Column, bounds: Sequence[float]) -> Column:
    """The number of the range a value is in: how many bounds are not above it."""
    c = F.col(column) if isinstance(column, str) else column
    if len(bounds) == 0:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds])
    # bounds are sorted: halve the interval once per bit of their number, inside generated code
    at = F.lit(0)
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        ahead = at + step
        at = F.when((ahead <= len(bounds)) & (F.try_element_at(array, F.least(ahead, F.lit(len(bounds)))) <= c), ahead).otherwise(at)
        step >>= 1
    return at


def _bucketed(lineage: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    if len(bounds) <= LITERAL_BOUNDS:
        return lineage.withColumn("_bucket", bucket(column, bounds).cast("long"))
    # many bounds: a table of coarse cells, joined by cell and range; its size is that of the sketch
    spark = lineage.sparkSession
    low, high, n = bounds[0], bounds[-1], len(bounds)
    width = (high - low) / n or 1.0
    edges = [(i, None if i == 0 else float(bounds[i - 1]), None if i == n else float(bounds[i])) for i in range(n + 1)]
    cell = lambda c: F.least(F.greatest(F.floor((c - low) / width), F.lit(-1)), F.lit(n)).cast("long")
    ranges = spark.createDataFrame(edges, "_bucket long, _from double, _to double")
    ranges = ranges.withColumn("_cell", F.explode(F.sequence(F.when(F.col("_from").isNull(), -1).otherwise(cell(F.col("_from"))).cast("long"), F.when(F.col("_to").isNull(), n).otherwise(cell(F.col("_to"))).cast("long"))))
    left = lineage.withColumn("_cell", cell(F.col(column)))
    inside = (F.col("_from").isNull() | (F.col(column) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(column) < F.col("_to")))
    return left.join(ranges, "_cell").where(inside).drop("_cell", "_from", "_to")


def sketch64(lineage: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """One long whose bit i tells whether the lineage has a value in range i (64 ranges at most)."""
    if len(bounds) > 63:
        raise ValueError("more than 64 ranges; use sketch()")
    return _bucketed(lineage, column, bounds).where(F.col(column).isNotNull()).agg(F.coalesce(F.expr("bit_or(shiftleft(1L, CAST(_bucket AS INT)))"), F.lit(0).cast("long")).alias("sketch"))


def sketch(lineage: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """Any number of ranges: (chunk, bits), 32,768 ranges to a chunk of 4,096 bytes. Partial sketches of the partitions are or-ed, so a shuffle moves bitmaps, not ids."""
    rows = _bucketed(lineage, column, bounds).where(F.col(column).isNotNull())
    return rows.groupBy(F.expr("bitmap_bucket_number(_bucket)").alias("chunk")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_bucket))").alias("bits"))


def ranges_touched(lineage: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    return _bucketed(lineage, column, bounds).where(F.col(column).isNotNull()).select(F.col("_bucket").alias("range")).distinct()


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sketches are equal."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def skip(table: DataFrame, column: str, bounds: Sequence[float], bits: int) -> DataFrame:
    """Use a 64-bit sketch: only the rows in ranges it has."""
    return table.where(F.getbit(F.lit(bits).cast("long"), bucket(column, bounds).cast("int")) == 1)
