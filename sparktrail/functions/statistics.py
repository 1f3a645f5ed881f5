"""What a capture keeps and how much of it: per-layer statistics, sizes, plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import Captured, hidden, layers_of


def layer_statistics(captured: Captured) -> DataFrame:
    """One row per layer: kind, rows, groups, null pointers, width, bytes as plain 8-byte columns, rows per group."""
    parts = []
    for layer in layers_of(captured.sources):
        ids = hidden(layer.sources)
        df = layer.df
        if layer.ptr:
            groups = df.groupBy(*layer.ptr).agg(F.count(F.lit(1)).alias("n"))
            nulls = reduce(lambda a, b: a & b, [F.col(p).isNull() for p in layer.ptr])
        else:
            groups = df.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
            nulls = F.lit(False)
        facts = groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
            F.count(F.lit(1)).cast("long").alias("n_groups"),
            F.coalesce(F.sum(F.when(nulls, F.col("n"))), F.lit(0)).cast("long").alias("null_pointer_rows"),
            F.coalesce(F.min("n"), F.lit(0)).cast("long").alias("min_group"),
            F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_group"),
        )
        width = len(layer.ptr) + len(ids)
        parts.append(facts.select(F.lit(layer.id).alias("layer"), F.lit(layer.kind).alias("kind"), F.lit(len(layer.ptr)).alias("pointer_columns"), F.lit(len(ids)).alias("id_columns"), "n_rows", "n_groups", "null_pointer_rows", "min_group", "max_group", (F.col("n_rows") * 8 * width).cast("long").alias("plain_bytes")))
    return reduce(lambda a, b: a.unionAll(b), parts)


def column_statistics(captured: Captured, layer_id: int) -> DataFrame:
    """Least, greatest and about how many values of each column of a layer."""
    layer = next(x for x in layers_of(captured.sources) if x.id == layer_id)
    parts = [layer.df.agg(F.lit(c).alias("column"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high"), F.approx_count_distinct(c).alias("about_distinct")) for c in layer.df.columns]
    return reduce(lambda a, b: a.unionAll(b), parts)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes that a saved capture takes, asked of whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def plan_text(df: DataFrame, mode: str = "optimized") -> str:
    """The plan Spark made of a capture or a backtrace: analyzed, optimized or executed."""
    execution = df._jdf.queryExecution()
    return {"analyzed": execution.analyzed, "optimized": execution.optimizedPlan, "executed": execution.executedPlan}[mode]().toString()
