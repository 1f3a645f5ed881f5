"""Reading and making tables: Parquet, CSV in and out, synthetic and Zipf-distributed rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Columns that identify a row. lineitem has no key in these tables; these columns of a row are distinct.
KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"),
    "events": ("event_id",),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_csv(df: DataFrame, path: str) -> None:
    """Lineage (or any flat table) as CSV with a header; nulls are empty, text is quoted where needed."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("emptyValue", "").schema(schema).csv(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Save a lineage relation as a table and read it from there."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def csv_to_table(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    return materialise(read_csv(spark, path, schema), name)


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder for stored captures under ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sparktrail-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """Any query over the session's tables and views, lineage views included."""
    return spark.sql(text)


def series(spark: SparkSession, n: int, columns: int = 1, modulus: int = 97) -> DataFrame:
    """``n`` rows of ``column_1..column_k``: (i mod modulus) + i."""
    return spark.range(n).select(*[(F.col("id") % modulus + F.col("id")).alias(f"column_{c}") for c in range(1, columns + 1)])


def chain(spark: SparkSession, lengths: list[int]) -> list[DataFrame]:
    """Tables for join chains: each has ``idx`` 0..n-1 and ``up``, the row of the table before that it belongs to."""
    out = []
    for i, n in enumerate(lengths):
        before = lengths[i - 1] if i else 1
        out.append(spark.range(n).select(F.col("id").alias(f"idx_{i}"), (F.col("id") % before).alias(f"up_{i}")))
    return out


def zipf(spark: SparkSession, rows: int, groups: int, skew: float, seed: int = 1) -> DataFrame:
    """(id, z, val): z from 1 to ``groups`` by Zipf's law with exponent ``skew``, val uniform from 1 to 100.

    The inverse of the distribution function: the running sums of i^-skew
    are a small array in the plan (one entry per group) in which each row's
    uniform number is looked up; the rows themselves are made on the cluster.
    """
    weights = [i**-skew for i in range(1, groups + 1)]
    total, sums, at = sum(weights), [], 0.0
    for w in weights:
        at += w / total
        sums.append(at)
    table = spark.createDataFrame([(i + 1, (sums[i - 1] if i else 0.0), sums[i] if i + 1 < groups else 1.0) for i in range(groups)], "z long, low double, high double")
    cells = 1024
    cut = table.select("z", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell"))
    base = spark.range(rows).select("id", F.rand(seed).alias("u"), (F.floor(F.rand(seed + 1) * 100) + 1).cast("int").alias("val")).withColumn("cell", F.floor(F.col("u") * cells))
    return base.join(F.broadcast(cut), (base["cell"] == cut["cell"]) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("id", "z", "val")
