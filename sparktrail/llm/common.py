"""Helpers shared by the training-data operators: table access, the shared
folder, written intermediate tables and the tokenisations the contracts fix."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_shipped: dict[str, str] = {}

#: Rows that one window group of the salted numbering should hold.
ROWS_PER_GROUP = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Before Python runs on executors: they get this package, and an Arrow batch holds at most 1,000 rows and 8 MB of them (one row may be larger).

    The two settings stay with the session, as results are lazy and run after the caller has them; a smaller limit that is set already stays.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not 0 < int(str(now).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if _shipped.get("to") != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="sparktrail-")) / "sparktrail_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped["to"] = context.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where that is unset a temporary one is set for a local session; on a cluster, whose executors would each write to their own disk, that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparktrail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: one without is on the cluster's default file system, as everywhere in Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and the rows can't change any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_sparktrail_folder"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``written`` frames that nothing will read any more: all that was made of them is itself written.

    Shuffle files of finished jobs go when the driver's JVM finds their plans
    unreachable, so it is asked to look; else they pile up on the executors
    until the driver's heap happens to be full.
    """
    for df in frames:
        folder = df.__dict__.pop("_sparktrail_folder", None)
        if folder:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def id_crc(col: Column | str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def numbered(rows: DataFrame, group: list[str], key: str, tie: str, total: int, out: str) -> DataFrame:
    """Gapless numbers from 0 inside each ``group``, in the order of the hash ``key``.

    A group may hold a third of all rows, so it is cut into ranges of the
    hash; each range is numbered on its own and the sizes of the ranges
    before it are added.  ``key`` is a uniform 64-bit hash.
    """
    from pyspark.sql import Window

    parts = max(1, -(-total // ROWS_PER_GROUP))
    # the top 31 bits, as a number from 0 to 2^31 - 1, cut into equal ranges: ranges are in the order of the key
    top = F.shiftright(F.col(key), 33) + F.lit(1 << 30)
    rows = rows.withColumn("__range", F.floor(top * F.lit(parts) / F.lit(float(1 << 31))).cast("long"))
    sizes = rows.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__range").orderBy(key, tie)
    rows = rows.withColumn("__in", F.row_number().over(inside))
    return rows.join(sizes, [*group, "__range"]).withColumn(out, (F.col("__before") + F.col("__in") - 1).cast("long")).drop("__range", "__before", "__in")


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty, without making Python strings."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
