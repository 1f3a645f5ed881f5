"""Layers and sources: what a capture keeps, and where a row's ids are found.

A layer is an ordinary DataFrame with pointer columns and id columns; it is
the projection of an operator's input, so nothing is logged by side effect
and a retried task changes nothing.  A source tells how to get from the rows
of a frame to the rows of an access:

* ``Direct``: the ids are columns of the frame;
* ``Via``: columns of the frame point into a layer, which has sources of its own;
* ``Guard``: the sources hold only for rows whose flag has a given value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Direct:
    access: str
    keys: tuple[str, ...]
    cols: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Layer:
    """kind: aggregate, pure_aggregate, exists, in, window, frame or set. ``place``: the row number column of a window layer. ``buckets``: the folders of a stored layer, by the pointer's hash."""

    id: int
    kind: str
    df: DataFrame
    ptr: tuple[str, ...]
    sources: tuple
    place: str | None = None
    buckets: int = 0


@dataclass(frozen=True, eq=False)
class Via:
    """``cols`` of the frame equal the layer's pointer columns, null matching null; ``frame``: columns between which a window row lies."""

    layer: Layer
    cols: tuple[str, ...]
    frame: tuple[str, str] | None = None


@dataclass(frozen=True, eq=False)
class Guard:
    col: str
    value: int
    sources: tuple


Source = Direct | Via | Guard


def hidden(sources) -> list[str]:
    """The frame's columns that the sources need, each once."""
    out: dict[str, None] = {}
    for s in sources:
        if isinstance(s, Direct):
            out |= dict.fromkeys(s.cols)
        elif isinstance(s, Via):
            out |= dict.fromkeys(s.cols + (s.frame or ()))
        else:
            out |= dict.fromkeys([s.col, *hidden(s.sources)])
    return list(out)


def reaches(sources, access: str) -> bool:
    return any(s.access == access if isinstance(s, Direct) else reaches(s.layer.sources if isinstance(s, Via) else s.sources, access) for s in sources)


def layers_of(sources) -> Iterator[Layer]:
    seen: set[int] = set()

    def go(sources):
        for s in sources:
            if isinstance(s, Guard):
                yield from go(s.sources)
            elif isinstance(s, Via) and s.layer.id not in seen:
                seen.add(s.layer.id)
                yield s.layer
                yield from go(s.layer.sources)

    yield from go(sources)


@dataclass(frozen=True, eq=False)
class Captured:
    """A query's frame with its hidden columns, and its sources.

    ``complete``: layers of which every group is still there, so that a
    backtrace of all rows needs no join.  ``order``: the sort of the result.
    ``keys``: output columns that are pointer columns of the root's layer.
    """

    df: DataFrame
    data: tuple[str, ...]
    sources: tuple
    complete: frozenset[int] = field(default_factory=frozenset)
    order: tuple[str, ...] = ()
    keys: tuple[tuple[str, str], ...] = ()

    @property
    def result(self) -> DataFrame:
        return self.df.select(*[F.col(f"`{c}`") for c in self.data])

    def with_(self, **changes) -> Captured:
        return replace(self, **changes)


# --- graph as JSON, layers as parquet -----------------------------------------


def _source_json(s) -> dict:
    if isinstance(s, Direct):
        return {"direct": s.access, "keys": s.keys, "cols": s.cols}
    if isinstance(s, Via):
        return {"via": s.layer.id, "cols": s.cols, "frame": s.frame}
    return {"guard": s.col, "value": s.value, "sources": [_source_json(x) for x in s.sources]}


def graph_json(captured: Captured) -> str:
    """The dependency graph: the root's sources, and each layer with its pointers and sources."""
    layers = [{"id": x.id, "kind": x.kind, "ptr": x.ptr, "place": x.place, "columns": x.df.columns, "sources": [_source_json(s) for s in x.sources]} for x in layers_of(captured.sources)]
    return json.dumps({"data": captured.data, "order": captured.order, "complete": sorted(captured.complete), "keys": captured.keys, "sources": [_source_json(s) for s in captured.sources], "layers": layers}, indent=1)


def bucket_of(pointer: list, buckets: int):
    """The folder that a stored layer's rows with this pointer are in."""
    return F.pmod(F.hash(*pointer), F.lit(buckets))


def save(captured: Captured, path: str, partitions: int = 0) -> Captured:
    """Write result and layers once, from the same run, and return the capture that reads them.

    Layers are sorted by pointer, so that row-group statistics prune a
    single-row backtrace; with ``partitions`` they are also split into that
    many folders by the pointer's hash, of which it opens one.
    """
    spark = captured.df.sparkSession
    captured.df.write.mode("overwrite").parquet(f"{path}/root")
    for layer in layers_of(captured.sources):
        df = layer.df
        if layer.ptr:
            if partitions:
                df = df.withColumn("_bucket", bucket_of([F.col(p) for p in layer.ptr], partitions))
            # the folder first: the writer needs that order, and keeps the pointers' order inside a folder
            df = df.sortWithinPartitions(*(["_bucket"] if partitions else []), *layer.ptr)
        writer = df.write.mode("overwrite")
        (writer.partitionBy("_bucket") if partitions and layer.ptr else writer).parquet(f"{path}/layer_{layer.id}")
    graph = json.dumps(json.loads(graph_json(captured)) | {"buckets": partitions}, indent=1)
    spark.createDataFrame([(graph,)], "graph string").coalesce(1).write.mode("overwrite").text(f"{path}/graph")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Captured:
    graph = json.loads(spark.read.text(f"{path}/graph", wholetext=True).first()[0])
    specs = {x["id"]: x for x in graph["layers"]}
    made: dict[int, Layer] = {}

    def layer(i: int) -> Layer:
        if i not in made:
            x = specs[i]
            buckets = graph.get("buckets", 0) if x["ptr"] else 0
            df = spark.read.parquet(f"{path}/layer_{i}").select(*x["columns"], *(["_bucket"] if buckets else []))
            made[i] = Layer(i, x["kind"], df, tuple(x["ptr"]), tuple(map(source, x["sources"])), x["place"], buckets)
        return made[i]

    def source(x: dict):
        if "direct" in x:
            return Direct(x["direct"], tuple(x["keys"]), tuple(x["cols"]))
        if "via" in x:
            return Via(layer(x["via"]), tuple(x["cols"]), tuple(x["frame"]) if x["frame"] else None)
        return Guard(x["guard"], x["value"], tuple(map(source, x["sources"])))

    return Captured(spark.read.parquet(f"{path}/root"), tuple(graph["data"]), tuple(map(source, graph["sources"])), frozenset(graph["complete"]), tuple(graph["order"]), tuple(map(tuple, graph["keys"])))


def keep_result(captured: Captured) -> Captured:
    """Keep the result with its pointers: the query runs once, and every backtrace starts from the same rows. (What a lost executor held is computed again; where a LIMIT has ties, save instead.)"""
    captured.df.persist()
    return captured


def cached(captured: Captured) -> Captured:
    """Keep result and layers on the executors' disks instead of writing them."""
    from pyspark import StorageLevel

    captured.df.persist(StorageLevel.DISK_ONLY)
    for layer in layers_of(captured.sources):
        layer.df.persist(StorageLevel.DISK_ONLY)
    return captured


def release(captured: Captured) -> None:
    captured.df.unpersist()
    for layer in layers_of(captured.sources):
        layer.df.unpersist()
