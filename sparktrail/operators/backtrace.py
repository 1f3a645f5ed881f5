"""Backtrace: from output rows through the layers to the rows of one access.

Each pointer step is one null-safe equi-join (a bucketed range join for
window frames); paths to the same access are united.  A layer without
pointers (an aggregate without GROUP BY) belongs to every output row: its
ids are returned once, guarded by the existence of an output row, instead of
being multiplied with the output.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .layers import Captured, Direct, Guard, Via, bucket_of, hidden, reaches

#: Row numbers per bucket of the range join for window frames.
FRAME_BUCKET = 1024
#: Groups that a layer's ids are dealt to, by their hash, where every output row gets all of them, and the most ids of a group in one array.
GROUPS = 1024
ARRAY = 128
#: Root rows whose pointers may be written into the plan as literals.
MAX_LITERALS = 1


def _wanted(sources, access: str) -> list[str]:
    return hidden([s for s in sources if reaches([s], access)])


def _follow(df: DataFrame, sources, access: str, keep: list[str], factored: bool) -> list[DataFrame]:
    out = []
    for s in sources:
        if not reaches([s], access):
            continue
        if isinstance(s, Direct):
            out.append(df.select(*keep, *[F.col(c).alias(f"{access}_{k}") for k, c in zip(s.keys, s.cols, strict=True)]))
        elif isinstance(s, Guard):
            out += _follow(df.where(F.col(s.col) == s.value), s.sources, access, keep, factored)
        else:
            joined, kept = _step(df, s, access, keep, factored)
            out += _follow(joined, s.layer.sources, access, kept, factored)
    return out


def _step(df: DataFrame, s: Via, access: str, keep: list[str], factored: bool) -> tuple[DataFrame, list[str]]:
    layer = s.layer
    ids = _wanted(layer.sources, access)
    if not s.cols and s.frame is None:
        if factored:  # the same for all output rows: once, if there is any
            there = df.limit(1).select(F.lit(1).alias("_any"))
            return layer.df.select(*ids).crossJoin(F.broadcast(there)).drop("_any"), []
        return _multiplied(df.select(*keep), layer.df.select(*ids)), keep
    names = [f"_l_{i}" for i in range(len(layer.ptr))]
    right = layer.df.select(*[F.col(p).alias(n) for p, n in zip(layer.ptr, names, strict=True)], *ids, *([F.col(layer.place).alias("_l_rn")] if s.frame else []))
    left = df.select(*dict.fromkeys([*keep, *s.cols, *(s.frame or ())]))
    # ids that the frame has too are those of the layer from here on
    clash = [c for c in left.columns if c in ids]
    left = left.withColumnsRenamed({c: f"_f_{c}" for c in clash})
    at = {c: f"_f_{c}" if c in clash else c for c in (*s.cols, *(s.frame or ()))}
    on = [F.col(at[c]).eqNullSafe(F.col(n)) for c, n in zip(s.cols, names, strict=True)]
    if s.frame:
        lo, hi = (F.col(at[c]) for c in s.frame)
        left = left.withColumn("_f_bucket", F.explode(F.sequence(F.floor(lo / FRAME_BUCKET), F.floor(hi / FRAME_BUCKET))))
        right = right.withColumn("_l_bucket", F.floor(F.col("_l_rn") / FRAME_BUCKET))
        on += [F.col("_f_bucket") == F.col("_l_bucket"), F.col("_l_rn").between(lo, hi)]
    kept = [f"_f_{k}" if k in clash else k for k in keep]
    joined = left.join(right, reduce(lambda a, b: a & b, on))
    return joined.select(*[F.col(k).alias(o) for k, o in zip(kept, keep, strict=True)], *ids), keep


def _multiplied(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``right``.

    The product is far larger than both, so its tasks must not follow from
    their files, which may be a single one: both sides are dealt out, and each
    pair of their partitions is a task.  ``right`` comes in short arrays, as a
    generated loop holds all that it makes of one row.  The hint keeps Spark
    from a broadcast join: its loop makes all pairs of one streamed row, so it
    would hold an array once for every output row.  Arrays are the outer side,
    as the same ids one after the other make small files.
    """
    if not left.columns or not right.columns:
        return left.crossJoin(right)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = math.isqrt(tasks)
    arrays = _in_arrays(right, math.ceil(tasks / some))
    pairs = arrays.hint("shuffle_replicate_nl").crossJoin(left.repartition(some))
    return pairs.select(*left.columns, F.explode("_ids").alias("_id")).select(*left.columns, *[F.col("_id")[c].alias(c) for c in right.columns])


def _in_arrays(df: DataFrame, tasks: int) -> DataFrame:
    """The rows as structs, in arrays ``_ids`` of ARRAY at most, however often a row is repeated."""
    at = F.pmod(F.xxhash64(*df.columns), F.lit(GROUPS))
    dealt = df.select(at.alias("_at"), F.struct(*df.columns).alias("_row")).repartition(tasks, "_at")
    part = F.floor((F.row_number().over(W.partitionBy("_at").orderBy("_at")) - 1) / ARRAY)
    return dealt.withColumn("_part", part).groupBy("_at", "_part").agg(F.collect_list("_row").alias("_ids")).select("_ids")


def _first_step(captured: Captured, root: DataFrame, access: str, keep: list[str], factored: bool) -> list[DataFrame]:
    """A single output row: its pointers become literals in the layer's filter, so the scan itself is pruned."""
    rows = root.limit(MAX_LITERALS + 1).collect()
    if len(rows) != 1:
        return _follow(root, captured.sources, access, keep, factored)
    row, out = rows[0], []
    spark = root.sparkSession
    here = spark.createDataFrame([row], root.schema)

    def go(sources):
        for s in sources:
            if not reaches([s], access):
                continue
            if isinstance(s, Guard):
                if row[s.col] == s.value:
                    yield from go(s.sources)
            elif isinstance(s, Via) and s.cols and s.frame is None:
                kinds = {f.name: f.dataType for f in root.schema.fields}
                values = [F.lit(row[c]).cast(kinds[c]) for c in s.cols]
                test = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(v) for p, v in zip(s.layer.ptr, values, strict=True)])
                if s.layer.buckets:
                    test &= F.col("_bucket") == bucket_of(values, s.layer.buckets)
                found = s.layer.df.where(test).select(*_wanted(s.layer.sources, access), *[F.lit(row[k]).cast(kinds[k]).alias(k) for k in keep])
                yield from _follow(found, s.layer.sources, access, keep, factored)
            else:
                yield from _follow(here, [s], access, keep, factored)

    out.extend(go(captured.sources))
    return out


def backtrace(captured: Captured, access: str, outputs: list[str] | None = None, where: str | None = None, offset: int | None = None, factored: bool = True) -> DataFrame:
    """Rows (out_<column>..., <access>_<key>...): which rows of ``access`` are behind which output row, as a bag.

    ``outputs``: the output columns that tell rows apart (default: all).
    ``where``: a condition on the output, or ``offset``: the place of one
    output row in the result's order (which must be total); either makes it
    a backtrace of single rows.  Ids behind a layer without pointers come
    without output columns unless ``factored`` is false.
    """
    if not reaches(captured.sources, access):
        raise ValueError(f"{access} has no lineage in this query")
    outputs = list(captured.data if outputs is None else outputs)
    if where is None and offset is None:
        whole = _whole_layer(captured, outputs)
        if whole is not None:
            df, layer = whole
            return _union(_follow(df, layer.sources, access, [f"out_{o}" for o in outputs], factored))
    root = captured.df
    if where is not None:
        root = root.where(F.expr(where))
    if offset is not None:
        from .capture import _sorts

        root = (root.orderBy(*_sorts(captured.order)) if captured.order else root).offset(offset).limit(1)
    needed = _wanted(captured.sources, access)
    root = root.select(*[F.col(f"`{o}`").alias(f"out_{o}") for o in outputs], *needed)
    keep = [f"out_{o}" for o in outputs]
    single = where is not None or offset is not None
    parts = _first_step(captured, root, access, keep, factored) if single else _follow(root, captured.sources, access, keep, factored)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _whole_layer(captured: Captured, outputs: list[str]):
    """Where every group of the last aggregation is in the output and only its keys are asked for, its layer with those keys; no join is needed then."""
    keys = dict(captured.keys)
    if len(captured.sources) != 1 or not isinstance(captured.sources[0], Via):
        return None
    layer = captured.sources[0].layer
    if layer.id not in captured.complete or not set(outputs) <= set(keys):
        return None
    return layer.df.select("*", *[F.col(keys[o]).alias(f"out_{o}") for o in outputs]), layer


def lineage(captured: Captured, access: str, where: str | None = None, offset: int | None = None) -> DataFrame:
    """The distinct ids of the rows of ``access`` behind the (chosen) output: <access>_<key>, without nulls from outer joins."""
    keys = _keys(captured.sources, access)
    return backtrace(captured, access, [], where, offset).select(*keys).distinct().where(" OR ".join(f"`{k}` IS NOT NULL" for k in keys))


def _keys(sources, access: str) -> list[str]:
    for s in sources:
        if isinstance(s, Direct) and s.access == access:
            return [f"{access}_{k}" for k in s.keys]
        if not isinstance(s, Direct) and reaches([s], access):
            return _keys(s.layer.sources if isinstance(s, Via) else s.sources, access)
    raise ValueError(f"{access} has no lineage in this query")


def as_view(captured: Captured, access: str, name: str) -> DataFrame:
    """The lineage relation under a name that SQL can read."""
    df = backtrace(captured, access)
    df.createOrReplaceTempView(name)
    return df
