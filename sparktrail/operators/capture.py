"""Capture: one provenance rule per operator.

``capture(plan)`` builds, for every node, the frame that computes it with
hidden id columns carried along, and the layers that an output row's
pointers lead into.  The pointer of a group is its key, so the layer of an
aggregation is just its input, projected.  Everything stays a DataFrame;
Catalyst decides how it runs.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import nodes as N
from .layers import Captured, Direct, Guard, Layer, Via, hidden


def capture(plan: N.Plan) -> Captured:
    return _Capture().of(plan)


_SORT = re.compile(r"(?P<by>.*?)(?:\s+(?P<way>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?\s*", re.IGNORECASE | re.DOTALL)


def _sorts(order) -> list[Column]:
    """Sort texts such as "x desc" or "x asc nulls last" as columns; without a word on nulls they are the smallest."""
    out = []
    for o in order:
        by, way, nulls = (g and g.lower() if i else g for i, g in enumerate(_SORT.fullmatch(o.strip()).groups()))
        name = {"desc": "desc"}.get(way, "asc") + (f"_nulls_{nulls}" if nulls else "")
        out.append(getattr(F.expr(by), name)())
    return out


_PEERS = re.compile(r"\s*(?:rank|dense_rank|percent_rank|cume_dist)\s*\(", re.IGNORECASE)


class _Capture:
    def __init__(self):
        self.ids = itertools.count(1)

    def of(self, node: N.Plan) -> Captured:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    # --- scan, filter, project, sort, limit: ids ride along -------------------

    def _scan(self, n: N.Scan) -> Captured:
        data = [n.name(c) for c in n.table.columns]
        if n.keys is None:
            ids = [F.col("_metadata.file_path").alias(f"_p_{n.access}_file"), F.col("_metadata.row_index").alias(f"_p_{n.access}_row")]
            keys = ("file", "row")
        else:
            ids = [F.col(f"`{k}`").alias(f"_p_{n.access}_{k}") for k in n.keys]
            keys = n.keys
        df = n.table.select(*[F.col(f"`{c}`").alias(d) for c, d in zip(n.table.columns, data, strict=True)], *ids)
        return Captured(df, tuple(data), (Direct(n.access, tuple(keys), tuple(f"_p_{n.access}_{k}" for k in keys)),))

    def _filter(self, n: N.Filter) -> Captured:
        c = self.of(n.child)
        return c.with_(df=c.df.where(F.expr(n.condition)), complete=frozenset())

    def _project(self, n: N.Project) -> Captured:
        c = self.of(n.child)
        df = c.df.select(*[F.expr(e).alias(name) for name, e in n.columns.items()], *hidden(c.sources))
        same = {name: e.strip("`") for name, e in n.columns.items()}
        ptr = dict(c.keys)
        return c.with_(df=df, data=tuple(n.columns), keys=tuple((name, ptr[e]) for name, e in same.items() if e in ptr))

    def _sort(self, n: N.Sort) -> Captured:
        c = self.of(n.child)
        return c.with_(df=c.df.orderBy(*_sorts(n.order)), order=n.order)

    def _limit(self, n: N.Limit) -> Captured:
        c = self.of(n.child)
        df = c.df.offset(n.offset) if n.offset else c.df
        df = df if n.n is None else df.limit(n.n)
        return c.with_(df=df, complete=frozenset())

    # --- joins ---------------------------------------------------------------

    def _join(self, n: N.Join) -> Captured:
        left, right = self.of(n.left), self.of(n.right)
        if n.how in ("right", "full"):
            left = self._optional(left)
        if n.how in ("left", "full"):
            right = self._optional(right)
        if n.how == "cross":
            df = left.df.crossJoin(right.df) if self._one_row(n.right) else left.df.join(right.df, F.expr(n.on))
        else:
            df = left.df.join(right.df, F.expr(n.on), {"full": "full_outer"}.get(n.how, n.how))
        return Captured(df, left.data + right.data, left.sources + right.sources)

    @staticmethod
    def _one_row(n: N.Plan) -> bool:
        return isinstance(n, N.Aggregate) and not n.keys

    def _optional(self, c: Captured) -> Captured:
        """The side of an outer join that may be missing: pointers count only where its flag is there. Plain ids are null there by themselves."""
        if not any(isinstance(s, (Via, Guard)) for s in c.sources):
            return c
        flag = f"_m_{next(self.ids)}"
        plain = tuple(s for s in c.sources if isinstance(s, Direct))
        rest = tuple(s for s in c.sources if not isinstance(s, Direct))
        return c.with_(df=c.df.withColumn(flag, F.lit(1)), sources=(*plain, Guard(flag, 1, rest)))

    def _exists(self, n: N.Exists) -> Captured:
        left, right = self.of(n.left), self.of(n.right)
        matches = [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in n.on] + ([F.expr(n.residual)] if n.residual else [])
        if not matches:  # one row decides for all output rows, and all rows are behind each of them
            any_ = F.broadcast(right.df.limit(1).agg(F.count(F.lit(1)).alias("_n_any")))
            there = F.col("_n_any") == (0 if n.negated else 1)
            df = left.df.crossJoin(any_).where(there).drop("_n_any")
            if n.negated:
                return left.with_(df=df, complete=frozenset())
            layer = Layer(next(self.ids), "pure_aggregate", right.df.select(*hidden(right.sources)), (), right.sources)
            return Captured(df, left.data, (*left.sources, Via(layer, ())), order=left.order)
        condition = reduce(lambda a, b: a & b, matches)
        if n.negated:  # nothing of the negated side is lineage
            if n.null_aware:
                return left.with_(df=_not_in(left.df, right.df, *n.on[0]), complete=frozenset())
            return left.with_(df=left.df.join(right.df, condition, "left_anti"), complete=frozenset())
        i = next(self.ids)
        if n.on and not n.residual:  # the equal values themselves point to the witnesses
            ptr = tuple(f"_ptr_{i}_{k}" for k in range(len(n.on)))
            layer = Layer(i, "in", right.df.select(*[F.col(f"`{b}`").alias(p) for (_, b), p in zip(n.on, ptr, strict=True)], *hidden(right.sources)), ptr, right.sources)
            df = left.df.join(right.df, condition, "left_semi").withColumns({p: F.col(f"`{a}`") for (a, _), p in zip(n.on, ptr, strict=True)})
            return Captured(df, left.data, (*left.sources, Via(layer, ptr)), order=left.order)
        # any condition: the outer values that it reads beside the ids of every witness
        read = [d for d in left.data if d in {a for a, _ in n.on} or d in (n.residual or "")]
        if not read:
            raise ValueError(f"an EXISTS whose condition reads nothing of the outer side: {n.residual}")
        ptr = tuple(f"_ptr_{i}_{k}" for k in range(len(read)))
        outer = left.df.select(*[F.col(f"`{d}`") for d in read]).distinct()
        pairs = outer.join(right.df, condition).select(*[F.col(f"`{d}`").alias(p) for d, p in zip(read, ptr, strict=True)], *hidden(right.sources))
        layer = Layer(i, "exists", pairs, ptr, right.sources)
        df = left.df.join(right.df, condition, "left_semi").withColumns({p: F.col(f"`{d}`") for d, p in zip(read, ptr, strict=True)})
        return Captured(df, left.data, (*left.sources, Via(layer, ptr)), order=left.order)

    def _mark(self, n: N.Mark) -> Captured:
        left, right = self.of(n.left), self.of(n.right)
        i = next(self.ids)
        ptr = tuple(f"_ptr_{i}_{k}" for k in range(len(n.on)))
        keyed = right.df.select(*[F.col(f"`{b}`").alias(p) for (_, b), p in zip(n.on, ptr, strict=True)], *hidden(right.sources))
        present = keyed.select(*[F.col(p).alias(f"{p}_k") for p in ptr]).distinct().withColumn(n.flag, F.lit(True))
        on = reduce(lambda a, b: a & b, [F.col(f"`{a}`") == F.col(f"{p}_k") for (a, _), p in zip(n.on, ptr, strict=True)])
        df = left.df.join(present, on, "left").withColumn(n.flag, F.coalesce(n.flag, F.lit(False))).drop(*[f"{p}_k" for p in ptr])
        flag = f"_m_{i}"
        df = df.withColumns({flag: F.col(n.flag).cast("int"), **{p: F.col(f"`{a}`") for (a, _), p in zip(n.on, ptr, strict=True)}})
        layer = Layer(i, "in", keyed, ptr, right.sources)
        return Captured(df, (*left.data, n.flag), (*left.sources, Guard(flag, 1, (Via(layer, ptr),))), order=left.order)

    # --- aggregation, distinct -------------------------------------------------

    def _aggregate(self, n: N.Aggregate) -> Captured:
        c = self.of(n.child)
        i = next(self.ids)
        ptr = tuple(f"_ptr_{i}_{k}" for k in range(len(n.keys)))
        keyed = c.df.withColumns({p: F.expr(e) for p, e in zip(ptr, n.keys.values(), strict=True)}) if ptr else c.df
        layer = Layer(i, "aggregate" if ptr else "pure_aggregate", keyed.select(*ptr, *hidden(c.sources)), ptr, c.sources)
        df = keyed.groupBy(*ptr).agg(*[F.expr(e).alias(name) for name, e in n.aggs.items()]) if n.aggs else keyed.select(*ptr).distinct()
        df = df.select(*[F.col(p).alias(name) for name, p in zip(n.keys, ptr, strict=True)], *[F.col(f"`{a}`") for a in n.aggs], *ptr)
        out = Captured(df, (*n.keys, *n.aggs), (Via(layer, ptr),), frozenset([i]), keys=tuple(zip(n.keys, ptr, strict=True)))
        return out.with_(df=df.where(F.expr(n.having)), complete=frozenset()) if n.having else out

    def _distinct(self, n: N.Distinct) -> Captured:
        c = self.of(n.child)
        i = next(self.ids)
        ptr = tuple(f"_ptr_{i}_{k}" for k in range(len(c.data)))
        layer = Layer(i, "aggregate", c.df.select(*[F.col(f"`{d}`").alias(p) for d, p in zip(c.data, ptr, strict=True)], *hidden(c.sources)), ptr, c.sources)
        return Captured(_pointed(c.result.distinct(), c.data, ptr), c.data, (Via(layer, ptr),), frozenset([i]), keys=tuple(zip(c.data, ptr, strict=True)))

    # --- windows -----------------------------------------------------------------

    def _window(self, n: N.Window) -> Captured:
        c = self.of(n.child)
        i = next(self.ids)
        part = [F.expr(p) for p in n.partition]
        ptr = tuple(f"_ptr_{i}_{k}" for k in range(len(part)))
        df = c.df.withColumns(dict(zip(ptr, part, strict=True))) if ptr else c.df
        whole = W.partitionBy(*ptr) if ptr else W.partitionBy(F.lit(0))
        if n.frame is None:
            spec = whole.orderBy(*_sorts(n.order)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing) if n.order else whole
            df = df.withColumns({name: F.expr(e).over(spec) for name, e in n.exprs.items()})
            layer = Layer(i, "window", df.select(*ptr, *hidden(c.sources)), ptr, c.sources)
            return Captured(df, (*c.data, *n.exprs), (Via(layer, ptr),), order=c.order)
        # one numbering for the layer and for the frame's ends; it follows the frame's order, so frames are contiguous
        kind, low, high = n.frame
        place, lo, hi = f"_rn_{i}", f"_lo_{i}", f"_hi_{i}"
        ordered = whole.orderBy(*_sorts(n.order))
        first = W.unboundedPreceding if low is None else low
        last = W.unboundedFollowing if high is None else high
        ties = [F.col(h) for h in hidden(c.sources)]
        total = whole.orderBy(*_sorts(n.order), *ties)
        df = df.withColumn(place, F.row_number().over(total))
        if kind == "rows":
            spec = whole.orderBy(place).rowsBetween(first, last)
        elif kind == "groups":  # peers counted as groups: a range over the dense rank
            df = df.withColumn(f"_dr_{i}", F.dense_rank().over(ordered))
            spec = whole.orderBy(f"_dr_{i}").rangeBetween(first, last)
        else:
            spec = ordered.rangeBetween(first, last)
        # ranks are about peers, so they are taken over the user's order; they have no frame of their own
        over = {name: F.expr(e).over(ordered if _PEERS.match(e) else spec) for name, e in n.exprs.items()}
        df = df.withColumns({**over, lo: F.min(place).over(spec), hi: F.max(place).over(spec)})
        layer = Layer(i, "frame", df.select(*ptr, place, *hidden(c.sources)), ptr, c.sources, place)
        keeps = (low is None or low <= 0) and (high is None or high >= 0)
        sources = (Via(layer, ptr, (lo, hi)),) + (() if keeps else c.sources)
        return Captured(df, (*c.data, *n.exprs), sources, order=c.order)

    # --- set operations ------------------------------------------------------------

    def _setop(self, n: N.SetOp) -> Captured:
        left, right = self.of(n.left), self.of(n.right)
        if len(left.data) != len(right.data):
            raise ValueError("both sides of a set operation need as many columns")
        right = right.with_(df=right.df.select(*[F.col(f"`{r}`").alias(name) for r, name in zip(right.data, left.data, strict=True)], *hidden(right.sources)), data=left.data)
        i = next(self.ids)
        if n.kind == "union":
            branch = f"_b_{i}"
            both = [s.df.select(*[F.col(f"`{d}`") for d in s.data], *hidden(s.sources), F.lit(k).alias(branch)) for k, s in enumerate((left, right))]
            return Captured(both[0].unionByName(both[1], allowMissingColumns=True), left.data, (Guard(branch, 0, left.sources), Guard(branch, 1, right.sources)))
        ptr = tuple(f"_ptr_{i}_{k}" for k in range(len(left.data)))
        one, two = left.result, right.result
        if n.kind == "intersect":
            df, sides = (one.intersectAll(two) if n.all else one.intersect(two)), (left, right)
        else:
            df, sides = (one.exceptAll(two) if n.all else one.subtract(two)), (left,)
        sources = []
        for s in sides:
            keyed = s.df.select(*[F.col(f"`{d}`").alias(p) for d, p in zip(s.data, ptr, strict=True)], *hidden(s.sources))
            sources.append(Via(Layer(next(self.ids), "set", keyed, ptr, s.sources), ptr))
        return Captured(_pointed(df, left.data, ptr), left.data, tuple(sources))


def _pointed(df: DataFrame, data, ptr) -> DataFrame:
    return df.withColumns({p: F.col(f"`{d}`") for d, p in zip(data, ptr, strict=True)}) if ptr else df


def _not_in(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """NOT IN: with a null on the inner side nothing passes, a null on the outer side passes only an empty inner side."""
    facts = right.agg(F.count(F.lit(1)).alias("_n_all"), F.count(F.lit(1) * F.when(F.col(f"`{b}`").isNull(), 1)).alias("_n_null"))
    kept = left.join(right, F.col(f"`{a}`") == F.col(f"`{b}`"), "left_anti").crossJoin(facts)
    return kept.where((F.col("_n_all") == 0) | ((F.col("_n_null") == 0) & F.col(f"`{a}`").isNotNull())).drop("_n_all", "_n_null")
