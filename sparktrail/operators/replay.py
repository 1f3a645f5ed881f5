"""Replay: the query over nothing but its lineage gives the same result.

Each access is cut down to its traced rows (``prune``); what stands under a
negation has no lineage and stays whole.
"""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import nodes as N
from .backtrace import lineage
from .capture import capture
from .layers import Captured, reaches


def restrict(plan: N.Plan, captured: Captured) -> N.Plan:
    """``plan`` with every traced access cut down to its lineage."""
    if isinstance(plan, N.Scan):
        if plan.keys is None or not reaches(captured.sources, plan.access):
            return plan
        ids = lineage(captured, plan.access)
        on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{plan.access}_{k}`")) for k in plan.keys]
        test = on[0]
        for o in on[1:]:
            test = test & o
        return replace(plan, table=plan.table.join(ids, test, "left_semi"))
    return replace(plan, **{f.name: restrict(getattr(plan, f.name), captured) for f in fields(plan) if isinstance(getattr(plan, f.name), N.Plan)})


def replay(plan: N.Plan, captured: Captured | None = None) -> DataFrame:
    """The result of the query over its lineage alone."""
    return capture(restrict(plan, captured or capture(plan))).result


def differences(plan: N.Plan) -> int:
    """Rows by which the replayed result differs from the query's own, counted as bags; 0 is right."""
    own, again = capture(plan).result, replay(plan)
    return own.exceptAll(again).count() + again.exceptAll(own).count()
