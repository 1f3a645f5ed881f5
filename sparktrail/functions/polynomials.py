"""Provenance polynomials over a lineage relation, and their evaluation in other semirings.

A lineage relation has output columns and, per access, id columns; a row is
one way (a product) to get an output row, and the rows of one output add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The signs of the polynomials.
TIMES, PLUS = " ⊗ ", " ⊕ "


def product(ids: Sequence[str]) -> Column:
    """One term: the ids of all accesses of a row."""
    return F.concat_ws(TIMES, *[F.col(i).cast("string") for i in ids])


def join_polynomial(lineage: DataFrame, outputs: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """A term per output row of a join."""
    return lineage.select(*outputs, product(ids).alias("polynomial"))


def unfactored(lineage: DataFrame, outputs: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(a ⊗ b) ⊕ (c ⊗ d) ...: the sum of all terms of each output row, terms in the order of their ids."""
    order = ", ".join(f"`{i}`" for i in ids)
    term = f"concat('(', concat_ws('{TIMES}', {', '.join(f'CAST(`{i}` AS STRING)' for i in ids)}), ')')"
    return lineage.groupBy(*outputs).agg(F.expr(f"listagg({term}, '{PLUS}') WITHIN GROUP (ORDER BY struct({order}))").alias("polynomial"))


def factored(sums: Sequence[tuple[DataFrame, str]], outputs: Sequence[str]) -> DataFrame:
    """(a ⊕ b) ⊗ (c ⊕ d) ...: where the inputs of a join were grouped first, each factor is summed on its own.

    ``sums``: a lineage relation and its id column per factor.  The size is
    the sum of the factors' sizes instead of their product.
    """
    out = None
    for k, (lineage, i) in enumerate(sums):
        factor = lineage.select(*outputs, i).distinct().groupBy(*outputs).agg(F.expr(f"concat('(', listagg(CAST(`{i}` AS STRING), '{PLUS}') WITHIN GROUP (ORDER BY `{i}`), ')')").alias(f"_f_{k}"))
        out = factor if out is None else out.join(factor, list(outputs))
    return out.select(*outputs, F.concat_ws(TIMES, *[F.col(f"_f_{k}") for k in range(len(sums))]).alias("polynomial"))


def counting(lineage: DataFrame, outputs: Sequence[str], multiplicity: Column | None = None) -> DataFrame:
    """The counting semiring: how many ways there are (every id worth ``multiplicity``, one by default)."""
    return lineage.groupBy(*outputs).agg(F.sum(F.lit(1) if multiplicity is None else multiplicity).cast("long").alias("ways"))


def which(lineage: DataFrame, outputs: Sequence[str], i: str) -> DataFrame:
    """The which-semiring: the set of ids, sorted, as text. For outputs of modest lineage; the relation itself is the form that scales."""
    return lineage.select(*outputs, i).where(F.col(i).isNotNull()).distinct().groupBy(*outputs).agg(F.expr(f"listagg(CAST(`{i}` AS STRING), ',') WITHIN GROUP (ORDER BY `{i}`)").alias("ids"))


def formula(lineage: DataFrame, outputs: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """δ of the sum of the terms: the mark of a duplicate elimination."""
    return unfactored(lineage, outputs, ids).withColumn("polynomial", F.concat(F.lit("δ("), F.col("polynomial"), F.lit(")")))


def evaluate(lineage: DataFrame, outputs: Sequence[str], value: Column, plus: str = "sum") -> DataFrame:
    """Any semiring whose sum is a Spark aggregate: ``value`` is the product of a row's ids (for example probabilities or costs), ``plus`` sum, max, min or bool_or."""
    return lineage.groupBy(*outputs).agg(getattr(F, plus)(value).alias("value"))
