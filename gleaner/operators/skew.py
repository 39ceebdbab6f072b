"""Joins of rows with facts by a key that a large share of the rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows is hot, so fewer than SHARE keys are.
SHARE = 1000


def meet(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Rows that have the key of a fact, with the fact's other columns.

    ``facts``: one row a key, with ``n``, how many rows have it (dropped).  The facts of hot
    keys, fewer than SHARE rows whatever the input, are broadcast; no key that is left has
    more than a SHAREth of the rows, so their shuffle is even.  A null key is a key.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    found = facts.withColumnRenamed(key, "__key")
    hot, cold = found.where(F.col("n") * SHARE > total).drop("n"), found.where(F.col("n") * SHARE <= total).drop("n")
    same = F.col(key).eqNullSafe(F.col("__key"))
    often = rows.join(F.broadcast(hot), same).drop("__key")
    seldom = rows.join(F.broadcast(hot.select("__key")), same, "left_anti")
    return often.unionByName(seldom.join(cold.hint("merge"), same).drop("__key"))
