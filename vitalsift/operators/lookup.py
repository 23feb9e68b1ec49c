"""Joins of many rows to one keyed row each, safe when a few keys hold most of the rows.

A shuffle join sends all rows of a key to one task. Adaptive execution splits such a task, but only
where both sides of the join come straight from a shuffle: a side that is aggregated, made
distinct or ranked on the way keeps the split from happening. The keyed side is therefore best a
stored table that is unique already, and joins that only ask whether a key exists are semi joins,
which need no distinct keys at all. Nothing is measured and no job runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, keyed: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to a table that is unique on ``on``; ``how`` is left, inner or left_semi."""
    return rows.join(keyed, on, how)


def with_known_key(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is null or among ``keys``, which may repeat.

    Null keys are set aside, so they never meet in a task, and the others go through a semi join.
    """
    known = rows.filter(F.col(on).isNotNull()).join(keys.select(on), on, "left_semi")
    return known.select(*rows.columns).unionByName(rows.filter(F.col(on).isNull()))


def rows_per_key(rows: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Rows per non-null key, combined before the shuffle, so a frequent key stays cheap."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count))
