"""Most recent values and rows per group."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def recency(df: DataFrame, date: str, row_id: str) -> Column:
    """A sortable column: later date first, then higher id among rows of one day.

    Both parts go into one number, which lets ``max_by`` run as a hash aggregate: a 64-bit
    integer for 32-bit ids, a decimal of 38 digits for 64-bit ids.
    """
    days = F.unix_date(F.col(date))
    if isinstance(df.schema[row_id].dataType, T.IntegerType):
        packed = days.cast("long") * F.lit(1 << 32) + (F.col(row_id).cast("long") + F.lit(1 << 31))
    else:
        packed = days.cast("decimal(10,0)") * F.lit(Decimal(1 << 64)) + (
            F.col(row_id).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
        )
        packed = packed.cast("decimal(38,0)")
    return F.when(F.col(date).isNotNull(), packed)


def latest_value(value: str, order: Column, only: Column | None = None) -> Column:
    """Aggregate: ``value`` of the most recent row, counting only rows where ``only`` holds."""
    return F.max_by(value, order if only is None else F.when(only, order))


def latest_value_by_concept(measurement: DataFrame, concept: int, alias: str) -> DataFrame:
    """The most recent value of one concept per person; people without any are left out."""
    return (
        measurement.filter(F.col("measurement_concept_id") == concept)
        .groupBy("person_id")
        .agg(
            latest_value(
                "value_as_number", recency(measurement, "measurement_date", "measurement_id")
            ).alias(alias)
        )
    )


def latest_lab(measurement: DataFrame) -> DataFrame:
    """Concept and value of each person's most recent measurement of any kind."""
    order = recency(measurement, "measurement_date", "measurement_id")
    return measurement.groupBy("person_id").agg(
        latest_value("measurement_concept_id", order).alias("latest_lab_concept_id"),
        latest_value("value_as_number", order).alias("latest_lab_value"),
    )


def top_recent(df: DataFrame, group: str, date: str, row_id: str, n: int) -> DataFrame:
    """The ``n`` most recent rows per group, the lower id first among rows of one day.

    Spark keeps only ``n`` rows per group in each task before the shuffle (WindowGroupLimit),
    so a very large group never meets in one task.
    """
    order = Window.partitionBy(group).orderBy(F.col(date).desc_nulls_last(), F.col(row_id))
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")
