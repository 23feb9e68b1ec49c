"""Small result tables for looking at the summary and at run results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preview(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by key; Spark keeps ``n`` rows per task and merges them."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def band_counts(summary: DataFrame) -> DataFrame:
    """People per decade of birth, in order."""
    return (
        summary.groupBy("year_of_birth_band").agg(F.count("*").alias("count"))
        .orderBy("year_of_birth_band")
    )


def prevalence(summary: DataFrame, flags: dict[str, str]) -> DataFrame:
    """People with each condition and their share in percent; ``flags`` maps name to column."""
    counts = summary.agg(
        F.count("*").alias("total"),
        *[F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(c) for c in flags.values()],
    )
    entries = [
        F.struct(
            F.lit(name).alias("condition"),
            F.col(c).alias("n"),
            F.when(F.col("total") > 0, F.round(100.0 * F.col(c) / F.col("total"), 1)).alias(
                "prevalence_pct"
            ),
        )
        for name, c in flags.items()
    ]
    return counts.select(F.inline(F.array(*entries)))


def column_summary(summary: DataFrame, column: str, places: int) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum of the non-null values."""
    value = F.col(column)
    return summary.filter(value.isNotNull()).agg(
        F.count("*").alias("n"),
        F.round(F.mean(value), places).alias("mean"),
        F.round(F.stddev_samp(value), places).alias("std"),
        F.round(F.min(value), places).alias("min"),
        F.round(F.max(value), places).alias("max"),
    )


def count_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of (section, table) whose ``rows`` differ or that only one side has."""
    left = expected.select("section", "table", F.col("rows").alias("expected"))
    right = actual.select("section", "table", F.col("rows").alias("actual"))
    return left.join(right, ["section", "table"], "full").filter(
        ~F.col("expected").eqNullSafe(F.col("actual"))
    )


def count_sections(cleaning: DataFrame) -> DataFrame:
    """Cleaning counts as (section, table, rows) with sections raw, cleaned and dropped."""
    return cleaning.unpivot(["table"], ["raw", "cleaned", "dropped"], "section", "rows").select(
        "section", "table", "rows"
    )
