"""Data-quality checks and their report.

A report has one row per check, ``(table, check, violations)``, in the model's order, with
zeros included. Rows and row rules are added up inside the tasks of one scan. Duplicate keys take
a scan of the key, and unknown references one of the referring column and one of the parent's
key; both are counted per key before they move, so a key held by many rows is combined first.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalsift.functions.scalars import missing
from vitalsift.operators.lookup import rows_per_key
from vitalsift.specs import ForeignKey, Model, TableSpec

REPORT_COLUMNS = ["table", "check", "violations"]


def row_rules(spec: TableSpec) -> dict[str, Column]:
    """Check name to a condition that is true for a violating row."""
    rules = {f"null_{c}": missing(F.col(c), spec.column_type(c)) for c in spec.required}
    for start, end in spec.date_pairs:
        rules[f"bad_date_{end}"] = F.col(end).isNotNull() & (F.col(end) < F.col(start))
    for column in spec.non_negative:
        rules[f"neg_{column}"] = F.col(column) < 0
    if spec.check_null_key:
        rules["null_pk"] = F.col(spec.key).isNull()
    return rules


def _one_row_per_count(counts: DataFrame, table: str, names: list[str]) -> DataFrame:
    """Turn a single row of counts into (table, check, violations) rows."""
    entries = [F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("violations")) for n in names]
    return counts.select(F.lit(table).alias("table"), F.inline(F.array(*entries)))


ROWS = "rows"


def rule_aggregates(spec: TableSpec) -> list[Column]:
    """The table's rows, and the violations of each row rule, as columns of a global aggregate."""
    return [F.count("*").alias(ROWS), *[F.count_if(rule).alias(name) for name, rule in row_rules(spec).items()]]


def rule_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: rows and violations of each row rule."""
    return df.agg(*rule_aggregates(spec))


def surplus_count(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: rows beyond the first of each key as ``dup_pk``; null keys form one group."""
    per_key = df.groupBy(spec.key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup_pk"))


def row_rule_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    return _one_row_per_count(rule_counts(df, spec), spec.name, list(row_rules(spec)))


def duplicate_count(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows beyond the first of each key; null keys form one group."""
    return _one_row_per_count(surplus_count(df, spec), spec.name, ["dup_pk"])


def orphan_count(
    df: DataFrame, spec: TableSpec, fk: ForeignKey, parent: DataFrame
) -> DataFrame:
    """Rows whose reference is not null and not among the parent's keys."""
    name = f"orphan_{fk.column}"
    references = rows_per_key(df, fk.column)
    keys = parent.select(F.col(fk.parent_key).alias(fk.column)).distinct()
    unknown = references.join(keys, fk.column, "left_anti")
    total = unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    return _one_row_per_count(total, spec.name, [name])


def _in_order(parts: list[DataFrame], spec: TableSpec) -> DataFrame:
    # Every part ends in a global aggregate, so these are a few dozen rows.
    place = F.array_position(F.array(*[F.lit(n) for n in [ROWS, *spec.check_names()]]), F.col("check"))
    return reduce(DataFrame.unionByName, parts).withColumn("_place", place)


def _key_parts(df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame]) -> list[DataFrame]:
    orphans = [orphan_count(df, spec, fk, parents[fk.parent]) for fk in spec.foreign_keys]
    return [duplicate_count(df, spec), *orphans]


def rows_and_rules(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The table's rows, as the check ``rows``, and the violations of each row rule, by one scan."""
    return _one_row_per_count(rule_counts(df, spec), spec.name, [ROWS, *row_rules(spec)])


def _with_orphans(df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame]) -> DataFrame:
    """All counts of a table as (table, check, violations), in check order after ``rows``."""
    return _in_order([rows_and_rules(df, spec), *_key_parts(df, spec, parents)], spec)


def key_checks(tables: Mapping[str, DataFrame], model: Model) -> DataFrame:
    """The report's checks of keys and references alone, without those of row rules.

    They read keys and references only. Rows and row rules can be counted while a table is
    written, with ``rule_aggregates`` as an observation.
    """
    return reduce(
        DataFrame.unionByName, [part for name in model for part in _key_parts(tables[name], model[name], tables)]
    )


def check_table(
    df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """The report of one table; ``parents`` holds the tables its foreign keys name."""
    found = _with_orphans(df, spec, parents or {})
    return found.filter(F.col("check") != ROWS).orderBy("_place").select(*REPORT_COLUMNS)


def counts_and_checks(tables: Mapping[str, DataFrame], model: Model) -> DataFrame:
    """The report of every table, with a row count as the ``rows`` entry of each.

    References are checked against the tables given.
    """
    found = [
        _with_orphans(tables[name], model[name], tables).withColumn("_table", F.lit(k))
        for k, name in enumerate(model)
    ]
    return reduce(DataFrame.unionByName, found).orderBy("_table", "_place").select(*REPORT_COLUMNS)


def check_all(tables: Mapping[str, DataFrame], model: Model) -> DataFrame:
    """The report of every table, in the model's order."""
    return counts_and_checks(tables, model).filter(F.col("check") != ROWS)


def violated(report: DataFrame) -> DataFrame:
    """Only the checks that found something."""
    return report.filter(F.col("violations") > 0)


def violation_total(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("total_violations"))


def bad_type_counts(text_rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Fields that hold text but not of the column's type, as ``bad_type_<column>`` checks.

    ``text_rows`` is the table read as strings only. A typed read would turn such fields into
    nulls without a trace.
    """
    typed = [f for f in spec.schema if f.dataType.simpleString() != "string"]
    counts = text_rows.agg(
        *[
            F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(
                f"bad_type_{f.name}"
            )
            for f in typed
        ]
    )
    return _one_row_per_count(counts, spec.name, [f"bad_type_{f.name}" for f in typed])
