"""Known faults for test data, placed on an exact, repeatable share of the rows.

Each fault draws its own sample, so one row can get several. Duplicates come last and copy rows
as the other faults left them. A table is read three times: twice its key column to place the
samples, and once in full; no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalsift.config import DEFAULTS
from vitalsift.operators.sampling import chosen, cutoffs
from vitalsift.specs import Model, TableSpec

# Never a valid id, whatever the table's size.
UNKNOWN_ID = -1


@dataclass(frozen=True)
class Fault:
    """``kind`` is null, bad_date, negative, orphan or duplicate."""

    kind: str
    column: str = ""
    start: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}"


# The faults of each table, in the order they are applied.
FAULTS: dict[str, tuple[Fault, ...]] = {
    "person": (Fault("null", "year_of_birth"), Fault("duplicate")),
    "visit_occurrence": (
        Fault("null", "visit_concept_id"),
        Fault("bad_date", "visit_end_date", "visit_start_date"),
        Fault("duplicate"),
    ),
    "condition_occurrence": (
        Fault("null", "condition_concept_id"),
        Fault("bad_date", "condition_end_date", "condition_start_date"),
        Fault("duplicate"),
    ),
    "drug_exposure": (
        Fault("null", "drug_concept_id"),
        Fault("bad_date", "drug_exposure_end_date", "drug_exposure_start_date"),
        Fault("negative", "days_supply"),
        Fault("negative", "quantity"),
        Fault("duplicate"),
    ),
    "measurement": (
        Fault("null", "measurement_date"),
        Fault("negative", "value_as_number"),
        Fault("orphan", "person_id"),
        Fault("duplicate"),
    ),
    "note": (
        Fault("null", "note_text"),
        Fault("orphan", "visit_occurrence_id"),
        Fault("duplicate"),
    ),
}


def _faulty_value(fault: Fault, df: DataFrame) -> Column:
    column_type = df.schema[fault.column].dataType
    values = {
        "null": lambda: F.lit(None),
        "bad_date": lambda: F.date_sub(F.col(fault.start), 1),
        "negative": lambda: F.lit(-1),
        "orphan": lambda: F.lit(UNKNOWN_ID),
    }
    return values[fault.kind]().cast(column_type)


def inject(
    df: DataFrame,
    key: str,
    faults: tuple[Fault, ...],
    *,
    fraction: float = DEFAULTS.fault_fraction,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Apply ``faults`` to a table with a unique ``key``.

    Each fault hits ``fraction`` of the original rows, rounded down, at least one.
    """
    seeds = {fault.name: seed + 1 + place for place, fault in enumerate(faults)}
    cuts = cutoffs(df, key, seeds, fraction=fraction)
    columns, dirty = df.columns, df
    for fault in faults:
        hit = chosen(key, fault.name, seeds[fault.name], cuts)
        if fault.kind == "duplicate":
            copies = F.when(hit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            dirty = dirty.withColumn("_copy", F.explode(copies)).select(*columns)
        else:
            value = F.when(hit, _faulty_value(fault, df)).otherwise(F.col(fault.column))
            dirty = dirty.withColumn(fault.column, value)
    return dirty


def inject_table(df: DataFrame, spec: TableSpec, **options) -> DataFrame:
    return inject(df, spec.key, FAULTS[spec.name], **options)


def inject_all(tables: Mapping[str, DataFrame], model: Model, **options) -> dict[str, DataFrame]:
    return {name: inject_table(tables[name], model[name], **options) for name in model}
