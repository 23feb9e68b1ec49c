"""One row per person from cleaned tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalsift.config import DEFAULTS
from vitalsift.functions import codes
from vitalsift.functions.scalars import age_at, decade_band
from vitalsift.operators.latest import latest_value, recency
from vitalsift.specs import MODEL, Model, require_schema


def visit_counts(visit: DataFrame) -> DataFrame:
    concept = F.col("visit_concept_id")
    return visit.groupBy("person_id").agg(
        F.count("*").alias("total_visit_count"),
        F.count_if(concept == codes.OUTPATIENT).alias("outpatient_visit_count"),
        F.count_if(concept == codes.INPATIENT).alias("inpatient_visit_count"),
        F.count_if(concept == codes.EMERGENCY).alias("er_visit_count"),
    )


def condition_flags(condition: DataFrame) -> DataFrame:
    concept = F.col("condition_concept_id")
    return condition.groupBy("person_id").agg(
        F.count("*").alias("condition_count"),
        F.bool_or(concept == codes.DIABETES).alias("has_diabetes"),
        F.bool_or(concept == codes.HYPERTENSION).alias("has_hypertension"),
    )


def drug_counts(drug: DataFrame) -> DataFrame:
    return drug.groupBy("person_id").agg(F.count("*").alias("drug_exposure_count"))


def measurement_summary(measurement: DataFrame) -> DataFrame:
    """Count, latest date and latest HbA1c and systolic pressure in one aggregate."""
    order = recency(measurement, "measurement_date", "measurement_id")
    concept = F.col("measurement_concept_id")
    value = "value_as_number"
    return measurement.groupBy("person_id").agg(
        F.count("*").alias("measurement_count"),
        F.max("measurement_date").alias("latest_measurement_date"),
        latest_value(value, order, concept == codes.HBA1C).alias("latest_hba1c"),
        latest_value(value, order, concept == codes.SYSTOLIC_BP).alias("latest_systolic_bp"),
    )


def person_summary(
    person: DataFrame,
    visit: DataFrame,
    condition: DataFrame,
    drug: DataFrame,
    measurement: DataFrame,
    *,
    reference_date: date = DEFAULTS.reference_date,
    model: Model = MODEL,
) -> DataFrame:
    """One row per cleaned person: age, decade of birth, counts, flags and latest values.

    Each event table is aggregated by person before it is joined, so every side of a join has
    one row per person and is already partitioned by it.
    """
    joined = (
        person.select("person_id", "year_of_birth", "gender_concept_id")
        .join(visit_counts(visit), "person_id", "left")
        .join(condition_flags(condition), "person_id", "left")
        .join(drug_counts(drug), "person_id", "left")
        .join(measurement_summary(measurement), "person_id", "left")
    )
    defaults = {
        **{c: F.lit(0).cast("long") for c in model.summary.names if c.endswith("_count")},
        "has_diabetes": F.lit(False),
        "has_hypertension": F.lit(False),
    }
    computed = {
        "age": age_at(reference_date, F.col("year_of_birth")),
        "year_of_birth_band": decade_band(F.col("year_of_birth")),
    }
    result = joined.select(
        *[
            computed[c].alias(c) if c in computed
            else F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults
            else F.col(c)
            for c in model.summary.names
        ]
    )
    require_schema(result, model.summary, "analytic_person")
    return result
