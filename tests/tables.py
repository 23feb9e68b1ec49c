"""Small tables for the tests: rows as dicts, columns left out are null."""

from datetime import date

from pyspark.sql import types as T

from vitalsift.specs import MODEL

D1, D2 = date(2020, 1, 1), date(2020, 6, 1)

VALID = {
    "person": dict(person_id=1, gender_concept_id=1, year_of_birth=1980, race_concept_id=1, ethnicity_concept_id=1),
    "visit_occurrence": dict(visit_occurrence_id=10, person_id=1, visit_concept_id=1, visit_start_date=D1, visit_end_date=D2),
    "condition_occurrence": dict(condition_occurrence_id=100, person_id=1, condition_concept_id=1, condition_start_date=D1, condition_end_date=D2),
    "drug_exposure": dict(drug_exposure_id=200, person_id=1, drug_concept_id=1, drug_exposure_start_date=D1,
                          drug_exposure_end_date=D2, days_supply=30, quantity=1.0),
    "measurement": dict(measurement_id=300, person_id=1, measurement_concept_id=4, measurement_date=D1, value_as_number=5.5),
    "note": dict(note_id=400, person_id=1, note_date=D1, note_text="text", visit_occurrence_id=10),
}


def table(spark, name, rows, model=MODEL):
    """A table of the model with every column nullable."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in model[name].schema])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def rows(spark, name, *changes, model=MODEL):
    """One row per set of changes to the valid row."""
    return table(spark, name, [{**VALID[name], **c} for c in changes], model)


def valid_tables(spark):
    return {name: rows(spark, name, {}) for name in VALID}


def counts(report):
    return {r["check"]: r["violations"] for r in report.collect()}


def survivors(df, key):
    found = {}
    for row in df.select(key).collect():
        found[row[0]] = found.get(row[0], 0) + 1
    return found
