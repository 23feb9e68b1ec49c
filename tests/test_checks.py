from datetime import date

import pytest

from tables import D1, VALID, counts, rows, table, valid_tables
from vitalsift.operators import checks
from vitalsift.specs import MODEL

EARLIER = date(2019, 12, 31)

# Table: faulty rows as changes to the valid row, each check they are expected to raise once.
FAULTY = {
    "person": [
        dict(person_id=2, gender_concept_id=None), dict(person_id=3, year_of_birth=None),
        dict(person_id=4, race_concept_id=None), dict(person_id=5, ethnicity_concept_id=None),
        dict(person_id=6), dict(person_id=6),
    ],
    "visit_occurrence": [
        dict(visit_occurrence_id=11, person_id=None), dict(visit_occurrence_id=12, visit_concept_id=None),
        dict(visit_occurrence_id=13, visit_start_date=None), dict(visit_occurrence_id=14, visit_end_date=None),
        dict(visit_occurrence_id=15, visit_end_date=EARLIER), dict(visit_occurrence_id=16, person_id=99),
        dict(visit_occurrence_id=17), dict(visit_occurrence_id=17),
    ],
    "condition_occurrence": [
        dict(condition_occurrence_id=101, person_id=None), dict(condition_occurrence_id=102, condition_concept_id=None),
        dict(condition_occurrence_id=103, condition_start_date=None),
        dict(condition_occurrence_id=104, condition_end_date=EARLIER),
        dict(condition_occurrence_id=105), dict(condition_occurrence_id=105),
        dict(condition_occurrence_id=106, condition_end_date=None),
    ],
    "drug_exposure": [
        dict(drug_exposure_id=201, person_id=None), dict(drug_exposure_id=202, drug_concept_id=None),
        dict(drug_exposure_id=203, drug_exposure_start_date=None), dict(drug_exposure_id=204, days_supply=None),
        dict(drug_exposure_id=205, quantity=None), dict(drug_exposure_id=206, drug_exposure_end_date=EARLIER),
        dict(drug_exposure_id=207, days_supply=-1), dict(drug_exposure_id=208, quantity=-0.5),
        dict(drug_exposure_id=209), dict(drug_exposure_id=209), dict(drug_exposure_id=210, days_supply=0),
    ],
    "measurement": [
        dict(measurement_id=301, person_id=None), dict(measurement_id=302, measurement_concept_id=None),
        dict(measurement_id=303, measurement_date=None), dict(measurement_id=304, value_as_number=None),
        dict(measurement_id=305, value_as_number=-1.0), dict(measurement_id=306, person_id=99),
        dict(measurement_id=307), dict(measurement_id=307),
    ],
    "note": [
        dict(note_id=401, person_id=None), dict(note_id=402, note_date=None), dict(note_id=403, note_text=None),
        dict(note_id=404, visit_occurrence_id=99), dict(note_id=405), dict(note_id=405),
        dict(note_id=406, visit_occurrence_id=None),
    ],
}


@pytest.mark.parametrize("name", list(VALID))
def test_every_check_finds_its_fault_once(spark, name):
    found = counts(checks.check_table(rows(spark, name, {}, *FAULTY[name]), MODEL[name], valid_tables(spark)))
    assert found == dict.fromkeys(MODEL[name].check_names(), 1)


def test_valid_tables_report_38_zeros_in_model_order(spark):
    found = checks.check_all(valid_tables(spark), MODEL).collect()
    assert [(r["table"], r["check"]) for r in found] == [
        (name, check) for name in MODEL for check in MODEL[name].check_names()
    ]
    assert len(found) == 38 and {r["violations"] for r in found} == {0}


def test_empty_tables_report_zeros(spark):
    empty = {name: table(spark, name, []) for name in VALID}
    report = checks.check_all(empty, MODEL)
    assert set(counts(report).values()) == {0}
    assert checks.violation_total(report).first()[0] == 0


def test_nan_counts_as_missing(spark):
    drugs = rows(spark, "drug_exposure", dict(quantity=float("nan")))
    assert counts(checks.check_table(drugs, MODEL["drug_exposure"]))["null_quantity"] == 1


def test_null_keys_are_one_group_of_duplicates(spark):
    people = rows(spark, "person", dict(person_id=None), dict(person_id=None), dict(person_id=None))
    assert counts(checks.check_table(people, MODEL["person"]))["dup_pk"] == 2
    strict = MODEL.with_checks(null_keys=True)["person"]
    assert counts(checks.check_table(people, strict))["null_pk"] == 3


def test_end_on_start_day_is_fine(spark):
    visits = rows(spark, "visit_occurrence", dict(visit_end_date=D1))
    found = counts(checks.check_table(visits, MODEL["visit_occurrence"], valid_tables(spark)))
    assert found["bad_date_visit_end_date"] == 0


def test_duplicate_parents_do_not_multiply_orphans(spark):
    people = rows(spark, "person", {}, {}, {})
    visits = rows(spark, "visit_occurrence", {}, dict(visit_occurrence_id=11, person_id=99))
    found = counts(checks.check_table(visits, MODEL["visit_occurrence"], {"person": people}))
    assert found["orphan_person_id"] == 1


def test_strict_keys_check_every_reference(spark):
    strict = MODEL.with_checks(strict_keys=True)
    tables = valid_tables(spark)
    tables["condition_occurrence"] = rows(
        spark, "condition_occurrence", dict(person_id=99), dict(condition_occurrence_id=101, visit_occurrence_id=77)
    )
    found = counts(checks.check_table(tables["condition_occurrence"], strict["condition_occurrence"], tables))
    assert (found["orphan_person_id"], found["orphan_visit_occurrence_id"]) == (1, 1)
    assert strict.cleaning_order().index("visit_occurrence") < strict.cleaning_order().index("condition_occurrence")


def test_violated_keeps_only_findings(spark):
    report = checks.check_table(rows(spark, "person", {}, {}), MODEL["person"])
    assert [(r["check"], r["violations"]) for r in checks.violated(report).collect()] == [("dup_pk", 1)]


def test_bad_types_are_counted_from_text(spark):
    text = spark.createDataFrame(
        [("1", "x", "2020-01-01"), ("2", None, "2020-99-01"), ("z", "3", None)],
        "note_id string, person_id string, note_date string",
    ).selectExpr("*", "null as note_text", "cast(null as string) as visit_occurrence_id")
    assert counts(checks.bad_type_counts(text, MODEL["note"])) == {
        "bad_type_note_id": 1, "bad_type_person_id": 1, "bad_type_note_date": 1, "bad_type_visit_occurrence_id": 0,
    }


def test_a_compared_column_must_be_required():
    with pytest.raises(ValueError, match="must be required"):
        type(MODEL["person"])("t", MODEL["person"].schema, key="person_id", non_negative=("year_of_birth",))
