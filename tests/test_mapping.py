import hashlib
from datetime import date

import pytest
from vitalsift.plans import mapping
from vitalsift.sources.tables import stored_in, work_folder
from vitalsift.specs import MODEL, WIDE_MODEL

SCHEMAS = {
    "patients": "Id string, GENDER string, RACE string, ETHNICITY string, BIRTHDATE string",
    "encounters": "Id string, PATIENT string, ENCOUNTERCLASS string, START string, STOP string",
    "conditions": "CODE string, PATIENT string, ENCOUNTER string, START string, STOP string",
    "medications": "CODE string, PATIENT string, ENCOUNTER string, START string, STOP string, DISPENSES string",
    "observations": "CODE string, PATIENT string, ENCOUNTER string, DATE string, VALUE string, UNITS string",
}

ROWS = {
    "patients": [
        ("pa", "M", "White", "nonhispanic", "1980-05-01"),
        ("pb", "f", "asian", "HISPANIC", "1991-01-31"),
        ("pc", "M", "martian", "hispanic", "1970-01-01"),
    ],
    "encounters": [
        ("e1", "pa", "wellness", "2019-01-01T08:00:00Z", "2019-01-01T09:00:00Z"),
        ("e2", "pa", "Emergency", "2020-01-01T23:30:00Z", "2020-01-02T01:00:00Z"),
        ("e3", "pa", "inpatient", "2021-01-01T08:00:00Z", None),
        ("e4", "pb", "hospice", "2018-05-05T08:00:00Z", "2018-05-06T08:00:00Z"),
        ("e5", "pb", "spaceship", "2022-01-01T08:00:00Z", "2022-01-01T08:00:00Z"),
        ("e6", "pc", "home", "2017-01-01T08:00:00Z", "2017-01-01T08:00:00Z"),
        ("e7", "nobody", "home", "2017-01-01T08:00:00Z", "2017-01-01T08:00:00Z"),
        ("e8", "pb", "home", None, "2017-01-01T08:00:00Z"),
    ],
    "conditions": [
        ("44054006", "pa", "e1", "2019-01-01", None),
        ("59621000", "pa", "e3", "2021-01-01", "2021-02-01"),
        ("00000000", "pa", "e3", "2021-01-01", None),
        (None, "pa", "e3", "2021-01-01", None),
        ("44054006", "nobody", "e7", "2017-01-01", None),
        ("44054006", "pb", "e4", "not a date", None),
        ("44054006", "pb", "e4", "2018-05-05", "not a date"),
        ("44054006", "pb", "e4", "2018-05-05", "not a date"),
    ],
    "medications": [
        ("834102", "pa", "e3", "2021-01-01T12:00:00Z", "2021-01-31T00:00:00Z", "3"),
        ("834061", "pa", "e2", "2020-01-01T00:00:00Z", None, "many"),
        ("860975", "pa", "e1", "2019-01-01T00:00:00Z", None, "1"),
        ("999", "pa", "e3", "2021-01-01T12:00:00Z", None, "1"),
        ("860975", "pb", "e4", "bad", None, "1"),
        ("860975", "pb", "e4", "2018-05-05T00:00:00Z", "2018-05-05T06:00:00Z", None),
    ],
    "observations": [
        ("8480-6", "pa", "e3", "2021-01-01T10:00:00Z", "120.5", "mm[Hg]"),
        ("2345-7", "pa", "e2", "2020-01-01T10:00:00Z", "99", "furlong"),
        ("4548-4", "pa", "e2", "2020-01-01T10:00:00Z", "high", "%"),
        ("4548-4", "pa", "e1", "2019-01-01T10:00:00Z", "6.1", "%"),
        ("0000-0", "pb", "e4", "2018-05-05T10:00:00Z", "1", "%"),
        ("4548-4", "pb", "e4", "2018-05-05T10:00:00Z", "6.5", "%"),
    ],
}


@pytest.fixture(scope="module")
def sources(spark):
    return {name: spark.createDataFrame(ROWS[name], SCHEMAS[name]) for name in SCHEMAS}


@pytest.fixture(scope="module")
def tables(spark, sources):
    return mapping.map_all(sources, keep=stored_in(work_folder(spark)))


def by_digest(keys):
    return {k: i + 1 for i, k in enumerate(sorted(keys, key=lambda k: hashlib.md5(k.encode()).hexdigest()))}


PEOPLE = by_digest(["pa", "pb", "pc"])
# pa has three visits and keeps the latest two; pc keeps its visit though pc is not in the person table.
VISITS = by_digest(["e2", "e3", "e4", "e6"])


def content(df, key):
    found = df.collect()
    assert sorted(r[key] for r in found) == list(range(1, len(found) + 1))
    return sorted((tuple(v for c, v in r.asDict().items() if c != key) for r in found), key=str)


def test_schemas(tables):
    for name, df in tables.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in MODEL[name].schema]


def test_wide_ids(sources):
    person = mapping.map_person(sources["patients"], mapping.person_keys(sources["patients"]), WIDE_MODEL)
    assert person.schema["person_id"].dataType.simpleString() == "bigint"


def test_person(tables):
    assert sorted(map(tuple, tables["person"].collect())) == sorted([
        (PEOPLE["pa"], 1, 1980, 1, 2, None),
        (PEOPLE["pb"], 2, 1991, 3, 1, None),
    ])


def test_visits_are_capped_and_keep_unlisted_people(tables):
    assert sorted(map(tuple, tables["visit_occurrence"].collect())) == sorted([
        (VISITS["e2"], PEOPLE["pa"], 3, date(2020, 1, 1), date(2020, 1, 2), None, None),
        (VISITS["e3"], PEOPLE["pa"], 2, date(2021, 1, 1), None, None, None),
        (VISITS["e4"], PEOPLE["pb"], 2, date(2018, 5, 5), date(2018, 5, 6), None, None),
        (VISITS["e6"], PEOPLE["pc"], 1, date(2017, 1, 1), date(2017, 1, 1), None, None),
    ])


def test_conditions_stay_without_their_visit(tables):
    again = (PEOPLE["pb"], 1, date(2018, 5, 5), None, VISITS["e4"])
    assert content(tables["condition_occurrence"], "condition_occurrence_id") == sorted([
        (PEOPLE["pa"], 1, date(2019, 1, 1), None, None),
        (PEOPLE["pa"], 2, date(2021, 1, 1), date(2021, 2, 1), VISITS["e3"]),
        again, again,
    ], key=str)


def test_drugs_of_kept_visits(tables):
    assert content(tables["drug_exposure"], "drug_exposure_id") == sorted([
        (PEOPLE["pa"], 13, date(2021, 1, 1), date(2021, 1, 31), 29, 3.0),
        (PEOPLE["pa"], 13, date(2020, 1, 1), None, 30, 1.0),
        (PEOPLE["pb"], 1, date(2018, 5, 5), date(2018, 5, 5), 1, 1.0),
    ], key=str)


def test_measurements_of_kept_visits(tables):
    assert content(tables["measurement"], "measurement_id") == sorted([
        (PEOPLE["pa"], 1, date(2021, 1, 1), 120.5, 1, VISITS["e3"]),
        (PEOPLE["pa"], 3, date(2020, 1, 1), 99.0, None, VISITS["e2"]),
        (PEOPLE["pb"], 4, date(2018, 5, 5), 6.5, 4, VISITS["e4"]),
    ], key=str)


def test_one_note_per_visit(tables):
    notes = {r["visit_occurrence_id"]: r for r in tables["note"].collect()}
    assert set(notes) == set(VISITS.values())
    assert all(r["note_id"] == v for v, r in notes.items())
    general = notes[VISITS["e6"]]["note_text"]
    assert general.startswith("CHIEF COMPLAINT: ") and "\n\nASSESSMENT AND PLAN: Patient seen" in general
    text = notes[VISITS["e3"]]["note_text"]
    assert "41" in text and "male" in text and "Penicillin V" in text and "120.5" in text
    assert "type 2 diabetes" in text or "hypertension" in text


def test_tally_of_lost_rows(sources):
    people = mapping.person_keys(sources["patients"])
    kept = mapping.kept_visits(sources["encounters"], people)
    tally = mapping.mapping_tally(sources, people, kept, mapping.visit_keys(kept)).collect()
    assert [tuple(r) for r in tally] == [
        ("person", "missing_id", 0),
        ("person", "unmapped_concept", 1),
        ("visit_occurrence", "missing_id", 0),
        ("visit_occurrence", "unmapped_or_missing", 3),
        ("visit_occurrence", "over_visit_cap", 1),
        ("condition_occurrence", "unmapped_code", 2),
        ("condition_occurrence", "missing_required", 2),
        ("drug_exposure", "unmapped_code", 1),
        ("drug_exposure", "missing_required", 1),
        ("measurement", "unmapped_code", 1),
        ("measurement", "missing_required", 1),
    ]


def test_malformed_visit_times_fail_the_job(spark, sources):
    broken = spark.createDataFrame([("e1", "pa", "home", "someday", None)], SCHEMAS["encounters"])
    with pytest.raises(Exception, match="not a timestamp: someday"):
        mapping.kept_visits(broken, mapping.person_keys(sources["patients"])).collect()


def test_mapping_the_same_whatever_partitions(spark, sources, tables):
    again = mapping.map_all(
        {name: df.repartition(5) for name, df in sources.items()}, keep=stored_in(work_folder(spark))
    )
    for name, df in tables.items():
        assert sorted(again[name].collect(), key=str) == sorted(df.collect(), key=str)


def test_rows_without_an_id_are_lost_before_the_cap_and_counted(spark):
    patients = spark.createDataFrame(
        [("p", "M", "white", "hispanic", "1980-01-01"), (None, "M", "white", "hispanic", "1980-01-01")], SCHEMAS["patients"]
    )
    visit = lambda i, day: (i, "p", "home", f"2020-01-0{day}T00:00:00Z", f"2020-01-0{day}T01:00:00Z")
    encounters = spark.createDataFrame([visit(None, 9), visit("a", 3), visit("b", 2), visit("c", 1)], SCHEMAS["encounters"])
    people = mapping.person_keys(patients)
    kept = mapping.kept_visits(encounters, people)
    visits = mapping.visit_keys(kept)
    assert {r["Id"] for r in kept.collect()} == {"a", "b"}
    assert mapping.map_visit(kept, visits).count() == 2
    assert mapping.map_person(patients, people).count() == 1
    none = {n: spark.createDataFrame([], SCHEMAS[n]) for n in ("conditions", "medications", "observations")}
    tally = mapping.mapping_tally({"patients": patients, "encounters": encounters, **none}, people, kept, visits)
    found = {(r["table"], r["rule"]): r["rows"] for r in tally.collect()}
    assert found["person", "missing_id"] == 1 and found["person", "unmapped_concept"] == 0
    assert found["visit_occurrence", "missing_id"] == 1 and found["visit_occurrence", "over_visit_cap"] == 1
