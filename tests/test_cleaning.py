from collections import Counter
from datetime import date

import pytest

from tables import D1, VALID, counts, rows, survivors, table, valid_tables
from vitalsift.operators import checks, cleaning
from vitalsift.sources import tables as storage
from vitalsift.specs import MODEL

BAD = date(2019, 1, 1)

# Table: (changes to the valid row, surviving key -> copies).
CASES = {
    "person": (
        [{}, dict(person_id=2, gender_concept_id=None), dict(person_id=3, year_of_birth=None),
         dict(person_id=4, race_concept_id=None), dict(person_id=5, ethnicity_concept_id=None),
         dict(person_id=6), dict(person_id=6)],
        {1: 1, 6: 1},
    ),
    "visit_occurrence": (
        [{}, dict(visit_occurrence_id=11, visit_concept_id=None), dict(visit_occurrence_id=12, visit_end_date=BAD),
         dict(visit_occurrence_id=13, visit_end_date=D1), dict(visit_occurrence_id=14, person_id=99),
         dict(visit_occurrence_id=15), dict(visit_occurrence_id=15)],
        {10: 1, 13: 1, 15: 1},
    ),
    "condition_occurrence": (
        [{}, dict(condition_occurrence_id=101, condition_concept_id=None),
         dict(condition_occurrence_id=102, condition_end_date=BAD),
         dict(condition_occurrence_id=103, condition_end_date=None),
         dict(condition_occurrence_id=104), dict(condition_occurrence_id=104)],
        {100: 1, 103: 1, 104: 1},
    ),
    "drug_exposure": (
        [{}, dict(drug_exposure_id=201, drug_concept_id=None), dict(drug_exposure_id=202, drug_exposure_end_date=BAD),
         dict(drug_exposure_id=203, days_supply=-1), dict(drug_exposure_id=204, quantity=-1.0),
         dict(drug_exposure_id=205, days_supply=0), dict(drug_exposure_id=206), dict(drug_exposure_id=206),
         dict(drug_exposure_id=207, quantity=float("nan"))],
        {200: 1, 205: 1, 206: 1},
    ),
    "measurement": (
        [{}, dict(measurement_id=301, measurement_date=None), dict(measurement_id=302, value_as_number=-1.0),
         dict(measurement_id=303, person_id=99), dict(measurement_id=304), dict(measurement_id=304)],
        {300: 1, 304: 1},
    ),
    "note": (
        [{}, dict(note_id=401, note_text=None), dict(note_id=402, visit_occurrence_id=99),
         dict(note_id=403, visit_occurrence_id=None), dict(note_id=404), dict(note_id=404)],
        {400: 1, 403: 1, 404: 1},
    ),
}


@pytest.mark.parametrize("name", list(CASES))
def test_only_valid_rows_survive_once(spark, name):
    changes, expected = CASES[name]
    cleaned = cleaning.clean_table(rows(spark, name, *changes), MODEL[name], valid_tables(spark))
    assert survivors(cleaned, MODEL[name].key) == expected
    assert cleaned.columns == MODEL[name].columns


@pytest.mark.parametrize("name", list(CASES))
def test_kept_and_quarantined_rows_add_up(spark, name):
    changes, expected = CASES[name]
    raw = rows(spark, name, *changes)
    removed = cleaning.quarantine(raw, MODEL[name], valid_tables(spark)).collect()
    assert sum(r["copies"] for r in removed) == len(changes) - sum(expected.values())
    assert all(r["reasons"] for r in removed)


def test_a_row_lists_all_its_reasons(spark):
    drug = rows(spark, "drug_exposure", dict(drug_concept_id=None, days_supply=-1, drug_exposure_end_date=BAD))
    (row,) = cleaning.quarantine(drug, MODEL["drug_exposure"]).collect()
    assert row["reasons"] == ["null_drug_concept_id", "bad_date_drug_exposure_end_date", "neg_days_supply"]


def test_duplicates_that_differ_keep_the_first_by_content_nulls_last(spark):
    people = rows(
        spark, "person",
        dict(location_id=None), dict(location_id=5), dict(location_id=3), dict(location_id=3),
    )
    (kept,) = cleaning.clean_table(people, MODEL["person"]).collect()
    assert kept["location_id"] == 3
    removed = {r["location_id"]: (r["reasons"], r["copies"]) for r in cleaning.quarantine(people, MODEL["person"]).collect()}
    assert removed == {None: (["dup_pk"], 1), 5: (["dup_pk"], 1), 3: (["dup_pk"], 1)}


def test_filters_run_before_deduplication(spark):
    people = rows(spark, "person", dict(year_of_birth=None), dict(year_of_birth=1990))
    (kept,) = cleaning.clean_table(people, MODEL["person"]).collect()
    assert kept["year_of_birth"] == 1990


def test_null_keys_keep_one_row(spark):
    people = rows(spark, "person", dict(person_id=None), dict(person_id=None, year_of_birth=1970), dict(person_id=None))
    (kept,) = cleaning.clean_table(people, MODEL["person"]).collect()
    assert (kept["person_id"], kept["year_of_birth"]) == (None, 1970)
    removed = cleaning.quarantine(people, MODEL["person"]).collect()
    assert [(r["year_of_birth"], r["copies"]) for r in removed] == [(1980, 2)]


def test_removing_a_person_removes_visits_and_then_notes(spark):
    raw = valid_tables(spark)
    raw["person"] = rows(spark, "person", {}, dict(person_id=2, gender_concept_id=None))
    raw["visit_occurrence"] = rows(spark, "visit_occurrence", {}, dict(visit_occurrence_id=11, person_id=2))
    raw["note"] = rows(spark, "note", {}, dict(note_id=401, person_id=2, visit_occurrence_id=11))
    cleaned = cleaning.clean_all(raw, MODEL)
    assert survivors(cleaned["visit_occurrence"], "visit_occurrence_id") == {10: 1}
    assert survivors(cleaned["note"], "note_id") == {400: 1}
    assert set(counts(checks.check_all(cleaned, MODEL)).values()) == {0}
    # The raw tables know person 2, so the raw report has no orphans.
    assert counts(checks.check_table(raw["visit_occurrence"], MODEL["visit_occurrence"], raw))["orphan_person_id"] == 0


def test_counts_before_and_after(spark):
    raw = valid_tables(spark)
    raw["person"] = rows(spark, "person", {}, dict(person_id=2, gender_concept_id=None))
    found = {r["table"]: r for r in cleaning.cleaning_counts(raw, cleaning.clean_all(raw, MODEL)).collect()}
    person = found["person"]
    assert (person["raw"], person["cleaned"], person["dropped"], person["drop_pct"]) == (2, 1, 1, 50.0)
    assert list(found) and len(found) == 6


def test_counts_of_empty_tables_have_no_rate(spark):
    empty = {name: table(spark, name, []) for name in VALID}
    found = cleaning.cleaning_counts(empty, cleaning.clean_all(empty, MODEL)).collect()
    assert {(r["raw"], r["dropped"], r["drop_pct"]) for r in found} == {(0, 0, None)}


def test_single_rule_filters(spark):
    drug, spec = rows(spark, "drug_exposure", *CASES["drug_exposure"][0]), MODEL["drug_exposure"]
    assert 201 not in survivors(cleaning.drop_missing(drug, spec), "drug_exposure_id")
    assert 202 not in survivors(cleaning.drop_bad_dates(drug, spec), "drug_exposure_id")
    left = survivors(cleaning.drop_negatives(drug, spec), "drug_exposure_id")
    assert 203 not in left and 204 not in left and 205 in left


def test_reason_counts_add_copies(spark):
    people = rows(spark, "person", {}, {}, {}, dict(person_id=2, race_concept_id=None))
    removed = cleaning.quarantine(people, MODEL["person"])
    found = Counter({r["reason"]: r["rows"] for r in cleaning.reason_counts(removed, "person").collect()})
    assert found == {"dup_pk": 2, "null_race_concept_id": 1}


# --- by row address ------------------------------------------------------------------------


def _many(spark, name):
    """The cases above, with null keys, keys with several contents, and one key with very many copies."""
    changes, _ = CASES[name]
    key = MODEL[name].key
    text = [c for c in MODEL[name].columns if c not in (key, *MODEL[name].required) and c not in {f.column for f in MODEL[name].foreign_keys}]
    more = [{key: None}, {key: None}, *[{key: 700, c: None} for c in text], *[{key: 700}] * 300, {key: 701}, {key: 701}]
    return rows(spark, name, *changes, *more).repartition(5)


@pytest.fixture
def keep(spark):
    with storage.scratch(spark) as folder:
        yield storage.stored_in(folder)


def _counted(df):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", list(CASES))
def test_addresses_give_the_same_rows(spark, keep, name):
    raw, spec, parents = keep("raw", _many(spark, name)), MODEL[name], valid_tables(spark)
    by_address = cleaning.clean_stored(raw, spec, parents, keep)
    # NaN is not equal to itself; no cleaned row holds one.
    assert _counted(by_address) == _counted(cleaning.clean_table(raw, spec, parents))
    assert by_address.columns == spec.columns
    removed = cleaning.quarantine(raw, spec, parents)
    found = cleaning.quarantine_stored(raw, spec, parents, keep)
    assert found.columns == removed.columns
    assert Counter(map(str, found.collect())) == Counter(map(str, removed.collect()))
    counts = {r["reason"]: r["rows"] for r in cleaning.removed_counts(raw, spec, parents, keep).collect()}
    assert counts == {r["reason"]: r["rows"] for r in cleaning.reason_counts(removed, name).collect()}


def test_addresses_of_clean_and_empty_tables(spark, keep):
    for name, df in (("one", rows(spark, "person", {})), ("none", table(spark, "person", []))):
        raw, spec = keep(name, df), MODEL["person"]
        assert cleaning.clean_stored(raw, spec, {}, keep).collect() == df.collect()
        assert cleaning.quarantine_stored(raw, spec, {}, keep).collect() == []
        assert cleaning.removed_counts(raw, spec, {}, keep).collect() == []


def test_cleaned_notes_are_not_moved_with_their_texts(spark, keep):
    raw, spec = keep("raw", _many(spark, "note")), MODEL["note"]
    parents = {n: keep(f"parent_{n}", df) for n, df in valid_tables(spark).items()}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cleaned = plan(cleaning.clean_stored(raw, spec, parents, keep))
    assert "BroadcastHashJoin" in cleaned and "hashpartitioning" not in cleaned and "note_text" in cleaned
    # The text is read for the rule that it must not be missing, and goes no further.
    doubtful = plan(cleaning.doubtful_addresses(raw, spec, parents))
    assert "Exchange" in doubtful
    for line in doubtful.splitlines():
        assert "note_text" not in line or any(step in line for step in ("Scan", "Project", "Filter")), line
