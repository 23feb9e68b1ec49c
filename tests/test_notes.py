"""Note text against a plain Python rendering of the same choices."""

from datetime import date

from tables import rows, table, valid_tables
from vitalsift.functions import codes
from vitalsift.plans import notes

SEED = 42


def index(row_id, slot, size):
    return ((row_id % 1_000_003) * notes.PRIMES[slot] + SEED) % size


def choose(row_id, slot, options):
    return options[index(row_id, slot, len(options))]


def expected_text(row_id, visit_type, age, gender, conditions, drugs, lab):
    if not conditions:
        kind = visit_type if visit_type in notes.COMPLAINTS else 1
        complaint = choose(row_id, "complaint", notes.COMPLAINTS[kind])
        return f"CHIEF COMPLAINT: {complaint}\n\nASSESSMENT AND PLAN: {notes.ASSESSMENTS[kind]}"
    parts = []
    if age is not None:
        word = codes.GENDER_WORDS.get(gender, "patient")
        parts.append(choose(row_id, "demographic", notes.DEMOGRAPHIC_PHRASES).format(age=age, gender=word))
    name = codes.CONDITION_NAMES[sorted(conditions)[index(row_id, "condition", len(conditions))]]
    parts.append(choose(row_id, "condition_phrase", notes.CONDITION_PHRASES).format(condition=name))
    if drugs:
        name = codes.DRUG_NAMES[sorted(drugs)[index(row_id, "drug", len(drugs))]]
        parts.append(choose(row_id, "drug_phrase", notes.DRUG_PHRASES).format(drug=name))
    if lab and lab[0] in codes.LAB_NAMES:
        phrase = choose(row_id, "lab_phrase", notes.LAB_PHRASES)
        parts.append(phrase.format(lab=codes.LAB_NAMES[lab[0]], value=f"{lab[1]:g}"))
    return "CHIEF COMPLAINT: " + " ".join(parts)


# Person: (year of birth or None when not listed, gender, conditions, drugs, latest lab).
PEOPLE = {
    1: (1980, 1, [1, 1, 1, 11, 5], [2, 2, 17], (4, 7.25)),
    2: (1955, 2, [2], [], None),
    3: (1990, 9, [9, 9], [13], (7, 3.0)),
    4: (None, None, [3, 4], [1], (1, 120.0)),
    5: (1970, 1, [], [4], (2, 30.0)),
}


def test_text_matches_plain_python(spark):
    person = rows(spark, "person", *[dict(person_id=p, year_of_birth=y, gender_concept_id=g)
                                     for p, (y, g, *_) in PEOPLE.items() if y])
    condition = rows(spark, "condition_occurrence", *[
        dict(condition_occurrence_id=i, person_id=p, condition_concept_id=c)
        for p, (_, _, cs, _, _) in PEOPLE.items() for i, c in enumerate(cs)])
    drug = rows(spark, "drug_exposure", *[
        dict(drug_exposure_id=i, person_id=p, drug_concept_id=d)
        for p, (_, _, _, ds, _) in PEOPLE.items() for i, d in enumerate(ds)])
    measurement = rows(spark, "measurement", *[
        dict(measurement_id=p, person_id=p, measurement_concept_id=lab[0], value_as_number=lab[1])
        for p, (*_, lab) in PEOPLE.items() if lab],
        dict(measurement_id=0, person_id=1, measurement_concept_id=2, value_as_number=1.0))
    visit = rows(spark, "visit_occurrence", *[
        dict(visit_occurrence_id=100 * p + i, person_id=p, visit_concept_id=i % 4, visit_start_date=date(2000 + i, 1, 1))
        for p in PEOPLE for i in range(24)])

    found = {r["note_id"]: r for r in notes.map_note(person, visit, condition, drug, measurement).collect()}
    assert len(found) == 24 * len(PEOPLE)
    for p, (born, gender, conditions, drugs, lab) in PEOPLE.items():
        for i in range(24):
            note_id = 100 * p + i
            age = 2000 + i - born if born else None
            assert found[note_id]["note_text"] == expected_text(note_id, i % 4, age, gender, conditions, drugs, lab)
            assert found[note_id]["note_date"] == date(2000 + i, 1, 1)


def test_history_counts_have_a_fixed_size(spark):
    condition = rows(spark, "condition_occurrence", *[dict(condition_occurrence_id=i, condition_concept_id=3) for i in range(500)])
    (row,) = notes.condition_history(condition).collect()
    assert row["conditions"] == [0, 0, 500] + [0] * 8


def test_people_without_history_get_zeros(spark):
    t = valid_tables(spark)
    empty = {n: table(spark, n, []) for n in ("condition_occurrence", "drug_exposure", "measurement")}
    (row,) = notes.note_inputs(
        t["visit_occurrence"], t["person"], empty["condition_occurrence"], empty["drug_exposure"], empty["measurement"]
    ).collect()
    assert (row["conditions"], row["drugs"], row["latest_lab_value"], row["age"]) == ([0] * 11, [0] * 17, None, 40)
