"""One text note per visit, put together from a person's history.

A person's history is kept as counts per concept, an array as long as the dictionary, rather
than a list of every event: its size is fixed however many events a person has. Picking a
concept from the counts gives each the same odds as picking an element of the full list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalsift.config import DEFAULTS
from vitalsift.functions import codes
from vitalsift.functions.scalars import age_on, compact_number, pick, pick_index
from vitalsift.operators.cleaning import Keep, unchanged
from vitalsift.operators.latest import latest_lab
from vitalsift.operators.lookup import lookup
from vitalsift.specs import MODEL, Model

# The phrases notes are made of.
COMPLAINTS = {
    1: [
        "Routine follow-up visit.",
        "Preventive care evaluation.",
        "Annual wellness check.",
        "Follow-up for chronic condition management.",
    ],
    2: [
        "Admission for inpatient monitoring and treatment.",
        "Inpatient stay for management of acute exacerbation.",
        "Admitted for observation and further evaluation.",
    ],
    3: [
        "Emergency evaluation for acute symptoms.",
        "Urgent care visit for new-onset complaint.",
        "Emergency department visit.",
    ],
}

# What a general note says about the kind of visit.
ASSESSMENTS = {
    1: "Patient seen and evaluated. Vital signs stable. Plan discussed with patient. Follow-up scheduled as appropriate.",
    2: "Patient admitted and monitored. Treatment initiated per protocol. Discharge planning in progress.",
    3: "Patient assessed in the emergency department. Appropriate workup completed. Disposition determined.",
}

# Phrases about the person.
DEMOGRAPHIC_PHRASES = [
    "{age}-year-old {gender} presenting today.",
    "Patient is a {age}-year-old {gender}.",
    "{gender}, age {age}, seen in clinic.",
]

# Phrases about a condition.
CONDITION_PHRASES = [
    "Patient presents for follow-up of {condition}.",
    "Continues management of {condition}.",
    "Here for routine monitoring of {condition}.",
    "Ongoing care for {condition} reviewed today.",
]

# Phrases about a drug.
DRUG_PHRASES = [
    "Currently taking {drug}, tolerating well.",
    "Medication regimen includes {drug}.",
    "Continues {drug} as prescribed.",
    "No changes made to {drug} at this visit.",
]

# Phrases about a measurement.
LAB_PHRASES = [
    "Most recent {lab} was {value}.",
    "Latest {lab} reading: {value}.",
    "{lab} at last check: {value}.",
]

# A prime per choice, so that choices within one note vary independently.
PRIMES = {
    "complaint": 7, "demographic": 11, "condition": 13, "condition_phrase": 17,
    "drug": 19, "drug_phrase": 23, "lab_phrase": 29,
}


def concept_counts(df: DataFrame, concept: str, ids: list[int], alias: str) -> DataFrame:
    """Per person, an array with the number of events of each concept in ``ids``, in that order."""
    counts = [F.count_if(F.col(concept) == i) for i in ids]
    return df.groupBy("person_id").agg(F.array(*counts).alias(alias))


def condition_history(condition: DataFrame) -> DataFrame:
    return concept_counts(condition, "condition_concept_id", list(codes.CONDITION_NAMES), "conditions")


def drug_history(drug: DataFrame) -> DataFrame:
    return concept_counts(drug, "drug_concept_id", list(codes.DRUG_NAMES), "drugs")


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n)


def note_inputs(
    visit: DataFrame, person: DataFrame, condition: DataFrame, drug: DataFrame, measurement: DataFrame,
    keep: Keep = unchanged,
) -> DataFrame:
    """Each visit with age at the visit, gender, history counts and latest lab of its person.

    History covers the whole record, whatever the date of the visit. People without history
    have all-zero counts. The facts are put together per person first, and ``keep`` may store
    them: a person with very many visits then meets them in one join that can be split.
    """
    facts = [
        person.select("person_id", "year_of_birth", "gender_concept_id"),
        condition_history(condition),
        drug_history(drug),
        latest_lab(measurement),
    ]
    visits = visit.select(
        "visit_occurrence_id", "person_id", "visit_concept_id", F.col("visit_start_date").alias("note_date")
    )

    def zeros(names: dict) -> Column:
        return F.array(*[F.lit(0).cast("long")] * len(names))

    by_person = reduce(lambda left, right: left.join(right, "person_id", "full"), facts)
    by_person = keep("note_facts", by_person.filter("person_id is not null"))
    return lookup(visits, by_person, "person_id").select(
        "visit_occurrence_id",
        "person_id",
        "visit_concept_id",
        "note_date",
        age_on(F.col("note_date"), F.col("year_of_birth")).alias("age"),
        "gender_concept_id",
        F.coalesce("conditions", zeros(codes.CONDITION_NAMES)).alias("conditions"),
        F.coalesce("drugs", zeros(codes.DRUG_NAMES)).alias("drugs"),
        "latest_lab_concept_id",
        "latest_lab_value",
    )


def _picked_concept(counts: Column, ids: list[int], row_id: Column, prime: int, seed: int) -> Column:
    """The concept at a repeatable position of the sorted list that the counts stand for.

    Null when all counts are zero.
    """
    position = pick_index(row_id, prime, seed, F.greatest(_total(counts), F.lit(1)))
    # Walk along the counts: the concept is the first whose running total exceeds the position.
    passed = F.aggregate(
        counts,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("passed")),
        lambda state, n: F.struct(
            (state["sum"] + n).alias("sum"),
            (state["passed"] + F.when(state["sum"] + n <= position, 1).otherwise(0)).alias("passed"),
        ),
        lambda state: state["passed"],
    )
    concepts = F.array(*[F.lit(i) for i in ids])
    return F.when(_total(counts) > 0, F.element_at(concepts, passed + 1))


def _filled(template: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def note_text(seed: int, row_id: str = "visit_occurrence_id") -> Column:
    """Text of a note from the columns of ``note_inputs``.

    A phrase is left out when what it is about is unknown. People without any condition get a
    general note for the kind of visit.
    """
    key = F.col(row_id)

    def phrase(slot: str, options: list[str]) -> Column:
        return pick(key, PRIMES[slot], seed, options)

    def concept(slot: str, counts: str, names: dict[int, str]) -> Column:
        picked = _picked_concept(F.col(counts), list(names), key, PRIMES[slot], seed)
        return codes.wording(picked, names)

    gender = F.coalesce(codes.wording(F.col("gender_concept_id"), codes.GENDER_WORDS), F.lit("patient"))
    demographic = _filled(
        phrase("demographic", DEMOGRAPHIC_PHRASES), age=F.col("age").cast("string"), gender=gender
    )
    condition = _filled(
        phrase("condition_phrase", CONDITION_PHRASES),
        condition=concept("condition", "conditions", codes.CONDITION_NAMES),
    )
    drug = _filled(phrase("drug_phrase", DRUG_PHRASES), drug=concept("drug", "drugs", codes.DRUG_NAMES))
    lab = _filled(
        phrase("lab_phrase", LAB_PHRASES),
        lab=codes.wording(F.col("latest_lab_concept_id"), codes.LAB_NAMES),
        value=compact_number(F.col("latest_lab_value")),
    )
    from_history = F.concat(F.lit("CHIEF COMPLAINT: "), F.concat_ws(" ", demographic, condition, drug, lab))

    visit_type = F.col("visit_concept_id")
    complaint = phrase("complaint", COMPLAINTS[1])
    assessment = F.lit(ASSESSMENTS[1])
    for kind in (2, 3):
        complaint = F.when(visit_type == kind, phrase("complaint", COMPLAINTS[kind])).otherwise(complaint)
        assessment = F.when(visit_type == kind, F.lit(ASSESSMENTS[kind])).otherwise(assessment)
    general = F.concat(
        F.lit("CHIEF COMPLAINT: "), complaint, F.lit("\n\nASSESSMENT AND PLAN: "), assessment
    )
    return F.when(_total(F.col("conditions")) > 0, from_history).otherwise(general)


def map_note(
    person: DataFrame,
    visit: DataFrame,
    condition: DataFrame,
    drug: DataFrame,
    measurement: DataFrame,
    *,
    seed: int = DEFAULTS.seed,
    model: Model = MODEL,
    keep: Keep = unchanged,
) -> DataFrame:
    """One note per visit. Visit ids run from 1 without gaps, and serve as note ids."""
    inputs = note_inputs(visit, person, condition, drug, measurement, keep)
    values = {
        "note_id": F.col("visit_occurrence_id"),
        "note_text": note_text(seed),
    }
    return inputs.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in model["note"].schema]
    )
