"""From source exports (text columns, source ids and codes) to the model's tables.

Source tables and their columns, all strings:
patients (Id, GENDER, RACE, ETHNICITY, BIRTHDATE), encounters (Id, PATIENT, ENCOUNTERCLASS,
START, STOP), conditions (CODE, PATIENT, ENCOUNTER, START, STOP), medications (CODE, PATIENT,
ENCOUNTER, START, STOP, DISPENSES), observations (CODE, PATIENT, ENCOUNTER, DATE, VALUE, UNITS).

Every mapper marks the rows that it leaves out with the reason, ``_lost``, or with ``_listed`` where
a code has no concept, and a table is what is not marked. A job stores the marked rows, so that one pass over an
export gives the table and the tally of lost rows, which reads the marks alone. Counts taken inside
the pass itself would be too high after the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalsift.config import DEFAULTS, JobConfig
from vitalsift.functions import codes
from vitalsift.functions.scalars import days_supplied, lenient_date, lenient_double, strict_date
from vitalsift.operators.cleaning import Keep, unchanged
from vitalsift.operators.latest import top_recent
from vitalsift.operators.lookup import lookup
from vitalsift.operators.numbering import dense_ids, dense_row_ids
from vitalsift.plans.notes import map_note
from vitalsift.specs import MODEL, Model, TableSpec


def typed(df: DataFrame, spec: TableSpec, *more: str) -> DataFrame:
    """The table's columns in order and type, then ``more``; columns the source lacks are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in spec.schema
        ],
        *more,
    )


def _present(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


# --- people ------------------------------------------------------------------------------


def person_keys(patients: DataFrame) -> DataFrame:
    """Source patient id to ``person_id``. Covers patients that ``map_person`` leaves out, so
    their events become orphans instead of losing their person."""
    return dense_ids(patients, "Id", "person_id")


# A patient or visit without an id cannot be referred to; it is lost and counted as such.
_PERSON_CODES = ("gender_concept_id", "race_concept_id", "ethnicity_concept_id")


def judged_patients(patients: DataFrame) -> DataFrame:
    """All patients, with ``_lost`` where the id or a concept of gender, race or ethnicity is missing."""
    rows = patients.select(
        "Id",
        "BIRTHDATE",
        codes.concept_of(F.col("GENDER"), codes.GENDER, fold="upper").alias("gender_concept_id"),
        codes.concept_of(F.col("RACE"), codes.RACE, fold="lower").alias("race_concept_id"),
        codes.concept_of(F.col("ETHNICITY"), codes.ETHNICITY, fold="lower").alias("ethnicity_concept_id"),
    )
    lost = F.when(F.col("Id").isNull(), "missing_id").when(~_present(*_PERSON_CODES), "unmapped_concept")
    born = F.when(lost.isNull(), F.year(strict_date(F.col("BIRTHDATE"))))
    return rows.select("Id", *_PERSON_CODES, born.alias("year_of_birth"), lost.alias("_lost"))


def _kept(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("_lost").isNull()).drop("_lost")


def map_person(patients: DataFrame, people: DataFrame, model: Model = MODEL) -> DataFrame:
    """People with an id whose gender, race and ethnicity all have a concept."""
    return _people(judged_patients(patients), people, model)


def _people(judged: DataFrame, people: DataFrame, model: Model) -> DataFrame:
    return typed(lookup(_kept(judged), people, "Id", "inner"), model["person"])


# --- visits ------------------------------------------------------------------------------


_VISIT_FIELDS = ("person_id", "visit_concept_id", "visit_start_date")


def judged_encounters(encounters: DataFrame, people: DataFrame) -> DataFrame:
    """All encounters, with ``_lost`` where the id, the person, the class's concept or the start is missing."""
    rows = encounters.select(
        "Id",
        "PATIENT",
        codes.concept_of(F.col("ENCOUNTERCLASS"), codes.VISIT_CLASS, fold="lower").alias("visit_concept_id"),
        strict_date(F.col("START")).alias("visit_start_date"),
        strict_date(F.col("STOP")).alias("visit_end_date"),
    )
    lost = F.when(F.col("Id").isNull(), "missing_id").when(~_present(*_VISIT_FIELDS), "unmapped_or_missing")
    return lookup(rows, people.withColumnRenamed("Id", "PATIENT"), "PATIENT").withColumn("_lost", lost)


def kept_visits(
    encounters: DataFrame, people: DataFrame, config: JobConfig = DEFAULTS
) -> DataFrame:
    """The most recent usable visits of each person, with their source ids."""
    return _most_recent(judged_encounters(encounters, people), config)


def _most_recent(judged: DataFrame, config: JobConfig) -> DataFrame:
    return top_recent(_kept(judged), "person_id", "visit_start_date", "Id", config.visits_per_person)


def visit_keys(kept: DataFrame) -> DataFrame:
    """Source encounter id to ``visit_occurrence_id``, kept visits only."""
    return dense_ids(kept, "Id", "visit_occurrence_id")


def map_visit(kept: DataFrame, visits: DataFrame, model: Model = MODEL) -> DataFrame:
    return typed(lookup(kept, visits, "Id", "inner"), model["visit_occurrence"])


# --- events ------------------------------------------------------------------------------


def _coded(rows: DataFrame, dictionary: Mapping, concept: str, **columns: Column) -> DataFrame:
    """Source ids, concept and typed columns of events; rows whose code is not ``_listed`` hold
    nothing but their encounter."""
    listed = F.coalesce(codes.listed(F.col("CODE"), dictionary), F.lit(False))
    columns = {"PATIENT": F.col("PATIENT"), concept: codes.concept_of(F.col("CODE"), dictionary)} | columns
    return rows.select(
        "ENCOUNTER", listed.alias("_listed"), *[F.when(listed, c).alias(name) for name, c in columns.items()]
    )


def _of_kept_visits(rows: DataFrame, dictionary: Mapping, visits: DataFrame) -> DataFrame:
    """Events of kept visits as they come; texts are parsed behind this, where most rows are gone."""
    listed = codes.listed(F.col("CODE"), dictionary)
    texts = [F.when(listed, F.col(c)).alias(c) for c in rows.columns if c != "ENCOUNTER"]
    return lookup(rows.select("ENCOUNTER", *texts), visits.withColumnRenamed("Id", "ENCOUNTER"), "ENCOUNTER", "inner")


def _judged(coded: DataFrame, people: DataFrame, fields: tuple[str, ...], spec: TableSpec) -> DataFrame:
    """Listed events as rows of their table without its key; ``_lost`` where one of ``fields`` is missing."""
    rows = lookup(coded.filter("_listed"), people.withColumnRenamed("Id", "PATIENT"), "PATIENT")
    rows = rows.withColumn("_lost", F.when(~_present(*fields), "missing_required"))
    return typed(rows, spec, "_lost").drop(spec.key)


def coded_conditions(conditions: DataFrame) -> DataFrame:
    return _coded(
        conditions, codes.CONDITION, "condition_concept_id",
        condition_start_date=lenient_date(F.col("START")),
        condition_end_date=lenient_date(F.col("STOP")),
    )


def judged_conditions(coded: DataFrame, people: DataFrame, visits: DataFrame, model: Model = MODEL) -> DataFrame:
    rows = lookup(coded.filter("_listed"), visits.withColumnRenamed("Id", "ENCOUNTER"), "ENCOUNTER")
    return _judged(rows, people, ("person_id", "condition_start_date"), model["condition_occurrence"])


def map_condition(
    conditions: DataFrame, people: DataFrame, visits: DataFrame, model: Model = MODEL,
    keep: Keep = unchanged,
) -> DataFrame:
    """Whitelisted conditions. Those of a visit that was not kept stay, without the visit."""
    judged = judged_conditions(coded_conditions(conditions), people, visits, model)
    return _numbered(keep("condition_occurrence_judged", judged), model["condition_occurrence"])


def coded_drugs(medications: DataFrame, visits: DataFrame, config: JobConfig = DEFAULTS) -> DataFrame:
    return _coded(
        _of_kept_visits(medications, codes.DRUG, visits), codes.DRUG, "drug_concept_id",
        drug_exposure_start_date=lenient_date(F.col("START")),
        drug_exposure_end_date=lenient_date(F.col("STOP")),
        days_supply=days_supplied(
            F.col("START"), F.col("STOP"), config.default_days_supply, config.min_days_supply
        ),
        quantity=F.coalesce(lenient_double(F.col("DISPENSES")), F.lit(config.default_quantity)),
    )


def judged_drugs(coded: DataFrame, people: DataFrame, model: Model = MODEL) -> DataFrame:
    return _judged(coded, people, ("person_id", "drug_exposure_start_date"), model["drug_exposure"])


def map_drug(
    medications: DataFrame, people: DataFrame, visits: DataFrame, model: Model = MODEL,
    config: JobConfig = DEFAULTS, keep: Keep = unchanged,
) -> DataFrame:
    """Whitelisted drugs of kept visits."""
    judged = judged_drugs(coded_drugs(medications, visits, config), people, model)
    return _numbered(keep("drug_exposure_judged", judged), model["drug_exposure"])


def coded_measurements(observations: DataFrame, visits: DataFrame) -> DataFrame:
    return _coded(
        _of_kept_visits(observations, codes.MEASUREMENT, visits), codes.MEASUREMENT, "measurement_concept_id",
        measurement_date=lenient_date(F.col("DATE")),
        value_as_number=lenient_double(F.col("VALUE")),
        unit_concept_id=codes.concept_of(F.col("UNITS"), codes.UNIT),
        visit_occurrence_id=F.col("visit_occurrence_id"),
    )


def judged_measurements(coded: DataFrame, people: DataFrame, model: Model = MODEL) -> DataFrame:
    return _judged(coded, people, ("person_id", "measurement_date", "value_as_number"), model["measurement"])


def map_measurement(
    observations: DataFrame, people: DataFrame, visits: DataFrame, model: Model = MODEL,
    keep: Keep = unchanged,
) -> DataFrame:
    """Whitelisted measurements of kept visits; an unknown unit is null."""
    judged = judged_measurements(coded_measurements(observations, visits), people, model)
    return _numbered(keep("measurement_judged", judged), model["measurement"])


def _numbered(judged: DataFrame, spec: TableSpec) -> DataFrame:
    """Add the table's own ids; the sources have none for events."""
    return typed(dense_row_ids(_kept(judged), spec.key), spec)


# --- all tables --------------------------------------------------------------------------


@dataclass(frozen=True)
class Steps:
    """All rows of the exports on their way into the tables, lost ones marked, and the keys."""

    patients: DataFrame
    people: DataFrame
    encounters: DataFrame
    kept: DataFrame
    visits: DataFrame
    coded: dict[str, DataFrame]
    judged: dict[str, DataFrame]


def steps_of(
    sources: Mapping[str, DataFrame],
    model: Model = MODEL,
    config: JobConfig = DEFAULTS,
    keep: Keep = unchanged,
) -> Steps:
    """Mark the rows of all exports and find the keys. ``keep`` may store what later steps read;
    each export is then scanned once."""
    patients = keep("patients_judged", judged_patients(sources["patients"]))
    people = keep("person_keys", person_keys(patients))
    encounters = keep("encounters_judged", judged_encounters(sources["encounters"], people))
    kept = keep("kept_visits", _most_recent(encounters, config))
    visits = keep("visit_keys", visit_keys(kept))
    return _event_steps(sources, (patients, people, encounters, kept, visits), model, config, keep)


def _event_steps(
    sources: Mapping[str, DataFrame], found: tuple, model: Model, config: JobConfig, keep: Keep
) -> Steps:
    _, people, _, _, visits = found
    coded = {
        "condition_occurrence": coded_conditions(sources["conditions"]),
        "drug_exposure": coded_drugs(sources["medications"], visits, config),
        "measurement": coded_measurements(sources["observations"], visits),
    }
    coded = {name: keep(f"{name}_coded", df) for name, df in coded.items()}
    judged = {
        "condition_occurrence": judged_conditions(coded["condition_occurrence"], people, visits, model),
        "drug_exposure": judged_drugs(coded["drug_exposure"], people, model),
        "measurement": judged_measurements(coded["measurement"], people, model),
    }
    return Steps(*found, coded, {name: keep(f"{name}_judged", df) for name, df in judged.items()})


def map_all(
    sources: Mapping[str, DataFrame],
    model: Model = MODEL,
    config: JobConfig = DEFAULTS,
    keep: Keep = unchanged,
    steps: Steps | None = None,
) -> dict[str, DataFrame]:
    """All six tables. ``keep`` may store an intermediate table that several steps read.

    ``steps`` are those of ``steps_of`` where they are there already.
    """
    steps = steps or steps_of(sources, model, config, keep)
    tables = {
        "person": _people(steps.patients, steps.people, model),
        "visit_occurrence": map_visit(steps.kept, steps.visits, model),
    } | {name: _numbered(judged, model[name]) for name, judged in steps.judged.items()}
    tables = {name: keep(f"mapped_{name}", df) for name, df in tables.items()}
    tables["note"] = keep(
        "mapped_note",
        map_note(*[tables[name] for name in tables], seed=config.seed, model=model, keep=keep),
    )
    return {name: tables[name] for name in model}


# --- rows lost while mapping -------------------------------------------------------------


def lost_rows(steps: Steps) -> DataFrame:
    """(table, rule, rows): rows each mapping step left out, in step order, zeros included.

    Of stored steps only the marks are read.
    """

    def count(table: str, df: DataFrame, **rules: Column) -> DataFrame:
        counted = df.agg(*[F.count_if(lost).alias(rule) for rule, lost in rules.items()])
        entries = [F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("rows")) for rule in rules]
        return counted.select(F.lit(table).alias("table"), F.inline(F.array(*entries)))

    def because(*rules: str) -> dict[str, Column]:
        return {rule: F.col("_lost") == rule for rule in rules}

    usable = steps.encounters.agg(F.count_if(F.col("_lost").isNull()).alias("rows"))
    over_cap = usable.unionByName(steps.kept.agg((-F.count("*")).alias("rows"))).agg(F.sum("rows").alias("rows"))
    parts = [
        count("person", steps.patients, **because("missing_id", "unmapped_concept")),
        count("visit_occurrence", steps.encounters, **because("missing_id", "unmapped_or_missing")),
        over_cap.select(F.lit("visit_occurrence").alias("table"), F.lit("over_visit_cap").alias("rule"), "rows"),
    ]
    for table, judged in steps.judged.items():
        parts.append(count(table, steps.coded[table], unmapped_code=~F.col("_listed")))
        parts.append(count(table, judged, **because("missing_required")))
    return reduce(DataFrame.unionByName, parts)


def mapping_tally(
    sources: Mapping[str, DataFrame],
    people: DataFrame,
    kept: DataFrame,
    visits: DataFrame,
    config: JobConfig = DEFAULTS,
    keep: Keep = unchanged,
) -> DataFrame:
    """``lost_rows`` where the keys are there but the exports have not been marked yet."""
    patients = keep("patients_judged", judged_patients(sources["patients"]))
    encounters = keep("encounters_judged", judged_encounters(sources["encounters"], people))
    return lost_rows(_event_steps(sources, (patients, people, encounters, kept, visits), MODEL, config, keep))
