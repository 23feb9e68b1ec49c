"""Registered queries: a name, the Spark job over the test tables, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starqueries import oracles as sql
from starqueries import views
from vitalsift.config import DEFAULTS
from vitalsift.functions import codes, scalars
from vitalsift.operators import checks, cleaning, explore, faults, latest, sampling, summary
from vitalsift.plans import jobs, mapping, notes
from vitalsift.sources import tables as storage

MODEL = views.MODEL
Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Job
    oracle: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, oracle: str | None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        QUERIES[name] = Query(job, sql.with_tables(oracle) if oracle else None)
        return job

    return add


# --- cleaned views ---------------------------------------------------------------------------


def cleaned(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Cleaned tables by name; parents are cleaned along the way, other tables are not read."""
    done: dict[str, DataFrame] = {}
    for name in MODEL.cleaning_order():
        if any(name == n or name in _parents(n) for n in names):
            raw = views.VIEWS[name](spark, sf_dir)
            done[name] = cleaning.clean_table(raw, MODEL[name], done)
    return [done[n] for n in names]


def _parents(name: str) -> set[str]:
    direct = {fk.parent for fk in MODEL[name].foreign_keys}
    return direct.union(*[_parents(p) for p in direct]) if direct else set()


def with_parents(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A raw table and the cleaned tables its foreign keys name."""
    parents = [fk.parent for fk in MODEL[name].foreign_keys]
    done = cleaned(spark, sf_dir, *parents) if parents else []
    return views.VIEWS[name](spark, sf_dir), dict(zip(parents, done))


def analytic_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ("person", "visit_occurrence", "condition_occurrence", "drug_exposure", "measurement")
    return summary.person_summary(*cleaned(spark, sf_dir, *events), model=MODEL)


# --- summary ---------------------------------------------------------------------------------

register("analytic_person", "select * from analytic_person")(analytic_person)


@register("visit_counts", "select * from visit_counts")
def _(spark, sf_dir):
    return summary.visit_counts(*cleaned(spark, sf_dir, "visit_occurrence"))


@register("condition_flags", "select * from condition_flags")
def _(spark, sf_dir):
    return summary.condition_flags(*cleaned(spark, sf_dir, "condition_occurrence"))


@register("drug_counts", "select * from drug_counts")
def _(spark, sf_dir):
    return summary.drug_counts(*cleaned(spark, sf_dir, "drug_exposure"))


@register("measurement_summary", "select * from measurement_summary")
def _(spark, sf_dir):
    return summary.measurement_summary(*cleaned(spark, sf_dir, "measurement"))


@register("latest_value_by_concept", "select * from hba1c")
def _(spark, sf_dir):
    (measurement,) = cleaned(spark, sf_dir, "measurement")
    return latest.latest_value_by_concept(measurement, codes.HBA1C, "latest_hba1c")


@register(
    "latest_any_measurement",
    """select person_id, measurement_concept_id as latest_lab_concept_id, value_as_number as latest_lab_value
from c_measurement
qualify row_number() over (partition by person_id order by measurement_date desc, measurement_id desc) = 1""",
)
def _(spark, sf_dir):
    return latest.latest_lab(*cleaned(spark, sf_dir, "measurement"))


@register(
    "recent_visits_top2",
    """select * from c_visit
qualify row_number() over (partition by person_id order by visit_start_date desc, visit_occurrence_id) <= 2""",
)
def _(spark, sf_dir):
    (visit,) = cleaned(spark, sf_dir, "visit_occurrence")
    return latest.top_recent(visit, "person_id", "visit_start_date", "visit_occurrence_id", 2)


@register(
    "dedup_natural",
    f"select {', '.join(sql.COLUMNS['condition_occurrence'])} from "
    f"({sql._ranked('v_condition', 'condition_occurrence')}) where rn = 1",
)
def _(spark, sf_dir):
    return cleaning.drop_duplicates(
        views.condition_occurrence(spark, sf_dir), "condition_occurrence_id"
    )


# --- checks ----------------------------------------------------------------------------------


def joined_once(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All raw tables; the line items behind two of them are joined once."""
    return views.tables(spark, sf_dir, storage.stored_in(storage.work_folder(spark)))


def with_stored_notes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``joined_once`` with notes, which hold texts, stored as they come, to be cleaned by row address."""
    raw = joined_once(spark, sf_dir)
    return raw | {"note": storage.stored_in(storage.work_folder(spark))("raw_note", raw["note"])}


#: Tables of ``with_stored_notes`` that are Parquet files as they are.
STORED = ("note",)


def cleaned_beside(raw: dict[str, DataFrame], keep: cleaning.Keep) -> dict[str, DataFrame]:
    """All tables cleaned and stored by ``keep``; of notes, the list of rows that are gone is, so no text is written again."""
    return cleaning.clean_all(raw, MODEL, lambda name, df: df if name in STORED else keep(name, df), STORED)


def _check_one(name: str) -> Job:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parents = {fk.parent: views.VIEWS[fk.parent](spark, sf_dir) for fk in MODEL[name].foreign_keys}
        return checks.check_table(views.VIEWS[name](spark, sf_dir), MODEL[name], parents)

    return run


for _name, _short in sql.SHORT.items():
    register(f"check_{_short}", sql.check_sql(_name, "v_"))(_check_one(_name))


@register("check_all", sql.check_all_sql("v_"))
def _(spark, sf_dir):
    return checks.check_all(joined_once(spark, sf_dir), MODEL)


@register("checks_violated", f"select * from ({sql.check_all_sql('v_')}) where violations > 0")
def _(spark, sf_dir):
    return checks.violated(checks.check_all(joined_once(spark, sf_dir), MODEL))


@register(
    "violation_total",
    f"select cast(sum(violations) as bigint) as total_violations from ({sql.check_all_sql('v_')})",
)
def _(spark, sf_dir):
    return checks.violation_total(checks.check_all(joined_once(spark, sf_dir), MODEL))


@register(
    "bad_types",
    """select 'drug_exposure' as "table", c as "check", cast(n as bigint) as violations from (
select 'bad_type_drug_exposure_start_date' as c, count(*) filter (where try_strptime(START, '%Y-%m-%dT%H:%M:%S.%gZ') is null and START is not null) as n from medications
union all select 'bad_type_drug_exposure_end_date', count(*) filter (where try_strptime(STOP, '%Y-%m-%dT%H:%M:%S.%gZ') is null and STOP is not null) from medications
union all select 'bad_type_quantity', count(*) filter (where DISPENSES = 'several') from medications
union all select 'bad_type_drug_exposure_id', count(*) from medications
union all select 'bad_type_person_id', count(*) filter (where PATIENT is not null) from medications
union all select 'bad_type_drug_concept_id', count(*) filter (where try_cast(CODE as int) is null and CODE is not null) from medications
union all select 'bad_type_days_supply', count(*) filter (where try_cast(DISPENSES as int) is null and DISPENSES is not null) from medications)""",
)
def _(spark, sf_dir):
    # Every column holds the text of a source column, ids with their letters included.
    sources = {
        "drug_exposure_id": "ENCOUNTER", "person_id": "PATIENT", "drug_concept_id": "CODE",
        "drug_exposure_start_date": "START", "drug_exposure_end_date": "STOP",
        "days_supply": "DISPENSES", "quantity": "DISPENSES",
    }
    text = views.medications(spark, sf_dir).select(*[F.col(c).alias(name) for name, c in sources.items()])
    return checks.bad_type_counts(text, MODEL["drug_exposure"])


# --- cleaning --------------------------------------------------------------------------------


def _clean_one(name: str) -> Job:
    return lambda spark, sf_dir: cleaned(spark, sf_dir, name)[0]


def _clean_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes hold texts, so they are stored as they come and cleaned by row address."""
    raw, parents = with_parents(spark, sf_dir, "note")
    keep = storage.stored_in(storage.work_folder(spark))
    return cleaning.clean_stored(keep("note", raw), MODEL["note"], parents, keep)


for _name, _short in sql.SHORT.items():
    register(f"clean_{_short}", f"select * from c_{_short}")(_clean_note if _name == "note" else _clean_one(_name))


@register("cleaning_counts", "select * from cleaning_counts")
def _(spark, sf_dir):
    raw = with_stored_notes(spark, sf_dir)
    keep = storage.stored_in(storage.work_folder(spark))
    parents = {fk.parent for name in MODEL for fk in MODEL[name].foreign_keys}

    def kept(name: str, df: DataFrame) -> DataFrame:
        # Parents and addresses have several readers, cleaned tables without children one.
        return df if name in MODEL and name not in parents else keep(name, df)

    return cleaning.cleaning_counts(raw, cleaning.clean_all(raw, MODEL, kept, STORED))


@register("quarantine_reasons", sql.reasons_sql())
def _(spark, sf_dir):
    raw = joined_once(spark, sf_dir)
    keep = storage.stored_in(storage.work_folder(spark))
    # Only the tables that foreign keys name have to be cleaned.
    parents = dict(zip(("person", "visit_occurrence"), cleaned(spark, sf_dir, "person", "visit_occurrence")))
    parents = {name: keep(name, df) for name, df in parents.items()}
    counts = [cleaning.removed_counts(raw[name], MODEL[name], parents, keep) for name in MODEL]
    return reduce(DataFrame.unionByName, counts)


def _quarantine_one(name: str) -> Job:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw, parents = with_parents(spark, sf_dir, name)
        keep = storage.stored_in(storage.work_folder(spark))
        removed = cleaning.quarantine_stored(keep(name, raw), MODEL[name], parents, keep)
        return removed.withColumn("reasons", F.concat_ws(",", "reasons"))

    return run


for _name, _short in sql.SHORT.items():
    register(f"quarantine_{_short}", sql.quarantine_sql(_name))(_quarantine_one(_name))


@register(
    "run_quarantine",
    f"""select "table", cast(sum(copies) as bigint) as removed, any_value(dropped) as dropped from (
{sql.quarantined_copies_sql()}) join cleaning_counts using ("table") group by "table\"""",
)
def _(spark, sf_dir):
    """Rows that a run puts in quarantine, beside those it reports as dropped."""
    output = storage.work_folder(spark)
    metrics = jobs.run(
        spark, with_stored_notes(spark, sf_dir), output, model=MODEL, with_quarantine=True, stored=STORED
    )
    dropped = spark.createDataFrame(list(metrics["row_counts"]["dropped"].items()), "table string, dropped long")
    removed = [
        spark.read.parquet(f"{output}/_quarantine/{name}").agg(F.sum("copies").alias("removed"))
        .select(F.lit(name).alias("table"), "removed")
        for name in MODEL
    ]
    return reduce(DataFrame.unionByName, removed).join(F.broadcast(dropped), "table")


@register(
    "run_violations",
    f"select 'raw' as section, * from ({sql.check_all_sql('v_')}) "
    f"union all select 'cleaned' as section, * from ({sql.check_all_sql('c_')})",
)
def _(spark, sf_dir):
    """The check counts that a run stores, as they are compared with another run's."""
    output = storage.work_folder(spark)
    jobs.run(spark, with_stored_notes(spark, sf_dir), output, model=MODEL, stored=STORED)
    return jobs.read_violations(spark, f"{output}/_metrics")


@register("manifest_losses", sql.MAPPING_TALLY)
def _(spark, sf_dir):
    output = storage.work_folder(spark)
    jobs.generate(spark, exported(spark, sf_dir), output, model=MODEL)
    lost = spark.read.json(f"{output}/_manifest").select(F.inline("lost_in_mapping"))
    return lost.select("table", "rule", "rows")


@register("gate_report", sql.check_all_sql("c_"))
def _(spark, sf_dir):
    keep = storage.stored_in(storage.work_folder(spark))
    return checks.check_all(cleaned_beside(with_stored_notes(spark, sf_dir), keep), MODEL)


# --- single rules ----------------------------------------------------------------------------


def _without_sql(table: str, *prefixes: str) -> str:
    broken = [c for name, c in sql.RULES[table][1] if name.startswith(prefixes)]
    return f"select * from v_{sql.SHORT[table]} where not ({' or '.join(f'coalesce({c}, false)' for c in broken)})"


@register("drop_missing", _without_sql("drug_exposure", "null_"))
def _(spark, sf_dir):
    return cleaning.drop_missing(views.drug_exposure(spark, sf_dir), MODEL["drug_exposure"])


@register("drop_bad_dates", _without_sql("condition_occurrence", "bad_date_"))
def _(spark, sf_dir):
    return cleaning.drop_bad_dates(views.condition_occurrence(spark, sf_dir), MODEL["condition_occurrence"])


@register("drop_negatives", _without_sql("drug_exposure", "neg_"))
def _(spark, sf_dir):
    return cleaning.drop_negatives(views.drug_exposure(spark, sf_dir), MODEL["drug_exposure"])


@register(
    "drop_orphans",
    """select * from v_note
where visit_occurrence_id is null or visit_occurrence_id in (select visit_occurrence_id from v_visit)""",
)
def _(spark, sf_dir):
    (fk,) = MODEL["note"].foreign_keys
    return cleaning.drop_orphans(views.note(spark, sf_dir), fk, views.visit_occurrence(spark, sf_dir))


@register(
    "keep_known",
    "select * from v_measurement where person_id in (select person_id from v_person)",
)
def _(spark, sf_dir):
    (fk,) = MODEL["measurement"].foreign_keys
    return cleaning.keep_known(views.measurement(spark, sf_dir), fk, views.person(spark, sf_dir))


@register(
    "strict_orphans",
    """select 'condition_occurrence' as "table", 'orphan_person_id' as "check", count(*) as violations
from v_condition where person_id not in (select person_id from c_person)
union all select 'condition_occurrence', 'orphan_visit_occurrence_id', count(*)
from v_condition where visit_occurrence_id not in (select visit_occurrence_id from c_visit)
union all select 'drug_exposure', 'orphan_person_id', count(*)
from v_drug where person_id not in (select person_id from c_person)
union all select 'measurement', 'orphan_visit_occurrence_id', count(*)
from v_measurement where visit_occurrence_id not in (select visit_occurrence_id from c_visit)""",
)
def _(spark, sf_dir):
    strict = MODEL.with_checks(strict_keys=True)
    parents = dict(zip(("person", "visit_occurrence"), cleaned(spark, sf_dir, "person", "visit_occurrence")))
    wanted = [
        ("condition_occurrence", "person_id"), ("condition_occurrence", "visit_occurrence_id"),
        ("drug_exposure", "person_id"), ("measurement", "visit_occurrence_id"),
    ]
    found = [
        checks.orphan_count(views.VIEWS[name](spark, sf_dir), strict[name], fk, parents[fk.parent])
        for name, column in wanted
        for fk in strict[name].foreign_keys
        if fk.column == column
    ]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


# --- scalar functions ------------------------------------------------------------------------


@register(
    "age_and_band",
    """select person_id, cast(2025 - year_of_birth as int) as age,
       cast((year_of_birth // 10) * 10 as varchar) || 's' as band from v_person""",
)
def _(spark, sf_dir):
    born = F.col("year_of_birth")
    return views.person(spark, sf_dir).select(
        "person_id",
        scalars.age_at(DEFAULTS.reference_date, born).alias("age"),
        scalars.decade_band(born).alias("band"),
    )


@register(
    "compact_numbers",
    """select event_id, printf('%g', value) as text, printf('%g', seven) as seven_digits
from (select *, ((event_id * 7919) % 1000000 * 10 + 5) / 1e6 as seven from events)""",
)
def _(spark, sf_dir):
    # Decimals whose seventh digit is a lone 5, beside the values themselves.
    seven = (F.col("event_id") * 7919 % 1_000_000 * 10 + 5) / F.lit(1e6)
    return views.read(spark, sf_dir, "events").select(
        "event_id", scalars.compact_number(F.col("value")).alias("text"),
        scalars.compact_number(seven).alias("seven_digits"),
    )


@register(
    "parsed_medications",
    """select PATIENT, ENCOUNTER, CODE, cast(try_strptime(START, '%Y-%m-%dT%H:%M:%S.%gZ') as date) as start_date,
       cast(try_strptime(STOP, '%Y-%m-%dT%H:%M:%S.%gZ') as date) as stop_date,
       greatest(coalesce(cast(floor((epoch_us(try_strptime(STOP, '%Y-%m-%dT%H:%M:%S.%gZ'))
         - epoch_us(try_strptime(START, '%Y-%m-%dT%H:%M:%S.%gZ'))) / 86400000000) as int), 30), 1) as days_supply,
       coalesce(try_cast(DISPENSES as double), 1) as quantity from medications""",
)
def _(spark, sf_dir):
    start, stop = F.col("START"), F.col("STOP")
    return views.medications(spark, sf_dir).select(
        "PATIENT",
        "ENCOUNTER",
        "CODE",
        scalars.strict_date(start).alias("start_date"),
        scalars.lenient_date(stop).alias("stop_date"),
        scalars.days_supplied(start, stop, DEFAULTS.default_days_supply, DEFAULTS.min_days_supply).alias("days_supply"),
        F.coalesce(scalars.lenient_double(F.col("DISPENSES")), F.lit(DEFAULTS.default_quantity)).alias("quantity"),
    )


@register(
    "unit_concepts",
    f"""select ENCOUNTER, CODE, UNITS, {sql._case('CODE', codes.MEASUREMENT)} as measurement_concept_id,
       {sql._case('UNITS', codes.UNIT)} as unit_concept_id
from observations""",
)
def _(spark, sf_dir):
    return views.observations(spark, sf_dir).select(
        "ENCOUNTER",
        "CODE",
        "UNITS",
        codes.concept_of(F.col("CODE"), codes.MEASUREMENT).alias("measurement_concept_id"),
        codes.concept_of(F.col("UNITS"), codes.UNIT).alias("unit_concept_id"),
    )


# --- source mapping --------------------------------------------------------------------------


def _keys(
    spark: SparkSession, sf_dir: str
) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[str, DataFrame], DataFrame]]:
    """Person keys, kept visits and visit keys, each stored once for its several readers, and
    the function that stores them."""
    keep = storage.stored_in(storage.work_folder(spark))
    people = keep("person_keys", mapping.person_keys(views.patients(spark, sf_dir)))
    kept = keep("kept_visits", mapping.kept_visits(views.encounters(spark, sf_dir), people))
    return people, kept, keep("visit_keys", mapping.visit_keys(kept)), keep


@register("person_keys", "select * from people")
def _(spark, sf_dir):
    return mapping.person_keys(views.patients(spark, sf_dir))


@register("kept_visits", "select Id, person_id, visit_concept_id, visit_start_date, visit_end_date from kept_visits")
def _(spark, sf_dir):
    return _keys(spark, sf_dir)[1].drop("PATIENT")


@register("visit_keys", "select * from visits")
def _(spark, sf_dir):
    return _keys(spark, sf_dir)[2]


@register("map_person", "select * from m_person")
def _(spark, sf_dir):
    patients = views.patients(spark, sf_dir)
    return mapping.map_person(patients, mapping.person_keys(patients), MODEL)


@register("map_visit", "select * from m_visit")
def _(spark, sf_dir):
    _, kept, visits, _ = _keys(spark, sf_dir)
    return mapping.map_visit(kept, visits, MODEL)


@register("map_condition", "select * from m_condition")
def _(spark, sf_dir):
    people, _, visits, keep = _keys(spark, sf_dir)
    return mapping.map_condition(views.conditions(spark, sf_dir), people, visits, MODEL, keep)


@register("map_drug", "select * from m_drug")
def _(spark, sf_dir):
    people, _, visits, keep = _keys(spark, sf_dir)
    return mapping.map_drug(views.medications(spark, sf_dir), people, visits, MODEL, keep=keep)


@register("map_measurement", "select * from m_measurement")
def _(spark, sf_dir):
    people, _, visits, keep = _keys(spark, sf_dir)
    return mapping.map_measurement(views.observations(spark, sf_dir), people, visits, MODEL, keep)


def exported(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The source exports. Jobs read each once; the line items behind two of them are joined once."""
    return views.sources(spark, sf_dir, storage.stored_in(storage.work_folder(spark)))


@register("map_note", "select * from m_note")
def _(spark, sf_dir):
    keep = storage.stored_in(storage.work_folder(spark))
    return mapping.map_all(exported(spark, sf_dir), MODEL, keep=keep)["note"]


@register("mapping_drop_tally", sql.MAPPING_TALLY)
def _(spark, sf_dir):
    people, kept, visits, keep = _keys(spark, sf_dir)
    return mapping.mapping_tally(views.sources(spark, sf_dir, keep), people, kept, visits, keep=keep)


# --- notes -----------------------------------------------------------------------------------


def _note_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("visit_occurrence", "person", "condition_occurrence", "drug_exposure", "measurement")
    return notes.note_inputs(*cleaned(spark, sf_dir, *names))


@register(
    "concept_history",
    "select person_id, concat_ws(',', "
    + ", ".join(f"count(*) filter (where condition_concept_id = {i})" for i in range(1, 12))
    + ") as conditions from c_condition group by person_id",
)
def _(spark, sf_dir):
    history = notes.condition_history(*cleaned(spark, sf_dir, "condition_occurrence"))
    return history.withColumn("conditions", F.concat_ws(",", F.col("conditions").cast("array<string>")))


@register("note_inputs", sql.note_inputs_report_sql("c_"))
def _(spark, sf_dir):
    inputs = _note_inputs(spark, sf_dir)
    for column in ("conditions", "drugs"):
        inputs = inputs.withColumn(column, F.concat_ws(",", F.col(column).cast("array<string>")))
    return inputs


@register("note_text", f"select note_id, note_text from ({sql.note_sql('c_')})")
def _(spark, sf_dir):
    return _note_inputs(spark, sf_dir).select(
        F.col("visit_occurrence_id").alias("note_id"), notes.note_text(42).alias("note_text")
    )


# --- faults ----------------------------------------------------------------------------------


def _inject_one(view: str, fault: faults.Fault) -> Job:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = views.VIEWS[view](spark, sf_dir, copies=False)
        return faults.inject(table, MODEL[view].key, (fault,))

    return run


for _query, _view, _fault, _as_sql in [
    ("inject_nulls", "person", faults.Fault("null", "year_of_birth"), ("null", "year_of_birth", "")),
    ("inject_bad_dates", "visit_occurrence", faults.Fault("bad_date", "visit_end_date", "visit_start_date"),
     ("bad", "visit_end_date", "visit_start_date")),
    ("inject_negatives", "measurement", faults.Fault("negative", "value_as_number"), ("neg", "value_as_number", "")),
    ("inject_orphans", "note", faults.Fault("orphan", "visit_occurrence_id"), ("orphan", "visit_occurrence_id", "")),
    ("inject_duplicates", "person", faults.Fault("duplicate"), ("dup", "", "")),
]:
    register(_query, sql.inject_sql(_view, f"distinct_{sql.SHORT[_view]}", [_as_sql]))(
        _inject_one(_view, _fault)
    )


@register("sample_rows", "select * from orders order by md5('42:' || cast(o_orderkey as varchar)) limit 100")
def _(spark, sf_dir):
    return sampling.sample_rows(views.read(spark, sf_dir, "orders"), "o_orderkey", 100, 42)


@register("injected_report", sql.check_all_sql("i_"))
def _(spark, sf_dir):
    output = storage.work_folder(spark)
    jobs.generate(spark, exported(spark, sf_dir), output, model=MODEL)
    return checks.check_all(storage.read_tables(spark, MODEL, output, "parquet"), MODEL)


# --- exploring -------------------------------------------------------------------------------


@register(
    "band_counts",
    """select year_of_birth_band, count(*) as "count" from analytic_person group by 1 order by 1""",
)
def _(spark, sf_dir):
    return explore.band_counts(analytic_person(spark, sf_dir))


@register("prevalence", sql.PREVALENCE)
def _(spark, sf_dir):
    flags = {"diabetes": "has_diabetes", "hypertension": "has_hypertension"}
    return explore.prevalence(analytic_person(spark, sf_dir), flags)


@register("hba1c_summary", sql.column_summary_sql("latest_hba1c", 2))
def _(spark, sf_dir):
    return explore.column_summary(analytic_person(spark, sf_dir), "latest_hba1c", 2)


@register("sbp_summary", sql.column_summary_sql("latest_systolic_bp", 1))
def _(spark, sf_dir):
    return explore.column_summary(analytic_person(spark, sf_dir), "latest_systolic_bp", 1)


@register("preview_rows", "select * from analytic_person order by person_id limit 10")
def _(spark, sf_dir):
    return explore.preview(analytic_person(spark, sf_dir), "person_id", 10)


@register("count_sections", f'select section, "table", actual as rows from ({sql.COUNT_SECTIONS})')
def _(spark, sf_dir):
    raw = with_stored_notes(spark, sf_dir)
    keep = storage.stored_in(storage.work_folder(spark))
    return explore.count_sections(cleaning.cleaning_counts(raw, cleaning.clean_all(raw, MODEL, keep, STORED)))


@register(
    "expected_vs_actual",
    f"""select coalesce(e.section, a.section) as section, coalesce(e."table", a."table") as "table", expected, actual
from (select 'raw' as section, 'person' as "table", (select count(*) from customer) as expected
      union all select 'raw', 'visit_occurrence', (select count(*) from orders)
      union all select 'raw', 'condition_occurrence', (select count(*) from lineitem)
      union all select 'raw', 'drug_exposure', (select count(*) from lineitem)
      union all select 'raw', 'measurement', (select count(*) from events)
      union all select 'raw', 'note', (select count(*) from documents join orders on doc_id = o_orderkey)
      union all select 'cleaned', "table", raw - dropped from cleaning_counts
      union all select 'dropped', "table", 0 from cleaning_counts) e
full join ({sql.COUNT_SECTIONS}) a on e.section = a.section and e."table" = a."table"
where expected is distinct from actual""",
)
def _(spark, sf_dir):
    """Counts of a stored metrics document against those of the source tables.

    Raw tables repeat some source rows, cleaned ones are as counted, and nothing is dropped from
    the source tables; what differs is reported.
    """
    output = storage.work_folder(spark)
    metrics = jobs.run(spark, with_stored_notes(spark, sf_dir), output, model=MODEL, stored=STORED)
    actual = jobs.read_counts(spark, f"{output}/_metrics", MODEL)
    sizes = {"person": "customer", "visit_occurrence": "orders", "condition_occurrence": "lineitem",
             "drug_exposure": "lineitem", "measurement": "events"}
    sources = {name: views.read(spark, sf_dir, t) for name, t in sizes.items()}
    sources["note"] = views.note(spark, sf_dir, copies=False)
    raw = cleaning.row_counts(sources).select(F.lit("raw").alias("section"), "table", "rows")
    rest = spark.createDataFrame(
        [("cleaned", t, n) for t, n in metrics["row_counts"]["cleaned"].items()] + [("dropped", t, 0) for t in MODEL],
        raw.schema,
    )
    return explore.count_mismatches(raw.unionByName(rest), actual)


@register("manifest", sql.counts_sql("v_"))
def _(spark, sf_dir):
    return jobs.load_manifest(views.tables(spark, sf_dir))


@register(
    "row_budget",
    f"""select cast(sum(rows) as bigint) as total_rows, 100000 as budget, sum(rows) > 150000 as over_budget
from ({sql.counts_sql('v_')})""",
)
def _(spark, sf_dir):
    return jobs.row_budget(jobs.load_manifest(views.tables(spark, sf_dir)))


# --- reading and writing, whole runs ---------------------------------------------------------


@register("csv_roundtrip", "select * from v_note")
def _(spark, sf_dir):
    path = f"{storage.work_folder(spark)}/note.csv"
    storage.write_csv(views.note(spark, sf_dir), path)
    return storage.read_csv(spark, path, MODEL["note"].schema, MODEL["note"].holds_text)


@register("csv_text_roundtrip", "select * from medications")
def _(spark, sf_dir):
    path = f"{storage.work_folder(spark)}/medications.csv"
    storage.write_csv(views.medications(spark, sf_dir), path)
    return storage.read_text(spark, path)


@register("parquet_partitions", "select distinct year_of_birth_band from analytic_person order by 1")
def _(spark, sf_dir):
    path = f"{storage.work_folder(spark)}/analytic_person"
    storage.write_parquet(analytic_person(spark, sf_dir), path, [jobs.BAND])
    return storage.partition_values(spark, path, jobs.BAND)


@register("full_run_output", "select * from analytic_person")
def _(spark, sf_dir):
    output = storage.work_folder(spark)
    jobs.run(spark, with_stored_notes(spark, sf_dir), output, model=MODEL, stored=STORED)
    return spark.read.parquet(f"{output}/analytic_person").select(*MODEL.summary.names)


@register(
    "full_run_metrics",
    """select section, "table", rows from (
select 'raw' as section, "table", raw as rows from cleaning_counts
union all select 'cleaned', "table", cleaned from cleaning_counts
union all select 'dropped', "table", dropped from cleaning_counts
union all select 'analytic_person', 'analytic_person', count(*) from analytic_person)""",
)
def _(spark, sf_dir):
    output = storage.work_folder(spark)
    jobs.run(spark, with_stored_notes(spark, sf_dir), output, model=MODEL, stored=STORED)
    counts = spark.read.json(f"{output}/_metrics").select("row_counts.*")
    sections = [
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("table"), F.col(f"{section}.{name}").alias("rows"))
        for section in ("raw", "cleaned", "dropped")
        for name in MODEL
    ]
    people = F.struct(
        F.lit("analytic_person").alias("section"), F.lit("analytic_person").alias("table"),
        F.col("analytic_person").alias("rows"),
    )
    return counts.select(F.inline(F.array(*sections, people)))


@register(
    "generated_manifest",
    sql.counts_sql("i_"),
)
def _(spark, sf_dir):
    output = storage.work_folder(spark)
    jobs.generate(spark, exported(spark, sf_dir), output, model=MODEL)
    counts = spark.read.json(f"{output}/_manifest").select("row_counts.*")
    return counts.unpivot([], list(MODEL), "table", "rows")
