"""Properties of the physical plans that matter at scale."""

import os
import re

import pytest

from starqueries import queries, views
from tables import table, valid_tables
from vitalsift.operators import checks, cleaning, faults, latest, sampling, summary
from vitalsift.plans import mapping, notes
from vitalsift.sources import tables as storage
from vitalsift.specs import MODEL, WIDE_MODEL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    keep = storage.stored_in(storage.work_folder(spark))
    return {name: keep(name, df) for name, df in valid_tables(spark).items()}


@pytest.fixture(scope="module")
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def everything(stored):
    cleaned = cleaning.clean_all(stored, MODEL)
    events = ("person", "visit_occurrence", "condition_occurrence", "drug_exposure", "measurement")
    return [
        checks.check_all(stored, MODEL),
        summary.person_summary(*[cleaned[n] for n in events]),
        cleaned["note"],
        cleaning.quarantine(stored["note"], MODEL["note"], cleaned),
        faults.inject_table(stored["drug_exposure"], MODEL["drug_exposure"]),
    ]


def test_no_cross_joins_and_no_python(stored, no_broadcast):
    for df in everything(stored):
        text = plan(df)
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "ExistingRDD"):
            assert word not in text, word


def test_summary_shuffles_each_table_once(stored, no_broadcast):
    events = ("person", "visit_occurrence", "condition_occurrence", "drug_exposure", "measurement")
    text = plan(summary.person_summary(*[stored[n] for n in events]))
    assert text.count("Exchange hashpartitioning(person_id") == 5
    assert text.count("Exchange") == 5
    # Counts and latest values combine before the shuffle, in hash aggregates.
    assert len(re.findall(r"HashAggregate\(keys=\[person_id[^,]*, functions=\[partial_count", text)) == 4
    assert "partial_max_by" in text and "SortAggregate" not in text and "Window" not in text


def test_wide_ids_combine_in_hash_aggregates(spark, no_broadcast):
    wide = {name: table(spark, name, [], WIDE_MODEL) for name in WIDE_MODEL}
    events = ("person", "visit_occurrence", "condition_occurrence", "drug_exposure", "measurement")
    for df in (
        summary.person_summary(*[wide[n] for n in events], model=WIDE_MODEL),
        summary.measurement_summary(wide["measurement"]),
        latest.latest_lab(wide["measurement"]),
        latest.latest_value_by_concept(wide["measurement"], 4, "v"),
    ):
        text = plan(df)
        assert "partial_max_by" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_a_report_moves_keys_only(stored, no_broadcast):
    text = plan(checks.counts_and_checks(stored, MODEL))
    # Rules of six tables, their keys, and a column and a parent's key for each of three references.
    assert text.count("FileScan parquet") <= 6 + 6 + 2 * 3
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sum("," in s for s in schemas) == 6
    # Rules are added up where rows are read: their counts travel in a single row per task.
    assert text.count("Exchange SinglePartition") >= 6


def test_the_gate_reads_keys_only(stored):
    text = plan(checks.key_checks(stored, MODEL))
    assert not any("," in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text))


def test_building_plans_runs_no_job(spark, stored):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        everything(stored)
        cleaning.quarantine_all(stored, cleaning.clean_all(stored, MODEL), MODEL)
        notes.map_note(*[stored[n] for n in stored if n != "note"])
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_summary_reads_only_the_columns_it_needs(stored):
    events = ("person", "visit_occurrence", "condition_occurrence", "drug_exposure", "measurement")
    text = plan(summary.person_summary(*[stored[n] for n in events]))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert "person_id:int" in schemas
    assert "person_id:int,visit_concept_id:int" in schemas
    assert not any("race_concept_id" in s or "quantity" in s or "unit_concept_id" in s for s in schemas)


def test_rules_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(cleaning.clean_table(stored["measurement"], MODEL["measurement"], stored))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", text)
    assert any("GreaterThanOrEqual(value_as_number" in p and "IsNotNull(person_id)" in p for p in pushed)


def test_duplicates_are_reduced_before_the_shuffle(stored, no_broadcast):
    for df, limit in (
        (cleaning.drop_duplicates(stored["note"], "note_id"), "1, Partial"),
        (latest.top_recent(stored["visit_occurrence"], "person_id", "visit_start_date", "visit_occurrence_id", 2), "2, Partial"),
    ):
        text = plan(df)
        assert re.search(rf"WindowGroupLimit .*{limit}", text)
        assert text.index("Partial") > text.index("Exchange")


def test_references_are_counted_before_they_are_joined(stored, no_broadcast):
    spec = MODEL["measurement"]
    text = plan(checks.orphan_count(stored["measurement"], spec, spec.foreign_keys[0], stored["person"]))
    assert text.count("Exchange hashpartitioning(person_id") == 2
    assert text.index("LeftAnti") < text.index("partial_count(1)")


def test_injecting_faults_moves_no_rows(stored, no_broadcast):
    """Only the main branch holds the rows; the samples are found in subqueries over keys."""
    text = plan(faults.inject_table(stored["note"], MODEL["note"]))
    main = text.split("Subquery")[0]
    assert "Exchange" not in main and "note_text" in main


def test_writing_by_band_regroups_once(stored):
    hinted = stored["person"].hint("rebalance", "year_of_birth")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(hinted)


def test_drug_texts_are_parsed_behind_the_join(spark, no_broadcast):
    medications = spark.createDataFrame([], "CODE string, PATIENT string, ENCOUNTER string, START string, STOP string, DISPENSES string")
    visits = spark.createDataFrame([], "Id string, visit_occurrence_id long")
    text = plan(mapping.coded_drugs(medications, visits))
    assert text.index("AS days_supply") < text.index("Join")


def test_samples_take_two_scans_of_the_key(stored, no_broadcast):
    text = plan(sampling.cutoffs(stored["person"], "person_id", {"a": 1}, k=1))
    # The second scan meets the edge that the first one found.
    assert text.count("FileScan parquet") == 2


def test_suspects_are_stored_before_texts_are_fetched(stored):
    kept = []
    cleaning.clean_stored(stored["note"], MODEL["note"], stored, lambda name, df: kept.append(name) or df)
    assert kept == ["note_suspects", "note_gone"]


SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@needs_tables
def test_lines_move_without_keys_of_parts(spark, no_broadcast):
    lines = views.tables(spark, SF_DIR, lambda name, df: df)["drug_exposure"]
    moved = [line for line in plan(lines).splitlines() if "hashpartitioning(l_orderkey" in line]
    assert moved
    text = lines._jdf.queryExecution().optimizedPlan().toString()
    join = text.index("Join Inner")
    assert "_partkey" not in text[:join] and "_suppkey" not in text[:join]


@needs_tables
def test_texts_of_notes_meet_few_orders_without_moving(spark):
    keep = storage.stored_in(storage.work_folder(spark))
    # Smaller than all orders, larger than those of notes.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    text = plan(views.tables(spark, SF_DIR, keep)["note"])
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_cleaned_notes_of_the_gate_query_are_not_stored(stored):
    kept = []
    queries.cleaned_beside(stored, lambda name, df: kept.append(name) or df)
    assert "note" not in kept and {"note_gone", "person", "drug_exposure"} <= set(kept)
