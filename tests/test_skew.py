"""A third of the rows on one key, many null keys, and many identical copies."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tables import rows
from vitalsift.operators import cleaning, numbering
from vitalsift.operators.lookup import lookup, with_known_key
from vitalsift.plans import mapping, notes
from vitalsift.sources.tables import stored_in, work_folder
from vitalsift.specs import MODEL

# Partitions of a few kilobytes count as large, and nothing is broadcast.
SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def splitting(spark):
    before = {k: spark.conf.get(k, None) for k in SPLITTING}
    for k, v in SPLITTING.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def keep(spark):
    return stored_in(work_folder(spark))


def final_plan(df):
    """The plan that ran; adaptive execution shows a join it has split as skewed."""
    executed = df._jdf.queryExecution()
    executed.toRdd().count()
    return executed.executedPlan().toString()


def _many(spark, n=6_000):
    """Half of the ids on one value."""
    return spark.range(0, n, 1, 12).withColumn("k", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 400))


def _measurements(spark):
    return _many(spark).select(
        F.col("id").cast("int").alias("measurement_id"), F.col("k").cast("int").alias("person_id"),
        F.lit(4).alias("measurement_concept_id"), F.current_date().alias("measurement_date"),
        F.col("id").cast("double").alias("value_as_number"),
    )


def test_keep_known_splits_a_hot_key(spark, splitting, keep):
    (fk,) = MODEL["measurement"].foreign_keys
    people = keep("people", spark.range(300).select(F.col("id").cast("int").alias("person_id")))
    assert "skew=true" in final_plan(cleaning.keep_known(keep("m", _measurements(spark)), fk, people))


def test_drop_orphans_splits_a_hot_key(spark, splitting, keep):
    (fk,) = MODEL["measurement"].foreign_keys
    people = keep("people", spark.range(300).select(F.col("id").cast("int").alias("person_id")))
    assert "skew=true" in final_plan(cleaning.drop_orphans(keep("m", _measurements(spark)), fk, people))


def test_source_ids_split_a_hot_key(spark, splitting, keep):
    text = lambda c, letter: F.concat(F.lit(letter), F.col(c).cast("string"))
    # Dates that differ keep the shuffled rows from shrinking to nothing.
    day = F.date_add(F.lit("1950-01-01").cast("date"), (F.xxhash64("id") % 9_000).cast("int")).cast("string")
    conditions = keep("conditions", _many(spark, 40_000).select(
        F.lit("44054006").alias("CODE"), text("k", "P").alias("PATIENT"), text("k", "E").alias("ENCOUNTER"),
        day.alias("START"), day.alias("STOP"),
    ))
    ids = spark.range(400)
    people = keep("people", ids.select(text("id", "P").alias("Id"), F.col("id").alias("person_id")))
    visits = keep("visits", ids.select(text("id", "E").alias("Id"), F.col("id").alias("visit_occurrence_id")))
    joined = mapping.judged_conditions(mapping.coded_conditions(conditions), people, visits)
    assert final_plan(joined).count("skew=true") >= 2
    assert joined.filter("person_id is null or visit_occurrence_id is null").count() == 0


def test_events_of_one_visit_are_split_listed_or_not(spark, splitting, keep):
    text = lambda c, letter: F.concat(F.lit(letter), F.col(c).cast("string"))
    day = F.date_add(F.lit("1950-01-01").cast("date"), (F.xxhash64("id") % 9_000).cast("int")).cast("string")
    # Three in four rows have a code without a concept.
    observations = keep("observations", _many(spark, 40_000).select(
        F.when(F.col("id") % 4 == 0, "4548-4").otherwise("none").alias("CODE"), text("k", "P").alias("PATIENT"),
        text("k", "E").alias("ENCOUNTER"), day.alias("DATE"), F.col("id").cast("string").alias("VALUE"),
        F.lit("%").alias("UNITS"),
    ))
    ids = spark.range(400)
    people = keep("people", ids.select(text("id", "P").alias("Id"), F.col("id").alias("person_id")))
    visits = keep("visits", ids.select(text("id", "E").alias("Id"), F.col("id").alias("visit_occurrence_id")))
    coded = mapping.coded_measurements(observations, visits)
    assert "skew=true" in final_plan(coded)
    stored = keep("coded", coded)
    unlisted = stored.filter("not _listed").agg(F.count("*"), F.count("PATIENT"), F.count("value_as_number"))
    assert tuple(unlisted.first()) == (30_000, 0, 0)
    judged = mapping.judged_measurements(stored, people)
    assert judged.count() == 10_000 and judged.filter("_lost is not null").count() == 0


def test_note_inputs_split_a_person_with_very_many_visits(spark, splitting, keep):
    visits = keep("visits", _many(spark).select(
        F.col("id").alias("visit_occurrence_id"), F.col("k").alias("person_id"), F.lit(1).alias("visit_concept_id"),
        F.current_date().alias("visit_start_date"),
    ))
    events = spark.range(400).select(F.col("id").alias("person_id"), F.col("id").alias("measurement_id"),
        F.lit(1980).alias("year_of_birth"), F.lit(1).alias("gender_concept_id"), F.lit(1).alias("condition_concept_id"),
        F.lit(1).alias("drug_concept_id"), F.lit(1).alias("measurement_concept_id"), F.lit(1.5).alias("value_as_number"),
        F.current_date().alias("measurement_date"))
    inputs = notes.note_inputs(visits, events, events, events, events, keep)
    assert "skew=true" in final_plan(inputs)
    assert inputs.count() == 6_000


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_keeps_null_and_unknown_keys_as_asked(spark, how):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "a")], "id int, k string")
    keyed = spark.createDataFrame([("a", "A")], "k string, v string")
    expected = {"left": {1, 2, 3, 4}, "inner": {1, 4}, "left_semi": {1, 4}}[how]
    assert {r["id"] for r in lookup(left, keyed, "k", how).collect()} == expected


def test_known_keys_may_repeat(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted(r["id"] for r in with_known_key(left, keys, "k").collect()) == [1, 2]


def _skewed_notes(spark):
    changes = [dict(note_id=i, visit_occurrence_id=10) for i in range(60)]
    changes += [dict(note_id=100 + i, visit_occurrence_id=None) for i in range(30)]
    changes += [dict(note_id=200 + i, visit_occurrence_id=99) for i in range(20)]
    changes += [dict(note_id=500) for _ in range(70)]
    return rows(spark, "note", *changes)


def test_hot_keys_are_cleaned_and_quarantined_whole(spark):
    notes_, parents = _skewed_notes(spark), {"visit_occurrence": rows(spark, "visit_occurrence", {})}
    kept = cleaning.clean_table(notes_, MODEL["note"], parents).collect()
    removed = cleaning.quarantine(notes_, MODEL["note"], parents).collect()
    assert len(kept) == 91
    found = Counter({(r["note_id"], tuple(r["reasons"])): r["copies"] for r in removed})
    assert found[500, ("dup_pk",)] == 69 and sum(found.values()) == 89
    assert notes_.count() == len(kept) + sum(found.values())


def test_a_null_key_is_not_the_text_of_a_sign(spark):
    from pyspark.sql import types as T

    from vitalsift.specs import TableSpec

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.IntegerType())])
    table = spark.createDataFrame([(None, 1), ("~", 2), ("~", 2), ("n", 3), (None, 1)], schema)
    spec = TableSpec("t", schema, key="k")
    removed = [tuple(r) for r in cleaning.quarantine(table, spec).collect()]
    assert sorted(removed, key=str) == sorted([("~", 2, ["dup_pk"], 1), (None, 1, ["dup_pk"], 1)], key=str)
    assert cleaning.clean_table(table, spec).count() == 3


def test_ids_are_dense_and_follow_the_digest(spark):
    keys = spark.createDataFrame([(f"P{i % 700}",) for i in range(2000)] + [(None,)], "Id string")
    found = {r["Id"]: r["n"] for r in numbering.dense_ids(keys, "Id", "n").collect()}
    in_order = sorted((f"P{i}" for i in range(700)), key=lambda k: hashlib.md5(k.encode()).hexdigest())
    assert found == {k: i + 1 for i, k in enumerate(in_order)}


def test_every_copy_gets_its_own_id(spark, monkeypatch):
    monkeypatch.setattr(numbering, "IDS_PER_CHUNK", 64)
    df = spark.createDataFrame([(i % 5, None if i % 2 else "x") for i in range(200)], "a int, b string")
    df = df.unionByName(spark.createDataFrame([(9, "hot")] * 1000, df.schema))
    numbered = numbering.dense_row_ids(df, "n").collect()
    assert sorted(r["n"] for r in numbered) == list(range(1, 1201))
    assert Counter((r["a"], r["b"]) for r in numbered) == Counter(map(tuple, df.collect()))
    hot = sorted(r["n"] for r in numbered if r["b"] == "hot")
    assert hot == list(range(hot[0], hot[0] + 1000))


def test_copies_of_a_row_are_numbered_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "IDS_PER_CHUNK", 64)
    copies = spark.range(20_000).select(F.lit(1).alias("a"))
    # Small partitions would be merged, as they hold little before the rows are expanded.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = numbering.dense_row_ids(copies, "n").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["n"] for r in numbered) == list(range(1, 20_001))
    per_task = Counter(r["task"] for r in numbered)
    assert len(per_task) == 3 and max(per_task.values()) < 10_000


def test_ids_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 90).alias("a"), F.lit("x").alias("b"))
    one, many = (numbering.dense_row_ids(df.repartition(n), "n").collect() for n in (1, 7))
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_numbering_nothing(spark):
    empty = spark.createDataFrame([], "Id string")
    assert numbering.dense_ids(empty, "Id", "n").collect() == []
    assert numbering.dense_row_ids(empty, "n").collect() == []
