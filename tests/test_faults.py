import hashlib
from collections import Counter
from datetime import timedelta

import pytest

from tables import D1, VALID, counts, rows
from vitalsift.operators import checks, cleaning, faults, sampling
from vitalsift.specs import MODEL


def digest_order(keys, seed):
    return sorted(keys, key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())


@pytest.mark.parametrize("k", [0, 1, 37, 999, 1000, 5000])
def test_exactly_k_rows(spark, k):
    df = spark.range(1000).withColumnRenamed("id", "key")
    found = {r["key"] for r in sampling.sample_rows(df, "key", k, 42).collect()}
    assert found == set(digest_order(range(1000), 42)[:k])


def test_sampling_nothing(spark):
    assert sampling.sample_rows(spark.range(0), "id", 10, 1).collect() == []


def _many(spark, name, n):
    key = MODEL[name].key
    return rows(spark, name, *[{key: i} for i in range(1, n + 1)])


def test_at_least_one_row_is_hit(spark):
    people = _many(spark, "person", 10)
    dirty = faults.inject(people, "person_id", (faults.Fault("null", "year_of_birth"),), fraction=0.015)
    assert dirty.filter("year_of_birth is null").count() == 1


def test_values_of_each_fault(spark):
    drugs = _many(spark, "drug_exposure", 200)
    dirty = faults.inject_table(drugs, MODEL["drug_exposure"], fraction=0.1, seed=42).collect()
    by_fault = {
        "null": {r["drug_exposure_id"] for r in dirty if r["drug_concept_id"] is None},
        "bad": {r["drug_exposure_id"] for r in dirty if r["drug_exposure_end_date"] == D1 - timedelta(days=1)},
        "days": {r["drug_exposure_id"] for r in dirty if r["days_supply"] == -1},
        "quantity": {r["drug_exposure_id"] for r in dirty if r["quantity"] == -1.0},
        "dup": {k for k, n in Counter(r["drug_exposure_id"] for r in dirty).items() if n == 2},
    }
    for place, chosen in enumerate(by_fault.values()):
        assert chosen == set(digest_order(range(1, 201), 43 + place)[:20])
    assert len(dirty) == 220


def test_orphans_use_an_id_that_never_exists(spark):
    notes = _many(spark, "note", 100)
    dirty = faults.inject(notes, "note_id", (faults.Fault("orphan", "visit_occurrence_id"),), fraction=0.05)
    assert dirty.filter("visit_occurrence_id = -1").count() == 5


def test_injected_faults_are_found_and_cleaned(spark):
    tables = {name: _many(spark, name, 400) for name in VALID}
    tables["visit_occurrence"] = rows(spark, "visit_occurrence", *[dict(visit_occurrence_id=i) for i in range(1, 401)])
    dirty = faults.inject_all(tables, MODEL, fraction=0.05, seed=7)
    report = {(r["table"], r["check"]): r["violations"] for r in checks.check_all(dirty, MODEL).collect()}
    hit = {
        name: {f"null_{f.column}" for f in plan if f.kind == "null"}
        | {f"bad_date_{f.column}" for f in plan if f.kind == "bad_date"}
        | {f"neg_{f.column}" for f in plan if f.kind == "negative"}
        | {f"orphan_{f.column}" for f in plan if f.kind == "orphan"}
        for name, plan in faults.FAULTS.items()
    }
    for (name, check), violations in report.items():
        if check == "dup_pk":
            assert violations == 20
        elif check in hit[name]:
            # Duplicates copy rows that other faults have hit already.
            assert 20 <= violations <= 40, (name, check)
        else:
            assert violations == 0, (name, check)
    cleaned = cleaning.clean_all(dirty, MODEL)
    assert set(counts(checks.check_all(cleaned, MODEL)).values()) == {0}


def test_injection_repeats_exactly(spark):
    people = _many(spark, "person", 300)
    first, second = (
        Counter(faults.inject_table(df, MODEL["person"]).collect()) for df in (people, people.repartition(5))
    )
    assert first == second


@pytest.mark.parametrize("k", [1, 40, 299, 500])
def test_exactly_k_rows_where_keys_repeat(spark, k):
    kinds = {
        "all alike": [(1, "x")] * 300,
        "one key": [(1, str(i % 90)) for i in range(300)],
        "no key": [(None, str(i // 2)) for i in range(300)],
        "some": [(i % 7 if i % 3 else None, str(i % 5)) for i in range(300)],
    }
    for kind, data in kinds.items():
        df = spark.createDataFrame(data, "key int, text string")
        found = [tuple(r) for r in sampling.sample_rows(df.repartition(4), "key", k, 42).collect()]
        assert len(found) == min(k, 300), kind
        left = Counter(data)
        left.subtract(found)
        assert min(left.values()) >= 0, kind
        again = [tuple(r) for r in sampling.sample_rows(df.repartition(2), "key", k, 42).collect()]
        assert Counter(found) == Counter(again), kind


def test_no_task_ranks_the_rows_of_a_bucket(spark):
    """Windows run over counts; the last one over the few digests that share eight digits."""
    df = spark.range(1_000)
    text = sampling.cutoffs(df, "id", {"a": 1}, k=10)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window" in line and "windowspecdefinition" in line]
    assert windows and not any("row_number" in w for w in windows)
    assert text.count("partial_sum(_weight") >= 3 or text.count("partial_sum") >= 3
