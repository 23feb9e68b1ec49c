import os
from datetime import date

import pytest

from tables import rows, valid_tables
from vitalsift.operators import checks
from vitalsift.sources import tables as storage
from vitalsift.specs import MODEL

TEXTS = [
    "CHIEF COMPLAINT: Routine visit.\n\nASSESSMENT AND PLAN: Stable.",
    'said "fine", left',
    "  padded  ",
    "back\\slash \\\" quote",
    "plain",
]


def test_csv_keeps_newlines_quotes_and_spaces(spark, tmp_path):
    notes = rows(spark, "note", *[dict(note_id=i, note_text=t) for i, t in enumerate(TEXTS)], dict(note_id=99, note_text=None))
    storage.write_csv(notes, str(tmp_path / "note.csv"))
    back = storage.read_table(spark, MODEL["note"], str(tmp_path))
    assert sorted(back.collect(), key=str) == sorted(notes.collect(), key=str)
    assert back.schema.names == MODEL["note"].columns


def test_empty_text_reads_as_missing(spark, tmp_path):
    storage.write_csv(rows(spark, "note", dict(note_text="")), str(tmp_path / "note.csv"))
    assert storage.read_table(spark, MODEL["note"], str(tmp_path)).first()["note_text"] is None


def test_a_single_csv_file_with_a_blank_line_in_a_cell(spark, tmp_path):
    (tmp_path / "note.csv").write_text(
        "note_id,person_id,note_date,note_text,visit_occurrence_id\n"
        '1,1,2025-01-01,"first\n\nsecond ""quoted""",1\n'
        "2,2,2025-01-02,single line,\n"
    )
    found = {r["note_id"]: r for r in storage.read_table(spark, MODEL["note"], str(tmp_path)).collect()}
    assert found[1]["note_text"] == 'first\n\nsecond "quoted"'
    assert (found[2]["note_date"], found[2]["visit_occurrence_id"]) == (date(2025, 1, 2), None)


def test_malformed_fields_become_null_and_the_row_stays(spark, tmp_path):
    (tmp_path / "person.csv").write_text(
        ",".join(MODEL["person"].columns) + "\n1,1,nineteen,1,1,\n2,1,1980,1,1,\n"
    )
    people = storage.read_table(spark, MODEL["person"], str(tmp_path))
    assert {r["person_id"]: r["year_of_birth"] for r in people.collect()} == {1: None, 2: 1980}
    text = storage.read_text(spark, str(tmp_path / "person.csv"))
    assert set(text.dtypes) == {(c, "string") for c in MODEL["person"].columns}
    found = {r["check"]: r["violations"] for r in checks.bad_type_counts(text, MODEL["person"]).collect()}
    assert found["bad_type_year_of_birth"] == 1 and sum(found.values()) == 1


def test_a_reordered_header_is_an_error(spark, tmp_path):
    columns = MODEL["person"].columns
    (tmp_path / "person.csv").write_text(",".join([columns[1], columns[0], *columns[2:]]) + "\n1,2,1980,1,1,\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        storage.read_table(spark, MODEL["person"], str(tmp_path)).collect()


def test_six_tables_as_csv_and_parquet(spark, tmp_path):
    for name, df in valid_tables(spark).items():
        storage.write_csv(df, str(tmp_path / f"{name}.csv"))
        storage.write_parquet(df, str(tmp_path / name))
    for format in ("csv", "parquet"):
        back = storage.read_tables(spark, MODEL, str(tmp_path), format)
        assert list(back) == list(MODEL)
        for name, df in valid_tables(spark).items():
            assert back[name].collect() == df.collect()


def test_partitioned_parquet(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat(1940 + 10 * (id % 4), 's') as band")
    path = str(tmp_path / "out")
    storage.write_parquet(df, path, ["band"])
    storage.write_parquet(df, path, ["band"])
    assert [r[0] for r in storage.partition_values(spark, path, "band").collect()] == ["1940s", "1950s", "1960s", "1970s"]
    plan = storage.partition_values(spark, path, "band")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" not in plan and "ReadSchema: struct<>" in plan
    # A file that is no Parquet is not noticed, as nothing is read.
    broken = next(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    open(broken, "wb").write(b"no parquet")
    assert storage.partition_values(spark, path, "band").count() == 4
    storage.write_parquet(df, path, ["band"])
    assert spark.read.parquet(path).count() == 1000
    # Rows are grouped by band first: one file per directory at this size.
    for band in (tmp_path / "out").glob("band=*"):
        assert len(list(band.glob("*.parquet"))) == 1


def test_missing_input_is_named(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        storage.read_table(spark, MODEL["person"], str(tmp_path)).collect()


def test_stored_tables_are_read_back(spark):
    folder = storage.work_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    keep = storage.stored_in(folder)
    stored = keep("person", rows(spark, "person", {}))
    assert stored.collect() == rows(spark, "person", {}).collect()
    assert stored.inputFiles()[0].startswith(f"file:{folder}/person") or folder in stored.inputFiles()[0]


def test_large_files_are_read_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        people = spark.range(20_000).selectExpr("cast(id as int) person_id", "1 g", "1980 y", "1 r", "1 e", "cast(null as int) l")
        storage.write_csv(people.toDF(*MODEL["person"].columns).coalesce(1), str(tmp_path / "person.csv"))
        assert storage.read_table(spark, MODEL["person"], str(tmp_path)).rdd.getNumPartitions() > 3
        assert storage.read_text(spark, str(tmp_path / "person.csv")).rdd.getNumPartitions() > 3
        notes = rows(spark, "note", *[dict(note_id=i, note_text="a\nb" * 50) for i in range(500)]).coalesce(1)
        storage.write_csv(notes, str(tmp_path / "note.csv"))
        assert storage.read_table(spark, MODEL["note"], str(tmp_path)).rdd.getNumPartitions() > 3
        assert storage.read_table(spark, MODEL["note"], str(tmp_path)).filter("length(note_text) = 150").count() == 500
        assert storage.read_table(spark, MODEL["note"], str(tmp_path)).count() == 500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [name for name in MODEL if MODEL[name].holds_text] == ["note"]


def test_intermediates_need_a_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    with storage.scratch(spark) as folder:
        spark.range(3).write.parquet(f"{folder}/x")
        path = folder.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)

    class Bare:
        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.work_folder(Bare)
    assert spark.conf.get("spark.checkpoint.dir") == shared


def test_documents_are_json(spark, tmp_path):
    storage.write_document(spark, {"a": {"b": 1}, "day": date(2025, 1, 1)}, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).select("a.b", "day").first() == (1, "2025-01-01")
