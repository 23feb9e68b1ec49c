"""Multi-line CSV against Spark's own reader, which takes a file as a whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from vitalsift.sources import records
from vitalsift.sources import tables as storage
from vitalsift.specs import MODEL

BITS = ["a", "word ", "\n", "\n\n", '"', '""', ",", "\r\n", " ", "é", "\n\"quoted\"\n", "", "\\", "long " * 12, "line\n" * 20]


@pytest.fixture(params=["17", "200", "128m"])
def small_splits(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, request.param)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n"):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "first", "second"])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def plain(rows):
    return sorted([(k, a or None, b or None) for k, a, b in rows], key=repr)


def read(spark, path):
    found = storage.read_csv(spark, str(path), storage.T.StructType.fromDDL("id int, first string, second string"), True)
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fields_come_back_exactly(spark, tmp_path, small_splits, end):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 6))).strip(" ")
    rows = [(k, text(), text()) for k in range(30 if small_splits == "17" else 400)]
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", rows[: len(rows) // 2], end)
    write(folder / "b.csv", rows[len(rows) // 2 :], end)
    (folder / "c.csv").write_text("id,first,second" + end)
    found = read(spark, folder)
    assert found == plain(rows)
    if end == "\r\n":
        # There Spark's own reader drops the CR inside fields too.
        return
    own = spark.read.options(**storage.CSV_READ, multiLine=True).schema("id int, first string, second string").csv(str(folder))
    assert found == sorted(map(tuple, own.collect()), key=repr)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    notes = [(k, f"line {k}\n\n" + 'said ""x""\n' * (k % 7), None) for k in range(3_000)]
    write(tmp_path / "note.csv", notes)
    try:
        for k in before:
            spark.conf.set(k, "16k")
        table = storage.read_csv(spark, str(tmp_path / "note.csv"), storage.T.StructType.fromDDL("id int, first string, second string"), True)
        tasks = table.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in tasks) == 3_000 and len([r for r in tasks if r["count"] > 50]) > 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_record_over_many_splits_and_splits_without_a_line(spark, tmp_path, small_splits):
    rows = [(1, "x\n" * 200, "y" * 300), (2, "a", "b"), (3, "\n" * 100 + '"', "end")]
    write(tmp_path / "f.csv", rows)
    assert read(spark, tmp_path / "f.csv") == plain(rows)


def test_headers(spark, tmp_path):
    (tmp_path / "longer.csv").write_text('id,first,second,third\n1,"a\nb",c,d\n')
    (tmp_path / "other.csv").write_text('id,second,first\n1,"a\nb",c\n')
    for name in ("longer.csv", "other.csv"):
        with pytest.raises(Exception, match="CSV header does not conform"):
            read(spark, tmp_path / name)
    found = storage.read_text(spark, str(tmp_path / "longer.csv"), multi_line=True)
    assert found.columns == ["id", "first", "second", "third"]
    assert [tuple(r) for r in found.collect()] == [("1", "a\nb", "c", "d")]


def test_empty_files_and_lines(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    assert read(spark, tmp_path / "none.csv") == []
    (tmp_path / "gaps.csv").write_text('id,first,second\n\n1,a,"\n"\n\n\n2,b,\n\n')
    assert read(spark, tmp_path / "gaps.csv") == [(1, "a", "\n"), (2, "b", None)]


def test_quotes_left_open_reach_to_the_end(spark, tmp_path, small_splits):
    (tmp_path / "open.csv").write_text('id,first,second\n1,a,b\n2,"never closed\nmore\n')
    assert [r[0] for r in read(spark, tmp_path / "open.csv")] == [1, 2]


def test_note_table(spark, tmp_path):
    (tmp_path / "note.csv").write_text(
        "note_id,person_id,note_date,note_text,visit_occurrence_id\n" + '1,1,2025-01-01,"first\n\nsecond ""quoted""",1\n2,x,2025-13-02,,\n'
    )
    rows = storage.read_table(spark, MODEL["note"], str(tmp_path)).orderBy("note_id").collect()
    assert rows[0]["note_text"] == 'first\n\nsecond "quoted"'
    assert (rows[1]["person_id"], rows[1]["note_date"], rows[1]["note_text"]) == (None, None, None)
    assert records.csv_records(spark, str(tmp_path / "note.csv")).filter("is_header").count() == 1
