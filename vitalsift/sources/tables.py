"""Reading and writing the tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vitalsift.sources.records import csv_records, parse_records
from vitalsift.specs import Model, TableSpec

# Quotes inside a field are doubled and no text is trimmed. An empty field is null, also when it
# is quoted. A header that does not name the schema's columns in order is an error rather than a
# silent misread.
CSV_FORMAT = {"header": True, "quote": '"', "escape": '"', "dateFormat": "yyyy-MM-dd"}
CSV_READ = {**CSV_FORMAT, "enforceSchema": False}
#: Intermediate tables are read a few times at most, so they are written small.
INTERMEDIATE = "zstd"
CSV_WRITE = {**CSV_FORMAT, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Typed CSV. A field that does not fit its type becomes null; the row stays.

    With ``multi_line`` fields may span lines; such files are split too, and read twice (``records``).
    """
    if multi_line:
        return parse_records(csv_records(spark, path), schema, CSV_FORMAT)
    return spark.read.options(**CSV_READ).schema(schema).csv(path)


def read_table(spark: SparkSession, spec: TableSpec, folder: str, format: str = "csv") -> DataFrame:
    """One of the model's tables from ``folder``: ``<name>.csv`` or ``<name>`` as Parquet."""
    if format == "csv":
        return read_csv(spark, f"{folder}/{spec.name}.csv", spec.schema, spec.holds_text)
    return spark.read.schema(spec.schema).format(format).load(f"{folder}/{spec.name}")


def read_tables(spark: SparkSession, model: Model, folder: str, format: str = "csv") -> dict[str, DataFrame]:
    return {name: read_table(spark, model[name], folder, format) for name in model}


def read_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with every column a string, for source exports. Names come from the header, a single line."""
    lines = spark.read.options(**CSV_FORMAT, inferSchema=False).csv(path)
    return parse_records(csv_records(spark, path), lines.schema, CSV_FORMAT) if multi_line else lines


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite"
) -> None:
    """Parquet, one directory per value of the partition columns.

    Rows are regrouped by those columns first, or every task would write a small file into each
    directory. The rebalance hint lets Spark split a value that holds many rows over several
    files and merge small ones.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def partition_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Values of a partition column that were written, from the paths of files; none is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(column).distinct().orderBy(column)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small JSON document, as a folder with one line that ``spark.read.json`` reads back.

    Written by the driver through Hadoop's file systems, as a job for one line would be: under a
    temporary name that is renamed at the end.
    """
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(configuration)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/_temporary-{uuid.uuid4().hex}")
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000.txt")
    system.mkdirs(folder)
    out = system.create(draft, True)
    try:
        out.write(bytearray((json.dumps(document, default=str) + "\n").encode()))
    finally:
        out.close()
    system.delete(final, False)
    if not system.rename(draft, final):
        raise OSError(f"cannot write {path}")


def work_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables in the cluster's shared checkpoint folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared.rstrip('/')}/vitalsift-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables, wherever Spark keeps it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def publish(spark: SparkSession, staged: str, output: str) -> None:
    """Move every folder of ``staged`` to ``output``, in place of one of the same name.

    Folders that are replaced are set aside first and put back when a move fails, so that
    ``output`` holds all of the old run or all of the new one. Other folders stay. A move is one step in file
    systems that rename folders; object stores copy.
    """
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source, target = path_of(staged), path_of(output)
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = path_of(f"{output}/_replaced-{uuid.uuid4().hex}")
    system.mkdirs(target)
    system.mkdirs(aside)
    names = sorted(status.getPath().getName() for status in system.listStatus(source))

    def move(name: str, old, new) -> None:
        if not system.rename(path_of(old, name), path_of(new, name)):
            raise OSError(f"cannot move {name} from {old} to {new}")

    put_aside, placed = [], []
    try:
        for name in names:
            if system.exists(path_of(target, name)):
                move(name, target, aside)
                put_aside.append(name)
        for name in names:
            move(name, source, target)
            placed.append(name)
    except BaseException:
        for name in placed:
            system.delete(path_of(target, name), True)
        for name in put_aside:
            move(name, aside, target)
        system.delete(aside, True)
        raise
    system.delete(aside, True)


@contextmanager
def staged(spark: SparkSession, output: str) -> Iterator[str]:
    """A folder beside ``output``'s contents, published at the end and deleted after a failure.

    It lies in ``output`` itself, so that moving is renaming; names with an underscore are ignored
    by Spark's readers.
    """
    folder = f"{output}/_staged-{uuid.uuid4().hex}"
    try:
        yield folder
        publish(spark, folder, output)
    finally:
        remove_folder(spark, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A work folder that is deleted at the end, also when a job fails in between."""
    folder = work_folder(spark)
    try:
        yield folder
    finally:
        remove_folder(spark, folder)


def stored_in(folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """A function that writes a table under ``folder`` and returns the written one.

    Later steps read the stored columns instead of recomputing, also when an executor is lost.
    """

    def keep(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/{name}"
        df.write.mode("overwrite").option("compression", INTERMEDIATE).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return keep
