"""CSV whose fields may span lines, read by many tasks.

Spark's own reader gives such a file to one task, because a line end inside quotes looks like one
between records. Whether a line starts a record depends only on the quotes before it: with
quotes doubled inside fields, a line end is outside all fields when their number is even.

So the file is read as lines, split like any text. A first pass adds up the quotes per split and, in
a table of one short row per split, of all splits before each. The next pass starts every split with that parity and
joins lines to records inside the task. Only records that cross the border of two splits
leave their tasks: a pass of its own takes their parts, and nothing else, from the splits' ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = ["file", "split"]
# Parts of records that cross a border: the rest of one begun in an earlier split, and the begin of one.
REST, BEGIN, HEADER = "rest", "begin", "header"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the split that they begin in, in order within it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
    )


def odd_splits(lines: DataFrame) -> DataFrame:
    """The splits that begin inside quotes. One row per split is all that the window sorts."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy(*SPLIT).agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = counted.withColumn("before", F.sum("quotes").over(before)).filter("before % 2 = 1")
    return inside.select(*SPLIT, F.lit(True).alias("inside"))


class _Split:
    """The open record of one split while its lines go by."""

    def __init__(self, file: int, split: int, inside: bool):
        self.key, self.inside = (file, split), inside
        self.open: list[str] = []
        # Lines before the first start of a record belong to one that began in an earlier split.
        self.kind = REST if inside else HEADER if split == 0 else None

    def add(self, lines: pa.Array, odd: np.ndarray, crossing: bool) -> Iterator[tuple]:
        """Records that end in these lines; with ``crossing`` only one that began in an earlier split."""
        # Whether each line ends inside quotes.
        ends_inside = (np.cumsum(odd) + self.inside) % 2 == 1
        ends = np.flatnonzero(~ends_inside)
        self.inside = bool(ends_inside[-1])
        if crossing and len(ends):
            if self.kind == REST:
                yield (*self.key, REST, "\n".join([*self.open, *lines[: ends[0] + 1].to_pylist()]))
            self.kind, self.open, texts = None, [], lines[ends[-1] + 1 :].to_pylist()
            ends = ends[:0]
        else:
            texts = lines.to_pylist()
        at = 0
        for end in ends.tolist():
            if end > at or self.open:
                record, self.open = "\n".join([*self.open, *texts[at : end + 1]]), []
            else:
                record = texts[at]
            yield (*self.key, self.kind, record)
            self.kind, at = None, end + 1
        self.open += texts[at:]

    def close(self) -> Iterator[tuple]:
        if self.open:
            # Without an end in this split the rest of a record goes on in the next one.
            yield (*self.key, self.kind or BEGIN, "\n".join(self.open) + "\n")


PARTS = "file long, split long, kind string, record string"


def _parts(batches: Iterator[pa.RecordBatch], crossing: bool) -> Iterator[pa.RecordBatch]:
    """Records that lie in one split, or the parts of those that cross a border (``crossing``).

    A part that ends with a line end goes on in the next split.
    """
    now: _Split | None = None
    last = -1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "split", "kind", "record"])

    for batch in batches:
        if not batch.num_rows:
            continue
        value, files, splits, inside, order = batch.columns
        odd = np.asarray(pc.count_substring(value, '"').fill_null(0)) % 2
        files, splits, order = np.asarray(files), np.asarray(splits), np.asarray(order)
        if order[0] <= last or (np.diff(order) <= 0).any():
            raise RuntimeError("lines are out of order")
        last = order[-1]
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(splits) != 0)) + 1
        out: list[tuple] = []
        for first, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(files)], strict=True):
            key = (int(files[first]), int(splits[first]))
            if now is None or now.key != key:
                out += now.close() if now and crossing else []
                now = _Split(*key, bool(inside[first].as_py()))
            out += (r for r in now.add(value[first:to], odd[first:to], crossing) if (r[2] == REST) == crossing)
        if out:
            yield batch_of(out)
    out = list(now.close()) if now and crossing else []
    if out:
        yield batch_of(out)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (the text of one record, without its line end) and ``is_header``.

    Lines end with ``\\n`` or ``\\r\\n``; the first line of every file is its header. Quotes
    inside fields are doubled and such fields quoted, as all common writers do. Empty
    lines between records are left out, a file without lines gives nothing, and a last record
    whose quotes are not closed reaches to the file's end. Rows are in no order. Compressed
    files are not split by Spark.
    """
    lines = _lines(spark, path)
    # One short row per split that begins inside quotes; Spark's own list of splits is larger.
    starts = F.broadcast(odd_splits(lines))
    numbered = lines.withColumn("order", F.monotonically_increasing_id())
    ordered = numbered.join(starts, SPLIT, "left").select("value", *SPLIT, F.coalesce("inside", F.lit(False)).alias("inside"), "order")
    whole = ordered.mapInArrow(partial(_parts, crossing=False), PARTS).select("record", F.col("kind").isNotNull().alias("is_header"))
    # At most two parts per split: the rest of a record and the begin of another.
    begins = (F.col("kind") == BEGIN).cast("int")
    back = Window.partitionBy("file").orderBy("split", begins).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        ordered.mapInArrow(partial(_parts, crossing=True), PARTS)
        .withColumn("number", F.sum(begins).over(back))
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(F.struct("split", "record"))).alias("parts"))
        .select(F.array_join("parts.record", "").alias("record"), F.lit(False).alias("is_header"))
    )
    record = F.rtrim(F.col("record"), F.lit("\r\n")).alias("record")
    return whole.unionByName(crossing).select(record, "is_header").filter("record != ''")


def parse_records(records: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """Typed rows from ``csv_records``. A header that does not name the columns in order is an error."""
    options = {**{k: str(v) for k, v in options.items() if k != "header"}, "multiLine": "true"}
    names = [f.name for f in schema]
    # One more column would hold what a longer header has.
    header = F.from_csv("record", ", ".join(f"`{c}` string" for c in [*(f"c{k}" for k in range(len(names))), "more"]), options)
    fits = header["more"].isNull()
    for k, name in enumerate(names):
        fits &= F.lower(F.trim(header[f"c{k}"])).eqNullSafe(F.lit(name.lower()))
    wrong = F.raise_error(F.concat(F.lit("CSV header does not conform to the schema: "), F.col("record"))).cast("boolean")
    rows = records.filter(F.when(F.col("is_header"), F.when(fits, False).otherwise(wrong)).otherwise(True))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(F.from_csv("record", types, options).alias("row")).select("row.*")
