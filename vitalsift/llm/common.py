"""Helpers shared by the operators: shared folders, stored tables, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Text handled at once inside a task; one document may be longer.
CHUNK_BYTES = 2 << 20


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing a local session gets a folder of its own, as in tests; any
    other session is refused, because executors would not find each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_open: list[Workspace] = []


class Workspace:
    """Tables of one run, written once and read back, so that no step is computed twice.

    Written tables cut the lineage: a lost executor costs only the tasks of the current step.
    The folder stays while results that read it are in use; ``remove`` deletes it.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.folder = shared_folder(spark, purpose)
        _open.append(self)

    def store(self, name: str, df: DataFrame, tasks: int | None = None) -> DataFrame:
        """Write a table and read it back; ``tasks`` bounds the tasks that write a small one."""
        path = f"{self.folder}/{name}"
        df = df.coalesce(tasks) if tasks else df
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, name: str | None = None) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def opened() -> int:
    """The number of runs whose folders are there, to be passed to ``remove_workspaces``."""
    return len(_open)


def remove_workspaces(after: int) -> None:
    """Delete the folders of the runs begun since ``opened``; their results must not be in use."""
    while len(_open) > after:
        _open.pop().remove()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let no Arrow batch hold more than ``rows`` rows in this session.

    Batches are counted in rows, and texts may have hundreds of kilobytes.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def slices(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of consecutive rows with at most ``limit`` bytes, one row at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        to = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, to
        first = to


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of Arrow batches with the UTF-8 bytes of a text column and its row offsets.

    A null text counts as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        for first, to in slices(np.diff(offsets), limit):
            own = offsets[first : to + 1]
            yield batch.slice(first, to - first), data[own[0] : own[-1]], own - own[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all ranges, one range after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def roots_of(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node that edges connect them to, within one task."""
    root = np.arange(n, dtype=np.int64)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root


EDGES_PER_TASK = 100_000


def components(work: Workspace, edges: DataFrame, name: str = "component", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): every node as ``id`` with its smallest member.

    Alternates two steps until nothing changes: every larger neighbour of a node is joined to
    the node's smallest neighbour, then every smaller one. Trees become stars in a number of
    rounds that grows with the logarithm of the longest path. Only the number of edges reaches
    the driver. Each round is stored, and a node with very many edges is split by adaptive
    execution because the table of smallest neighbours is stored and unique. The number of tasks
    that write a round follows the number of edges.
    """
    counted = Observation()
    pairs = work.store(
        f"{name}-0",
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u != v")
        .distinct()
        .observe(counted, F.count("*").alias("n")),
    )
    n = counted.get["n"]
    if not n:
        return pairs.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    tasks = -(-2 * n // EDGES_PER_TASK)
    for round_ in range(rounds):
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = work.store(f"{name}-{round_}-large", least, tasks)
        # Larger neighbours of a node, and the node itself, go to its smallest neighbour.
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        large = work.store(f"{name}-{round_}-pairs", large, tasks)
        least = work.store(f"{name}-{round_}-small", large.groupBy("u").agg(F.min("v").alias("m")), tasks)
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        pairs = work.store(f"{name}-{round_ + 1}", small, tasks)
        # Done when all edges form stars: no node has two centres, and no centre has one.
        seconds = pairs.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        chained = pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if seconds.union(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    centres = pairs.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return work.store(name, stars.union(centres), tasks)
