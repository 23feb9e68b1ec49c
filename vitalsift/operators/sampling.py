"""Choosing exactly k rows at random, repeatably and without a global sort or limit.

A row's place in the sample order is the MD5 of "seed:key". The k-th smallest digest is found by
radix selection: rows are counted by the first digits of their digests, then by the whole digest in
the one bucket that the k-th row falls in. Each count is a scan of the key column, combined inside the tasks. A row is chosen when its digest is
not above the one found; rows of one key that only some of are wanted go on by their contents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalsift.operators.numbering import HEX_DIGITS, row_text

# Buckets by four digits: what is left for whole digests holds one row in 65,536, copies of a key aside.
LEVELS = 1


def digest(key: Column, seed: int) -> Column:
    """A row's place in a sample's order; rows without a key share one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def sample_size(rows: Column, fraction: float) -> Column:
    """``fraction`` of the rows, rounded down, but at least one."""
    return F.greatest(F.floor(rows * F.lit(fraction)).cast("long"), F.lit(1).cast("long"))


def _edge(sizes: DataFrame, by: str) -> DataFrame:
    """The group, in the order of ``by``, in which a sample's wanted row lies, and its place there."""
    ordered = Window.partitionBy("_sample").orderBy(by)
    before = sizes.withColumn("_before", F.sum("_size").over(ordered) - F.col("_size"))
    inside = (F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_size"))
    return before.filter(inside).select("_sample", by, (F.col("_wanted") - F.col("_before")).alias("_wanted"), "_size")


def _select(drawn: DataFrame, wanted: Column) -> DataFrame:
    """One row with a map from sample name to ``digest`` (of the last wanted row), ``need`` and
    ``have``: how many rows with that digest are wanted, and how many there are.

    ``drawn`` has (_sample, _digest, _weight); ``wanted`` may use ``_total``, the sample's rows.
    """
    edge = None
    for level in range(LEVELS):
        bucket = F.substring("_digest", 1, HEX_DIGITS * (level + 1))
        rows = drawn.withColumn("_bucket", bucket)
        if edge is not None:
            # One row per sample.
            rows = rows.withColumn("_outer", F.substring("_digest", 1, HEX_DIGITS * level)).join(
                F.broadcast(edge.select("_sample", F.col("_bucket").alias("_outer"), "_wanted")), ["_sample", "_outer"]
            )
        # At most 65,536 buckets per sample, whatever the table holds.
        keys = ["_sample", "_bucket"] + (["_wanted"] if edge is not None else [])
        sizes = rows.groupBy(*keys).agg(F.sum("_weight").alias("_size"))
        if edge is None:
            total = sizes.withColumn("_total", F.sum("_size").over(Window.partitionBy("_sample")))
            sizes = total.withColumn("_wanted", F.least(wanted, F.col("_total")))
        edge = _edge(sizes, "_bucket")
    left = drawn.withColumn("_bucket", F.substring("_digest", 1, HEX_DIGITS * LEVELS)).join(
        F.broadcast(edge.select("_sample", "_bucket", "_wanted")), ["_sample", "_bucket"]
    )
    last = _edge(left.groupBy("_sample", "_digest", "_wanted").agg(F.sum("_weight").alias("_size")), "_digest")
    found = F.struct(F.col("_digest").alias("digest"), F.col("_wanted").alias("need"), F.col("_size").alias("have"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct(F.col("_sample"), found))).alias("cutoffs"))


def cutoffs(
    df: DataFrame, key: str, seeds: Mapping[str, int], *, fraction: float | None = None, k: int | None = None
) -> DataFrame:
    """One row with a map from sample name to its last chosen digest and the rows wanted of that.

    ``seeds`` names the independent samples; all are drawn in the same scans. Give either a
    fraction of the rows or a number ``k``; at most all rows are chosen.
    """
    samples = [
        F.struct(F.lit(name).alias("_sample"), digest(F.col(key), seed).alias("_digest"), F.lit(1).alias("_weight"))
        for name, seed in seeds.items()
    ]
    drawn = df.select(F.inline(F.array(*samples)))
    return _select(drawn, sample_size(F.col("_total"), fraction) if fraction is not None else F.lit(k).cast("long"))


def chosen(key: str, sample: str, seed: int, cuts: DataFrame) -> Column:
    """True for the rows of a sample; ``cuts`` is the result of ``cutoffs``.

    A condition on one row cannot part rows of one key, so the query fails where copies of a key lie
    across the end of the sample; ``sample_rows`` takes such tables.
    """
    cut = F.try_element_at(cuts.scalar(), F.lit(sample))
    own = digest(F.col(key), seed)
    error = F.raise_error(F.lit(f"sampling by a condition needs a unique key, but {key} repeats")).cast("boolean")
    last = F.when(cut["need"] < cut["have"], error).otherwise(True)
    # Most rows are settled by the first comparison, so their digest is taken once.
    return (
        F.when(own > cut["digest"], False).when(own < cut["digest"], True).when(own == cut["digest"], last).otherwise(False)
    )


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Exactly ``k`` rows, or all when there are fewer.

    Keys may repeat or be missing. Where only some rows of a key are wanted, these are taken in the
    order of a digest of all their columns, found in the same way, and of identical rows any.
    """
    cuts = cutoffs(df, key, {"sample": seed}, k=k)
    cut = F.try_element_at(cuts.scalar(), F.lit("sample"))
    own = digest(F.col(key), seed)
    whole = df.filter((own < cut["digest"]) | ((own == cut["digest"]) & (cut["need"] == cut["have"])))
    # Identical rows are combined first, so a row that is there very often is one row.
    parted = df.filter((own == cut["digest"]) & (cut["need"] < cut["have"])).groupBy(*df.columns).agg(F.count("*").alias("_weight"))
    parted = parted.withColumn("_digest", F.md5(row_text(df)))
    wanted = F.coalesce(cut["need"], F.lit(0).cast("long"))
    inner = _select(parted.select(F.lit("rows").alias("_sample"), "_digest", "_weight"), wanted)
    edge = F.try_element_at(inner.scalar(), F.lit("rows"))
    copies = F.when(F.col("_digest") < edge["digest"], F.col("_weight")).when(F.col("_digest") == edge["digest"], edge["need"])
    some = parted.withColumn("_copies", copies).filter("_copies > 0")
    repeated = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return whole.unionByName(repeated.select(*df.columns))
