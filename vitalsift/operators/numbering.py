"""Dense integer ids 1..n without a global sort.

A ``row_number`` over the whole table runs in one task. Here the ids follow the MD5 of the key.
The first four hex digits put the rows into 65,536 buckets of about equal size; counting the
buckets (a small table) gives each its first id, and rows are numbered inside their bucket only.
The ids depend on the data alone, not on how files or partitions are laid out, so a recomputed
task yields the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalsift.functions.scalars import exact_number

HEX_DIGITS = 4
MAX_BUCKETS = 16**HEX_DIGITS
IDS_PER_CHUNK = 4_096


def with_digest(df: DataFrame, text: Column) -> DataFrame:
    """Add the order of the ids, ``_digest``, and the ``_bucket`` it falls in."""
    return df.withColumn("_digest", F.md5(text)).withColumn(
        "_bucket", F.substring("_digest", 1, HEX_DIGITS)
    )


def bucket_starts(digested: DataFrame, weight: Column) -> DataFrame:
    """Ids used up ahead of each ``_bucket``, as ``_start``.

    The running sum is over at most ``MAX_BUCKETS`` rows, whatever the table holds.
    """
    sizes = digested.groupBy("_bucket").agg(F.sum(weight).alias("_size"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.select("_bucket", (F.sum("_size").over(ahead) - F.col("_size")).alias("_start"))


def dense_ids(keys: DataFrame, key: str, id_column: str) -> DataFrame:
    """Number the distinct values of ``key`` 1..n.

    Repeated values are combined before the shuffle and share one id.
    """
    distinct = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    digested = with_digest(distinct, F.col(key).cast("string"))
    # At most MAX_BUCKETS rows.
    starts = F.broadcast(bucket_starts(digested, F.lit(1)))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))
    return (
        digested.withColumn("_place", place)
        .join(starts, "_bucket")
        .select(key, (F.col("_start") + F.col("_place")).alias(id_column))
    )


def row_text(df: DataFrame) -> Column:
    """All columns of a row as one text; "~" stands for null, floating numbers have their exact digits."""

    def text(name: str, kind: str) -> Column:
        return exact_number(F.col(name)) if kind in ("float", "double") else F.col(name).cast("string")

    return F.concat_ws("|", *[F.coalesce(text(*c), F.lit("~")) for c in df.dtypes])


def dense_row_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Add ids 1..n to every row of a table that has no key, copies of a row included.

    Copies are combined into one row with a count before anything is sorted and numbered as a
    block. The ids are cut into chunks of equal size; every block goes to the chunks that its ids
    lie in, most to one, and each chunk gives its blocks their ids. So tasks emit about equally many
    rows whatever the copies, and at most ``IDS_PER_CHUNK`` for a row they read. The table is read
    twice: store it first if it is costly.
    """
    columns = df.columns
    unique = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    digested = with_digest(unique, row_text(df))
    # At most MAX_BUCKETS rows.
    starts = F.broadcast(bucket_starts(digested, F.col("_copies")))
    # The columns matter only for rows with equal digests.
    within = (
        Window.partitionBy("_bucket")
        .orderBy("_digest", *[F.col(c).asc_nulls_last() for c in columns])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = F.col("_start") + F.col("_through")
    blocks = (
        digested.withColumn("_through", F.sum("_copies").over(within))
        .join(starts, "_bucket")
        .select(*columns, (last - F.col("_copies") + 1).alias("_first"), last.alias("_last"))
    )
    size = F.lit(IDS_PER_CHUNK).cast("long")
    chunks = F.sequence(F.expr(f"_first div {IDS_PER_CHUNK}"), F.expr(f"_last div {IDS_PER_CHUNK}"))
    first_of_chunk = F.col("_chunk") * size
    parts = blocks.withColumn("_chunk", F.explode(chunks)).repartition("_chunk")
    ids = F.sequence(F.greatest("_first", first_of_chunk), F.least("_last", first_of_chunk + size - 1))
    return parts.select(F.explode(ids).alias(id_column), *columns)
