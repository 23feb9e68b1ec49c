"""Document fingerprints by one-permutation MinHash, with column expressions only.

Every shingle of five words is hashed once. The top bits of the hash choose one of 128 bins and
each bin keeps its smallest hash. An empty bin takes the value of a full bin that it picks by
hashing the two bin numbers (optimal densification), so equal sets fill it alike. Of each value only the low 8 bits are
stored. Two bins agree by chance once in 256, which the likeness corrects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
# Ranges of doc_id per shuffle partition when neighbours are brought together.
RANGES_PER_PARTITION = 4
FIRST = -(1 << 63)


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS).cast("int")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: an array of 128 numbers below 256, empty for a text without words.

    Each step is a column of its own that the next one uses more than once: Spark then computes
    it once per row instead of once per element.
    """
    words, hashes, mins, by_bin = (f"_{out}_{s}" for s in ("words", "hashes", "mins", "by_bin"))
    at = lambda k: F.get(F.col(words), k)
    n = F.size(words)
    shingles = F.when(
        n >= WORDS,
        F.transform(F.sequence(F.lit(0), n - WORDS), lambda k: F.xxhash64(*[at(k + j) for j in range(WORDS)])),
    ).when(n > 0, F.array(F.xxhash64(F.col(words), n)))
    return (
        df.withColumn(words, F.transform(
            F.array_remove(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w)
        ))
        .withColumn(hashes, F.sort_array(shingles))
        # Sorted hashes stand bin by bin; the first of a bin is its smallest.
        .withColumn(mins, F.filter(
            F.col(hashes), lambda h, k: (k == 0) | (_bin(F.get(F.col(hashes), k - 1)) != _bin(h))
        ))
        .withColumn(by_bin, F.map_from_arrays(
            F.transform(mins, _bin), F.transform(mins, lambda h: h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("short"))
        ))
        .withColumn(out, F.when(F.size(mins) > 0, F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)),
            lambda k: F.coalesce(
                F.try_element_at(F.col(by_bin), k),
                F.try_element_at(F.col(by_bin), F.array_min(
                    F.transform(F.map_keys(by_bin), lambda b: F.struct(F.xxhash64(k, b).alias("h"), b.alias("b")))
                )["b"]),
            ),
        )).otherwise(F.array().cast("array<short>")))
        .drop(words, hashes, mins, by_bin)
    )


def packed(values: Column) -> Column:
    """The fingerprint as text: two hexadecimal digits per bin, empty for a text without words."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty fingerprints are alike, one is not."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    chance = 1.0 / (1 << LOW_BITS)
    estimate = F.greatest(F.lit(0.0), (agree / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def _ranges(ids: DataFrame, column: str) -> Column:
    """The number of the range that a key falls in; ranges hold about equally many rows.

    The bounds are quantiles of the whole column, as many as shuffle partitions times a
    constant. They are found in two levels, so a row is compared with few of them.
    """
    spark = ids.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION)
    quantiles = F.percentile_approx(column, [k / n for k in range(1, n)] or [0.5], 10 * n)
    found = ids.agg(quantiles.alias("q")).first()["q"]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    key = F.col(column)
    coarse = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    fine = F.array(F.array().cast("array<long>"), *[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    group = F.size(F.filter(coarse, lambda b: b <= key))
    inside = F.size(F.filter(F.get(fine, group), lambda b: b <= key))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + inside)


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text has the last half of the code points replaced by the first as many of the
    next document by falling doc_id, the first document following the last. Texts travel once: rows are
    dealt by ranges of doc_id, and each range also gets the first document of the next one.
    A null text counts as empty; null ids come last, and rows with one id follow their texts. A
    single document follows itself. Other columns are ignored; an empty table gives no rows.
    """
    rows = documents.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("_key", F.coalesce("doc_id", F.lit(FIRST)))
    ids = rows.select("_key")
    rows = rows.withColumn("_range", _ranges(ids, "_key"))
    heads = rows.groupBy("_range").agg(F.max("_key").alias("_head"))
    # One row per range: the head of the range below, or of the highest for the lowest.
    order = Window.orderBy("_range")
    first = F.max(F.struct("_range", "_head")).over(Window.partitionBy())["_head"]
    following = heads.select(
        F.col("_range").alias("_before"), F.coalesce(F.lag("_head").over(order), first).alias("_key")
    )
    copies = rows.drop("_range").join(F.broadcast(following), "_key").withColumnRenamed("_before", "_range")
    rows = rows.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    rows = with_fingerprint(rows, "text", "_bins")
    next_of = Window.partitionBy("_range").orderBy("_copy", F.col("_key").desc(), "text")
    rows = (
        rows.withColumn("_next", F.lead(F.struct("text", "_bins")).over(next_of))
        .filter(~F.col("_copy"))
        .withColumn("_n", F.length("text"))
        .withColumn("_half", F.floor(F.col("_n") / 2).cast("int"))
        .withColumn("_edited", F.concat(
            F.substr("text", F.lit(1), F.col("_n") - F.col("_half")), F.substr("_next.text", F.lit(1), F.col("_half"))
        ))
    )
    rows = with_fingerprint(rows, "_edited", "_edited_bins")
    return rows.select(
        "doc_id", F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.encode("_edited", "utf-8"), 256).alias("edited_sha256"),
        packed(F.col("_bins")).alias("fingerprint"),
        packed(F.col("_edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("_bins"), F.col("_edited_bins")).alias("near_edited"),
        likeness(F.col("_bins"), F.col("_next._bins")).alias("near_next"),
    )
