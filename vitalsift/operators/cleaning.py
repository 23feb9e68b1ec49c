"""Dropping or quarantining rows that break a rule.

Filters run before de-duplication, so a duplicate key keeps a valid row when it has one.
Tables are cleaned parents first, and references are checked against the cleaned parents, so a
removed person takes their visits along and those visits their notes.
"""

from __future__ import annotations

from collections.abc import Callable, Container, Mapping
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalsift.operators.checks import row_rules
from vitalsift.operators.lookup import lookup, rows_per_key, with_known_key
from vitalsift.specs import ForeignKey, Model, TableSpec

# Stores a named table and returns the stored one, or returns it as it is.
Keep = Callable[[str, DataFrame], DataFrame]


def unchanged(name: str, df: DataFrame) -> DataFrame:
    return df


def drop_missing(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows with every required field present."""
    return _without(df, [r for n, r in row_rules(spec).items() if n.startswith("null_")])


def drop_bad_dates(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows whose end date is absent or not before the start date."""
    return _without(df, [r for n, r in row_rules(spec).items() if n.startswith("bad_date_")])


def drop_negatives(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows without negative values; zero stays, null goes."""
    return _without(df, [r for n, r in row_rules(spec).items() if n.startswith("neg_")])


def _without(df: DataFrame, rules: list[Column]) -> DataFrame:
    return reduce(lambda rows, rule: rows.filter(~rule), rules, df)


def mark_known(df: DataFrame, fk: ForeignKey, parent: DataFrame, marker: str) -> DataFrame:
    """Add ``marker``: true when the reference is null or names a parent row.

    ``parent`` must be unique on its key, as a cleaned table is.
    """
    keys = parent.select(F.col(fk.parent_key).alias(fk.column), F.lit(True).alias(marker))
    known = F.col(fk.column).isNull() | F.col(marker).isNotNull()
    return lookup(df, keys, fk.column).withColumn(marker, known)


def drop_orphans(df: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Rows whose reference is null or names a parent row; parent keys may repeat."""
    return with_known_key(df, parent.select(F.col(fk.parent_key).alias(fk.column)), fk.column)


def keep_known(df: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Rows whose reference names a parent row; null references are dropped.

    A single semi join, which is cheaper than ``drop_orphans`` where a reference is required anyway.
    """
    keys = parent.select(F.col(fk.parent_key).alias(fk.column))
    return lookup(df, keys, fk.column, "left_semi").select(*df.columns)


def content_order(columns: list[str], key: str) -> list[Column]:
    """All other columns ascending, nulls last: a total order but for identical copies."""
    return [F.col(c).asc_nulls_last() for c in columns if c != key]


def drop_duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row per key: the first by all remaining columns; null keys form one group.

    Spark applies the rank limit in each task before the shuffle (WindowGroupLimit), so the
    copies of a key are reduced to one row per task before they meet.
    """
    first = Window.partitionBy(key).orderBy(*content_order(df.columns, key))
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def valid_rows(df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that break no rule, duplicates still included."""
    rows = _without(df, list(row_rules(spec).values()))
    for fk in spec.foreign_keys:
        drop = keep_known if fk.column in spec.required else drop_orphans
        rows = drop(rows, fk, parents[fk.parent])
    return rows


def clean_table(
    df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Valid rows, one per key. ``parents`` holds the cleaned tables the foreign keys name."""
    return drop_duplicates(valid_rows(df, spec, parents or {}), spec.key)


def by_address(name: str, model: Model, stored: Container[str]) -> bool:
    """Whether ``clean_all`` cleans a table by row address: it is stored as it is, and holds texts."""
    return name in stored and model[name].holds_text


def clean_all(
    tables: Mapping[str, DataFrame],
    model: Model,
    keep: Keep = unchanged,
    stored: Container[str] = (),
) -> dict[str, DataFrame]:
    """Every table cleaned, in the model's order.

    ``keep`` may store a cleaned table and return the stored one, so that children and later
    steps do not clean it again. ``stored`` names tables that are Parquet files as they are;
    of these, tables that hold texts are cleaned by row address.
    """
    cleaned: dict[str, DataFrame] = {}
    for name in model.cleaning_order():
        clean = partial(clean_stored, keep=keep) if by_address(name, model, stored) else clean_table
        cleaned[name] = keep(name, clean(tables[name], model[name], cleaned))
    return {name: cleaned[name] for name in model}


# --- by row address ----------------------------------------------------------------------

#: A row's file and its number there. Only a table read from Parquet, with nothing done to it, has them.
ADDRESS = ["_file", "_row"]


def with_address(stored: DataFrame) -> DataFrame:
    return stored.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )


def _key_text(key: str) -> Column:
    """A key as text that is never null: null keys form one group, and a first letter tells them from any text."""
    return F.when(F.col(key).isNull(), "n").otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))


def _flagged(rows: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame], identity: list[str]) -> DataFrame:
    """``identity``, ``_key`` and ``reasons`` (the rules broken) of all rows. Keys, references and the
    rules' outcome are all that leaves the scan."""
    rules = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in row_rules(spec).items()]))
    references = {fk.column: fk for fk in spec.foreign_keys}
    rows = rows.select(*identity, _key_text(spec.key).alias("_key"), *references, rules.alias("reasons"))
    for column, fk in references.items():
        orphan = F.when(~F.col("_known"), F.array(F.lit(f"orphan_{column}"))).otherwise(F.array().cast("array<string>"))
        rows = mark_known(rows, fk, parents[fk.parent], "_known").withColumn("reasons", F.concat("reasons", orphan))
    return rows.select(*identity, "_key", "reasons")


def doubtful_addresses(stored: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Address, ``_key`` and ``reasons`` of the rows that may have to go.

    These are rows that break a rule, with the rules' names, and valid rows whose key occurs twice
    among valid rows, without reasons.
    """
    flagged = _flagged(with_address(stored), spec, parents, ADDRESS)
    valid = flagged.filter(F.size("reasons") == 0)
    repeated = rows_per_key(valid, "_key").filter("n > 1").select("_key")
    return flagged.filter(F.size("reasons") > 0).unionByName(lookup(valid, repeated, "_key", "left_semi"))


def fetch(stored: DataFrame, addresses: DataFrame) -> DataFrame:
    """The rows at ``addresses``, with the other columns of these."""
    return with_address(stored).join(addresses, ADDRESS).drop(*ADDRESS)


def clean_stored(
    stored: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame] | None = None, keep: Keep = unchanged
) -> DataFrame:
    """``clean_table`` of a stored table, whose rows are neither sorted nor shuffled with their texts.

    The addresses of rows that go are found on narrow columns; texts are looked at only where a key
    is repeated. The rest is one anti join while the table is read again: a broadcast where Spark
    finds the list of addresses small, which ``keep`` should store for that, else the one exchange of
    whole rows.
    """
    # Stored too, so that Spark sees how small the list of suspects is before their texts would move.
    doubtful = keep(f"{spec.name}_suspects", doubtful_addresses(stored, spec, parents or {}))
    suspects = doubtful.filter(F.size("reasons") == 0)
    contents = with_address(stored).join(suspects.select(*ADDRESS, "_key"), ADDRESS)
    first = Window.partitionBy("_key").orderBy(*content_order(stored.columns, spec.key), *ADDRESS)
    kept = contents.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").select(*ADDRESS)
    losers = suspects.select(*ADDRESS).join(kept, ADDRESS, "left_anti")
    gone = doubtful.filter(F.size("reasons") > 0).select(*ADDRESS).unionByName(losers)
    return with_address(stored).join(keep(f"{spec.name}_gone", gone), ADDRESS, "left_anti").select(*stored.columns)


def quarantine_stored(
    stored: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame] | None = None, keep: Keep = unchanged
) -> DataFrame:
    """``quarantine`` of a stored table: reasons are found on addresses, and rows are fetched once.

    What is fetched are removed rows and rows of repeated keys; nothing else moves with all its columns.
    """
    doubtful = doubtful_addresses(stored, spec, parents or {})
    rows = keep(f"{spec.name}_doubtful", fetch(stored, doubtful))
    invalid = (
        rows.filter(F.size("reasons") > 0).groupBy(*stored.columns, "reasons").agg(F.count("*").alias("copies"))
    )
    suspects = rows.filter(F.size("reasons") == 0).groupBy("_key", *stored.columns).agg(F.count("*").alias("copies"))
    return invalid.unionByName(_surplus_copies(suspects, spec, stored.columns))


def removed_counts(
    df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame] | None = None, keep: Keep = unchanged
) -> DataFrame:
    """``reason_counts`` of a table's quarantine without the removed rows themselves.

    A key, the reasons and nothing else of every row goes through the joins. ``keep`` may store them.
    """
    flagged = keep(f"{spec.name}_flagged", _flagged(df, spec, parents or {}, []))
    reasons = flagged.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))
    # All but one of the valid rows of a key go.
    keys = rows_per_key(flagged.filter(F.size("reasons") == 0), "_key")
    surplus = keys.agg(F.sum(F.col("n") - 1).alias("rows")).filter("rows > 0").select(F.lit("dup_pk").alias("reason"), "rows")
    return reasons.unionByName(surplus).select(F.lit(spec.name).alias("table"), "reason", "rows")


def with_reasons(
    df: DataFrame, spec: TableSpec, parents: Mapping[str, DataFrame]
) -> DataFrame:
    """Add ``reasons``, the names of the rules a row breaks; empty for a valid row."""
    rows, broken = df, dict(row_rules(spec))
    for fk in spec.foreign_keys:
        marker = f"_known_{fk.column}"
        rows = mark_known(rows, fk, parents[fk.parent], marker)
        broken[f"orphan_{fk.column}"] = ~F.col(marker)
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in broken.items()]))
    return rows.select(*df.columns, reasons.alias("reasons"))


def quarantine(
    df: DataFrame,
    spec: TableSpec,
    parents: Mapping[str, DataFrame] | None = None,
    keep: Keep = unchanged,
) -> DataFrame:
    """What cleaning removes: the table's columns, ``reasons``, and ``copies``.

    Identical rows appear once with their number in ``copies``, so a row repeated very often
    stays one row. Surplus rows of a key carry the reason ``dup_pk``. The rows with their reasons
    are read three times; ``keep`` may store them.
    """
    flagged = keep(f"{spec.name}_with_reasons", with_reasons(df, spec, parents or {}))
    invalid = (
        flagged.filter(F.size("reasons") > 0)
        .groupBy(*df.columns, "reasons")
        .agg(F.count("*").alias("copies"))
    )
    valid = flagged.filter(F.size("reasons") == 0).drop("reasons")
    return invalid.unionByName(_surplus(valid, spec, keep))


def _surplus(valid: DataFrame, spec: TableSpec, keep: Keep = unchanged) -> DataFrame:
    """Valid rows that de-duplication removes.

    Only rows whose key occurs twice go through the comparison with the row that is kept. The
    key is compared as text so that null keys, which form one group, can be joined as well.
    """
    columns = valid.columns
    valid = valid.withColumn("_key", _key_text(spec.key))
    repeated = valid.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    suspects = (
        lookup(valid, keep(f"{spec.name}_repeated_keys", repeated), "_key", "left_semi")
        .groupBy("_key", *columns)
        .agg(F.count("*").alias("copies"))
    )
    return _surplus_copies(suspects, spec, columns)


def _surplus_copies(suspects: DataFrame, spec: TableSpec, columns: list[str]) -> DataFrame:
    """All but one row of every key, from rows of repeated keys with their numbers of copies."""
    key = spec.key
    others = [c for c in columns if c != key]
    kept = drop_duplicates(suspects.select(*columns), key).select(
        _key_text(key).alias("_key"), *[F.col(c).alias(f"_kept_{c}") for c in others]
    )
    is_kept = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_kept_{c}")) for c in others], F.lit(True)
    )
    return (
        lookup(suspects, kept, "_key", "inner")
        .withColumn("copies", F.col("copies") - F.when(is_kept, 1).otherwise(0))
        .filter("copies > 0")
        .select(*columns, F.array(F.lit("dup_pk")).alias("reasons"), "copies")
    )


def quarantine_all(
    tables: Mapping[str, DataFrame],
    cleaned: Mapping[str, DataFrame],
    model: Model,
    keep: Keep = unchanged,
    stored: Container[str] = (),
) -> dict[str, DataFrame]:
    """The quarantine of every table, references taken from the cleaned tables.

    ``stored`` names tables that are Parquet files as they are, whose removed rows are found by address.
    """
    return {
        name: (quarantine_stored if name in stored else quarantine)(tables[name], model[name], cleaned, keep)
        for name in model
    }


def reason_counts(rows: DataFrame, table: str) -> DataFrame:
    """Removed rows per reason; a row with several reasons counts under each."""
    return (
        rows.select(F.explode("reasons").alias("reason"), "copies")
        .groupBy("reason")
        .agg(F.sum("copies").alias("rows"))
        .select(F.lit(table).alias("table"), "reason", "rows")
    )


def row_counts(tables: Mapping[str, DataFrame], column: str = "rows") -> DataFrame:
    """Rows per table, one row each, in one job."""
    counts = [
        df.agg(F.count("*").alias(column)).select(F.lit(name).alias("table"), column)
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def cleaning_counts(raw: Mapping[str, DataFrame], cleaned: Mapping[str, DataFrame]) -> DataFrame:
    """Rows before and after, rows dropped, and the share dropped in percent."""
    counts = row_counts(raw, "raw").join(row_counts(cleaned, "cleaned"), "table")
    return with_drop_rate(counts)


def with_drop_rate(counts: DataFrame) -> DataFrame:
    dropped = F.col("raw") - F.col("cleaned")
    rate = F.when(F.col("raw") > 0, F.round(100.0 * dropped / F.col("raw"), 2))
    return counts.withColumn("dropped", dropped).withColumn("drop_pct", rate)
