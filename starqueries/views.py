"""The test tables seen as clinical tables and as source exports.

Customers are people, orders are visits, line items conditions and drugs, events measurements
(errors have no concept), documents notes. Every view has all rows of its table. Faults come
from fixed remainders of the keys, so both engines agree on them. Ids are 64-bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalsift.functions import codes
from vitalsift.operators.cleaning import Keep, unchanged
from vitalsift.operators.lookup import lookup
from vitalsift.specs import WIDE_MODEL, TableSpec

MODEL = WIDE_MODEL


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rest(column: str, divisor: int) -> Column:
    return F.pmod(F.col(column), F.lit(divisor))


def _typed(df: DataFrame, spec: TableSpec, values: dict[str, Column]) -> DataFrame:
    return df.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.schema]
    )


def _with_copies(df: DataFrame, repeated: Column) -> DataFrame:
    """Every row once, and rows where ``repeated`` holds twice."""
    copies = F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_copy", F.explode(copies)).drop("_copy")


def _orders(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Customer and date of every order, its number as ``key``."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(key), "o_custkey", F.to_date("o_orderdate").alias("o_date")
    )


def lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, as far as an export needs them, with customer and date of their order."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
        F.to_date("l_shipdate").alias("l_shipdate"),
    )
    return lookup(lines, _orders(spark, sf_dir, "l_orderkey"), "l_orderkey", "inner")


def events_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions and drugs of line items, with customer and date of their order.

    What the tables hold of a line is derived ahead of the join, so that small values move, not keys of parts.
    """
    shipped = F.to_date("l_shipdate")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", shipped.alias("l_shipdate"), (F.col("l_returnflag") != "N").alias("returned"),
        F.when(_rest("l_partkey", 73) != 9, _rest("l_partkey", 11) + 1).cast("int").alias("condition_concept_id"),
        F.when(_rest("l_partkey", 73) != 9, _rest("l_partkey", 17) + 1).cast("int").alias("drug_concept_id"),
        F.when(_rest("l_suppkey", 37) == 5, -1).otherwise(F.col("l_quantity").cast("int")).alias("days_supply"),
        F.when(_rest("l_suppkey", 41) == 6, -1.0).otherwise(F.col("l_quantity")).alias("quantity"),
    )
    return lookup(lines, _orders(spark, sf_dir, "l_orderkey"), "l_orderkey", "inner")


def person(spark: SparkSession, sf_dir: str, copies: bool = True) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    if copies:
        customers = _with_copies(customers, _rest("c_custkey", 71) == 5)
    born = F.lit(1930) + F.pmod(F.col("c_custkey") * 7, F.lit(80))
    return _typed(customers, MODEL["person"], {
        "person_id": F.col("c_custkey"),
        "gender_concept_id": _rest("c_custkey", 2) + 1,
        "year_of_birth": F.when(_rest("c_custkey", 67) != 13, born),
        "race_concept_id": _rest("c_nationkey", 6) + 1,
        "ethnicity_concept_id": _rest("c_nationkey", 2) + 1,
    })


def visit_occurrence(spark: SparkSession, sf_dir: str, copies: bool = True) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    if copies:
        orders = _with_copies(orders, _rest("o_orderkey", 79) == 4)
    start = F.to_date("o_orderdate")
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", 3)
        .when(F.col("o_orderpriority") == "2-HIGH", 2)
        .otherwise(1)
    )
    end = F.when(_rest("o_orderkey", 97) == 11, F.date_sub(start, 1)).otherwise(
        F.date_add(start, _rest("o_orderkey", 5).cast("int"))
    )
    return _typed(orders, MODEL["visit_occurrence"], {
        "visit_occurrence_id": F.col("o_orderkey"),
        "person_id": F.when(_rest("o_orderkey", 83) == 7, F.lit(-1)).otherwise(F.col("o_custkey")),
        "visit_concept_id": F.when(_rest("o_orderkey", 89) != 3, kind),
        "visit_start_date": start,
        "visit_end_date": end,
    })


def condition_occurrence(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    return _typed(lines or events_of_lines(spark, sf_dir), MODEL["condition_occurrence"], {
        "condition_occurrence_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "person_id": F.col("o_custkey"),
        "condition_concept_id": F.col("condition_concept_id"),
        "condition_start_date": F.col("o_date"),
        "condition_end_date": F.when(F.col("returned"), F.col("l_shipdate")),
        "visit_occurrence_id": F.col("l_orderkey"),
    })


def drug_exposure(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    return _typed(lines or events_of_lines(spark, sf_dir), MODEL["drug_exposure"], {
        "drug_exposure_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "person_id": F.col("o_custkey"),
        "drug_concept_id": F.col("drug_concept_id"),
        "drug_exposure_start_date": F.col("o_date"),
        "drug_exposure_end_date": F.col("l_shipdate"),
        "days_supply": F.col("days_supply"),
        "quantity": F.col("quantity"),
    })


def measurement(spark: SparkSession, sf_dir: str, copies: bool = True) -> DataFrame:
    events = read(spark, sf_dir, "events")
    if copies:
        events = _with_copies(events, _rest("event_id", 79) == 4)
    kind = (
        F.when(F.col("event_type") == "view", 1)
        .when(F.col("event_type") == "click", 2)
        .when(F.col("event_type") == "purchase", 3)
        .when(F.col("event_type") == "signup", 4)
    )
    return _typed(events, MODEL["measurement"], {
        "measurement_id": F.col("event_id"),
        "person_id": F.when(_rest("event_id", 83) == 7, F.lit(-1)).otherwise(F.col("user_id")),
        "measurement_concept_id": kind,
        "measurement_date": F.when(_rest("event_id", 89) != 3, F.to_date("ts")),
        "value_as_number": F.when(_rest("event_id", 97) == 11, -1.0).otherwise(F.col("value")),
        "visit_occurrence_id": F.col("event_id"),
    })


def orders_of_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and date of the orders that documents name: as many rows as there are notes, without their texts."""
    named = read(spark, sf_dir, "documents").select("doc_id")
    return lookup(_orders(spark, sf_dir, "doc_id"), named, "doc_id", "left_semi")


def note(spark: SparkSession, sf_dir: str, copies: bool = True, orders: DataFrame | None = None) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    notes = lookup(documents, orders or _orders(spark, sf_dir, "doc_id"), "doc_id", "inner")
    if copies:
        notes = _with_copies(notes, _rest("doc_id", 47) == 5)
    visit = F.when(_rest("doc_id", 59) == 3, F.lit(-1)).when(_rest("doc_id", 53) != 4, F.col("doc_id"))
    return _typed(notes, MODEL["note"], {
        "note_id": F.col("doc_id"),
        "person_id": F.col("o_custkey"),
        "note_date": F.col("o_date"),
        "note_text": F.when(_rest("doc_id", 61) != 2, F.col("text")),
        "visit_occurrence_id": visit,
    })


VIEWS = {
    "person": person,
    "visit_occurrence": visit_occurrence,
    "condition_occurrence": condition_occurrence,
    "drug_exposure": drug_exposure,
    "measurement": measurement,
    "note": note,
}


OF_LINES = ("condition_occurrence", "drug_exposure", "conditions", "medications")


def tables(spark: SparkSession, sf_dir: str, keep: Keep = unchanged) -> dict[str, DataFrame]:
    """All tables. ``keep`` may store the line items joined to their orders, which two of them are made of, and
    the orders of notes: where Spark finds these small, texts meet them without moving."""
    lines = keep("lines", events_of_lines(spark, sf_dir))
    found = _views(VIEWS, spark, sf_dir, lines)
    if keep is not unchanged:
        found["note"] = note(spark, sf_dir, orders=keep("orders_of_notes", orders_of_notes(spark, sf_dir)))
    return found


def _views(views: dict, spark: SparkSession, sf_dir: str, lines: DataFrame) -> dict[str, DataFrame]:
    return {
        name: view(spark, sf_dir, lines=lines) if name in OF_LINES else view(spark, sf_dir)
        for name, view in views.items()
    }


# --- source exports: text columns as the mapping jobs read them -----------------------------


def _choice(column: Column, options: list[str | None]) -> Column:
    """The option at a zero-based position."""
    return F.element_at(F.array(*[F.lit(o).cast("string") for o in options]), (column + 1).cast("int"))


def _at(day: Column, time: str) -> Column:
    return F.concat(day.cast("string"), F.lit(f"T{time}Z"))


# One or two codes that no dictionary lists follow the known ones.
CONDITION_CODES = [*codes.CONDITION, "10509002", None]
DRUG_CODES = [*codes.DRUG, "243670", None]


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    races = ["White", "BLACK", "asian", "hawaiian", "native", "other"]
    born = F.lit(1930) + F.pmod(F.col("c_custkey") * 7, F.lit(80))
    return read(spark, sf_dir, "customer").select(
        F.when(_rest("c_custkey", 131) != 11, F.concat(F.lit("P"), F.col("c_custkey").cast("string"))).alias("Id"),
        F.when(_rest("c_custkey", 67) == 13, "U").otherwise(_choice(_rest("c_custkey", 2), ["m", "F"])).alias("GENDER"),
        F.when(_rest("c_custkey", 101) != 7, _choice(_rest("c_nationkey", 6), races)).alias("RACE"),
        _choice(_rest("c_nationkey", 2), ["Hispanic", "nonhispanic"]).alias("ETHNICITY"),
        F.concat(born.cast("string"), F.lit("-03-15")).alias("BIRTHDATE"),
    )


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    kind = (
        F.when(_rest("o_orderkey", 89) == 3, "unheard-of")
        .when(F.col("o_orderpriority") == "1-URGENT", "emergency")
        .when(F.col("o_orderpriority") == "2-HIGH", "Inpatient")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "ambulatory")
        .when(F.col("o_orderpriority") == "5-LOW", "WELLNESS")
        .otherwise("virtual")
    )
    patient = F.when(_rest("o_orderkey", 83) == 7, "P-unknown").otherwise(
        F.concat(F.lit("P"), F.col("o_custkey").cast("string"))
    )
    return read(spark, sf_dir, "orders").select(
        F.when(_rest("o_orderkey", 127) != 13, F.concat(F.lit("E"), F.col("o_orderkey").cast("string"))).alias("Id"),
        patient.alias("PATIENT"),
        kind.alias("ENCOUNTERCLASS"),
        F.when(_rest("o_orderkey", 103) != 9, _at(day, "08:30:00")).alias("START"),
        _at(F.date_add(day, _rest("o_orderkey", 5).cast("int")), "17:00:00").alias("STOP"),
    )


def conditions(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    return (lines or lines_with_orders(spark, sf_dir)).select(
        _choice(_rest("l_partkey", 13), CONDITION_CODES).alias("CODE"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("PATIENT"),
        F.concat(F.lit("E"), F.col("l_orderkey").cast("string")).alias("ENCOUNTER"),
        F.when(_rest("l_suppkey", 59) == 3, "soon").otherwise(F.col("o_date").cast("string")).alias("START"),
        F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate").cast("string")).alias("STOP"),
    )


def medications(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    dispensed = F.when(_rest("l_suppkey", 41) == 6, "several").when(_rest("l_suppkey", 47) == 5, "5d").when(
        _rest("l_suppkey", 43) != 2, F.col("l_quantity").cast("int").cast("string")
    )
    return (lines or lines_with_orders(spark, sf_dir)).select(
        _choice(_rest("l_partkey", 20), DRUG_CODES).alias("CODE"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("PATIENT"),
        F.concat(F.lit("E"), F.col("l_orderkey").cast("string")).alias("ENCOUNTER"),
        _at(F.col("o_date"), "12:00:00.900").alias("START"),
        F.when(_rest("l_suppkey", 37) == 5, "ongoing").otherwise(
            _at(F.to_date("l_shipdate"), "12:00:00.100")
        ).alias("STOP"),
        dispensed.alias("DISPENSES"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    code = (
        F.when(kind == "view", "8480-6")
        .when(kind == "click", "39156-5")
        .when((kind == "purchase") & (_rest("event_id", 7) == 1), "2345-7")
        .when(kind == "purchase", "2339-0")
        .when(kind == "signup", "4548-4")
        .otherwise("8867-4")
    )
    unit = (
        F.when(_rest("event_id", 53) == 4, "furlong")
        .when(kind == "view", "mm[Hg]")
        .when(kind == "click", "kg/m2")
        .when(kind == "purchase", "mg/dL")
        .otherwise("%")
    )
    return read(spark, sf_dir, "events").select(
        code.alias("CODE"),
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("PATIENT"),
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("ENCOUNTER"),
        F.when(_rest("event_id", 89) == 3, "yesterday").otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).alias("DATE"),
        F.when(_rest("event_id", 97) == 11, "high").when(_rest("event_id", 101) == 3, "7f").when(
            _rest("event_id", 211) == 5, "Infinity"
        ).otherwise(F.col("value").cast("string")).alias("VALUE"),
        unit.alias("UNITS"),
    )


def sources(spark: SparkSession, sf_dir: str, keep: Keep = unchanged) -> dict[str, DataFrame]:
    """All exports. ``keep`` may store the line items joined to their orders, which two of them are made of."""
    exports = (patients, encounters, conditions, medications, observations)
    lines = keep("lines", lines_with_orders(spark, sf_dir))
    return _views({export.__name__: export for export in exports}, spark, sf_dir, lines)
