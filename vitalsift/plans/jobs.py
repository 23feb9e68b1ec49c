"""The two jobs: make the raw tables from source exports, and turn raw tables into the summary.

Only these functions run Spark actions and write; they are given a session and leave it open.
"""

from __future__ import annotations

import time
from collections.abc import Container, Mapping
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalsift.config import DEFAULTS, JobConfig
from vitalsift.operators.checks import ROWS, counts_and_checks, key_checks, rows_and_rules, rule_aggregates
from vitalsift.operators.cleaning import by_address, clean_all, quarantine_all, row_counts
from vitalsift.operators.faults import inject_all
from vitalsift.operators.summary import person_summary
from vitalsift.plans.mapping import Steps, lost_rows, map_all, steps_of
from vitalsift.sources.tables import (
    INTERMEDIATE,
    read_tables,
    read_text,
    scratch,
    staged,
    stored_in,
    write_csv,
    write_document,
    write_parquet,
)
from vitalsift.specs import MODEL, Model

SOURCES = ("patients", "encounters", "conditions", "medications", "observations")
BAND = "year_of_birth_band"


class GateError(RuntimeError):
    """Cleaned tables still break a rule."""


@dataclass(frozen=True)
class TableState:
    """Row counts by table and the check report, collected in one job."""

    rows: dict[str, int]
    report: list[dict]

    @property
    def violated(self) -> list[dict]:
        return [r for r in self.report if r["violations"] > 0]


def inspect(tables: Mapping[str, DataFrame], model: Model = MODEL) -> TableState:
    """Check every table and count its rows, in one action that collects a few dozen rows."""
    found = counts_and_checks(tables, model).collect()
    return TableState(
        rows={r["table"]: r["violations"] for r in found if r["check"] == ROWS},
        report=[r.asDict() for r in found if r["check"] != ROWS],
    )


def write_cleaned(
    raw: Mapping[str, DataFrame], model: Model, folder: str, stored: Container[str] = ()
) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]]]:
    """Clean and store all tables; also their rows and violations of row rules, counted as they are written.

    A table that others refer to is a job of its own. All other tables are written in one job,
    as partitions of one table with the columns of all. One that is cleaned by row address is not written
    again: it is the stored table without the rows on its stored list, and has no counts here.
    """
    keep = stored_in(folder)
    parents = {fk.parent for name in model for fk in model[name].foreign_keys}
    listed = {name for name in model if by_address(name, model, stored)} - parents
    seen = {name: Observation(name) for name in model if name not in listed}

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.observe(seen[name], *rule_aggregates(model[name]))

    def kept(name: str, df: DataFrame) -> DataFrame:
        # Lists of addresses are stored, a table without children waits for the others.
        if name in seen:
            df = counted(name, df)
        return df if name in model and name not in parents else keep(name, df)

    cleaned = clean_all(raw, model, kept, stored)
    leaves = [name for name in model if name not in parents | listed]
    if not leaves:
        return cleaned, {name: found.get for name, found in seen.items()}
    rows = [cleaned[name].withColumn("_table", F.lit(name)) for name in leaves]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    together.write.mode("overwrite").option("compression", INTERMEDIATE).partitionBy("_table").parquet(f"{folder}/leaves")
    reader = raw[leaves[0]].sparkSession.read
    for name in leaves:
        # A table without rows has no folder, so the partition is picked by its column.
        schema = T.StructType([*cleaned[name].schema, T.StructField("_table", T.StringType())])
        rows = reader.schema(schema).parquet(f"{folder}/leaves").filter(F.col("_table") == name)
        cleaned[name] = rows.drop("_table")
    return cleaned, {name: found.get for name, found in seen.items()}


def inspect_written(
    tables: Mapping[str, DataFrame], counts: Mapping[str, Mapping[str, int]], model: Model = MODEL
) -> TableState:
    """``inspect`` of tables whose rows and row rules have been counted already, but for those not in ``counts``."""
    uncounted = [rows_and_rules(tables[name], model[name]) for name in model if name not in counts]
    checks = reduce(DataFrame.unionByName, uncounted, key_checks(tables, model))
    found = {(r["table"], r["check"]): r["violations"] for r in checks.collect()}
    found |= {(name, check): n for name, counted in counts.items() for check, n in counted.items()}
    report = [
        {"table": name, "check": check, "violations": found[name, check]}
        for name in model
        for check in model[name].check_names()
    ]
    return TableState(rows={name: found[name, ROWS] for name in model}, report=report)


def require_clean(state: TableState) -> None:
    """The gate: raise when any check found something."""
    if state.violated:
        found = ", ".join(f"{r['table']}.{r['check']}={r['violations']}" for r in state.violated)
        raise GateError(f"Cleaned tables still have {len(state.violated)} violation(s): {found}")


def write_summary(summary: DataFrame, path: str) -> int:
    """Write the summary by decade of birth; return its rows, counted as they are written."""
    counted = Observation("summary")
    write_parquet(summary.observe(counted, F.count("*").alias("rows")), path, partition_by=[BAND])
    return counted.get["rows"]


def run(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    output: str,
    *,
    model: Model = MODEL,
    config: JobConfig = DEFAULTS,
    with_quarantine: bool = False,
    stored: Container[str] = (),
) -> dict:
    """Check, clean, check again as a gate, summarise and write. Returns the metrics.

    Cleaned tables are stored once in the shared work folder: their children, the gate and the
    summary read them from there. The folder is deleted at the end, also after a failure.
    Rows and row rules of the gate are counted while cleaned tables are written, so that it reads
    keys and references only. Nothing is written to ``output`` when the gate fails. What a run writes
    appears there at its end and all together, so a run that fails leaves the output of the one before it.
    ``with_quarantine`` also writes the removed rows of every table, with their reasons, under
    ``_quarantine``. ``stored`` names raw tables that are Parquet files as they are (see ``clean_all``).
    """
    with scratch(spark) as folder:
        return _run(spark, raw, output, folder, model, config, with_quarantine, stored)


def _run(
    spark: SparkSession, raw: Mapping[str, DataFrame], output: str, folder: str, model: Model,
    config: JobConfig, with_quarantine: bool, stored: Container[str],
) -> dict:
    started = time.perf_counter()
    timings: dict[str, float] = {}

    def timed(stage: str, since: float) -> float:
        now = time.perf_counter()
        timings[stage] = round(now - since, 2)
        return now

    before = inspect(raw, model)
    clock = timed("validation_raw", started)
    cleaned, counts = write_cleaned(raw, model, f"{folder}/cleaned", stored)
    clock = timed("cleaning", clock)
    after = inspect_written(cleaned, counts, model)
    require_clean(after)
    clock = timed("validation_cleaned", clock)
    events = ("person", "visit_occurrence", "condition_occurrence", "drug_exposure", "measurement")
    summary = person_summary(
        *[cleaned[name] for name in events], reference_date=config.reference_date, model=model
    )
    with staged(spark, output) as drafts:
        people = write_summary(summary, f"{drafts}/analytic_person")
        clock = timed("build_and_write", clock)
        if with_quarantine:
            removed = quarantine_all(raw, cleaned, model, stored_in(f"{folder}/quarantine"), stored)
            for name, rows in removed.items():
                write_parquet(rows, f"{drafts}/_quarantine/{name}")
            timed("quarantine", clock)
        timed("total", started)
        metrics = {
            "row_counts": {
                "raw": before.rows,
                "cleaned": after.rows,
                "dropped": {t: before.rows[t] - after.rows[t] for t in model},
                "analytic_person": people,
            },
            "validation": {"raw": before.report, "cleaned": after.report},
            "timings_seconds": timings,
        }
        write_document(spark, metrics, f"{drafts}/_metrics")
    return metrics


def read_counts(spark: SparkSession, path: str, model: Model = MODEL) -> DataFrame:
    """The row counts of a stored metrics document as (section, table, rows).

    Sections are raw, cleaned and dropped. Comparing two runs, or a run and a golden file, is
    ``explore.count_mismatches`` on two of these.
    """
    counts = spark.read.option("multiLine", True).json(path).select("row_counts.*")
    entries = [
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("table"),
                 F.col(f"{section}.{name}").cast("long").alias("rows"))
        for section in ("raw", "cleaned", "dropped")
        for name in model
    ]
    return counts.select(F.inline(F.array(*entries)))


def read_violations(spark: SparkSession, path: str) -> DataFrame:
    """The check counts of a stored metrics document as (section, table, check, violations)."""
    document = spark.read.option("multiLine", True).json(path)
    parts = [
        document.select(F.lit(section).alias("section"), F.inline(f"validation.{section}"))
        for section in ("raw", "cleaned")
    ]
    return parts[0].unionByName(parts[1]).select("section", "table", "check", "violations")


def run_from(
    spark: SparkSession,
    folder: str,
    output: str,
    *,
    format: str = "csv",
    model: Model = MODEL,
    config: JobConfig = DEFAULTS,
    with_quarantine: bool = False,
) -> dict:
    """``run`` on the tables stored in ``folder``.

    CSV is loaded once into the shared work folder, because every check and the cleaning would
    parse it again. The copy is deleted at the end, also after a failure.
    """
    raw = read_tables(spark, model, folder, format)
    options = {"model": model, "config": config, "with_quarantine": with_quarantine}
    if format != "csv":
        return run(spark, raw, output, **options, stored=model if format == "parquet" else ())
    with scratch(spark) as copies:
        keep = stored_in(f"{copies}/raw")
        raw = {name: keep(name, df) for name, df in raw.items()}
        return run(spark, raw, output, **options, stored=model)


def load_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    return row_counts(tables)


def row_budget(manifest: DataFrame, config: JobConfig = DEFAULTS) -> DataFrame:
    """Total rows and whether they clearly exceed the budget."""
    total = F.coalesce(F.sum("rows"), F.lit(0))
    return manifest.agg(total.alias("total_rows")).select(
        "total_rows",
        F.lit(config.row_budget).alias("budget"),
        (F.col("total_rows") > config.row_budget * config.budget_tolerance).alias("over_budget"),
    )


def generate(
    spark: SparkSession,
    sources: Mapping[str, DataFrame],
    output: str,
    *,
    model: Model = MODEL,
    config: JobConfig = DEFAULTS,
    format: str = "parquet",
) -> dict:
    """Map the source exports, add known faults, and write the raw tables with a manifest.

    The manifest holds the rows of every table and the rows each mapping step left out. All of it
    appears in ``output`` together, in place of an earlier run's. Intermediate tables are deleted at the end, also after a failure.
    """
    with scratch(spark) as folder:
        return _generate(spark, sources, output, folder, model, config, format)


def _generate(
    spark: SparkSession, sources: Mapping[str, DataFrame], output: str, folder: str, model: Model,
    config: JobConfig, format: str,
) -> dict:
    keep = stored_in(f"{folder}/mapping")
    steps = steps_of(sources, model, config, keep)
    mapped = map_all(sources, model, config, keep, steps)
    raw = inject_all(mapped, model, fraction=config.fault_fraction, seed=config.seed)
    counted = {name: Observation(name) for name in raw}
    with staged(spark, output) as drafts:
        for name, df in raw.items():
            df = df.observe(counted[name], F.count("*").alias("rows"))
            if format == "csv":
                write_csv(df, f"{drafts}/{name}.csv")
            else:
                write_parquet(df, f"{drafts}/{name}")
        return _write_manifest(spark, drafts, steps, counted, config)


def _write_manifest(
    spark: SparkSession, drafts: str, steps: Steps, counted: Mapping[str, Observation], config: JobConfig
) -> dict:
    manifest = {name: found.get["rows"] for name, found in counted.items()}
    lost = lost_rows(steps).collect()
    total = sum(manifest.values())
    document = {
        "generated_at": datetime.now(timezone.utc).isoformat(),
        "random_seed": config.seed,
        "reference_date": config.reference_date.isoformat(),
        "row_counts": manifest,
        "total_rows": total,
        "over_budget": total > config.row_budget * config.budget_tolerance,
        "lost_in_mapping": [r.asDict() for r in lost],
        "config": asdict(config),
    }
    write_document(spark, document, f"{drafts}/_manifest")
    return document


def generate_from(
    spark: SparkSession,
    folder: str,
    output: str,
    *,
    model: Model = MODEL,
    config: JobConfig = DEFAULTS,
    format: str = "parquet",
) -> dict:
    """``generate`` on the source exports in ``folder``, ``<name>.csv`` each, every column as text.

    Each file is parsed once, by the step that marks its rows.
    """
    sources = {name: read_text(spark, f"{folder}/{name}.csv") for name in SOURCES}
    return generate(spark, sources, output, model=model, config=config, format=format)
