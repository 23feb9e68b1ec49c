"""Table specifications: schemas, keys and quality rules, kept as data.

The operators read these specs; none of them knows a table by name. Ids are 32-bit in
``MODEL``. A 32-bit id runs out at about two billion rows, and an ANSI cast then fails, so
``WIDE_MODEL`` has the same tables with 64-bit ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

INT, LONG, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
STRING, DATE, BOOLEAN = T.StringType(), T.DateType(), T.BooleanType()


@dataclass(frozen=True)
class ForeignKey:
    """``column`` must be null or name a ``parent`` row."""

    column: str
    parent: str
    parent_key: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: str
    required: tuple[str, ...] = ()
    date_pairs: tuple[tuple[str, str], ...] = ()
    non_negative: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    # Additional checks that are off unless asked for.
    check_null_key: bool = False

    def __post_init__(self):
        # A comparison with null is neither kept nor counted, so these must be required too.
        compared = {start for start, _ in self.date_pairs} | set(self.non_negative)
        if not compared <= set(self.required):
            raise ValueError(f"{self.name}: {sorted(compared - set(self.required))} must be required")

    def column_type(self, column: str) -> T.DataType:
        return self.schema[column].dataType

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def holds_text(self) -> bool:
        """Whether fields may be free text, which can span lines in a CSV file."""
        return any(isinstance(f.dataType, T.StringType) for f in self.schema)

    def check_names(self) -> list[str]:
        """Names of the table's checks in report order."""
        names = [f"null_{c}" for c in self.required]
        names += [f"bad_date_{end}" for _, end in self.date_pairs]
        names += [f"neg_{c}" for c in self.non_negative]
        names += ["null_pk"] if self.check_null_key else []
        names += [f"orphan_{fk.column}" for fk in self.foreign_keys]
        return names + ["dup_pk"]


@dataclass(frozen=True)
class Model:
    """Table specs by name, in report order, plus the schema of the per-person summary."""

    tables: dict[str, TableSpec]
    summary: T.StructType = field(repr=False)
    id_type: T.DataType = INT

    def __getitem__(self, name: str) -> TableSpec:
        return self.tables[name]

    def __iter__(self):
        return iter(self.tables)

    def cleaning_order(self) -> list[str]:
        """Table names with every parent ahead of its children."""
        ordered: list[str] = []

        def visit(name: str) -> None:
            if name in ordered:
                return
            for fk in self.tables[name].foreign_keys:
                visit(fk.parent)
            ordered.append(name)

        for name in self.tables:
            visit(name)
        return ordered

    def with_checks(self, *, strict_keys: bool = False, null_keys: bool = False) -> "Model":
        """The same model with stricter optional checks.

        ``strict_keys`` demands a valid person and visit wherever a table names one;
        ``null_keys`` reports missing primary keys.
        """
        tables = {}
        for name, spec in self.tables.items():
            fks = list(spec.foreign_keys)
            if strict_keys and name != "person":
                known = {fk.column for fk in fks}
                for fk in (PERSON_KEY, VISIT_KEY):
                    if fk.column in spec.columns and fk.column not in known and fk.parent != name:
                        fks.append(fk)
            tables[name] = replace(
                spec, foreign_keys=tuple(fks), check_null_key=null_keys or spec.check_null_key
            )
        return replace(self, tables=tables)


PERSON_KEY = ForeignKey("person_id", "person", "person_id")
VISIT_KEY = ForeignKey("visit_occurrence_id", "visit_occurrence", "visit_occurrence_id")


def _struct(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in columns])


def build_model(id_type: T.DataType = INT) -> Model:
    """The six-table patient-centric model with ids of the given type."""
    must, may = False, True
    specs = [
        TableSpec(
            "person",
            _struct(
                ("person_id", id_type, must),
                ("gender_concept_id", INT, must),
                ("year_of_birth", INT, must),
                ("race_concept_id", INT, must),
                ("ethnicity_concept_id", INT, must),
                ("location_id", INT, may),
            ),
            key="person_id",
            required=(
                "gender_concept_id", "year_of_birth", "race_concept_id", "ethnicity_concept_id",
            ),
        ),
        TableSpec(
            "visit_occurrence",
            _struct(
                ("visit_occurrence_id", id_type, must),
                ("person_id", id_type, must),
                ("visit_concept_id", INT, must),
                ("visit_start_date", DATE, must),
                ("visit_end_date", DATE, must),
                ("care_site_id", INT, may),
                ("provider_id", INT, may),
            ),
            key="visit_occurrence_id",
            required=("person_id", "visit_concept_id", "visit_start_date", "visit_end_date"),
            date_pairs=(("visit_start_date", "visit_end_date"),),
            foreign_keys=(PERSON_KEY,),
        ),
        TableSpec(
            "condition_occurrence",
            _struct(
                ("condition_occurrence_id", id_type, must),
                ("person_id", id_type, must),
                ("condition_concept_id", INT, must),
                ("condition_start_date", DATE, must),
                ("condition_end_date", DATE, may),
                ("visit_occurrence_id", id_type, may),
            ),
            key="condition_occurrence_id",
            required=("person_id", "condition_concept_id", "condition_start_date"),
            date_pairs=(("condition_start_date", "condition_end_date"),),
        ),
        TableSpec(
            "drug_exposure",
            _struct(
                ("drug_exposure_id", id_type, must),
                ("person_id", id_type, must),
                ("drug_concept_id", INT, must),
                ("drug_exposure_start_date", DATE, must),
                ("drug_exposure_end_date", DATE, may),
                ("days_supply", INT, must),
                ("quantity", DOUBLE, must),
            ),
            key="drug_exposure_id",
            required=(
                "person_id", "drug_concept_id", "drug_exposure_start_date", "days_supply", "quantity",
            ),
            date_pairs=(("drug_exposure_start_date", "drug_exposure_end_date"),),
            non_negative=("days_supply", "quantity"),
        ),
        TableSpec(
            "measurement",
            _struct(
                ("measurement_id", id_type, must),
                ("person_id", id_type, must),
                ("measurement_concept_id", INT, must),
                ("measurement_date", DATE, must),
                ("value_as_number", DOUBLE, must),
                ("unit_concept_id", INT, may),
                ("visit_occurrence_id", id_type, may),
            ),
            key="measurement_id",
            required=("person_id", "measurement_concept_id", "measurement_date", "value_as_number"),
            non_negative=("value_as_number",),
            foreign_keys=(PERSON_KEY,),
        ),
        TableSpec(
            "note",
            _struct(
                ("note_id", id_type, must),
                ("person_id", id_type, must),
                ("note_date", DATE, must),
                ("note_text", STRING, must),
                ("visit_occurrence_id", id_type, may),
            ),
            key="note_id",
            required=("person_id", "note_date", "note_text"),
            foreign_keys=(VISIT_KEY,),
        ),
    ]
    summary = _struct(
        ("person_id", id_type, must),
        ("age", INT, must),
        ("year_of_birth_band", STRING, must),
        ("gender_concept_id", INT, must),
        ("total_visit_count", LONG, must),
        ("outpatient_visit_count", LONG, must),
        ("inpatient_visit_count", LONG, must),
        ("er_visit_count", LONG, must),
        ("condition_count", LONG, must),
        ("drug_exposure_count", LONG, must),
        ("measurement_count", LONG, must),
        ("has_diabetes", BOOLEAN, must),
        ("has_hypertension", BOOLEAN, must),
        ("latest_hba1c", DOUBLE, may),
        ("latest_systolic_bp", DOUBLE, may),
        ("latest_measurement_date", DATE, may),
    )
    return Model({s.name: s for s in specs}, summary, id_type)


MODEL = build_model()
WIDE_MODEL = build_model(LONG)


def require_schema(df, expected: T.StructType, label: str) -> None:
    """Raise ``ValueError`` unless ``df`` has the expected columns with their types.

    The order of columns and whether they may be null are free.
    """
    there = dict(df.dtypes)
    problems = [
        f"{f.name} is {there.pop(f.name, 'absent')}, not {f.dataType.simpleString()}"
        for f in expected
        if there.get(f.name) != f.dataType.simpleString() or there.pop(f.name) is None
    ]
    problems += [f"{name} is not expected" for name in there]
    if problems:
        raise ValueError(f"{label}: {'; '.join(problems)}")
