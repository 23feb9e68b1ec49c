"""The registered queries as SQL for a second engine, written independently of the library.

Only the fixed values are the library's own: code dictionaries, phrases and the plan of faults.
Named table expressions build on each other; ``with_tables`` puts those a query needs ahead of
it. Nulls sort last everywhere.
"""

from __future__ import annotations

import re

from vitalsift.functions import codes
from vitalsift.operators import faults as library_faults
from vitalsift.plans import notes


def _text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(map(_text, texts)) + "]"


def _case(column: str, dictionary: dict) -> str:
    """The value that a dictionary holds for a column."""
    as_sql = lambda x: _text(x) if isinstance(x, str) else str(x)
    return f"case {column} " + " ".join(f"when {as_sql(k)} then {as_sql(v)}" for k, v in dictionary.items()) + " end"


def _dictionary(dictionary: dict) -> str:
    return "(values " + ", ".join(f"({_text(k)}, {v})" for k, v in dictionary.items()) + ") d(code, concept)"


def _listed(dictionary: dict) -> str:
    return ", ".join(map(_text, dictionary))


TABLES: dict[str, str] = {}

# --- the test tables as clinical tables ------------------------------------------------------

TABLES["v_person"] = """
select c_custkey as person_id,
       cast(c_custkey % 2 + 1 as int) as gender_concept_id,
       cast(case when c_custkey % 67 <> 13 then 1930 + (c_custkey * 7) % 80 end as int) as year_of_birth,
       cast(c_nationkey % 6 + 1 as int) as race_concept_id,
       cast(c_nationkey % 2 + 1 as int) as ethnicity_concept_id,
       cast(null as int) as location_id
from (select * from customer union all select * from customer where c_custkey % 71 = 5)"""

TABLES["v_visit"] = """
select o_orderkey as visit_occurrence_id,
       case when o_orderkey % 83 = 7 then -1 else o_custkey end as person_id,
       cast(case when o_orderkey % 89 = 3 then null when o_orderpriority = '1-URGENT' then 3
                 when o_orderpriority = '2-HIGH' then 2 else 1 end as int) as visit_concept_id,
       cast(o_orderdate as date) as visit_start_date,
       case when o_orderkey % 97 = 11 then cast(o_orderdate as date) - 1
            else cast(o_orderdate as date) + cast(o_orderkey % 5 as int) end as visit_end_date,
       cast(null as int) as care_site_id, cast(null as int) as provider_id
from (select * from orders union all select * from orders where o_orderkey % 79 = 4)"""

TABLES["v_condition"] = """
select l_orderkey * 10 + l_linenumber as condition_occurrence_id, o_custkey as person_id,
       cast(case when l_partkey % 73 <> 9 then l_partkey % 11 + 1 end as int) as condition_concept_id,
       cast(o_orderdate as date) as condition_start_date,
       case when l_returnflag <> 'N' then cast(l_shipdate as date) end as condition_end_date,
       l_orderkey as visit_occurrence_id
from lineitem join orders on l_orderkey = o_orderkey"""

TABLES["v_drug"] = """
select l_orderkey * 10 + l_linenumber as drug_exposure_id, o_custkey as person_id,
       cast(case when l_partkey % 73 <> 9 then l_partkey % 17 + 1 end as int) as drug_concept_id,
       cast(o_orderdate as date) as drug_exposure_start_date,
       cast(l_shipdate as date) as drug_exposure_end_date,
       case when l_suppkey % 37 = 5 then -1 else cast(l_quantity as int) end as days_supply,
       case when l_suppkey % 41 = 6 then cast(-1 as double) else l_quantity end as quantity
from lineitem join orders on l_orderkey = o_orderkey"""

TABLES["v_measurement"] = """
select event_id as measurement_id,
       case when event_id % 83 = 7 then -1 else user_id end as person_id,
       case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3
            when 'signup' then 4 end as measurement_concept_id,
       case when event_id % 89 <> 3 then cast(ts as date) end as measurement_date,
       case when event_id % 97 = 11 then cast(-1 as double) else value end as value_as_number,
       cast(null as int) as unit_concept_id, event_id as visit_occurrence_id
from (select * from events union all select * from events where event_id % 79 = 4)"""

TABLES["v_note"] = """
select doc_id as note_id, o_custkey as person_id, cast(o_orderdate as date) as note_date,
       case when doc_id % 61 <> 2 then text end as note_text,
       case when doc_id % 59 = 3 then -1 when doc_id % 53 <> 4 then doc_id end as visit_occurrence_id
from (select * from documents union all select * from documents where doc_id % 47 = 5)
join orders on doc_id = o_orderkey"""

# --- rules -----------------------------------------------------------------------------------

# Table: (key, [(check, condition of a violating row)], foreign key or None).
RULES = {
    "person": ("person_id", [
        ("null_gender_concept_id", "gender_concept_id is null"),
        ("null_year_of_birth", "year_of_birth is null"),
        ("null_race_concept_id", "race_concept_id is null"),
        ("null_ethnicity_concept_id", "ethnicity_concept_id is null"),
    ], None),
    "visit_occurrence": ("visit_occurrence_id", [
        ("null_person_id", "person_id is null"),
        ("null_visit_concept_id", "visit_concept_id is null"),
        ("null_visit_start_date", "visit_start_date is null"),
        ("null_visit_end_date", "visit_end_date is null"),
        ("bad_date_visit_end_date", "visit_end_date < visit_start_date"),
    ], ("person_id", "person")),
    "condition_occurrence": ("condition_occurrence_id", [
        ("null_person_id", "person_id is null"),
        ("null_condition_concept_id", "condition_concept_id is null"),
        ("null_condition_start_date", "condition_start_date is null"),
        ("bad_date_condition_end_date", "condition_end_date < condition_start_date"),
    ], None),
    "drug_exposure": ("drug_exposure_id", [
        ("null_person_id", "person_id is null"),
        ("null_drug_concept_id", "drug_concept_id is null"),
        ("null_drug_exposure_start_date", "drug_exposure_start_date is null"),
        ("null_days_supply", "days_supply is null"),
        ("null_quantity", "quantity is null or isnan(quantity)"),
        ("bad_date_drug_exposure_end_date", "drug_exposure_end_date < drug_exposure_start_date"),
        ("neg_days_supply", "days_supply < 0"),
        ("neg_quantity", "quantity < 0"),
    ], None),
    "measurement": ("measurement_id", [
        ("null_person_id", "person_id is null"),
        ("null_measurement_concept_id", "measurement_concept_id is null"),
        ("null_measurement_date", "measurement_date is null"),
        ("null_value_as_number", "value_as_number is null or isnan(value_as_number)"),
        ("neg_value_as_number", "value_as_number < 0"),
    ], ("person_id", "person")),
    "note": ("note_id", [
        ("null_person_id", "person_id is null"),
        ("null_note_date", "note_date is null"),
        ("null_note_text", "note_text is null"),
    ], ("visit_occurrence_id", "visit_occurrence")),
}

COLUMNS = {
    "person": "person_id gender_concept_id year_of_birth race_concept_id ethnicity_concept_id location_id".split(),
    "visit_occurrence": "visit_occurrence_id person_id visit_concept_id visit_start_date visit_end_date care_site_id provider_id".split(),
    "condition_occurrence": "condition_occurrence_id person_id condition_concept_id condition_start_date condition_end_date visit_occurrence_id".split(),
    "drug_exposure": "drug_exposure_id person_id drug_concept_id drug_exposure_start_date drug_exposure_end_date days_supply quantity".split(),
    "measurement": "measurement_id person_id measurement_concept_id measurement_date value_as_number unit_concept_id visit_occurrence_id".split(),
    "note": "note_id person_id note_date note_text visit_occurrence_id".split(),
}

# Short names used for the table expressions above and below.
SHORT = {
    "person": "person", "visit_occurrence": "visit", "condition_occurrence": "condition",
    "drug_exposure": "drug", "measurement": "measurement", "note": "note",
}


def _keys(short_parent: str, parent: str) -> str:
    return f"select {RULES[parent][0]} from {short_parent}"


def _ranked(rows: str, table: str) -> str:
    key = RULES[table][0]
    order = ", ".join(f"{c} nulls last" for c in COLUMNS[table] if c != key)
    return f"select *, row_number() over (partition by {key} order by {order}) as rn from {rows}"


for _table, (_key, _rules, _fk) in RULES.items():
    _broken = " or ".join(f"coalesce({c}, false)" for _, c in _rules)
    if _fk:
        _broken += f" or ({_fk[0]} is not null and {_fk[0]} not in ({_keys('c_' + SHORT[_fk[1]], _fk[1])}))"
    _s = SHORT[_table]
    TABLES[f"valid_{_s}"] = f"select * from v_{_s} where not ({_broken})"
    TABLES[f"ranked_{_s}"] = _ranked(f"valid_{_s}", _table)
    TABLES[f"c_{_s}"] = f"select {', '.join(COLUMNS[_table])} from ranked_{_s} where rn = 1"


def check_sql(table: str, prefix: str) -> str:
    """The report of one table whose expressions are named prefix + short name."""
    key, rules, fk = RULES[table]
    source = prefix + SHORT[table]
    parts = [
        f"select '{table}' as \"table\", '{name}' as \"check\", "
        f"count(*) filter (where {condition}) as violations from {source}"
        for name, condition in rules
    ]
    if fk:
        parts.append(
            f"select '{table}', 'orphan_{fk[0]}', count(*) from {source} where {fk[0]} is not null "
            f"and {fk[0]} not in ({_keys(prefix + SHORT[fk[1]], fk[1])} where {RULES[fk[1]][0]} is not null)"
        )
    parts.append(
        f"select '{table}', 'dup_pk', cast(coalesce(sum(n - 1), 0) as bigint) "
        f"from (select count(*) as n from {source} group by {key})"
    )
    return "\nunion all ".join(parts)


def check_all_sql(prefix: str) -> str:
    return "\nunion all ".join(check_sql(t, prefix) for t in RULES)


def counts_sql(prefix: str, column: str = "rows") -> str:
    return "\nunion all ".join(
        f"select '{t}' as \"table\", count(*) as {column} from {prefix}{SHORT[t]}" for t in RULES
    )


TABLES["cleaning_counts"] = "\nunion all ".join(
    f"""select '{t}' as "table", r as raw, c as cleaned, r - c as dropped,
               round(cast(100 as double) * (r - c) / r, 2) as drop_pct
        from (select count(*) as r from v_{s}), (select count(*) as c from c_{s})"""
    for t, s in SHORT.items()
)


COUNT_SECTIONS = """
select 'raw' as section, "table", raw as actual from cleaning_counts
union all select 'cleaned', "table", cleaned from cleaning_counts
union all select 'dropped', "table", dropped from cleaning_counts"""


def quarantined_copies_sql() -> str:
    return " union all ".join(
        f"select '{t}' as \"table\", copies from ({quarantine_sql(t)})" for t in RULES
    )


def reasons_sql() -> str:
    parts = []
    for table, (_, rules, fk) in RULES.items():
        s = SHORT[table]
        for name, condition in rules:
            parts.append(f"select '{table}' as \"table\", '{name}' as reason, count(*) as rows from v_{s} where {condition}")
        if fk:
            parts.append(
                f"select '{table}' as \"table\", 'orphan_{fk[0]}' as reason, count(*) as rows from v_{s} "
                f"where {fk[0]} is not null and {fk[0]} not in ({_keys('c_' + SHORT[fk[1]], fk[1])})"
            )
        parts.append(f"select '{table}' as \"table\", 'dup_pk' as reason, count(*) as rows from ranked_{s} where rn > 1")
    return f"select * from ({' union all '.join(parts)}) where rows > 0"


def quarantine_sql(table: str) -> str:
    """Removed rows with their reasons as text and the number of identical copies."""
    _, rules, fk = RULES[table]
    s, columns = SHORT[table], ", ".join(COLUMNS[table])
    reasons = [f"case when {condition} then '{name}' end" for name, condition in rules]
    if fk:
        reasons.append(
            f"case when {fk[0]} is not null and {fk[0]} not in ({_keys('c_' + SHORT[fk[1]], fk[1])}) "
            f"then 'orphan_{fk[0]}' end"
        )
    return f"""
select {columns}, reasons, count(*) as copies
from (select *, concat_ws(',', {', '.join(reasons)}) as reasons from v_{s}) where reasons <> ''
group by all
union all
select {columns}, 'dup_pk' as reasons, count(*) as copies from ranked_{s} where rn > 1 group by all"""


# --- per-person summary ----------------------------------------------------------------------

VISIT_COUNTS = """
select person_id, count(*) as total_visit_count,
       count(*) filter (where visit_concept_id = 1) as outpatient_visit_count,
       count(*) filter (where visit_concept_id = 2) as inpatient_visit_count,
       count(*) filter (where visit_concept_id = 3) as er_visit_count
from c_visit group by person_id"""

CONDITION_FLAGS = """
select person_id, count(*) as condition_count, bool_or(condition_concept_id = 1) as has_diabetes,
       bool_or(condition_concept_id = 2) as has_hypertension
from c_condition group by person_id"""

DRUG_COUNTS = "select person_id, count(*) as drug_exposure_count from c_drug group by person_id"


def latest_sql(concept: int, alias: str) -> str:
    return f"""select person_id, value_as_number as {alias} from c_measurement
where measurement_concept_id = {concept}
qualify row_number() over (partition by person_id order by measurement_date desc, measurement_id desc) = 1"""


TABLES["hba1c"] = latest_sql(4, "latest_hba1c")
TABLES["systolic"] = latest_sql(1, "latest_systolic_bp")

MEASUREMENT_SUMMARY = """
select m.person_id, m.measurement_count, m.latest_measurement_date, h.latest_hba1c, s.latest_systolic_bp
from (select person_id, count(*) as measurement_count, max(measurement_date) as latest_measurement_date
      from c_measurement group by person_id) m
left join hba1c h on h.person_id = m.person_id left join systolic s on s.person_id = m.person_id"""

TABLES["visit_counts"] = VISIT_COUNTS
TABLES["condition_flags"] = CONDITION_FLAGS
TABLES["drug_counts"] = DRUG_COUNTS
TABLES["measurement_summary"] = MEASUREMENT_SUMMARY

TABLES["analytic_person"] = """
select p.person_id, cast(2025 - p.year_of_birth as int) as age,
       cast((p.year_of_birth // 10) * 10 as varchar) || 's' as year_of_birth_band, p.gender_concept_id,
       coalesce(v.total_visit_count, 0) as total_visit_count,
       coalesce(v.outpatient_visit_count, 0) as outpatient_visit_count,
       coalesce(v.inpatient_visit_count, 0) as inpatient_visit_count,
       coalesce(v.er_visit_count, 0) as er_visit_count,
       coalesce(c.condition_count, 0) as condition_count,
       coalesce(d.drug_exposure_count, 0) as drug_exposure_count,
       coalesce(m.measurement_count, 0) as measurement_count,
       coalesce(c.has_diabetes, false) as has_diabetes,
       coalesce(c.has_hypertension, false) as has_hypertension,
       m.latest_hba1c, m.latest_systolic_bp, m.latest_measurement_date
from c_person p
left join visit_counts v on v.person_id = p.person_id
left join condition_flags c on c.person_id = p.person_id
left join drug_counts d on d.person_id = p.person_id
left join measurement_summary m on m.person_id = p.person_id"""


def column_summary_sql(column: str, places: int) -> str:
    return f"""select count({column}) as n, round(avg({column}), {places}) as mean,
       round(stddev_samp({column}), {places}) as std, round(min({column}), {places}) as min,
       round(max({column}), {places}) as max from analytic_person"""


PREVALENCE = """
select 'diabetes' as condition, cast(sum(cast(has_diabetes as int)) as bigint) as n,
       round(cast(100 as double) * sum(cast(has_diabetes as int)) / count(*), 1) as prevalence_pct from analytic_person
union all
select 'hypertension', cast(sum(cast(has_hypertension as int)) as bigint),
       round(cast(100 as double) * sum(cast(has_hypertension as int)) / count(*), 1) from analytic_person"""

# --- source exports --------------------------------------------------------------------------

TABLES["patients"] = """
select case when c_custkey % 131 <> 11 then 'P' || c_custkey end as Id,
       case when c_custkey % 67 = 13 then 'U' when c_custkey % 2 = 0 then 'm' else 'F' end as GENDER,
       case when c_custkey % 101 <> 7
            then ['White', 'BLACK', 'asian', 'hawaiian', 'native', 'other'][c_nationkey % 6 + 1] end as RACE,
       case when c_nationkey % 2 = 0 then 'Hispanic' else 'nonhispanic' end as ETHNICITY,
       (1930 + (c_custkey * 7) % 80) || '-03-15' as BIRTHDATE
from customer"""

TABLES["encounters"] = """
select case when o_orderkey % 127 <> 13 then 'E' || o_orderkey end as Id,
       case when o_orderkey % 83 = 7 then 'P-unknown' else 'P' || o_custkey end as PATIENT,
       case when o_orderkey % 89 = 3 then 'unheard-of' when o_orderpriority = '1-URGENT' then 'emergency'
            when o_orderpriority = '2-HIGH' then 'Inpatient' when o_orderpriority = '3-MEDIUM' then 'ambulatory'
            when o_orderpriority = '5-LOW' then 'WELLNESS' else 'virtual' end as ENCOUNTERCLASS,
       case when o_orderkey % 103 <> 9 then cast(cast(o_orderdate as date) as varchar) || 'T08:30:00Z' end as START,
       cast(cast(o_orderdate as date) + cast(o_orderkey % 5 as int) as varchar) || 'T17:00:00Z' as STOP
from orders"""

TABLES["conditions"] = f"""
select {_list([*codes.CONDITION, '10509002', None])}[l_partkey % 13 + 1] as CODE,
       'P' || o_custkey as PATIENT, 'E' || l_orderkey as ENCOUNTER,
       case when l_suppkey % 59 = 3 then 'soon' else cast(cast(o_orderdate as date) as varchar) end as START,
       case when l_returnflag <> 'N' then cast(cast(l_shipdate as date) as varchar) end as STOP
from lineitem join orders on l_orderkey = o_orderkey"""

TABLES["medications"] = f"""
select {_list([*codes.DRUG, '243670', None])}[l_partkey % 20 + 1] as CODE,
       'P' || o_custkey as PATIENT, 'E' || l_orderkey as ENCOUNTER,
       cast(cast(o_orderdate as date) as varchar) || 'T12:00:00.900Z' as START,
       case when l_suppkey % 37 = 5 then 'ongoing' else cast(cast(l_shipdate as date) as varchar) || 'T12:00:00.100Z' end as STOP,
       case when l_suppkey % 41 = 6 then 'several' when l_suppkey % 47 = 5 then '5d' when l_suppkey % 43 <> 2
            then cast(cast(l_quantity as int) as varchar) end as DISPENSES
from lineitem join orders on l_orderkey = o_orderkey"""

TABLES["observations"] = """
select case event_type when 'view' then '8480-6' when 'click' then '39156-5'
            when 'purchase' then (case when event_id % 7 = 1 then '2345-7' else '2339-0' end)
            when 'signup' then '4548-4' else '8867-4' end as CODE,
       'P' || user_id as PATIENT, 'E' || event_id as ENCOUNTER,
       case when event_id % 89 = 3 then 'yesterday' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as DATE,
       case when event_id % 97 = 11 then 'high' when event_id % 101 = 3 then '7f'
            when event_id % 211 = 5 then 'Infinity' else cast(value as varchar) end as VALUE,
       case when event_id % 53 = 4 then 'furlong' when event_type = 'view' then 'mm[Hg]'
            when event_type = 'click' then 'kg/m2' when event_type = 'purchase' then 'mg/dL' else '%' end as UNITS
from events"""

# --- source mapping ---------------------------------------------------------------------------

_STAMP = "'%Y-%m-%dT%H:%M:%SZ'"
_MILLIS = "'%Y-%m-%dT%H:%M:%S.%gZ'"


def _dense(key: str, rows: str, alias: str) -> str:
    return (
        f"select {key}, row_number() over (order by md5({key})) as {alias} "
        f"from (select distinct {key} from {rows} where {key} is not null)"
    )


def _exact(number: str) -> str:
    """Significant digits and a power of ten."""
    text = f"cast(abs({number}) as varchar)"
    mantissa, power = f"split_part({text}, 'e', 1)", f"coalesce(try_cast(ltrim(split_part({text}, 'e', 2), '+') as int), 0)"
    digits = f"ltrim(replace({mantissa}, '.', ''), '0')"
    short = f"rtrim({digits}, '0')"
    exponent = f"({power} - length(split_part({mantissa}, '.', 2)) + length({digits}) - length({short}))"
    return (
        f"case when isnan({number}) then 'nan' when {number} is not null then case when cast({number} as varchar) like '-%' then '-' else '' end"
        f" || case when isinf({number}) then 'inf' when {short} = '' then '0' else {short} || 'e' || {exponent} end end"
    )


def _numbered(rows: str, key: str, columns: list[str], numbers: tuple[str, ...] = ()) -> str:
    text = ", ".join(f"coalesce({_exact(c) if c in numbers else f'cast({c} as varchar)'}, '~')" for c in columns)
    return (
        f"select row_number() over (order by md5(concat_ws('|', {text}))) as {key}, "
        f"{', '.join(columns)} from {rows}"
    )


TABLES["people"] = _dense("Id", "patients", "person_id")

TABLES["person_candidates"] = f"""
select Id, {_case('upper(GENDER)', codes.GENDER)} as gender_concept_id,
       cast(year(cast(BIRTHDATE as date)) as int) as year_of_birth,
       {_case('lower(RACE)', codes.RACE)} as race_concept_id,
       {_case('lower(ETHNICITY)', codes.ETHNICITY)} as ethnicity_concept_id
from patients"""

TABLES["m_person"] = """
select k.person_id, gender_concept_id, year_of_birth, race_concept_id, ethnicity_concept_id,
       cast(null as int) as location_id
from person_candidates join people k using (Id)
where Id is not null and gender_concept_id is not null and race_concept_id is not null and ethnicity_concept_id is not null"""

TABLES["visit_candidates"] = f"""
select e.Id, k.person_id,
       {_case('lower(ENCOUNTERCLASS)', codes.VISIT_CLASS)} as visit_concept_id,
       cast(strptime(START, {_STAMP}) as date) as visit_start_date,
       cast(strptime(STOP, {_STAMP}) as date) as visit_end_date
from encounters e left join people k on k.Id = e.PATIENT"""

TABLES["usable_visits"] = """
select * from visit_candidates
where Id is not null and person_id is not null and visit_concept_id is not null and visit_start_date is not null"""

TABLES["kept_visits"] = """
select * from usable_visits
qualify row_number() over (partition by person_id order by visit_start_date desc, Id) <= 2"""

TABLES["visits"] = _dense("Id", "kept_visits", "visit_occurrence_id")

TABLES["m_visit"] = """
select visit_occurrence_id, person_id, visit_concept_id, visit_start_date, visit_end_date,
       cast(null as int) as care_site_id, cast(null as int) as provider_id
from kept_visits join visits using (Id)"""

TABLES["condition_candidates"] = f"""
select d.concept as condition_concept_id, k.person_id, v.visit_occurrence_id,
       try_cast(START as date) as condition_start_date, try_cast(STOP as date) as condition_end_date
from conditions c
join {_dictionary(codes.CONDITION)} on d.code = c.CODE
left join people k on k.Id = c.PATIENT left join visits v on v.Id = c.ENCOUNTER"""

TABLES["m_condition"] = _numbered(
    "(select * from condition_candidates where person_id is not null and condition_start_date is not null)",
    "condition_occurrence_id", COLUMNS["condition_occurrence"][1:],
)

TABLES["drug_candidates"] = f"""
select d.concept as drug_concept_id, k.person_id,
       cast(try_strptime(START, {_MILLIS}) as date) as drug_exposure_start_date,
       cast(try_strptime(STOP, {_MILLIS}) as date) as drug_exposure_end_date,
       greatest(coalesce(cast(floor((epoch_us(try_strptime(STOP, {_MILLIS})) - epoch_us(try_strptime(START, {_MILLIS}))) / 86400000000) as int), 30), 1) as days_supply,
       coalesce(try_cast(DISPENSES as double), 1) as quantity
from medications m
join {_dictionary(codes.DRUG)} on d.code = m.CODE
join visits v on v.Id = m.ENCOUNTER left join people k on k.Id = m.PATIENT"""

TABLES["m_drug"] = _numbered(
    "(select * from drug_candidates where person_id is not null and drug_exposure_start_date is not null)",
    "drug_exposure_id", COLUMNS["drug_exposure"][1:], ("quantity",),
)

TABLES["measurement_candidates"] = f"""
select d.concept as measurement_concept_id, k.person_id, v.visit_occurrence_id,
       cast(try_strptime(DATE, {_STAMP}) as date) as measurement_date, try_cast(VALUE as double) as value_as_number,
       {_case('UNITS', codes.UNIT)} as unit_concept_id
from observations o
join {_dictionary(codes.MEASUREMENT)} on d.code = o.CODE
join visits v on v.Id = o.ENCOUNTER left join people k on k.Id = o.PATIENT"""

TABLES["m_measurement"] = _numbered(
    "(select * from measurement_candidates where person_id is not null and measurement_date is not null and value_as_number is not null)",
    "measurement_id", COLUMNS["measurement"][1:], ("value_as_number",),
)

_LISTED = {
    "conditions": _listed(codes.CONDITION), "medications": _listed(codes.DRUG), "observations": _listed(codes.MEASUREMENT),
}

MAPPING_TALLY = f"""
select 'person' as "table", 'missing_id' as rule, count(*) as rows from person_candidates where Id is null
union all select 'person', 'unmapped_concept', count(*) from person_candidates
where Id is not null and (gender_concept_id is null or race_concept_id is null or ethnicity_concept_id is null)
union all select 'visit_occurrence', 'missing_id', count(*) from visit_candidates where Id is null
union all select 'visit_occurrence', 'unmapped_or_missing', count(*) from visit_candidates
where Id is not null and (person_id is null or visit_concept_id is null or visit_start_date is null)
union all select 'visit_occurrence', 'over_visit_cap', (select count(*) from usable_visits) - (select count(*) from kept_visits)
union all select 'condition_occurrence', 'unmapped_code', count(*) from conditions
where CODE is null or CODE not in ({_LISTED['conditions']})
union all select 'condition_occurrence', 'missing_required', count(*) from condition_candidates
where person_id is null or condition_start_date is null
union all select 'drug_exposure', 'unmapped_code', count(*) from medications
where ENCOUNTER in (select Id from visits) and (CODE is null or CODE not in ({_LISTED['medications']}))
union all select 'drug_exposure', 'missing_required', count(*) from drug_candidates
where person_id is null or drug_exposure_start_date is null
union all select 'measurement', 'unmapped_code', count(*) from observations
where ENCOUNTER in (select Id from visits) and (CODE is null or CODE not in ({_LISTED['observations']}))
union all select 'measurement', 'missing_required', count(*) from measurement_candidates
where person_id is null or measurement_date is null or value_as_number is null"""

# --- notes -----------------------------------------------------------------------------------

def _index(prime: int, size: str) -> str:
    return f"(((visit_occurrence_id % 1000003) * {prime} + 42) % {size})"


def _pick(prime: int, texts: list[str]) -> str:
    return f"{_list(texts)}[{_index(prime, str(len(texts)))} + 1]"


def note_inputs_sql(p: str) -> str:
    """Inputs with full concept lists, from the expressions with prefix ``p``."""
    return f"""
select v.visit_occurrence_id, v.person_id, v.visit_concept_id, v.visit_start_date as note_date,
       cast(year(v.visit_start_date) - p.year_of_birth as int) as age, p.gender_concept_id,
       coalesce(c.conditions, []) as conditions, coalesce(d.drugs, []) as drugs,
       m.measurement_concept_id as latest_lab_concept_id, m.value_as_number as latest_lab_value
from {p}visit v left join {p}person p on p.person_id = v.person_id
left join (select person_id, list_sort(list(condition_concept_id)) as conditions from {p}condition group by person_id) c
  on c.person_id = v.person_id
left join (select person_id, list_sort(list(drug_concept_id)) as drugs from {p}drug group by person_id) d
  on d.person_id = v.person_id
left join (select * from {p}measurement qualify row_number() over
           (partition by person_id order by measurement_date desc, measurement_id desc) = 1) m
  on m.person_id = v.person_id"""


def note_inputs_report_sql(p: str) -> str:
    """The inputs with each list as text of counts per concept."""
    def counts(column: str, n: int) -> str:
        return "concat_ws(',', " + ", ".join(
            f"len([x for x in {column} if x = {i}])" for i in range(1, n + 1)
        ) + ")"

    return f"""
select visit_occurrence_id, person_id, visit_concept_id, note_date, age, gender_concept_id,
       {counts('conditions', 11)} as conditions, {counts('drugs', 17)} as drugs,
       latest_lab_concept_id, latest_lab_value
from ({note_inputs_sql(p)})"""


def note_sql(p: str) -> str:
    prime = notes.PRIMES
    demographic = _pick(prime["demographic"], notes.DEMOGRAPHIC_PHRASES)
    condition = _pick(prime["condition_phrase"], notes.CONDITION_PHRASES)
    drug = _pick(prime["drug_phrase"], notes.DRUG_PHRASES)
    lab = _pick(prime["lab_phrase"], notes.LAB_PHRASES)
    outpatient, inpatient, emergency = (_pick(prime["complaint"], notes.COMPLAINTS[kind]) for kind in (1, 2, 3))
    return f"""
select visit_occurrence_id as note_id, person_id, note_date,
  case when len(conditions) > 0 then 'CHIEF COMPLAINT: ' || concat_ws(' ',
      replace(replace({demographic}, '{{age}}', cast(age as varchar)), '{{gender}}',
              coalesce({_case('gender_concept_id', codes.GENDER_WORDS)}, 'patient')),
      replace({condition}, '{{condition}}', {_list(codes.CONDITION_NAMES.values())}[conditions[{_index(13, 'len(conditions)')} + 1]]),
      case when len(drugs) > 0 then
        replace({drug}, '{{drug}}', {_list(codes.DRUG_NAMES.values())}[drugs[{_index(19, 'greatest(len(drugs), 1)')} + 1]]) end,
      replace(replace({lab}, '{{lab}}', {_case('latest_lab_concept_id', codes.LAB_NAMES)}),
              '{{value}}', printf('%g', latest_lab_value)))
  else 'CHIEF COMPLAINT: ' || case visit_concept_id when 2 then {inpatient} when 3 then {emergency} else {outpatient} end
    || chr(10) || chr(10) || 'ASSESSMENT AND PLAN: ' || coalesce({_case('visit_concept_id', notes.ASSESSMENTS)}, {_text(notes.ASSESSMENTS[1])})
  end as note_text, visit_occurrence_id
from ({note_inputs_sql(p)})"""


TABLES["m_note"] = note_sql("m_")

# --- faults ----------------------------------------------------------------------------------

# The library's plan of faults, as (kind, column, start column).
_KINDS = {"null": "null", "bad_date": "bad", "negative": "neg", "orphan": "orphan", "duplicate": "dup"}
FAULTS = {
    table: [(_KINDS[f.kind], f.column, f.start) for f in planned] for table, planned in library_faults.FAULTS.items()
}


def inject_sql(table: str, rows: str, faults: list[tuple[str, str, str]]) -> str:
    key = RULES[table][0]
    ranks = ", ".join(
        f"row_number() over (order by md5('{43 + i}:' || cast({key} as varchar))) as rank_{i}"
        for i in range(len(faults))
    )
    changed, dup = {}, None
    for i, (kind, column, start) in enumerate(faults):
        if kind == "dup":
            dup = i
            continue
        value = {"null": "null", "bad": f"{start} - 1", "neg": "-1", "orphan": "-1"}[kind]
        changed[column] = f"case when rank_{i} <= k then {value} else {column} end as {column}"
    columns = ", ".join(changed.get(c, c) for c in COLUMNS[table])
    base = (
        f"from (select *, {ranks}, (select greatest(cast(floor(count(*) * 0.015) as bigint), 1) from {rows}) as k from {rows})"
    )
    sql = f"select {columns} {base}"
    if dup is not None:
        sql += f"\nunion all select {columns} {base} where rank_{dup} <= k"
    return sql


for _table, _s in SHORT.items():
    TABLES[f"i_{_s}"] = inject_sql(_table, f"m_{_s}", FAULTS[_table])

TABLES["distinct_person"] = "select distinct * from v_person"
TABLES["distinct_visit"] = "select distinct * from v_visit"
TABLES["distinct_measurement"] = "select distinct * from v_measurement"
TABLES["distinct_note"] = "select distinct * from v_note"


def with_tables(query: str) -> str:
    """``query`` preceded by the table expressions it uses, directly or through others."""
    needed: list[str] = []

    def add(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", sql)):
            if name in TABLES and name not in needed:
                add(TABLES[name])
                if name not in needed:
                    needed.append(name)

    add(query)
    if not needed:
        return query
    return "with " + ",\n".join(f"{n} as materialized ({TABLES[n]})" for n in needed) + "\n" + query
