"""Code dictionaries and the lookup that applies them.

Each dictionary is a fixed value: source code to small integer concept. They hold at most 18
entries, so a lookup is an expression over a constant map; no join or broadcast is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Concept ids used by the summary.
OUTPATIENT, INPATIENT, EMERGENCY = 1, 2, 3
DIABETES, HYPERTENSION = 1, 2
SYSTOLIC_BP, BODY_MASS_INDEX, GLUCOSE, HBA1C = 1, 2, 3, 4

# Source code -> concept id.
GENDER = {"M": 1, "F": 2}

RACE = {"white": 1, "black": 2, "asian": 3, "hawaiian": 4, "native": 5, "other": 6}

ETHNICITY = {"hispanic": 1, "nonhispanic": 2}

VISIT_CLASS = {
    "ambulatory": 1, "outpatient": 1, "wellness": 1, "urgentcare": 1, "virtual": 1, "home": 1,
    "inpatient": 2, "snf": 2, "hospice": 2,
    "emergency": 3,
}

CONDITION = {
    "44054006": 1, "59621000": 2, "55822004": 3, "271737000": 4, "64859006": 5, "88805009": 6,
    "49436004": 7, "43878008": 8, "307426000": 9, "706870000": 10, "239873007": 11,
}

DRUG = {
    "860975": 1, "106892": 2, "314076": 3, "308136": 4, "310798": 5, "314231": 6, "205923": 7,
    "904419": 8, "1719286": 9, "200033": 10, "197604": 11, "855332": 12, "834102": 13,
    "834061": 13, "309309": 14, "1648755": 15, "854252": 16, "849574": 17,
}

MEASUREMENT = {"8480-6": 1, "39156-5": 2, "2339-0": 3, "2345-7": 3, "4548-4": 4}

UNIT = {"mm[Hg]": 1, "kg/m2": 2, "mg/dL": 3, "%": 4}

# Concept id -> wording used in note text.
CONDITION_NAMES = {
    1: "type 2 diabetes", 2: "hypertension", 3: "hyperlipidemia", 4: "anemia",
    5: "osteoporosis", 6: "congestive heart failure", 7: "atrial fibrillation",
    8: "streptococcal pharyngitis", 9: "a urinary tract infection",
    10: "a pulmonary embolism", 11: "osteoarthritis",
}

DRUG_NAMES = {
    1: "Metformin", 2: "insulin", 3: "Lisinopril", 4: "Amlodipine", 5: "Hydrochlorothiazide",
    6: "Simvastatin", 7: "Epoetin Alfa", 8: "Alendronic acid", 9: "Furosemide",
    10: "Carvedilol", 11: "Digoxin", 12: "Warfarin", 13: "Penicillin V", 14: "Ciprofloxacin",
    15: "Nitrofurantoin", 16: "Enoxaparin", 17: "Naproxen",
}

LAB_NAMES = {1: "systolic blood pressure", 2: "BMI", 3: "glucose", 4: "HbA1c"}

GENDER_WORDS = {1: "male", 2: "female"}


def concept_of(code: Column, codes: dict[str, int], *, fold: str | None = None) -> Column:
    """The dictionary's concept id for a source code, null when the code is not listed.

    ``fold`` is "upper" or "lower" for codes that ignore case.
    """
    if fold:
        code = F.upper(code) if fold == "upper" else F.lower(code)
    return F.try_element_at(_literal_map(codes), code)


def listed(code: Column, codes: dict[str, int]) -> Column:
    """True for whitelisted codes. An ``IN`` list, so it reaches the file scan as a filter."""
    return code.isin(list(codes))


def wording(concept: Column, names: dict[int, str]) -> Column:
    """The phrase for a concept id, null when the id has none."""
    return F.try_element_at(_literal_map(names), concept)


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for entry in entries.items() for x in entry])
