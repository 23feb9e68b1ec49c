"""Personal data in texts, found by expanding anchors.

One Aho-Corasick automaton passes once over a text and reports anchors: at-signs, a plus or a
point beside digits, neighbouring digits, the end of a URI's scheme and words that announce an account number, in
any case of letters. At each anchor
a small parser finds the exact boundaries and checks them. An anchor inside what its parser has already
read is skipped, so a text costs time in proportion to its length whatever it holds.

Base kinds, leftmost and without overlap within a kind; matches that fail their check are dropped:

- ``email``: letters, digits and ``._%+-``, an at-sign, at least two labels joined by points
- ``ip``: four numbers of at most 255 joined by points
- ``card``: 14 to 19 digits, single blanks or hyphens between them, with a valid Luhn sum
- ``phone``: a plus and 10 to 15 digits with blanks, brackets, points and hyphens between them

Kinds that only a cue makes certain:

- ``tel``: 7 to 15 digits after ``tel:``
- ``account``: an IBAN with a valid checksum, or 6 to 17 digits, after a word such as ``IBAN``; words and numbers
  may follow the IBAN, its end is the one that its country fixes or else the last at which the checksum holds
- ``userinfo``: ``user:password`` in front of a host in a URI
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalsift.llm.common import small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "tel", "account", "userinfo")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DIGITS = frozenset("0123456789")
SCHEME_ENDS = frozenset(LOCAL) - frozenset("_%")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
FOUR_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
DIGIT_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TEL = re.compile(r"[0-9][0-9().-]*[0-9]")
CUED = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?|#))?[ ]{0,2}[:=#]?[ ]{0,2}", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9])++(?![A-Za-z0-9])")
USERINFO = re.compile(r"[^\s/@:\"'<>]++:[^\s/@\"'<>]++(?=@)")
NON_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_checks(code: str) -> bool:
    """Whether country code, check digits and account number agree (remainder 1 by 97)."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, begin: int) -> int:
    """The end of the IBAN that starts at ``begin``; -1 where there is none.

    Capitals and digits after a blank may belong to it or not. An end of the length that the country fixes
    comes first, then all others from the last to the first.
    """
    match = IBAN.match(text, begin)
    if not match:
        return -1
    ends = []
    code = ""
    for at in range(begin, match.end()):
        code += text[at].strip()
        # No letter or digit follows.
        if len(code) >= 15 and text[at] != " " and not (text[at + 1 : at + 2].isascii() and text[at + 1 : at + 2].isalnum()):
            ends.append((len(code) == IBAN_LENGTHS.get(code[:2]), at + 1, code))
    return next((end for _, end, code in sorted(ends, reverse=True) if iban_checks(code)), -1)


def in_any_case(word: str) -> list[str]:
    """All spellings of a short word in small letters and capitals."""
    return ["".join(letters) for letters in product(*[sorted({c, c.upper()}) for c in word])]


def build_anchors():
    """The automaton; an anchor's value is its kind and its length."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    anchors = {"@": "email", "://": "userinfo", **{f"+{d}": "phone" for d in DIGITS}}
    anchors |= dict.fromkeys(in_any_case("tel:"), "tel")
    for a in DIGITS:
        for b in DIGITS:
            anchors[f"{a}.{b}"] = "ip"
            anchors |= dict.fromkeys((a + b, f"{a} {b}", f"{a}-{b}"), "card")
    anchors |= {written: "account" for cue in ACCOUNT_CUES for written in in_any_case(cue)}
    for anchor, kind in anchors.items():
        automaton.add_word(anchor, (kind, len(anchor)))
    automaton.make_automaton()
    return automaton


def find_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of all personal data in a text, in order."""
    found: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    previous_at = -1
    for last, (kind, size) in automaton.iter(text):
        start = last + 1 - size
        if kind == "email":
            low = max(done["email"], previous_at + 1)
            previous_at = start
            begin = low + len(text[low:start].rstrip(LOCAL))
            match = DOMAIN.match(text, start + 1) if begin < start else None
            if match:
                done["email"] = match.end()
                found.append((begin, match.end(), 0))
            continue
        if start < done[kind]:
            continue
        if kind == "ip":
            while start > done["ip"] and text[start - 1] in DIGITS:
                start -= 1
            match = FOUR_NUMBERS.match(text, start)
            if match:
                done["ip"] = match.end()
                parts = [p.lstrip("0") for p in match.group().split(".")]
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                    found.append((start, match.end(), 1))
        elif kind == "card":
            match = DIGIT_GROUPS.match(text, start)
            done["card"] = match.end()
            digits = NON_DIGIT.sub("", match.group()) if match.end() - start < 64 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((start, match.end(), 2))
        elif kind == "phone":
            match = PHONE.match(text, start)
            if match:
                done["phone"] = match.end()
                if 10 <= len(NON_DIGIT.sub("", match.group())) <= 15:
                    found.append((start, match.end(), 3))
        elif kind == "tel":
            match = TEL.match(text, last + 1)
            if match:
                done["tel"] = match.end()
                if 7 <= len(NON_DIGIT.sub("", match.group())) <= 15:
                    found.append((last + 1, match.end(), 4))
        elif kind == "account":
            begin = CUED.match(text, last + 1).end()
            end = iban_end(text, begin)
            if end >= 0:
                done["account"] = end
                found.append((begin, end, 5))
            elif match := ACCOUNT.match(text, begin):
                done["account"] = match.end()
                if match.end() - begin < 64 and 6 <= len(NON_DIGIT.sub("", match.group())) <= 17:
                    found.append((begin, match.end(), 5))
        # Any scheme, so a letter, digit or sign of one stands before the colon.
        elif start and text[start - 1] in SCHEME_ENDS and (match := USERINFO.match(text, last + 1)):
            done["userinfo"] = match.end()
            found.append((last + 1, match.end(), 6))
    found.sort(key=lambda span: (span[0], span[2]))
    return found


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_anchors = None


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _anchors
    _anchors = _anchors or build_anchors()
    for batch in batches:
        spans = [
            [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in find_spans(text, _anchors)] if text else []
            for text in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, _ARROW_SPANS)], names=["doc_id", "spans"]
        )


def find_private(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points) of every row's text.

    Spans are in order of start, then of kind as listed in ``KINDS``. A null or empty text has
    none; rows are handled one by one, so repeated ids and rows stay. Other columns are ignored; an
    empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        _spans, "doc_id long, spans array<struct<kind: string, start: int, end: int>>"
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and a digest of the base kinds, and all spans as text."""
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[of(k) for k in BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
