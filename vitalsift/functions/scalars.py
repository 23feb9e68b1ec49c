"""Column expressions shared by the operators. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000
# Text of a number: digits with a sign, a point or an exponent, or the word for infinity.
NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def lenient_date(text: Column) -> Column:
    """Date written in a timestamp string; text that is no timestamp becomes null."""
    return text.try_cast("timestamp_ntz").cast("date")


def strict_date(text: Column) -> Column:
    """Date written in a timestamp string; text that is no timestamp fails the query."""
    complaint = F.raise_error(F.concat(F.lit("not a timestamp: "), text)).cast("date")
    return F.coalesce(lenient_date(text), F.when(text.isNotNull(), complaint))


def lenient_double(text: Column) -> Column:
    """Number in a string; text that is no number becomes null.

    A cast alone would also read Java literals such as "5d".
    """
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def days_supplied(start: Column, stop: Column, default: int, floor: int) -> Column:
    """Whole days elapsed between two timestamp strings.

    Counts full 24-hour spans, not calendar days. ``default`` when either end is missing or
    malformed, never below ``floor``.
    """
    elapsed = F.unix_micros(stop.try_cast("timestamp")) - F.unix_micros(start.try_cast("timestamp"))
    days = F.floor(elapsed / F.lit(MICROS_PER_DAY)).cast("int")
    return F.greatest(F.coalesce(days, F.lit(default)), F.lit(floor))


def age_at(reference: date, year_of_birth: Column) -> Column:
    return F.lit(reference.year) - year_of_birth


def age_on(event_date: Column, year_of_birth: Column) -> Column:
    return F.year(event_date) - year_of_birth


def decade_band(year: Column) -> Column:
    """1943 becomes "1940s"."""
    return F.concat((year - year % 10).cast("string"), F.lit("s"))


def missing(column: Column, data_type: T.DataType) -> Column:
    """Null, or NaN for floating-point columns."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _beyond_product(x: Column, a: Column, b: Column) -> Column:
    """``x - a * b``, exact in sign when the two are close (Dekker's product)."""
    def halves(whole: Column) -> Column:
        high = whole * F.lit(134217729.0) - (whole * F.lit(134217729.0) - whole)
        return F.struct(high.alias("high"), (whole - high).alias("low"))

    def difference(p: Column) -> Column:
        u, v = p["a"], p["b"]
        rounded_off = u["low"] * v["low"] - (
            ((p["ab"] - u["high"] * v["high"]) - u["low"] * v["high"]) - u["high"] * v["low"]
        )
        return (x - p["ab"]) - rounded_off

    return _with(F.struct((a * b).alias("ab"), halves(a).alias("a"), halves(b).alias("b")), difference)


def _away_from_tie(value: Column) -> Column:
    """``value``, moved off the middle between two numbers of six digits to the side it is on.

    Formatting rounds the shortest decimal of a double, which may lie exactly in the middle when
    the double itself does not. Such decimals have seven digits and end in 5. Whether the
    double is above or below is decided on exact products, for powers of ten up to 22; beyond
    them a middle is rounded away from zero.
    """
    def moved(text: Column) -> Column:
        digits = F.concat(F.substring(text, 1, 1), F.substring(text, 3, 6)).try_cast("double")
        exponent = F.split_part(text, F.lit("e"), F.lit(2))
        power = exponent.try_cast("int") - 6
        scale = F.pow(F.lit(10.0), F.abs(power).cast("double"))
        # Below 10 ** 7 the double is scaled up, otherwise the decimal is.
        above = F.when(power <= 0, -_beyond_product(digits, F.abs(value), scale)).otherwise(
            _beyond_product(F.abs(value), digits, scale)
        )
        even = F.substring(text, 7, 1).isin("0", "2", "4", "6", "8")
        digit = _with(above, lambda x: F.when((x > 0) | ((x == 0) & ~even), "6").otherwise("4"))
        beside = F.concat(F.substring(text, 1, 7), digit, F.lit("e"), exponent).try_cast("double")
        return F.when(F.abs(power) <= 22, beside * F.signum(value)).otherwise(value)

    def decided(text: Column) -> Column:
        return F.when(text.rlike(r"^[0-9]\.[0-9]{5}50{10}e"), moved(text)).otherwise(value)

    return _with(F.format_string("%.16e", F.abs(value)), decided)


def exact_number(value: Column) -> Column:
    """A number as its significant digits and a power of ten, ``-125e-2`` for -1.25.

    The digits are those of Spark's own text for the number, without zeros at either end, so the
    form does not depend on where that text changes to an exponent. Zeros are ``0`` and ``-0``,
    infinities ``inf`` and ``-inf``, NaN is ``nan``.
    """
    value = value.cast("double")

    def printed(text: Column) -> Column:
        sign = F.when(text.startswith("-"), "-").otherwise("")
        body = F.ltrim(text, F.lit("-"))
        mantissa, power = F.split_part(body, F.lit("E"), F.lit(1)), F.split_part(body, F.lit("E"), F.lit(2))
        places = F.length(F.split_part(mantissa, F.lit("."), F.lit(2)))
        digits = F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0"))
        short = F.rtrim(digits, F.lit("0"))
        exponent = F.coalesce(power.try_cast("int"), F.lit(0)) - places + F.length(digits) - F.length(short)
        number = F.when(short == "", "0").otherwise(F.concat(short, F.lit("e"), exponent.cast("string")))
        return F.concat(sign, F.when(body == "Infinity", "inf").otherwise(number))

    # Numbers in this range have no exponent in Spark's text; expressions alone are far cheaper than a lambda.
    plain = F.abs(value).between(1e-3, 9_999_999.0)
    text = F.abs(value).cast("string")
    digits = F.ltrim(F.replace(text, F.lit("."), F.lit("")), F.lit("0"))
    short = F.rtrim(digits, F.lit("0"))
    exponent = F.instr(text, ".") - F.length(text) + F.length(digits) - F.length(short)
    number = F.concat(F.when(value < 0, "-").otherwise(""), short, F.lit("e"), exponent.cast("string"))
    return (
        F.when(F.isnan(value), "nan")
        .when(plain, number)
        .when(value.isNotNull(), _with(value.cast("string"), printed))
    )


def compact_number(value: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros, as ``%g`` prints it.

    Rounds the exact binary value; infinities and NaN are ``inf``, ``-inf`` and ``nan``. Below
    1e-307, where doubles hold fewer than six digits, the shortest decimal is printed.
    """
    value = value.cast("double")

    def trim(digits: Column) -> Column:
        return F.regexp_replace(digits, r"\.?0+$", "")

    def printed(text: Column) -> Column:
        exponent = F.split_part(text, F.lit("e"), F.lit(2))
        power = exponent.try_cast("int")
        scientific = F.concat(trim(F.split_part(text, F.lit("e"), F.lit(1))), F.lit("e"), exponent)
        # The decimal has a fixed scale, so trailing zeros always follow a decimal point.
        plain = trim(text.try_cast("decimal(20,10)").cast("string"))
        return F.when((power < -4) | (power >= 6), scientific).otherwise(plain)

    return (
        F.when(F.isnan(value), "nan")
        .when(F.abs(value) == F.lit(float("inf")), F.when(value > 0, "inf").otherwise("-inf"))
        .when(value == 0, F.when(value.cast("string").startswith("-"), "-0").otherwise("0"))
        .when(value.isNotNull(), _with(F.format_string("%.5e", _away_from_tie(value)), printed))
    )


def pick_index(row_id: Column, prime: int, seed: int, size: Column | int) -> Column:
    """A repeatable index in [0, size) for a row; a different prime per slot varies the slots.

    The id is reduced first so that the product fits in 64 bits for any id.
    """
    size = F.lit(size) if isinstance(size, int) else size
    return F.pmod(F.pmod(row_id.cast("long"), F.lit(1_000_003)) * prime + seed, size.cast("long"))


def pick(row_id: Column, prime: int, seed: int, choices: list[str]) -> Column:
    """One of a fixed list of texts, chosen by ``pick_index``."""
    options = F.array(*[F.lit(c) for c in choices])
    return F.element_at(options, (pick_index(row_id, prime, seed, len(choices)) + 1).cast("int"))
