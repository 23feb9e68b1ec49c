import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from vitalsift.functions import codes, scalars


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value",
    [0.0, 7.5, 120.0, 337.16, 100.0, 0.0001, 0.00012345678, 123456.0, 123456.7, 999999.5, 1e6, 1234567.0, 1.5e-5,
     -3.25, 99.99999, 10.0, 1e15, 2.50, 1 / 3],
)
def test_compact_number_prints_like_g(spark, value):
    assert one(spark, scalars.compact_number(F.lit(value))) == f"{value:g}"


def test_compact_number_rounds_the_exact_value(spark):
    """Decimals of seven digits, most of which end in 5, and every kind of special value."""
    rng = random.Random(1)
    values = [float(f"{rng.randrange(1_000_000, 10_000_000)}e{rng.randint(-12, 6)}") for _ in range(1_000)]
    values += [float(f"{rng.randrange(100_000, 1_000_000)}5e{rng.randint(-12, 6)}") for _ in range(2_000)]
    values += [2.209285, -2.209285, -0.0, float("inf"), float("-inf"), float("nan"), 9999995.0, 1.7e308]
    found = spark.createDataFrame(list(enumerate(values)), "i int, v double").select(
        "i", scalars.compact_number(F.col("v")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in found} == {i: f"{v:g}" for i, v in enumerate(values)}


def test_compact_number_of_null(spark):
    assert one(spark, scalars.compact_number(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("year, band", [(1943, "1940s"), (1987, "1980s"), (2000, "2000s"), (1999, "1990s")])
def test_decade_band(spark, year, band):
    assert one(spark, scalars.decade_band(F.lit(year))) == band


@pytest.mark.parametrize(
    "start, stop, days",
    [
        ("2020-01-01T12:00:00Z", "2020-01-03T00:00:00Z", 1),
        ("2020-01-01T00:00:00Z", "2020-01-31T00:00:00Z", 30),
        ("2020-01-01T00:00:00Z", "2020-01-01T10:00:00Z", 1),
        ("2020-01-05T00:00:00Z", "2020-01-01T00:00:00Z", 1),
        ("2020-01-01T00:00:00Z", None, 30),
        ("soon", "2020-01-01T00:00:00Z", 30),
        ("2020-01-01T00:00:00.900Z", "2020-01-03T00:00:00.100Z", 1),
        ("2020-01-01T00:00:00.100Z", "2020-01-03T00:00:00.100Z", 2),
    ],
)
def test_days_supplied(spark, start, stop, days):
    column = scalars.days_supplied(F.lit(start), F.lit(stop).cast("string"), 30, 1)
    assert one(spark, column) == days


def test_dates_from_text(spark):
    late = "2020-03-01T23:59:59Z"
    assert one(spark, scalars.lenient_date(F.lit(late))) == date(2020, 3, 1)
    assert one(spark, scalars.strict_date(F.lit(late))) == date(2020, 3, 1)
    assert one(spark, scalars.strict_date(F.lit("1950-07-09"))) == date(1950, 7, 9)
    assert one(spark, scalars.lenient_date(F.lit("2020-02-31"))) is None
    assert one(spark, scalars.strict_date(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="not a timestamp: soon"):
        one(spark, scalars.strict_date(F.col("t")), t="soon")


def test_dates_do_not_depend_on_the_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, scalars.lenient_date(F.lit("2020-03-01T23:59:59Z"))) == date(2020, 3, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numbers_from_text(spark):
    found = [one(spark, scalars.lenient_double(F.lit(t))) for t in ("1.5", "many", "NaN", " 2 ")]
    assert found == [1.5, None, None, 2.0]
    found = [one(spark, scalars.lenient_double(F.lit(t))) for t in ("5d", "5f", "0x1", "1_0", "1e", "", "-1e3", ".5", "Infinity")]
    assert found == [None, None, None, None, None, None, -1000.0, 0.5, float("inf")]


def test_ages(spark):
    assert one(spark, scalars.age_at(date(2025, 1, 1), F.lit(1980))) == 45
    assert one(spark, scalars.age_on(F.lit(date(2001, 12, 31)), F.lit(1980))) == 21


def test_picking_is_repeatable_and_in_range(spark):
    ids = spark.range(5000).union(spark.createDataFrame([(2**62,), (-5,)], "id bigint"))
    found = ids.select(scalars.pick_index(F.col("id"), 13, 42, 4).alias("i")).collect()
    assert {r["i"] for r in found} == {0, 1, 2, 3}
    assert one(spark, scalars.pick(F.lit(3), 7, 42, ["a", "b", "c"])) == "abc"[(3 * 7 + 42) % 3]


@pytest.mark.parametrize(
    "code, dictionary, fold, concept",
    [
        ("m", codes.GENDER, "upper", 1), ("F", codes.GENDER, "upper", 2), ("U", codes.GENDER, "upper", None),
        ("Hawaiian", codes.RACE, "lower", 4), ("NonHispanic", codes.ETHNICITY, "lower", 2),
        ("SNF", codes.VISIT_CLASS, "lower", 2), ("urgentcare", codes.VISIT_CLASS, "lower", 1),
        ("834061", codes.DRUG, None, 13), ("834102", codes.DRUG, None, 13), ("2345-7", codes.MEASUREMENT, None, 3),
        ("%", codes.UNIT, None, 4), (None, codes.UNIT, None, None), ("mm[hg]", codes.UNIT, None, None),
    ],
)
def test_concepts(spark, code, dictionary, fold, concept):
    assert one(spark, codes.concept_of(F.lit(code).cast("string"), dictionary, fold=fold)) == concept


def test_every_concept_has_a_name():
    assert set(codes.CONDITION.values()) == set(codes.CONDITION_NAMES)
    assert set(codes.DRUG.values()) == set(codes.DRUG_NAMES)
    assert set(codes.MEASUREMENT.values()) == set(codes.LAB_NAMES)
    assert {len(d) for d in (codes.CONDITION, codes.DRUG, codes.MEASUREMENT, codes.VISIT_CLASS)} == {11, 18, 5, 10}


def test_exact_numbers_in_both_engines(spark):
    duckdb = pytest.importorskip("duckdb")
    from starqueries.oracles import _exact

    values = [0.0, -0.0, 1.0, -1.25, 100.0, 0.1, 1e-7, 1e20, 1.5e-300, 1.7976931348623157e308, 123456789.125, 1e16, 9007199254740993.0,
              0.001, 1234567.0, 12345678.0, float("inf"), float("-inf"), float("nan"), None]
    expected = ["0", "-0", "1e0", "-125e-2", "1e2", "1e-1", "1e-7", "1e20", "15e-301", "17976931348623157e292", "123456789125e-3", "1e16",
                "9007199254740992e0", "1e-3", "1234567e0", "12345678e0", "inf", "-inf", "nan", None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    assert [r[0] for r in df.orderBy("k").select(scalars.exact_number(F.col("v"))).collect()] == expected
    found = [duckdb.execute(f"select {_exact('v')} from (select cast(? as double) as v)", [v]).fetchone()[0] for v in values]
    assert found == expected
