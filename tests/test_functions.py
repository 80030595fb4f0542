import math

import pytest
from pyspark.sql import functions as F

from itemloom.functions.labels import interval_label
from itemloom.functions.numbers import literal_number, locale_number, segment
from itemloom.model import (
    AllOf,
    Border,
    Equidistant,
    Equisized,
    Interval,
    MiningTask,
    min_count,
)


def column(spark, expression, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    "locale, text, number",
    [
        ("en", "1,234.5", 1234.5),
        ("en", "-7", -7.0),
        ("en", "5-LOW", None),
        ("en", "+5", None),
        ("en", "", None),
        ("en", "1d", None),
        ("en", "1.5E3", 1500.0),
        ("en", "1 234", None),
        ("de", "1.234,5", 1234.5),
        ("cs", "1 234,5", 1234.5),
        ("cs", "1 234,5", 1234.5),
        ("fr_FR", "1 234,5", 1234.5),
    ],
)
def test_locale_number(spark, locale, text, number):
    assert column(spark, locale_number(F.col("v"), locale), [text]) == [number]


def test_number_prefix_is_an_option(spark):
    found = column(spark, locale_number(F.col("v"), "en", prefix=True), ["12abc", "2019-01-01", "x1"])
    assert found == [12.0, 2019.0, None]


def test_literal_number_needs_the_whole_form(spark):
    assert column(spark, literal_number(F.col("v")), ["1e3", "12abc", "-0.5"]) == [1000.0, None, -0.5]


def test_segment_sides_and_infinity(spark):
    cuts = [(1.0, 0), (1.0, 1), (2.0, 0)]
    labels = [F.lit(x) for x in ("below", "one", "between", "above")]
    values = [-math.inf, 0.9, 1.0, 1.5, 2.0, math.inf]
    found = column(spark, segment(F.col("v"), cuts, labels), values, "double")
    assert found == ["below", "below", "one", "between", "above", "above"]


def test_segment_of_a_thousand_bins(spark):
    cuts = [(float(i), 0) for i in range(1, 1000)]
    labels = [F.lit(i) for i in range(1000)]
    assert column(spark, segment(F.col("v"), cuts, labels), [0.0, 1.0, 499.5, 1e9], "double") == [0, 1, 499, 999]


def test_interval_label_rounds_half_up(spark):
    label = interval_label(F.col("v"), F.lit(2.0), F.lit(True), F.lit(False))
    assert column(spark, label, [-2.5, 1.00000049, -math.inf], "double") == [
        "[-2.5,2.0)",
        "[1.0,2.0)",
        "[-Infinity,2.0)",
    ]


def test_min_count_has_no_float_drift():
    assert min_count(0.07, 100) == 7
    assert min_count(0.01, 15001) == 151
    assert min_count(0.5, 0) == 1


@pytest.mark.parametrize(
    "bad",
    [
        Equidistant(1, "x", 1, bins=0),
        Equidistant(1, "x", 1, bins=1001),
        Equidistant(1, "", 1, bins=5),
        Equidistant(1, "x" * 256, 1, bins=5),
        Equisized(1, "x", 1, support=0.001),
        Interval(Border(1.0, False), Border(1.0)),
        Interval(Border(2.0), Border(1.0)),
        MiningTask(limit=0, min_confidence=0.5, min_support=0.5, max_length=3),
        MiningTask(limit=1, min_confidence=0.0001, min_support=0.5, max_length=3),
        MiningTask(limit=1, min_confidence=0.5, min_support=0.5, min_length=4, max_length=3),
        MiningTask(limit=1, auto=True),
        MiningTask(limit=1, auto=True, consequent=AllOf(1) | AllOf(2)),
    ],
)
def test_checks_reject(bad):
    with pytest.raises(ValueError):
        bad.check()


def test_length_bound():
    task = MiningTask(limit=1, min_confidence=0.5, min_support=0.5, max_length=9)
    assert task.length_bound(4) == 4
    both = MiningTask(limit=1, max_length=9, antecedent=AllOf(1) & AllOf(2), consequent=AllOf(3))
    assert both.length_bound(7) == 3
