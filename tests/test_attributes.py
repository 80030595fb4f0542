import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemloom.model import (
    Border,
    Enumeration,
    Equidistant,
    Equifrequent,
    Equisized,
    Field,
    FieldType,
    Interval,
    Intervals,
    Simple,
)
from itemloom.operators import attributes as attr
from itemloom.operators import cuts, profile
from itemloom.operators.cuts import RunningCounts
from itemloom.sources.tables import data_source

NOMINAL, NUMERIC = FieldType.NOMINAL, FieldType.NUMERIC
INF = float("inf")


def source_of(spark, values, kind=NUMERIC, column="double"):
    wide = spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], f"id long, v {column}")
    return data_source(wide, [Field(1, "v", kind)])


def items(dataset):
    found = dataset.item_values.orderBy("item").collect()
    return [(r["item"], r["value"], r["frequency"]) for r in found]


def counted(dataset):
    rows = dataset.item_instances.groupBy("item").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["item"]: r["n"] for r in rows}


def counts_of(pairs, stride=1):
    values, freq = np.array([float(v) for v, _ in pairs]), np.array([f for _, f in pairs])
    below = np.concatenate([[0], np.cumsum(freq)[:-1]])

    def load(blocks):
        return {b: (below[b * stride : (b + 1) * stride], values[b * stride : (b + 1) * stride]) for b in blocks}

    return RunningCounts(len(values), int(freq.sum()), below[::stride], values[::stride], stride, load)


# -- cut points ---------------------------------------------------------------


def test_equal_frequencies_end_nearest_to_the_target():
    # target 5: 4 is as near as 6, so the first bin stays short; then the border moves
    assert cuts.equifrequent_starts(counts_of([(1, 4), (2, 2), (3, 4)]), 2, 10) == [0, 1]
    assert cuts.equifrequent_starts(counts_of([(i, 1) for i in range(9)]), 3, 9) == [0, 3, 6]


def test_every_bin_gets_a_value():
    assert cuts.equifrequent_starts(counts_of([(1, 1), (2, 1), (3, 50)]), 3, 52) == [0, 1, 2]
    assert len(cuts.equifrequent_bins(counts_of([(1, 3), (2, 9)]), 5, 12)) == 2


def test_short_last_bin_joins_its_neighbour():
    assert cuts.equisized_starts(counts_of([(1, 3), (2, 3), (3, 2)]), 3) == [0, 1]
    assert cuts.equisized_starts(counts_of([(1, 1)]), 5) == [0]


def test_smoothing_moves_one_value_to_the_emptier_bin():
    counts = counts_of([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)])
    assert cuts.smoothing_pass(counts, [0, 1], cuts.nearer_to(3)) == [0, 2]
    assert cuts.smooth(counts, [0, 1], cuts.nearer_to(3)) == [0, 3]
    assert cuts.smooth(counts, [0, 5], cuts.nearer_to(3)) == [0, 3]


def test_smoothing_keeps_the_least_frequency():
    counts = counts_of([(1, 4), (2, 4), (3, 1)])
    assert cuts.smooth(counts, [0, 2], cuts.not_below(5)) == [0, 2]
    assert cuts.smooth(counts, [0, 2], cuts.not_below(4)) == [0, 1]


value_counts = st.lists(st.integers(1, 30), min_size=1, max_size=40)


@settings(max_examples=200, deadline=None)
@given(value_counts, st.integers(1, 12), st.integers(0, 40), st.integers(2, 7))
def test_equal_frequency_invariants(freq, bins, missing, stride):
    pairs = list(enumerate(freq))
    size = sum(freq) + missing
    dense, sparse = counts_of(pairs), counts_of(pairs, stride)
    found = cuts.equifrequent_bins(dense, bins, size)
    assert found == cuts.equifrequent_bins(sparse, bins, size)
    assert len(found) == min(bins, len(freq))
    assert sum(f for _, _, f in found) == sum(freq)
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
    starts = cuts.equifrequent_starts(dense, bins, size)
    before = np.diff([dense.mass(s) for s in [*starts, dense.n]])
    assert sum(f * f for _, _, f in found) <= int((before**2).sum())


@settings(max_examples=200, deadline=None)
@given(value_counts, st.integers(1, 60), st.integers(2, 7))
def test_minimum_support_invariants(freq, least, stride):
    pairs = list(enumerate(freq))
    found = cuts.equisized_bins(counts_of(pairs), least)
    assert found == cuts.equisized_bins(counts_of(pairs, stride), least)
    assert sum(f for _, _, f in found) == sum(freq)
    assert len(found) == 1 or all(f >= least for _, _, f in found)


def by_passes(counts, starts, accept):
    """Smoothing as it is defined: one value at a time until a pass moves nothing."""
    while (moved := cuts.smoothing_pass(counts, starts, accept)) != starts:
        starts = moved
    return starts


@settings(max_examples=300, deadline=None)
@given(st.data(), st.lists(st.integers(1, 30), min_size=2, max_size=60), st.integers(2, 7))
def test_jumps_end_where_single_passes_end(data, freq, stride):
    pairs = list(enumerate(freq))
    dense, sparse = counts_of(pairs), counts_of(pairs, stride)
    sparse.most = max(freq)
    borders = data.draw(st.sets(st.integers(1, len(freq) - 1), min_size=1, max_size=10))
    starts = [0, *sorted(borders)]
    for accept in (cuts.nearer_to(data.draw(st.integers(1, 60))), cuts.not_below(data.draw(st.integers(1, 30)))):
        assert cuts.smooth(sparse, starts, accept) == by_passes(dense, starts, accept)


@pytest.mark.parametrize("most", [1, 4])
@pytest.mark.parametrize("missing", [0.1, 0.6])
def test_jumps_over_many_values(most, missing):
    freq = np.random.default_rng(most).integers(1, most + 1, 4_000)
    counts = RunningCounts.of(np.arange(4_000.0), freq)
    size = int(freq.sum() / (1 - missing))
    starts, accept = cuts.equifrequent_starts(counts, 12, size), cuts.nearer_to(math.ceil(size / 12))
    assert cuts.smooth(counts, starts, accept) == by_passes(counts, starts, accept)
    least = int(freq.sum() / 12.6)
    starts, accept = cuts.equisized_starts(counts, least), cuts.not_below(least)
    assert cuts.smooth(counts, starts, accept) == by_passes(counts, starts, accept)


@pytest.mark.parametrize("n", [10_000, 1_000_000])
def test_loads_do_not_grow_with_the_distinct_values(n):
    freq = np.random.default_rng(7).integers(1, 4, n)
    below = np.concatenate([[0], np.cumsum(freq)[:-1]])
    loads = []

    def refine(gaps):
        places = np.concatenate([np.arange(low, high, -(-(high - low) // 65))[1:] for low, high in gaps])
        loads.append(len(places))
        return places, below[places], places.astype(float)

    stride = n // 500
    counts = RunningCounts(n, int(freq.sum()), below[::stride], np.arange(0.0, n, stride), stride, refine=refine, most=3)
    found = cuts.equifrequent_bins(counts, 10, int(freq.sum() * 1.8))
    assert len(found) == 10 and sum(f for _, _, f in found) == freq.sum()
    assert max(loads) <= 64 * 40 and len(loads) <= 60 and sum(loads) <= 25_000


def test_running_counts_over_ranges_and_blocks(spark):
    rng = random.Random(5)
    rows = [(f, str(i), float(i), rng.randint(1, 9)) for f in (1, 2) for i in range(400)]
    rows += [(1, "7.0", 7.0, 5), (1, "none", None, 99)]
    values = spark.createDataFrame(rows, "field int, value_nominal string, value_numeric double, frequency long")
    table = cuts.running_counts_table(values, [1, 2])
    loaded = cuts.load_running_counts(table, [1, 2, 3], entries=50)
    assert sorted(loaded) == [1, 2]
    for field in (1, 2):
        exact: dict[float, int] = {}
        for f, _, v, n in rows:
            if f == field and v is not None:
                exact[v] = exact.get(v, 0) + n
        pairs = sorted(exact.items())
        assert loaded[field].stride == 8
        size = sum(exact.values())
        assert cuts.equifrequent_bins(loaded[field], 9, size) == cuts.equifrequent_bins(counts_of(pairs), 9, size)
        assert cuts.equisized_bins(loaded[field], 77) == cuts.equisized_bins(counts_of(pairs), 77)


# -- building -----------------------------------------------------------------


def test_simple_attribute_of_a_numeric_field_drops_texts(spark):
    source = source_of(spark, ["2", "x", "10", "2", None], NUMERIC, "string")
    dataset = attr.build_attributes(source, [Simple(1, "a", 1)])
    assert items(dataset) == [(1, "10", 1), (2, "2", 2)]
    assert dataset.size == 5


def test_last_bin_wins_and_equal_names_merge(spark):
    source = source_of(spark, ["a", "b", "b", "c", "d"], NOMINAL, "string")
    bins = (("x", ("a", "b")), ("y", ("b", "c")), ("x", ("c",)))
    dataset = attr.build_attributes(source, [Enumeration(1, "e", 1, bins=bins)])
    assert items(dataset) == [(1, "d", 1), (2, "x", 2), (3, "y", 2)]
    assert counted(dataset) == {1: 1, 2: 2, 3: 2}


def test_user_intervals(spark):
    source = source_of(spark, [-5.0, 0.0, 1.0, 2.0, 3.0, 10.0, None])
    bins = (
        ("low", (Interval(Border(-INF), Border(1.0)),)),
        ("point", (Interval(Border(2.0), Border(2.0)), Interval(Border(10.0), Border(INF)))),
        ("open", (Interval(Border(0.0, False), Border(2.0, False)),)),
    )
    dataset = attr.build_attributes(source, [Intervals(1, "i", 1, bins=bins)])
    assert items(dataset) == [(1, "3.0", 1), (2, "low", 2), (3, "open", 1), (4, "point", 2)]
    assert counted(dataset) == {1: 1, 2: 2, 3: 1, 4: 2}


def test_equal_width(spark):
    source = source_of(spark, [0.0, 1.0, 2.0, 9.0, 10.0])
    dataset = attr.build_attributes(source, [Equidistant(1, "w", 1, bins=5)])
    assert items(dataset) == [
        (1, "[0.0,2.0)", 2),
        (2, "[2.0,4.0)", 1),
        (3, "[4.0,6.0)", 0),
        (4, "[6.0,8.0)", 0),
        (5, "[8.0,10.0]", 2),
    ]
    assert counted(dataset) == {1: 2, 2: 1, 5: 2}


def test_constant_field_gives_one_bin(spark):
    source = source_of(spark, [3.0, 3.0])
    specs = [Equidistant(1, "w", 1, bins=5), Equifrequent(2, "f", 1, bins=5), Equisized(3, "s", 1, support=0.4)]
    dataset = attr.build_attributes(source, specs)
    assert [v for _, v, _ in items(dataset)] == ["[3.0,3.0]"] * 3


def test_computed_bins_agree_with_their_instances(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 40), 1) for _ in range(700)] + [None] * 60
    source = source_of(spark, values)
    specs = [
        Equidistant(1, "w", 1, bins=8),
        Equifrequent(2, "f", 1, bins=8),
        Equisized(3, "s", 1, support=0.1),
        Simple(4, "all", 1),
    ]
    dataset = attr.build_attributes(source, specs)
    found, seen = items(dataset), counted(dataset)
    assert {i: f for i, _, f in found if f} == seen
    assert [i for i, _, _ in found] == list(range(1, len(found) + 1))


def test_unusable_specs(spark):
    source = source_of(spark, ["a"], NOMINAL, "string")
    dataset = attr.build_attributes(source, [Simple(1, "a", 1), Simple(2, "b", 9), Equidistant(3, "c", 1, bins=3)])
    assert [a.attribute for a in dataset.attributes] == [1]
    with pytest.raises(ValueError):
        attr.build_attributes(source, [Equidistant(3, "c", 1, bins=3)])


def test_extending_continues_the_ids(spark):
    source = source_of(spark, [1.0, 2.0, 4.0])
    dataset = attr.build_attributes(source, [Simple(1, "a", 1)])
    wider = attr.extend(dataset, [Equidistant(2, "b", 1, bins=2), Simple(3, "c", 1)])
    assert [(i, v) for i, v, _ in items(wider)] == [
        (1, "1.0"), (2, "2.0"), (3, "4.0"),
        (4, "1.0"), (5, "2.0"), (6, "4.0"),
        (7, "[1.0,2.5)"), (8, "[2.5,4.0]"),
    ]
    assert len(wider.rows) == 2


def test_wide_rows_recode_like_narrow_instances(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), rng.choice([None, float(rng.randint(0, 30))])) for i in range(300)]
    wide = spark.createDataFrame(rows, "id long, kind string, v double")
    source = data_source(wide, [Field(1, "kind", NOMINAL), Field(2, "v", NUMERIC)])
    specs = [
        Enumeration(1, "k", 1, bins=(("ab", ("a", "b")),)),
        Intervals(2, "i", 2, bins=(("low", (Interval(Border(0.0), Border(9.0)),)),)),
        Equifrequent(3, "f", 2, bins=4),
        Equidistant(4, "w", 2, bins=4),
    ]
    dataset = attr.build_attributes(source, specs)
    recoded, columns = attr.item_columns(dataset.rows)
    assert [a for a, _ in columns] == [1, 2, 4, 3]
    from_rows = recoded.select(F.explode(F.array_compact(F.array(*[n for _, n in columns]))).alias("item"))
    row_counts = {r["item"]: r["count"] for r in from_rows.groupBy("item").count().collect()}
    assert row_counts == counted(dataset)


# -- profile ------------------------------------------------------------------


def test_histogram_borders(spark):
    values = source_of(spark, [0.0, 1.0, 2.5, 5.0, 10.0, 10.0, None]).values
    found = profile.histogram(values, 1, 4).orderBy("bin").collect()
    assert [r["frequency"] for r in found] == [2, 1, 1, 2]
    open_ends = profile.histogram(values, 1, 4, Border(0.0, False), Border(10.0, False)).orderBy("bin").collect()
    assert [r["frequency"] for r in open_ends] == [1, 1, 1, 0]
    assert [r["from_inclusive"] for r in open_ends] == [False, True, True, True]
    assert not any(r["to_inclusive"] for r in open_ends)


def test_histogram_checks(spark):
    source = source_of(spark, ["a", "b"], NOMINAL, "string")
    assert profile.histogram(source.values, 1, 4).count() == 0
    for bins, low, high in ((1, None, None), (1001, None, None), (4, Border(2.0), Border(2.0))):
        with pytest.raises(ValueError):
            profile.histogram(source.values, 1, bins, low, high)
    constant = source_of(spark, [2.0, 2.0]).values
    with pytest.raises(Exception):
        profile.histogram(constant, 1, 4).collect()


def test_profile_in_one_pass_equals_the_parts(spark):
    source = source_of(spark, ["1", "1.0", "x", None, "3"], NUMERIC, "string")
    fields = spark.createDataFrame([(1, "v", "NUMERIC"), (2, "empty", "NOMINAL")], "field int, name string, type string")
    found = {r["field"]: r.asDict() for r in profile.profile_fields(fields, source.instances).collect()}
    assert (found[1]["support_nominal"], found[1]["support_numeric"]) == (4, 3)
    assert (found[1]["distinct_nominal"], found[1]["distinct_numeric"]) == (4, 3)
    assert math.isclose(found[1]["avg"], 5 / 3)
    assert found[2]["support_nominal"] == 0 and found[2]["min"] is None


def test_equal_width_bins_agree_with_their_borders(spark):
    """Values on borders that the quotient rounds below."""
    source = source_of(spark, [1.0, 2.8, 4.6, 8.2, 10.0])
    found = {(r["from"], r["to"]): r["frequency"] for r in profile.histogram(source.values, 1, 5).collect()}
    for (low, high), n in found.items():
        inside = [v for v in (1.0, 2.8, 4.6, 8.2, 10.0) if low <= v < high or v == high == 10.0]
        assert n == len(inside)


def test_one_field_reads_one_column(spark, tmp_path):
    wide = spark.range(20).selectExpr("id", "cast(id % 3 as string) AS a", "cast(id AS double) AS b", "'x' AS c")
    wide.write.parquet(str(tmp_path / "wide"))
    fields = (Field(1, "a", FieldType.NOMINAL), Field(2, "b", FieldType.NUMERIC), Field(3, "c", FieldType.NOMINAL))
    source = data_source(spark.read.parquet(str(tmp_path / "wide")), fields)
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (source.cells([2]), source.frequencies([2]))]
    assert all("ReadSchema" in p and "a:string" not in p and "c:string" not in p for p in plans)


# -- large dictionaries with frequent values ------------------------------------


@pytest.fixture
def nothing_sent(spark, monkeypatch):
    """No dictionary is small enough for the optimizer to send it; small partitions stay apart."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    monkeypatch.setattr(attr, "SMALL_DICTIONARY", 10)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def largest_share(frame):
    """The largest share of the joined rows in one partition."""
    sizes = [r["n"] for r in frame.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_a_value_on_a_third_of_the_rows(spark, nothing_sent):
    """Rows of the frequent value stay where they are; items are those of the plain join."""
    cells = spark.range(0, 60_000, 1, 8).select(
        "id",
        F.lit(1).alias("field"),
        F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("v"), F.col("id") % 20_000)).alias("value_nominal"),
        F.lit(None).cast("double").alias("value_numeric"),
    )
    source = attr.DataSource([Field(1, "f", NOMINAL)], cells, profile.value_frequencies(cells))
    spec = [Simple(1, "f", 1)]
    made = attr.build_attributes(source, spec)
    names = {r["item"]: r["value"] for r in made.item_values.collect()}
    found = made.item_instances.select("id", "item")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    rows = {r["id"]: names[r["item"]] for r in found.collect()}
    assert rows == {i: "often" if i % 3 == 0 else f"v{i % 20_000}" for i in range(60_000)}
    assert found.count() == 60_000 and largest_share(found) < 0.2
    heavy = attr.heavy_entries(made.item_values, F.col("frequency")).collect()
    assert [r["value"] for r in heavy] == ["often"]


def test_lookups_with_frequent_unknown_and_null_keys(spark, nothing_sent):
    entries = spark.range(1, 5_001).select(
        F.lit(1).alias("attribute"), F.concat(F.lit("v"), "id").alias("value"), F.col("id").alias("item"), F.lit(1).alias("frequency")
    )
    value = (
        F.when(F.col("id") % 4 == 0, "v7").when(F.col("id") % 4 == 1, "unknown").when(F.col("id") % 4 == 2, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id")))
    )
    pairs = spark.range(0, 8_000, 1, 4).select("id", F.lit(1).alias("attribute"), value.alias("value"))
    plain = attr.lookup_items(pairs, entries).select("id", "item")
    spread = attr.lookup_items(pairs, entries, spread=True).select("id", "item")
    assert spread.exceptAll(plain).count() == plain.exceptAll(spread).count() == 0 and spread.count() == 8_000
    assert largest_share(spread) < 0.3
    ids = spread.withColumn("attribute", F.lit(1)).select("id", "attribute", "item")
    texts = attr.lookup_values(ids, entries, spread=True).select("id", "value")
    expected = attr.lookup_values(ids, entries).select("id", "value")
    assert texts.exceptAll(expected).count() == expected.exceptAll(texts).count() == 0
    assert attr.lookup_items(pairs.limit(0), entries, spread=True).collect() == []
