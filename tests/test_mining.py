import itertools
import random
import threading
import time
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from itemloom.model import AllOf, Field, FieldType, Is, MiningTask, Not, Simple, StageNote, min_count
from itemloom.operators import attributes as attr
from itemloom.operators import cedents, itemsets, rules, wording
from itemloom.plans import mining
from itemloom.runtime import Overdue, run_until
from itemloom.sources.tables import data_source


def random_transactions(seed, n=300, items=12, longest=7):
    rng = random.Random(seed)
    return [sorted(rng.sample(range(1, items + 1), rng.randint(0, longest))) for _ in range(n)]


def as_instances(spark, transactions):
    rows = [(t, i) for t, items in enumerate(transactions) for i in items]
    return spark.createDataFrame(rows, "id long, item long")


def brute_itemsets(transactions, support, longest):
    held = [t for t in transactions if t]
    counts = Counter(c for t in held for k in range(1, longest + 1) for c in itertools.combinations(t, k))
    least = min_count(support, len(held))
    return len(held), {c: n for c, n in counts.items() if n >= least}


def found_itemsets(frame):
    return {tuple(r["items"]): r["count"] for r in frame.collect()}


@pytest.mark.parametrize("seed, support, longest", [(1, 0.05, 3), (2, 0.02, 5), (3, 0.2, 4), (4, 1.0, 3)])
def test_itemsets_equal_enumeration(spark, seed, support, longest):
    data = random_transactions(seed)
    tx = as_instances(spark, data)
    _, expected = brute_itemsets(data, support, longest)
    assert found_itemsets(itemsets.frequent_itemsets(tx, support, longest)) == expected


def test_pairs_are_filtered_before_they_are_counted(spark, monkeypatch):
    """More possible pairs than counters: the same itemsets from a part of the pairs that occur together."""
    rng = random.Random(8)
    data = [sorted(rng.sample(range(1, 121), 14)) for _ in range(500)] + [[1, 2, 3, 4]] * 60 + [[5, 6, 7]] * 50
    tx = as_instances(spark, data)
    search = itemsets.start_search(tx, 0.05)
    occurring = itemsets.occurrences(search).select("set_id", "item").distinct().count()
    assert itemsets.candidates(search).select("set_id", "item").distinct().count() == occurring
    monkeypatch.setattr(itemsets, "PAIR_COUNTERS", 4096)
    counted = itemsets.candidates(search).select("set_id", "item").distinct().count()
    assert 0 < counted < 0.2 * occurring
    _, expected = brute_itemsets(data, 0.05, 4)
    assert found_itemsets(itemsets.frequent_itemsets(tx, 0.05, 4)) == expected
    # the bitmap has one bit for each counter
    assert len(itemsets.pair_filter(search).first()["bits"]) == 4096 // 64


def test_duplicate_rows_count_once(spark):
    instances = as_instances(spark, [[1, 2], [1]])
    doubled = instances.union(instances)
    assert {tuple(r["items"]) for r in itemsets.transactions(doubled).collect()} == {(1, 2), (1,)}
    assert found_itemsets(itemsets.frequent_itemsets(doubled, 0.5, 2)) == {(1,): 2, (2,): 1, (1, 2): 1}


def test_itemsets_equal_the_built_in_search(spark):
    data = [t for t in random_transactions(9, n=500, items=9) if t]
    instances = as_instances(spark, data)
    tx = itemsets.transactions(instances)
    built_in = FPGrowth(itemsCol="items", minSupport=0.04).fit(tx).freqItemsets.collect()
    ours = found_itemsets(itemsets.frequent_itemsets(instances, 0.04, 9))
    assert ours == {tuple(sorted(r["items"])): r["freq"] for r in built_in}


def test_long_transactions_are_spread(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "SLICE", 3)
    data = random_transactions(5, n=120, items=11, longest=11)
    tx = as_instances(spark, data)
    search = itemsets.start_search(tx, 0.1)
    assert search.baskets.where(F.col("first") > 0).count() > 0
    _, expected = brute_itemsets(data, 0.1, 4)
    assert found_itemsets(itemsets.frequent_itemsets(tx, 0.1, 4)) == expected


def test_states_are_written_between_deep_levels(spark):
    data = random_transactions(6)
    _, expected = brute_itemsets(data, 0.03, 6)
    assert found_itemsets(itemsets.frequent_itemsets(as_instances(spark, data), 0.03, 6)) == expected


def test_one_id_with_most_of_the_rows(spark):
    data = random_transactions(7) + [list(range(1, 2000))]
    _, expected = brute_itemsets([[i for i in t if i <= 12] for t in data], 0.05, 3)
    found = found_itemsets(itemsets.frequent_itemsets(as_instances(spark, data), 0.05, 3))
    assert found == expected


def brute_rules(transactions, support, confidence, longest, left=lambda i: True, right=lambda i: True):
    n, sets = brute_itemsets(transactions, support, longest)
    found = {}
    for items, both in sets.items():
        for y in items:
            x = tuple(i for i in items if i != y)
            if not right(y) or not all(left(i) for i in x):
                continue
            n_x = sets[x] if x else n
            if both / n_x >= confidence:
                found[(x, y)] = (both, n_x, sets[(y,)], n)
    return found


def found_rules(frame):
    return {
        (tuple(r["antecedent"]), r["consequent"][0]): (r["n_both"], r["n_left"], r["n_right"], r["n"])
        for r in frame.collect()
    }


@pytest.mark.parametrize(
    "left, right",
    [
        (lambda i: True, lambda i: True),
        (lambda i: i > 3, lambda i: i <= 3),
        (lambda i: True, lambda i: i in (1, 5)),
        (lambda i: i % 2 == 0, lambda i: True),
    ],
)
def test_rules_with_sides(spark, left, right):
    data = random_transactions(11)
    sides = spark.createDataFrame([(i, left(i), right(i)) for i in range(1, 13)], "item long, can_lhs boolean, can_rhs boolean")
    search = itemsets.start_search(as_instances(spark, data), 0.05, sides)
    for search in itemsets.grow(search, 4):
        pass
    found = rules.association_rules(search, 0.4)
    assert found_rules(found) == brute_rules(data, 0.05, 0.4, 4, left, right)


def test_measures_of_a_known_rule(spark):
    """A published example: 72,371 rows, confidence 0.6068, support 0.011344, lift 1.120788."""
    table = spark.createDataFrame([(821, 532, 38361, 32657), (885, 490, 38297, 32699)], "a long, b long, c long, d long")
    measured = rules.measures_from_four_fold(table).orderBy("a").collect()
    assert [round(r["confidence"], 6) for r in measured] == [0.6068, 0.643636]
    assert [round(r["support"], 6) for r in measured] == [0.011344, 0.012229]
    assert [round(r["lift"], 6) for r in measured] == [1.120788, 1.188827]
    back = rules.four_fold_from_measures(rules.measures_from_four_fold(table).drop(*"abcd"), 72371)
    assert sorted(tuple(r[x] for x in "abcd") for r in back.collect()) == [
        (821, 532, 38361, 32657),
        (885, 490, 38297, 32699),
    ]


# -- tasks --------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        a = rng.choice(["x", "y", None])
        b = "p" if a == "x" and rng.random() < 0.8 else rng.choice(["p", "q"])
        c = {"p": "u", "q": "v"}[b] if rng.random() < 0.7 else rng.choice(["u", "v", "w"])
        d = rng.choice(["k", "l", None])
        rows.append((i, a, b, c, d))
    return rows


@pytest.fixture(scope="module")
def dataset(spark, table):
    wide = spark.createDataFrame(table, "id long, a string, b string, c string, d string")
    fields = [Field(i, n, FieldType.NOMINAL) for i, n in enumerate("abcd", 1)]
    return attr.build_attributes(data_source(wide, fields), [Simple(i, n, i) for i, n in enumerate("abcd", 1)])


def narrow_only(dataset):
    return attr.Dataset(dataset.attributes, dataset.item_values, dataset.item_instances, dataset.source)


def task(**changes):
    base = dict(limit=10_000, min_confidence=0.3, min_support=0.02, max_length=4)
    return MiningTask(**{**base, **changes})


@pytest.mark.parametrize(
    "patterns",
    [
        {},
        {"antecedent": AllOf(1) | AllOf(4), "consequent": AllOf(3)},
        {"antecedent": Not(AllOf(3))},
        {"consequent": Not(Is(3, 5))},
        {"antecedent": Is(1, 1) & Is(4, 8), "consequent": Is(3, 5)},
    ],
)
def test_wide_and_narrow_searches_agree(dataset, patterns):
    wide = mining.mine(dataset, task(**patterns))
    narrow = mining.mine(narrow_only(dataset), task(**patterns))
    assert found_rules(wide.rules) == found_rules(narrow.rules)
    assert found_rules(wide.rules)


def test_transactions_without_selected_items_do_not_count(dataset, table):
    selected = task(antecedent=AllOf(1), consequent=AllOf(4))
    result = mining.mine(dataset, selected)
    n = sum(1 for _, a, _, _, d in table if a or d)
    assert {r["n"] for r in result.rules.collect()} == {n}
    assert n < dataset.size


def test_a_conjunction_selects_the_items_of_both_parts(dataset):
    both = cedents.select_items(dataset.item_values, AllOf(1) & AllOf(2))
    either = cedents.select_items(dataset.item_values, AllOf(1) | AllOf(2))
    assert sorted(both.collect()) == sorted(either.collect())
    assert both.count() == 4


def test_stages(dataset):
    stages = list(mining.mine_staged(dataset, task()))
    assert [(s.shortest, s.longest) for s in stages] == [(1, 3), (4, 4)]
    assert {r["length"] for r in stages[1].rules.collect()} == {4}
    assert not any(s.notes for s in stages)
    assert mining.stage_lengths(2, 6) == [(2, 3), (4, 4), (5, 5), (6, 6)]
    assert mining.stage_lengths(5, 6) == [(5, 5), (6, 6)]
    assert mining.stage_lengths(1, 2) == [(1, 2)]


def test_short_rules_fill_the_limit_first(dataset):
    first, second = mining.mine_staged(dataset, task())
    limit = first.found + 3
    result = mining.mine(dataset, task(limit=limit))
    lengths = [r["length"] for r in result.rules.collect()]
    assert len(lengths) == limit and lengths.count(4) == 3
    assert [n.kind for n in result.notes] == ["externallimit"]
    kept = found_rules(result.rules.where("length = 4"))
    assert kept == found_rules(rules.limit_rules(second.rules, 3))


def test_limit_inside_a_stage(dataset):
    result = mining.mine(dataset, task(limit=5))
    ranked = sorted((-r["confidence"], -r["support"]) for r in mining.mine(dataset, task(max_length=3)).rules.collect())
    assert sorted((-r["confidence"], -r["support"]) for r in result.rules.collect()) == ranked[:5]
    assert [n.kind for n in result.notes] == ["internallimit"]


def test_lengths_and_lift(dataset):
    result = mining.mine(dataset, task(min_length=2, max_length=3, min_lift=1.1))
    found = result.rules.collect()
    assert found and all(2 <= r["length"] <= 3 and r["lift"] >= 1.1 for r in found)
    assert mining.mine(dataset, task(min_length=9, max_length=9)).rules.count() == 0


def test_texts_and_elements(spark, dataset, tmp_path):
    from itemloom.sources.export import write_rules_xml

    found = mining.mine(dataset, task(consequent=AllOf(3))).rules
    worded = wording.rule_text(found, dataset.item_values, dataset.names()).collect()
    texts = {r["text"] for r in worded}
    assert len(texts) == found.count()
    assert "* → c(u)" in texts
    assert any(t.startswith("a(x) & b(p) → c(u)") for t in texts)
    cedents_found = wording.rule_cedents(found).collect()
    sides = {tuple(r["antecedent"]) for r in found.collect()}
    expected = {s[:k] for s in sides for k in range(2, len(s) + 1)}
    assert {tuple(r["items"]) for r in cedents_found} == expected
    assert len({r["cedent"] for r in cedents_found}) == len(expected)
    path = str(tmp_path / "out")
    write_rules_xml(found, dataset.item_values, dataset.names(), path)
    basic = spark.read.format("xml").option("rowTag", "BBA").load(f"{path}/BBA")
    assert basic.count() == wording.rule_items(found, dataset.item_values, dataset.names()).count()
    compound = spark.read.format("xml").option("rowTag", "DBA").load(f"{path}/DBA")
    assert {len(r["BARef"]) for r in compound.collect()} == {2}
    listed = spark.read.format("xml").option("rowTag", "AssociationRule").load(f"{path}/AssociationRule")
    assert listed.where("_antecedent IS NULL").count() == found.where("length = 1").count()


# -- time limit -----------------------------------------------------------------


def attribute_dataset(spark, rows=400, attributes=6):
    make = random.Random(3)
    names = [f"a{i}" for i in range(attributes)]
    data = [(i, *[make.choice("xyz") for _ in names]) for i in range(rows)]
    wide = spark.createDataFrame(data, f"id long, {', '.join(f'{n} string' for n in names)}")
    fields = [Field(i, n, FieldType.NOMINAL) for i, n in enumerate(names, 1)]
    return attr.build_attributes(data_source(wide, fields), [Simple(i, n, i) for i, n in enumerate(names, 1)])


def test_a_stage_over_the_time_limit_is_cancelled(spark, monkeypatch):
    """Stage 1 is whole and stage 2, stopped inside a running Spark job, is published as a note."""
    dataset = attribute_dataset(spark)
    task = MiningTask(limit=10_000, min_confidence=0.01, min_support=0.01, max_length=5)
    unhurried = list(mining.mine_staged(dataset, task))
    assert [(s.shortest, s.longest) for s in unhurried] == [(1, 3), (4, 4), (5, 5)] and not any(s.notes for s in unhurried)

    real, started = itemsets.next_level, []

    def slow_at_four(search):
        if len(search.levels) < 3:
            return real(search)
        started.append(time.monotonic())
        wait = F.udf(lambda x: (time.sleep(60), x)[1], "long")
        return real(search).withColumn("count", wait("count"))

    monkeypatch.setattr(itemsets, "next_level", slow_at_four)
    # the deadline is set once the slow stage has begun
    monkeypatch.setattr(mining, "run_until", lambda s, d, work: run_until(s, time.monotonic() + (3 if len(ready) else 600), work))
    stages, ready = [], []
    for stage in mining.mine_staged(dataset, replace(task, max_seconds=600)):
        stages.append(stage)
        ready.append(True)
    assert started and time.monotonic() - started[0] < 45
    first, second = stages
    assert sorted(map(repr, first.rules.collect())) == sorted(map(repr, unhurried[0].rules.collect()))
    assert (second.shortest, second.longest, second.found) == (4, 4, 0)
    assert second.notes == (StageNote("timeout", 4, first.found),)
    assert second.rules.columns == first.rules.columns and second.rules.count() == 0
    # nothing of the cancelled stage is still running, and the session works
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    monkeypatch.undo()
    assert mining.mine(dataset, replace(task, max_seconds=600)).rules.count() == sum(s.found for s in unhurried)


def test_no_time_at_all_gives_a_note_only(spark):
    dataset = attribute_dataset(spark, rows=20, attributes=3)
    task = MiningTask(limit=10, min_confidence=0.1, min_support=0.1, max_length=3, max_seconds=1e-6)
    result = mining.mine(dataset, task)
    assert result.rules.count() == 0 and result.notes == (StageNote("timeout", 3, 0),)
    with pytest.raises(ValueError):
        replace(task, max_seconds=0).check()


def test_only_the_own_jobs_are_cancelled(spark):
    """A job of another thread goes on while tagged work is stopped; errors of the work come through."""
    other = {}
    slow = F.udf(lambda x: (time.sleep(0.05), x)[1], "long")

    def apart():
        other["sum"] = spark.range(0, 64, 1, 4).select(slow("id").alias("id")).agg(F.sum("id")).first()[0]

    thread = threading.Thread(target=apart)
    thread.start()
    endless = F.udf(lambda x: (time.sleep(60), x)[1], "long")
    with pytest.raises(Overdue):
        run_until(spark, time.monotonic() + 0.5, lambda: spark.range(4).select(endless("id")).collect())
    thread.join()
    assert other["sum"] == 2016
    with pytest.raises(ZeroDivisionError):
        run_until(spark, time.monotonic() + 10, lambda: 1 // 0)
    assert run_until(spark, time.monotonic() + 10, lambda: 7) == run_until(spark, None, lambda: 7) == 7
