import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from itemloom.model import AllOf, Field, FieldType, MiningTask, Simple
from itemloom.operators import attributes as attr
from itemloom.operators import classify, thresholds
from itemloom.operators.itemsets import grow
from itemloom.operators.rules import association_rules
from itemloom.plans import mining
from itemloom.sources.tables import data_source

BASKETS = "items array<bigint>, labels array<bigint>, weight bigint"
RANKED = "rank bigint, antecedent array<bigint>, consequent array<bigint>, support double, confidence double, length int"


def sequential(baskets, rules):
    """Database coverage as defined: one rule after the other."""
    live = list(baskets)
    totals = Counter(label for _, labels, w in baskets for label in labels for _ in range(w))
    n = sum(w for _, _, w in baskets)
    chosen, curve, wrong = [], [], 0
    for rank, (left, right) in enumerate(rules, 1):
        taken = [b for b in live if set(left) <= set(b[0])]
        if not any(right in labels for _, labels, _ in taken):
            continue
        live = [b for b in live if not set(left) <= set(b[0])]
        wrong += sum(w for _, labels, w in taken if right not in labels)
        rest = Counter()
        for _, labels, w in live:
            for label in labels:
                rest[label] += w
        top = max(rest.values(), default=0)
        chosen.append(rank)
        curve.append((rank, wrong + sum(w for _, _, w in live) - top))
    assert n and totals
    return chosen, curve


def random_case(seed):
    rng = random.Random(seed)
    baskets = {}
    for _ in range(rng.randint(3, 30)):
        items = tuple(sorted(rng.sample(range(1, 7), rng.randint(0, 5))))
        labels = (rng.choice([101, 102, 103]),) if rng.random() < 0.9 else ()
        baskets[(items, labels)] = rng.randint(1, 9)
    rules = []
    for _ in range(rng.randint(1, 12)):
        rule = (tuple(sorted(rng.sample(range(1, 7), rng.randint(0, 3)))), rng.choice([101, 102, 103]))
        if rule not in rules:
            rules.append(rule)
    return [(list(i), list(l), w) for (i, l), w in baskets.items()], rules


@pytest.mark.parametrize("seed", range(6))
def test_coverage_equals_the_sequential_walk(spark, seed):
    baskets, rules = random_case(seed)
    frame = spark.createDataFrame(baskets, BASKETS)
    ranked = spark.createDataFrame(
        [(r, list(left), [right]) for r, (left, right) in enumerate(rules, 1)],
        "rank bigint, antecedent array<bigint>, consequent array<bigint>",
    )
    chosen, curve = sequential(baskets, rules)
    coverage = classify.cover(frame, ranked)
    assert sorted(r["rank"] for r in coverage.selected.collect()) == chosen
    if chosen:
        found = classify.error_curve(coverage).collect()
        # without any label left the curve has no row to take a default from
        assert [(r["rank"], r["errors"]) for r in sorted(found, key=lambda r: r["rank"]) if r["rank"]] == curve
        best = min(curve, key=lambda c: (c[1], c[0]))
        classifier = classify.build_classifier(frame, ranked)
        assert sorted(r["rank"] for r in classifier.ranks.collect()) == [r for r in chosen if r <= best[0]]
        assert classifier.errors == best[1]


@pytest.fixture(scope="module")
def dataset(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        a, b = rng.choice("xyz"), rng.choice("pq")
        label = ("yes" if a == "x" else "no") if rng.random() < 0.85 else rng.choice(["yes", "no"])
        rows.append((i, a, b, label))
    wide = spark.createDataFrame(rows, "id long, a string, b string, c string")
    fields = [Field(i, n, FieldType.NOMINAL) for i, n in enumerate("abc", 1)]
    return attr.build_attributes(data_source(wide, fields), [Simple(i, n, i) for i, n in enumerate("abc", 1)])


def test_pruned_rules(dataset):
    task = MiningTask(limit=200, min_confidence=0.5, min_support=0.01, max_length=3, consequent=AllOf(3), prune=True)
    pruned = mining.mine(dataset, task).rules
    everything = mining.mine_together(dataset, task).rules
    kept = {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in pruned.collect()}
    assert kept and kept < {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in everything.collect()}
    narrow = attr.Dataset(dataset.attributes, dataset.item_values, dataset.item_instances, dataset.source)
    again = mining.mine(narrow, task).rules
    assert kept == {(tuple(r["antecedent"]), tuple(r["consequent"])) for r in again.collect()}


def test_automatic_thresholds(dataset):
    task = MiningTask(limit=50, auto=True, prune=True, consequent=AllOf(3))
    result, chosen = mining.mine_auto(dataset, task)
    found = result.rules.collect()
    assert found and len(found) <= 50
    assert all(r["confidence"] >= chosen.min_confidence and r["support"] >= chosen.min_support for r in found)
    # the data follow attribute a, so no longer rules are needed
    assert {r["length"] for r in found} <= {1, 2}


def test_scores_equal_direct_classification(spark):
    for seed in range(4):
        baskets, rules = random_case(100 + seed)
        rng = random.Random(seed)
        rows = [
            (r, list(left), [right], rng.choice([0.1, 0.2]), rng.choice([0.4, 0.8]), len(left) + 1)
            for r, (left, right) in enumerate(rules, 1)
        ]
        ranked = spark.createDataFrame(
            rows,
            "rank bigint, antecedent array<bigint>, consequent array<bigint>, "
            "support double, confidence double, length int",
        )
        grid = [classify.Thresholds(s, c, n) for s in (0.1, 0.2) for c in (0.4, 0.8) for n in (2, 4)]
        frame = spark.createDataFrame(baskets, BASKETS)
        scores = classify.score_thresholds(frame, ranked, grid).orderBy("cell").collect()
        n = sum(w for _, _, w in baskets)
        for cell, (limits, row) in enumerate(zip(grid, scores)):
            usable = [
                r for r in rows
                if r[3] >= limits.min_support and r[4] >= limits.min_confidence and r[5] <= limits.max_length
            ]
            right, rest = 0, Counter()
            for items, labels, w in baskets:
                first = next((r for r in usable if set(r[1]) <= set(items)), None)
                if first is None:
                    for label in labels:
                        rest[label] += w
                elif first[2][0] in labels:
                    right += w
            assert row["cell"] == cell and row["rules"] == len(usable)
            assert row["accuracy"] == pytest.approx((right + max(rest.values(), default=0)) / n)


def classified(baskets, rows, least_support, least_confidence, longest):
    """(weight classified rightly, rules within the thresholds), by direct classification."""
    usable = [r for r in rows if r[3] >= least_support and r[4] >= least_confidence and r[5] <= longest]
    right, rest = 0, Counter()
    for items, labels, weight in baskets:
        first = next((r for r in usable if set(r[1]) <= set(items)), None)
        if first is None:
            for label in labels:
                rest[label] += weight
        elif first[2][0] in labels:
            right += weight
    return right + max(rest.values(), default=0), len(usable)


@pytest.mark.parametrize("parts", [1, 4])
def test_best_occurring_thresholds_equal_all_of_them(spark, parts):
    for seed in range(3):
        baskets, rules = random_case(200 + seed)
        rng = random.Random(seed)
        measures = sorted(((rng.randint(1, 6) / 8, rng.randint(1, 9) / 16) for _ in rules), reverse=True)
        rows = [
            (rank, list(left), [right], support, confidence, len(left) + 1)
            for rank, ((left, right), (confidence, support)) in enumerate(zip(rules, measures), 1)
        ]
        ranked = spark.createDataFrame(rows, RANKED)
        longest = rng.randint(2, 4)
        found = thresholds.best_occurring(spark.createDataFrame(baskets, BASKETS), ranked, longest, parts)
        usable = [r for r in rows if r[5] <= longest]
        expected = []
        for s in {r[3] for r in usable}:
            for c in {r[4] for r in usable}:
                for n in range(1, longest + 1):
                    right, count = classified(baskets, rows, s, c, n)
                    if count:
                        expected.append((-right, count, -c, -s, n))
        if not expected:
            assert found is None
            continue
        right, count, c, s, n = min(expected)
        assert found == thresholds.Best(classify.Thresholds(-s, -c, n), -right, count)


def test_no_rules_have_no_thresholds(spark):
    frame = spark.createDataFrame([([1], [9], 2)], BASKETS)
    assert thresholds.best_occurring(frame, spark.createDataFrame([], RANKED), 3) is None


def test_thresholds_are_as_good_as_any_grid(dataset):
    """The optimum over what occurs against the scores of a fixed grid."""
    task = MiningTask(limit=50, auto=True, consequent=AllOf(3))
    search = mining.open_search(dataset, task, 0.001)
    for search in grow(search, 3):
        pass
    ranked = classify.rank_rules(association_rules(search, 0.1, 1, 3))
    baskets = mining.class_baskets(dataset, task, ranked)
    grid = [classify.Thresholds(s, c, n) for s in (0.001, 0.01, 0.1) for c in (0.1, 0.5, 0.7, 0.9) for n in (1, 2, 3)]
    scores = [r["accuracy"] for r in classify.score_thresholds(baskets, ranked, grid).collect()]
    found = thresholds.best_occurring(baskets, ranked, 3)
    assert found.right / dataset.size >= max(scores)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(-1, 2), st.integers(0, 9), st.integers(0, 9), st.integers(0, 2)), min_size=1, max_size=30))
def test_split_tree_equals_trying_every_split(changes):
    tree, totals = thresholds.SplitTree(7, 3), np.array([40, 90, 60])
    right, rules, covered, top = np.zeros(7, int), np.zeros(7, int), np.zeros((3, 7), int), 0
    for change in changes:
        leaf, label, good, weight, count = change
        tree.add(*(np.array([x]) for x in change))
        right[leaf] += good
        rules[leaf] += count
        if label >= 0:
            covered[label, leaf] += weight
        if count:
            top = max(top, leaf + 1)
        splits = [(right[k:].sum() + (totals - covered[:, k:].sum(axis=1)).max(), k, rules[k:].sum()) for k in range(top)]
        expected = max(splits)[:3] if splits else None
        found = tree.split(totals)
        assert (found is None) == (expected is None)
        if found:
            assert found == (expected[0], expected[2], expected[1])


def many_labels(labels):
    """A basket per label, a rule for every tenth, and rules without a left side."""
    baskets = [([i], [100_000 + i], 1 + i % 3) for i in range(labels)]
    rules = [((i,), 100_000 + i) for i in range(0, labels, 10)] + [((), 100_000 + labels + 5), ((), 100_001), ((), 100_002)]
    return baskets, rules


@pytest.mark.parametrize("labels", [60, 10_000])
def test_coverage_with_many_labels(spark, labels):
    """Work follows the transactions a rule takes, not ranks times labels; an open rule ends the walk."""
    baskets, rules = many_labels(labels)
    ranked = spark.createDataFrame(
        [(r, list(left), [right]) for r, (left, right) in enumerate(rules, 1)],
        "rank bigint, antecedent array<bigint>, consequent array<bigint>",
    )
    coverage = classify.cover(spark.createDataFrame(baskets, BASKETS), ranked)
    chosen = sorted(r["rank"] for r in coverage.selected.collect())
    # the first open rule has no transaction of its label, the second takes all the rest
    count = labels // 10
    assert chosen == [*range(1, count + 1), count + 2]
    found = {r["rank"]: (r["default_label"], r["errors"]) for r in classify.error_curve(coverage).collect()}
    left = {right: w for _, (right,), w in baskets}
    total = sum(left.values())
    for rank in [0, 1, 2, 3, count // 2, count]:
        rest = {k: w for k, w in left.items() if (k - 100_000) % 10 or k - 100_000 >= 10 * rank}
        best = max(rest.values())
        assert found[rank] == (min(k for k, w in rest.items() if w == best), sum(rest.values()) - best)
    taken = sum(w for k, w in left.items() if (k - 100_000) % 10)
    assert found[count + 2][1] == taken - left[100_001] and len(found) == count + 2 and total > taken
