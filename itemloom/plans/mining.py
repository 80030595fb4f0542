"""Running a mining task: staged search, rule limit, pruning, automatic thresholds."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.model import MIN_MEASURE, AllOf, MiningTask, StageNote, min_count
from itemloom.operators.attributes import Dataset, item_columns, rows_with_items
from itemloom.operators.cedents import appearance, filter_item_instances, item_filter
from itemloom.operators.classify import Thresholds, cba_prune, labelled_baskets, rank_rules
from itemloom.operators.itemsets import (
    Itemsets,
    begin,
    first_level,
    grow,
    max_transaction_length,
    start_search,
    weighted_columns,
)
from itemloom.operators.rules import association_rules, filter_lift, limit_rules, merge_results, no_rules
from itemloom.operators.thresholds import best_occurring
from itemloom.runtime import Overdue, materialize, run_until

FIRST_STAGE_LENGTH = 3

# The automatic mode tries no confidence below this.
AUTO_CONFIDENCE = 0.1


@dataclass(frozen=True)
class Stage:
    """Rules of one range of lengths; ``found`` counts them before the limit."""

    rules: DataFrame
    shortest: int
    longest: int
    found: int
    notes: tuple[StageNote, ...] = ()


@dataclass(frozen=True)
class MiningResult:
    rules: DataFrame
    notes: tuple[StageNote, ...]


def stage_lengths(shortest: int, longest: int) -> list[tuple[int, int]]:
    """Short rules together, then one length at a time."""
    first = []
    if shortest <= min(FIRST_STAGE_LENGTH, longest):
        first = [(shortest, min(FIRST_STAGE_LENGTH, longest))]
    return first + [(k, k) for k in range(max(shortest, FIRST_STAGE_LENGTH + 1), longest + 1)]


def selected_instances(dataset: Dataset, task: MiningTask) -> DataFrame:
    return filter_item_instances(dataset.item_instances, task.antecedent, task.consequent)


def open_search(dataset: Dataset, task: MiningTask, min_support: float) -> Itemsets:
    """Count transactions and items and get the transactions ready.

    A dataset made from a wide table needs neither a shuffle of its instances nor a
    pass to count items: its dictionary has the frequencies.
    """
    free = task.antecedent is None and task.consequent is None
    sides = None if free else appearance(dataset.item_values, task.antecedent, task.consequent).drop("attribute")
    if dataset.rows is None:
        return start_search(selected_instances(dataset, task), min_support, sides)
    keep = item_filter(task.antecedent, task.consequent)
    n = rows_with_items(dataset.rows, keep).count()
    least = min_count(min_support, n)
    counts = filter_item_instances(dataset.item_values, task.antecedent, task.consequent)
    counts = counts.select("item", F.col("frequency").alias("count"))
    level = materialize(first_level(counts, least, sides), "level-1")
    rows, columns = item_columns(dataset.rows, keep, level)
    return begin(n, least, level, weighted_columns(rows, columns))


def longest_rule(dataset: Dataset, task: MiningTask) -> int:
    """How many items a rule can have.

    An instance of a wide source has one item per attribute, so the attributes of the two
    patterns bound the length.  Elsewhere an instance may have many items of an attribute,
    and only the longest transaction is a bound.
    """
    if dataset.rows is not None:
        return task.length_bound(len(dataset.attributes))
    if task.max_length is not None:
        return task.max_length
    return max_transaction_length(selected_instances(dataset, task)).first()["max_length"] or 0


def _stages(
    search: Itemsets, task: MiningTask, min_confidence: float, lengths: list[tuple[int, int]]
) -> Iterator[tuple[int, int, DataFrame, int]]:
    """Rules of each range of lengths; itemset levels are shared between stages."""
    deeper = grow(search, max((high for _, high in lengths), default=0))
    for low, high in lengths:
        while len(search.levels) < high:
            grown = next(deeper, None)
            if grown is None:
                break
            search = grown
        if len(search.levels) < low:
            return
        rules = filter_lift(association_rules(search, min_confidence, low, high), task.min_lift)
        rules = materialize(rules, "rules")
        yield low, high, rules, rules.count()


def mine_staged(dataset: Dataset, task: MiningTask) -> Iterator[Stage]:
    """Publish rules stage by stage; shorter rules come first and fill the limit first.

    A stage that is not done when the task's time is over is cancelled: it is published without rules and
    with a note, and the stages before it stay as they are.
    """
    task.check()
    spark = dataset.item_values.sparkSession
    deadline = None if task.max_seconds is None else time.monotonic() + task.max_seconds
    published, lengths, found_stages = 0, None, None

    def opened() -> tuple[list[tuple[int, int]], Iterator]:
        ranges = stage_lengths(task.min_length, longest_rule(dataset, task))
        return ranges, _stages(open_search(dataset, task, task.min_support), task, task.min_confidence, ranges)

    for number in itertools.count():
        try:
            if found_stages is None:
                lengths, found_stages = run_until(spark, deadline, opened)
            found_stage = run_until(spark, deadline, lambda: next(found_stages, None))
        except Overdue:
            low, high = lengths[number] if lengths else (task.min_length, task.max_length)
            yield Stage(no_rules(spark), low, high, 0, (StageNote("timeout", high, published),))
            return
        if found_stage is None:
            return
        low, high, rules, found = found_stage
        left, notes = task.limit - published, []
        if found >= task.limit:
            notes.append(StageNote("internallimit", high, found))
        if min(found, task.limit) > left:
            notes.append(StageNote("externallimit", task.max_length, min(found, task.limit) + published))
        kept = limit_rules(rules, left) if found > left else rules
        yield Stage(kept, low, high, found, tuple(notes))
        if notes:
            return
        published += found


def mine_together(dataset: Dataset, task: MiningTask) -> MiningResult:
    """All lengths as one result: search until the limit is reached, then the best rules."""
    bound = longest_rule(dataset, task)
    search = open_search(dataset, task, task.min_support)
    parts, total, notes = [], 0, ()
    for _, high, rules, found in _stages(
        search, task, task.min_confidence, stage_lengths(min(task.min_length, bound), bound)
    ):
        parts.append(rules)
        total += found
        if total >= task.limit:
            notes = (StageNote("internallimit", high, total),)
            break
    rules = merge_results(parts) if parts else association_rules(search, 1.0).limit(0)
    return MiningResult(limit_rules(rules, task.limit) if notes else rules, notes)


def class_baskets(dataset: Dataset, task: MiningTask, rules: DataFrame) -> DataFrame:
    """Distinct transactions, reduced to what ``rules`` can use, with their class labels."""
    (attribute,) = task.consequent.attributes()
    used = rules.select(F.explode("antecedent").alias("item"))
    of_class = dataset.item_values.where(F.col("attribute") == attribute).select("item")
    wanted = used.union(of_class).distinct()
    if dataset.rows is None:
        instances = selected_instances(dataset, task).join(wanted, "item", "left_semi")
        grouped = labelled_baskets(instances, attribute)
    else:
        keep = item_filter(task.antecedent, task.consequent)
        rows, columns = item_columns(dataset.rows, keep, wanted)
        grouped = weighted_columns(rows, columns, attribute).where(F.size("items") > 0)
    grouped = materialize(grouped, "labelled")
    # transactions without any of these items are neither covered nor labelled
    counted = grouped.agg(F.sum("weight").alias("n")).first()["n"] or 0
    one = rules.select("n").first()
    others = 0 if one is None else one["n"] - counted
    if others > 0:
        grouped = grouped.union(grouped.sparkSession.createDataFrame([([], [], others)], grouped.schema))
    return grouped


def mine_auto(dataset: Dataset, task: MiningTask) -> tuple[MiningResult, Thresholds | None]:
    """Rules of the threshold combination that classifies the data best.

    The data are mined once at the lowest thresholds; then every support, confidence and length that
    occurs among those rules is compared.
    """
    task.check()
    if task.antecedent is None:
        # the class is the whole attribute, whichever of its values were named
        (attribute,) = task.consequent.attributes()
        task = replace(task, consequent=AllOf(attribute))
    bound = longest_rule(dataset, task)
    lowest = min(1.0, max(MIN_MEASURE, task.auto_min_rows / max(dataset.size, 1)))
    search = open_search(dataset, task, lowest)
    for search in grow(search, bound):
        pass
    ranked = rank_rules(association_rules(search, AUTO_CONFIDENCE, 1, bound))
    baskets = class_baskets(dataset, task, ranked)
    best = best_occurring(baskets, ranked, bound)
    chosen = best.thresholds if best else None
    if chosen is None:
        return MiningResult(ranked.drop("rank").limit(0), ()), None
    rules = ranked.drop("rank").where(
        (ranked.support >= chosen.min_support)
        & (ranked.confidence >= chosen.min_confidence)
        & (ranked.length <= chosen.max_length)
    )
    if task.prune:
        rules = cba_prune(baskets, rules).drop("rank")
    rules = materialize(rules, "rules")
    found = rules.count()
    if found <= task.limit:
        return MiningResult(rules, ()), chosen
    return MiningResult(limit_rules(rules, task.limit), (StageNote("internallimit", chosen.max_length, found),)), chosen


def mine(dataset: Dataset, task: MiningTask) -> MiningResult:
    """Run a task in the mode it asks for."""
    task.check()
    if task.auto:
        return mine_auto(dataset, task)[0]
    if task.prune:
        result = mine_together(dataset, task)
        found = materialize(result.rules, "limited")
        pruned = cba_prune(class_baskets(dataset, task, found), found).drop("rank")
        return MiningResult(pruned, result.notes)
    stages = list(mine_staged(dataset, task))
    if not stages:
        empty = association_rules(open_search(dataset, task, task.min_support), 1.0).limit(0)
        return MiningResult(empty, ())
    notes = tuple(note for stage in stages for note in stage.notes)
    return MiningResult(merge_results([stage.rules for stage in stages]), notes)
