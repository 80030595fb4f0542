"""Automatic thresholds: the best of all supports, confidences and lengths that occur.

Rules are ranked by confidence, so at a least support a transaction has one best rule, and it is
classified by that rule for every least confidence up to the rule's, else by the default label.  As
the least support falls the best rule only gets better: the steps of this staircase are all that a
transaction adds.  Steps are summed over all transactions by (support, confidence, label); what is left
has the size of the rule set.  A row of one least support and all confidences is then kept as a
tree of sums, whose root knows the best split into rules above and defaults below; going to the
next support changes the leaves of its steps only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.operators.classify import Thresholds, covering, keyed_baskets
from itemloom.runtime import materialize, number_rows, share_package

PARTS = 16  # parts of the supports, searched side by side for each length
NEVER = -(1 << 60)


@dataclass(frozen=True)
class Best:
    """Thresholds with the weight of rightly classified transactions and the number of rules within them."""

    thresholds: Thresholds
    right: int
    rules: int


class SplitTree:
    """Sums over confidences in rising order, and the best place to split them.

    A leaf has the weight its rules classify rightly, and by label the weight they cover.  At a
    split the leaves from there on are rules; what the others cover gets the most frequent label.
    """

    def __init__(self, leaves: int, labels: int):
        self.size = 1 << max(0, leaves - 1).bit_length()
        self.right = np.zeros(2 * self.size, np.int64)
        self.rules = np.zeros(2 * self.size, np.int64)
        self.covered = np.zeros((labels, 2 * self.size), np.int64)
        self.best = np.full((labels, 2 * self.size), NEVER, np.int64)
        self.open = 0  # leaves up to the highest confidence of a rule; no split lies above

    def add(self, leaf: np.ndarray, label: np.ndarray, right: np.ndarray, covered: np.ndarray, rules: np.ndarray) -> None:
        """Change leaves; a label of -1 stands for none."""
        at = leaf + self.size
        np.add.at(self.right, at, right)
        np.add.at(self.rules, at, rules)
        own = label >= 0
        np.add.at(self.covered, (label[own], at[own]), covered[own])
        highest = int(leaf[rules > 0].max(initial=-1)) + 1
        changed = np.unique(at)
        if highest > self.open:
            changed = np.union1d(changed, np.arange(self.open, highest) + self.size)
            self.open = highest
        usable = changed[changed < self.size + self.open]
        self.best[:, usable] = self.right[usable]
        while len(changed) and changed[0] > 1:
            changed = np.unique(changed >> 1)
            low, high = 2 * changed, 2 * changed + 1
            self.right[changed] = self.right[low] + self.right[high]
            self.rules[changed] = self.rules[low] + self.rules[high]
            self.covered[:, changed] = self.covered[:, low] + self.covered[:, high]
            self.best[:, changed] = np.maximum(self.best[:, low] + self.right[high], self.covered[:, low] + self.best[:, high])

    def split(self, totals: np.ndarray) -> tuple[int, int, int] | None:
        """(weight classified rightly, rules, leaf) of the best split; the highest leaf of equal ones."""
        if not self.open:
            return None
        value = totals - self.covered[:, 1] + self.best[:, 1]
        found = (-1, 0)
        for label in np.flatnonzero(value == value.max()).tolist():
            node = 1
            above = 0
            while node < self.size:
                low, high = 2 * node, 2 * node + 1
                if self.covered[label, low] + self.best[label, high] == self.best[label, node]:
                    node = high
                else:
                    above += int(self.rules[high])
                    node = low
            found = max(found, (node - self.size, above + int(self.rules[node])))
        return int(value.max()), found[1], found[0]


def _steps(baskets: DataFrame, rules: DataFrame, longest: int) -> DataFrame:
    """``max_length, s, c, label, right, covered``: changes of the sums as the least support falls to ``s``."""
    lengths = F.explode(F.sequence("length", F.lit(longest))).alias("max_length")
    pairs = covering(baskets.select("key", "items", "labels"), rules.select("rank", "antecedent", "consequent"))
    held = pairs.select("key", "rank", "correct").join(rules.select("rank", "s", "c", "length"), "rank")
    # of rules that become usable together the first decides
    first = (
        held.select("key", "s", "rank", "correct", "c", lengths)
        .groupBy("key", "max_length", "s")
        .agg(F.min(F.struct("rank", "correct", "c")).alias("first"))
        .select("key", "max_length", "s", "first.*")
    )
    falling = Window.partitionBy("key", "max_length").orderBy(F.desc("s"))
    before = F.min("rank").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    stairs = first.withColumn("before", before).where("before IS NULL OR rank < before").drop("before")
    last = F.lag(F.struct("correct", "c")).over(falling)
    changes = stairs.withColumn("last", last).join(baskets.select("key", "labels", "weight"), "key")
    both = changes.select(
        "max_length",
        "s",
        "labels",
        "weight",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit(1).alias("sign"), F.col("c"), F.col("correct")),
                    F.struct(F.lit(-1).alias("sign"), F.col("last.c").alias("c"), F.col("last.correct").alias("correct")),
                ),
                lambda e: e["c"].isNotNull(),
            )
        ),
    )
    signed = both.withColumn("weight", F.col("sign") * F.col("weight"))
    right = signed.where("correct").select("max_length", "s", "c", F.lit(-1).alias("label"), F.col("weight").alias("right"), F.lit(0).alias("covered"))
    covered = signed.select("max_length", "s", "c", F.explode("labels").alias("label"), F.lit(0).alias("right"), F.col("weight").alias("covered"))
    summed = right.unionByName(covered).groupBy("max_length", "s", "c", "label")
    return summed.agg(F.sum("right").alias("right"), F.sum("covered").alias("covered"))


def _numbered(rules: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a measure with their place in rising order."""
    return materialize(number_rows(rules.select(column).distinct(), [column], name, start=0), f"{column}s")


def best_occurring(baskets: DataFrame, ranked: DataFrame, longest: int, parts: int = PARTS) -> Best | None:
    """The thresholds under which the rules classify most of the training weight rightly.

    All least supports and confidences that some rule has, and all lengths up to ``longest``, are
    compared, so no other thresholds do better.  Of equals: fewest rules, highest confidence,
    highest support, shortest rules.  ``ranked`` has ranks by falling confidence.  None without a rule.
    """
    usable = ranked.where(F.col("length") <= longest)
    supports, confidences = _numbered(usable, "support", "s"), _numbered(usable, "confidence", "c")
    rules = materialize(
        usable.select("rank", "antecedent", "consequent", "length", "support", "confidence")
        .join(supports, "support")
        .join(confidences, "confidence")
        .drop("support", "confidence"),
        "placed-rules",
    )
    size = confidences.count()
    if not size:
        return None
    keyed = keyed_baskets(baskets, ranked)
    steps = materialize(_steps(keyed, rules, longest), "steps")
    labels = keyed.select(F.explode("labels").alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("total"))
    totals = {row["label"]: row["total"] for row in labels.collect()}  # one row for each class label
    counted = rules.select(F.explode(F.sequence("length", F.lit(longest))).alias("max_length"), "s", "c")
    counted = counted.groupBy("max_length", "s", "c").agg(F.count(F.lit(1)).alias("rules"))
    zero = F.lit(0).cast("long")
    changes = steps.withColumn("rules", zero).unionByName(
        counted.select("max_length", "s", "c", F.lit(-1).cast("long").alias("label"), zero.alias("right"), zero.alias("covered"), "rules")
    )
    deep = max(1, -(-supports.count() // parts))
    # rows of the highest supports come first; a part starts from the sums of all parts before it
    placed = changes.withColumn("part", F.floor((supports.agg(F.max("s")).scalar() - F.col("s")) / deep).cast("int"))
    sums = [F.sum(x).alias(x) for x in ("right", "covered", "rules")]
    whole = placed.groupBy("max_length", "part", "c", "label").agg(*sums)
    later = F.explode(F.sequence(F.col("part") + 1, F.lit(parts - 1))).alias("part")
    given = whole.where(F.col("part") < parts - 1).select("max_length", later, "c", "label", "right", "covered", "rules")
    given = given.groupBy("max_length", "part", "c", "label").agg(*sums).withColumn("s", F.lit(None).cast("long"))
    names = ["max_length", "part", "s", "c", "label", "right", "covered", "rules"]
    dealt = placed.select(names).unionByName(given.select(names)).repartition("max_length", "part")
    ordered = dealt.sortWithinPartitions("max_length", "part", F.col("s").desc_nulls_first())
    share_package(ordered.sparkSession)
    found = ordered.mapInArrow(_search(size, totals), "max_length int, s long, c long, right long, rules long")
    shown = found.join(supports, "s").join(confidences, "c")
    best = shown.orderBy(F.desc("right"), "rules", F.desc("confidence"), F.desc("support"), "max_length").first()
    return Best(Thresholds(best["support"], best["confidence"], best["max_length"]), best["right"], best["rules"])


def _search(size: int, totals: dict):
    order = sorted(totals)
    place = {label: i for i, label in enumerate(order)}
    weights = np.array([totals[label] for label in order] or [0], np.int64)
    schema = pa.schema([("max_length", pa.int32()), ("s", pa.int64()), ("c", pa.int64()), ("right", pa.int64()), ("rules", pa.int64())])

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        """The changes of one support after the other, with the length and part they belong to."""
        at, held = None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("max_length", "part", "s", "c", "label", "right", "covered", "rules")]
            for *key, c, label, right, covered, rules in zip(*columns):
                if key != at:
                    if held:
                        yield (*at, held)
                    at, held = key, []
                held.append((c, place.get(label, -1), right, covered, rules))
        if held:
            yield (*at, held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, best = None, None, None
        for length, part, s, changes in groups(batches):
            if (length, part) != at:
                if best is not None:
                    yield _one(best, schema)
                tree, at, best = SplitTree(size, len(weights)), (length, part), None
            tree.add(*(np.array(column, np.int64) for column in zip(*changes)))
            if s is None:
                continue
            found = tree.split(weights)
            if found is not None:
                right, rules, leaf = found
                key = (right, -rules, leaf, s)
                if best is None or key > best[0]:
                    best = (key, length)
        if best is not None:
            yield _one(best, schema)

    return run


def _one(best: tuple, schema: pa.Schema) -> pa.RecordBatch:
    (right, rules, leaf, s), length = best
    return pa.RecordBatch.from_pylist([{"max_length": length, "s": s, "c": leaf, "right": right, "rules": -rules}], schema)
