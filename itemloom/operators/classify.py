"""Rule classifiers: database coverage, error cut and automatic thresholds.

After Liu, Hsu, Ma: Integrating Classification and Association Rule Mining (KDD 1998).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.operators.rules import rule_order
from itemloom.runtime import materialize, number_rows, share_package

PARTS = 16  # ranges of ranks that are walked side by side
NEVER_TAKEN = 1 << 62


def labelled_baskets(item_instances: DataFrame, class_attribute: int) -> DataFrame:
    """Distinct transactions as ``items``, ``labels`` (items of the class attribute), ``weight``."""
    of_class = F.col("attribute") == class_attribute
    grouped = (
        item_instances.select("id", "attribute", "item")
        .distinct()
        .groupBy("id")
        .agg(
            F.sort_array(F.collect_list("item")).alias("items"),
            F.sort_array(F.collect_list(F.when(of_class, F.col("item")))).alias("labels"),
        )
    )
    return grouped.groupBy("items", "labels").agg(F.count(F.lit(1)).alias("weight"))


def keyed_baskets(baskets: DataFrame, ranked: DataFrame) -> DataFrame:
    """Baskets reduced to the items that occur on left sides, counted again, with a key."""
    used = ranked.select(F.explode("antecedent").alias("item")).distinct()
    whole = materialize(baskets.withColumn("key", F.monotonically_increasing_id()), "baskets")
    kept = (
        whole.select("key", F.explode("items").alias("item"))
        .join(used, "item", "left_semi")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("item")).alias("_kept"))
    )
    nothing = F.array().cast(baskets.schema["items"].dataType)
    reduced = whole.drop("items").join(kept, "key", "left").withColumn("items", F.coalesce("_kept", nothing))
    grouped = reduced.groupBy("items", "labels").agg(F.sum("weight").alias("weight"))
    return materialize(grouped.withColumn("key", F.monotonically_increasing_id()), "keyed")


def rank_rules(rules: DataFrame) -> DataFrame:
    """Rules with ``rank`` 1, 2, …: confidence, support, brevity, then items."""
    return materialize(number_rows(rules, rule_order(), "rank"), "ranked")


def held_pairs(baskets: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every basket paired with each rule whose left side has items and is held, and whether the rule is right.

    A rule is looked up by the rarest item of its left side and then checked in full.
    """
    right = F.element_at("consequent", 1).alias("right")
    entries = baskets.withColumn("anchor", F.explode("items"))
    counts = entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        ranked.select("rank", F.explode("antecedent").alias("anchor"))
        .join(counts, "anchor", "left")
        .groupBy("rank")
        .agg(F.min_by("anchor", F.struct(F.coalesce("_n", F.lit(0)), "anchor")).alias("anchor"))
    )
    anchored = materialize(ranked.join(rarest, "rank").select("rank", "antecedent", right, "anchor"), "anchored")
    held = F.forall("antecedent", lambda item: F.array_contains("items", item))
    named = entries.join(anchored, "anchor").where(held).drop("anchor", "antecedent")
    return named.withColumn("correct", F.array_contains("labels", F.col("right"))).drop("right")


def open_rules(ranked: DataFrame) -> DataFrame:
    """``rank, right`` of the rules that hold for every basket; at most one for each right side."""
    return ranked.where(F.size("antecedent") == 0).select("rank", F.element_at("consequent", 1).alias("right"))


def covering(baskets: DataFrame, ranked: DataFrame) -> DataFrame:
    """The same for all rules; those with an empty left side go to all baskets as one row."""
    listed = open_rules(ranked).agg(F.collect_list(F.struct("rank", "right")).alias("_rules"))
    always = (
        baskets.withColumn("_one", F.lit(1))
        .join(F.broadcast(listed.withColumn("_one", F.lit(1))), "_one")
        .select(*baskets.columns, F.inline("_rules"))
        .withColumn("correct", F.array_contains("labels", F.col("right")))
        .drop("right")
    )
    return held_pairs(baskets, ranked).unionByName(always)


@dataclass(frozen=True)
class Coverage:
    """Baskets by ``key``, the selected rules' ``rank``, and the first selected rule of each covered basket."""

    baskets: DataFrame
    selected: DataFrame
    owned: DataFrame


def cover(baskets: DataFrame, ranked: DataFrame) -> Coverage:
    """Database coverage.

    The sequential definition walks the rules by rank: a rule is selected when a
    transaction it covers and no selected rule has taken yet is classified
    correctly, and then takes all it covers.  Here every round decides many rules
    together: each remaining transaction names its best rule still in question, a
    rule that is named by a transaction it classifies correctly is selected, the
    transactions that name a selected rule are taken, and a rule without any
    correct remaining transaction is dropped.  All state is in written tables.

    Rules with an empty left side take part only at the end: the first of them that has a
    correct transaction left takes all that is left, so no rule after it is selected.
    """
    keyed = keyed_baskets(baskets, ranked)
    live = materialize(held_pairs(keyed.select("key", "items", "labels"), ranked).select("key", "rank", "correct"), "pairs")
    selected, owned = live.select("rank").limit(0), live.limit(0)
    while True:
        best = live.groupBy("key").agg(F.min(F.struct("rank", "correct")).alias("best"))
        heads = materialize(best.select("key", "best.rank", "best.correct"), "heads")
        if heads.isEmpty():
            return _closed(Coverage(keyed, selected, owned), ranked)
        chosen = heads.where("correct").select("rank")
        selected = materialize(selected.union(chosen).distinct(), "selected")
        taken = heads.join(selected, "rank", "left_semi").select("key", "rank", "correct")
        owned = materialize(owned.union(taken), "owned")
        rest = live.join(taken, "key", "left_anti")
        alive = rest.where("correct").select("rank").union(selected).distinct()
        live = materialize(rest.join(alive, "rank", "left_semi").select("key", "rank", "correct"), "live")


def _closed(coverage: Coverage, ranked: DataFrame) -> Coverage:
    """Coverage with the rules that hold for every basket.

    Of each label the transaction taken last, or never, tells which of these rules still finds one.
    """
    owners = coverage.baskets.select("key", "labels").join(coverage.owned.withColumnRenamed("rank", "owner"), "key", "left")
    last = owners.select(F.explode("labels").alias("right"), F.coalesce("owner", F.lit(NEVER_TAKEN)).alias("until"))
    last = last.groupBy("right").agg(F.max("until").alias("until"))
    end = open_rules(ranked).join(last, "right").where("until > rank").orderBy("rank").first()
    if end is None:
        return coverage
    rank, right = F.lit(end["rank"]).cast("long"), end["right"]
    later = F.col("owner").isNull() | (F.col("owner") > rank)
    taken = owners.select(
        "key",
        F.when(later, rank).otherwise(F.col("owner")).alias("rank"),
        F.when(later, F.array_contains("labels", right)).otherwise(F.col("correct")).alias("correct"),
    )
    before = coverage.selected.where(F.col("rank") < rank)
    last_rule = coverage.selected.sparkSession.range(1).select(rank.alias("rank"))
    return Coverage(coverage.baskets, materialize(before.union(last_rule), "selected"), materialize(taken, "owned"))


@dataclass(frozen=True)
class Classifier:
    """Table of the kept ranks, the label for uncovered transactions, and training errors."""

    ranks: DataFrame
    default_label: int | None
    errors: int


def error_curve(coverage: Coverage, parts: int = PARTS) -> DataFrame:
    """Training errors after each selected rule: ``rank, default_label, errors``.

    Rank 0 stands for no rule at all.  Each transaction belongs to its first
    selected rule; what is left gets the most frequent remaining label.  Ranges of ranks are walked
    side by side, each from the sums of those before it, and a rank changes only the
    labels of the transactions it takes.
    """
    baskets = coverage.baskets.select("key", "labels", "weight").join(coverage.owned, "key", "left")
    owned = materialize(
        baskets.groupBy("rank", "correct", "labels").agg(F.sum("weight").alias("weight")), "owned-weights"
    )
    by_label = owned.select("rank", F.explode("labels").alias("label"), "weight")
    # one row for each label of the class
    totals = {r["label"]: r["n"] for r in by_label.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    everything = owned.agg(F.sum("weight").alias("n")).first()["n"]
    taken = owned.where(F.col("rank").isNotNull())
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    wrong = F.when(~F.col("correct"), F.col("weight")).otherwise(0)
    ranks = coverage.selected.union(coverage.selected.sparkSession.range(1).select(F.col("id").alias("rank")))
    changes = (
        taken.select("rank", none.alias("label"), F.col("weight").alias("covered"), wrong.alias("wrong"))
        .unionByName(ranks.select("rank", none.alias("label"), zero.alias("covered"), zero.alias("wrong")))
        .unionByName(
            by_label.where(F.col("rank").isNotNull()).select("rank", "label", F.col("weight").alias("covered"), zero.alias("wrong"))
        )
    )
    sums = [F.sum(c).alias(c) for c in ("covered", "wrong")]
    changes = changes.groupBy("rank", "label").agg(*sums)
    wide = coverage.selected.agg(F.floor(F.coalesce(F.max("rank"), F.lit(0)) / parts) + 1).scalar()
    placed = changes.withColumn("part", F.floor(F.col("rank") / wide).cast("int"))
    later = F.explode(F.sequence(F.col("part") + 1, F.lit(parts - 1))).alias("part")
    before = placed.where(F.col("part") < parts - 1).groupBy("part", "label").agg(*sums).select(later, "label", "covered", "wrong")
    before = before.groupBy("part", "label").agg(*sums).withColumn("rank", none)
    names = ["part", "rank", "label", "covered", "wrong"]
    dealt = placed.select(names).unionByName(before.select(names)).repartition("part")
    ordered = dealt.sortWithinPartitions("part", F.col("rank").asc_nulls_first())
    share_package(ordered.sparkSession)
    return ordered.mapInArrow(_walk(totals, everything), "rank long, default_label long, errors long")


def _walk(totals: dict[int, int], everything: int) -> Callable:
    schema = pa.schema([(name, pa.int64()) for name in ("rank", "default_label", "errors")])

    class Rest:
        """The weight that is left of each label, and in all; the most frequent label is on top of a heap."""

        def __init__(self):
            self.of = dict(totals)
            self.heap = sorted((-n, label) for label, n in totals.items())
            self.covered = self.wrong = 0

        def take(self, label: int | None, covered: int, wrong: int) -> None:
            if label is None:
                self.covered, self.wrong = self.covered + covered, self.wrong + wrong
            else:
                self.of[label] -= covered

        def row(self, rank: int) -> tuple[int, int, int]:
            # what was taken since it was put on the heap makes an entry too good
            while self.of[self.heap[0][1]] != -self.heap[0][0]:
                label = self.heap[0][1]
                heapq.heapreplace(self.heap, (-self.of[label], label))
            rest, label = self.heap[0]
            return rank, label, self.wrong + everything - self.covered + rest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rank, state = None, None, None
        for batch in batches:
            found = []
            columns = [batch.column(n).to_pylist() for n in ("part", "rank", "label", "covered", "wrong")]
            for part, here, *change in zip(*columns):
                if totals and (part, here) != (at, rank) and rank is not None:
                    found.append(state.row(rank))
                if part != at:
                    state = Rest()
                at, rank = part, here
                state.take(*change)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
        if rank is not None and totals:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in state.row(rank)], schema=schema)

    return run


def build_classifier(baskets: DataFrame, ranked: DataFrame) -> Classifier:
    coverage = cover(baskets, ranked)
    # the first minimum among prefixes of at least one rule
    best = error_curve(coverage).where("rank > 0").orderBy("errors", "rank").first()
    if best is None:
        return Classifier(coverage.selected.limit(0), None, 0)
    return Classifier(coverage.selected.where(F.col("rank") <= best["rank"]), best["default_label"], best["errors"])


def cba_prune(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules a classifier keeps, with their rank."""
    ranked = rank_rules(rules)
    return ranked.join(build_classifier(baskets, ranked).ranks, "rank", "left_semi")


# --------------------------------------------------------------------------
# Automatic thresholds


@dataclass(frozen=True)
class Thresholds:
    min_support: float
    min_confidence: float
    max_length: int


def score_thresholds(baskets: DataFrame, ranked: DataFrame, grid: Sequence[Thresholds]) -> DataFrame:
    """Training accuracy and rule count of every threshold combination, in one job.

    A transaction is classified by its best rule within the thresholds, or by the
    most frequent label among the transactions no rule covers.
    """
    spark = ranked.sparkSession
    cells = spark.createDataFrame(
        [(i, g.min_support, g.min_confidence, g.max_length) for i, g in enumerate(grid)],
        "cell int, min_support double, min_confidence double, max_length int",
    )
    allowed = (
        F.when(
            (F.col("support") >= F.lit(g.min_support))
            & (F.col("confidence") >= F.lit(g.min_confidence))
            & (F.col("length") <= F.lit(g.max_length)),
            F.lit(i),
        )
        for i, g in enumerate(grid)
    )
    member = ranked.select("rank", F.array_compact(F.array(*allowed)).alias("cells"))
    counts = member.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("rules"))
    keyed = keyed_baskets(baskets, ranked)
    # rules within the same combinations are one step, of which a basket keeps its best rule
    best = F.min(F.struct("rank", "correct")).alias("first")
    steps = (
        covering(keyed.select("key", "items", "labels"), ranked.select("rank", "antecedent", "consequent"))
        .select("key", "rank", "correct")
        .join(member.where(F.size("cells") > 0), "rank")
        .groupBy("key", "cells")
        .agg(best)
    )
    first = (
        steps.select("key", "first.*", F.explode("cells").alias("cell"))
        .groupBy("key", "cell")
        .agg(best)
        .join(keyed.select("key", "labels", "weight"), "key")
    )
    decided = materialize(
        first.groupBy("cell", "labels", F.col("first.correct").alias("correct")).agg(F.sum("weight").alias("weight")),
        "decided",
    )
    right = decided.groupBy("cell").agg(F.sum(F.when(F.col("correct"), F.col("weight")).otherwise(0)).alias("right"))
    labels = keyed.select(F.explode("labels").alias("label"), "weight")
    totals = labels.groupBy("label").agg(F.sum("weight").alias("total"))
    taken = (
        decided.select("cell", F.explode("labels").alias("label"), "weight")
        .groupBy("cell", "label")
        .agg(F.sum("weight").alias("taken"))
    )
    all_cells = F.array(*[F.lit(i) for i in range(len(grid))])
    by_default = (
        totals.select("label", "total", F.explode(all_cells).alias("cell"))
        .join(taken, ["cell", "label"], "left")
        .groupBy("cell")
        .agg(F.max(F.col("total") - F.coalesce("taken", F.lit(0))).alias("by_default"))
    )
    n = keyed.agg(F.sum("weight").alias("n")).first()["n"]
    return (
        cells.join(counts, "cell", "left")
        .join(right, "cell", "left")
        .join(by_default, "cell", "left")
        .fillna(0, subset=["rules", "right", "by_default"])
        .select(
            "cell",
            "min_support",
            "min_confidence",
            "max_length",
            "rules",
            ((F.col("right") + F.col("by_default")) / F.lit(n)).alias("accuracy"),
        )
    )


def best_thresholds(scores: DataFrame) -> Thresholds | None:
    """Highest accuracy, then fewest rules, then highest thresholds."""
    row = (
        scores.where(F.col("rules") > 0)
        .orderBy(
            F.col("accuracy").desc(),
            "rules",
            F.col("min_confidence").desc(),
            F.col("min_support").desc(),
            "max_length",
        )
        .first()
    )
    return None if row is None else Thresholds(row["min_support"], row["min_confidence"], row["max_length"])
