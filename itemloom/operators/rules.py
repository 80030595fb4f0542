"""Association rules from frequent itemsets: measures, limits, contingency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions.measures import CONFIDENCE, LIFT, SUPPORT
from itemloom.operators.itemsets import Itemsets
from itemloom.runtime import union_all

def rule_order() -> list:
    """Best rules first; shorter and then smaller item ids settle ties."""
    return [
        F.col("confidence").desc(),
        F.col("support").desc(),
        F.col("length").asc(),
        F.col("antecedent").asc(),
        F.col("consequent").asc(),
    ]


def _rules_of_level(search: Itemsets, size: int) -> DataFrame:
    level, singles = search.levels[size - 1], search.levels[0]
    right = singles.where("can_rhs").selectExpr(
        "item AS right", "count AS n_right", "right_only AS _right_only"
    )
    # an item that may only stand on the right has to be the one that does
    split = (
        level.selectExpr("items", "count AS n_both", "right_only", "explode(items) AS right")
        .join(right, "right")
        .where("right_only = _right_only")
        .selectExpr(
            "array_remove(items, right) AS antecedent", "array(right) AS consequent", "n_both", "n_right"
        )
    )
    if size == 1:
        return split.selectExpr("*", f"{search.n}L AS n_left")
    left = search.levels[size - 2].selectExpr("items AS antecedent", "count AS n_left")
    return split.join(left, "antecedent")


def association_rules(
    search: Itemsets, min_confidence: float, min_length: int = 1, max_length: int | None = None
) -> DataFrame:
    """Rules with one item on the right and any number, also none, on the left."""
    top = len(search.levels) if max_length is None else min(max_length, len(search.levels))
    frames = [_rules_of_level(search, size) for size in range(min_length, top + 1)]
    if not frames:
        frames = [_rules_of_level(search, 1).limit(0)]
    return rule_measures(union_all(frames).selectExpr("*", f"{search.n}L AS n")).where(
        F.col("confidence") >= min_confidence
    )


def rule_measures(rules: DataFrame) -> DataFrame:
    """Support, confidence and lift from the counts of both sides."""
    return rules.selectExpr(
        "antecedent",
        "consequent",
        "size(antecedent) + 1 AS length",
        f"{SUPPORT} AS support",
        f"{CONFIDENCE} AS confidence",
        f"{LIFT} AS lift",
        "n_both",
        "n_left",
        "n_right",
        "n",
    )


def no_rules(spark: SparkSession) -> DataFrame:
    """A result without rules."""
    counts = "n_both long, n_left long, n_right long, n long"
    return rule_measures(spark.createDataFrame([], f"antecedent array<long>, consequent array<long>, {counts}"))


def filter_lift(rules: DataFrame, min_lift: float | None) -> DataFrame:
    return rules if min_lift is None else rules.where(F.col("lift") >= min_lift)


def limit_rules(rules: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` rules."""
    return rules.orderBy(*rule_order()).limit(limit)


def merge_results(parts: Sequence[DataFrame]) -> DataFrame:
    """All rules of several results."""
    return union_all(parts)


def four_fold(rules: DataFrame) -> DataFrame:
    """Exact 4-fold table over the transactions that were mined."""
    return rules.selectExpr(
        "*", "n_both AS a", "n_left - n_both AS b", "n_right - n_both AS c", "n - n_left - n_right + n_both AS d"
    )


def measures_from_four_fold(table: DataFrame) -> DataFrame:
    """Support, confidence and lift back from a 4-fold table."""
    counted = table.drop("support", "confidence", "lift", "n_both", "n_left", "n_right", "n").selectExpr(
        "*", "a AS n_both", "a + b AS n_left", "a + c AS n_right", "a + b + c + d AS n"
    )
    return counted.selectExpr("*", f"{SUPPORT} AS support", f"{CONFIDENCE} AS confidence", f"{LIFT} AS lift")


def four_fold_from_measures(rules: DataFrame, size: int) -> DataFrame:
    """4-fold table rebuilt from the measures and the size of the whole dataset."""
    a = F.rint(F.col("support") * size)
    with_a = rules.withColumn("a", a)
    b = F.rint(F.col("a") / F.col("confidence") - F.col("a"))
    c = F.rint(F.col("confidence") * size / F.col("lift") - F.col("a"))
    return (
        with_a.withColumns({"b": b, "c": c})
        .withColumns({x: F.col(x).cast("long") for x in "abc"})
        .withColumn("d", F.lit(size).cast("long") - F.col("a") - F.col("b") - F.col("c"))
    )
