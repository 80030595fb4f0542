"""Readable rules and the element tables of an exported rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named_items(item_values: DataFrame, names: DataFrame) -> DataFrame:
    named = item_values.join(names, "attribute")
    return named.selectExpr("item", "name", "value", "concat(name, '(', value, ')') AS text")


def side_texts(rules: DataFrame, item_values: DataFrame, names: DataFrame) -> DataFrame:
    """The text of every distinct rule side: ``side, text``."""
    sides = rules.selectExpr("explode(array(antecedent, consequent)) AS side").distinct()
    return (
        sides.selectExpr("side", "posexplode(side) AS (at, item)")
        .join(_named_items(item_values, names), "item")
        .groupBy("side")
        .agg(F.expr("array_join(transform(sort_array(collect_list(struct(at, text))), p -> p.text), ' & ') AS text"))
    )


def rule_text(rules: DataFrame, item_values: DataFrame, names: DataFrame) -> DataFrame:
    """``text`` like ``a(x) & b(y) → c(z)``; ``*`` stands for an empty left side."""
    texts = side_texts(rules, item_values, names)
    left = texts.selectExpr("side AS antecedent", "text AS _left")
    right = texts.selectExpr("side AS consequent", "text AS _right")
    return (
        rules.join(left, "antecedent", "left")
        .join(right, "consequent")
        .selectExpr(*rules.columns, "concat(coalesce(_left, '*'), ' → ', _right) AS text")
    )


def rule_items(rules: DataFrame, item_values: DataFrame, names: DataFrame) -> DataFrame:
    """The basic items a rule set uses: ``item, text, name, value``."""
    used = rules.select(F.explode(F.concat("antecedent", "consequent")).alias("item")).distinct()
    return used.join(_named_items(item_values, names), "item").select("item", "text", "name", "value")


def cedent_id(items: Column) -> Column:
    """Id of a rule side from its item ids: BBA for one item, DBA for several."""
    kind = F.when(F.size(items) == 1, F.lit("BBA")).otherwise(F.lit("DBA"))
    return F.concat(kind, F.array_join(items.cast("array<string>"), "_"))


def rule_cedents(rules: DataFrame) -> DataFrame:
    """Compound sides and their prefixes of two or more items, each with its two children."""
    sides = rules.select(F.explode(F.array("antecedent", "consequent")).alias("side"))
    prefixes = sides.where(F.size("side") >= 2).select(
        F.explode(
            F.transform(F.sequence(F.lit(2), F.size("side")), lambda i: F.slice("side", F.lit(1), i))
        ).alias("items")
    )
    items, size = F.col("items"), F.size("items")
    return prefixes.distinct().select(
        cedent_id(items).alias("cedent"),
        "items",
        cedent_id(F.slice(items, F.lit(1), size - 1)).alias("first_child"),
        cedent_id(F.slice(items, size, F.lit(1))).alias("second_child"),
    )
