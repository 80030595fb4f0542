"""Rule patterns: which items may stand on which side of a rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.model import AllOf, And, Cedent, Is, Not, Or


def item_predicate(
    cedent: Cedent | None, attribute: Column | None = None, item: Column | None = None
) -> Column:
    """A condition on an item, by default on the columns ``attribute`` and ``item``.

    A cedent names a set of items, so a conjunction names the union of its parts
    just as a disjunction does: an item belongs to one attribute only.
    """
    attribute = F.col("attribute") if attribute is None else attribute
    item = F.col("item") if item is None else item
    match cedent:
        case And(left, right) | Or(left, right):
            return item_predicate(left, attribute, item) | item_predicate(right, attribute, item)
        case Not(operand):
            return ~item_predicate(operand, attribute, item)
        case AllOf(number):
            return attribute == number
        case Is(number, value):
            return (attribute == number) & (item == value)
        case _:
            return F.lit(False)


def select_items(item_values: DataFrame, cedent: Cedent) -> DataFrame:
    return item_values.where(item_predicate(cedent)).select("attribute", "item")


def intersect_items(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, ["attribute", "item"], "left_semi")


def subtract_items(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, ["attribute", "item"], "left_anti")


def side_flags(antecedent: Cedent | None, consequent: Cedent | None) -> tuple[Column, Column]:
    """Conditions on an item for standing left and for standing right."""
    in_left, in_right = item_predicate(antecedent), item_predicate(consequent)
    if antecedent is not None and consequent is not None:
        return in_left | ~in_right, in_right
    if antecedent is not None:
        return in_left, F.lit(True)
    if consequent is not None:
        return F.lit(True), in_right
    return F.lit(True), F.lit(True)


def appearance(item_values: DataFrame, antecedent: Cedent | None, consequent: Cedent | None) -> DataFrame:
    """The sides each item may take, after the item filter of :func:`filter_item_instances`."""
    can_left, can_right = side_flags(antecedent, consequent)
    return filter_item_instances(item_values, antecedent, consequent).select(
        "attribute", "item", can_left.alias("can_lhs"), can_right.alias("can_rhs")
    )


def item_filter(
    antecedent: Cedent | None, consequent: Cedent | None
) -> Callable[[Column, Column], Column] | None:
    """With both sides given only their items take part, otherwise all do (``None``)."""
    if antecedent is None or consequent is None:
        return None
    return lambda attribute, item: item_predicate(antecedent, attribute, item) | item_predicate(
        consequent, attribute, item
    )


def filter_item_instances(items: DataFrame, antecedent: Cedent | None, consequent: Cedent | None) -> DataFrame:
    """The rows of items that take part, see :func:`item_filter`."""
    keep = item_filter(antecedent, consequent)
    return items if keep is None else items.where(keep(F.col("attribute"), F.col("item")))
