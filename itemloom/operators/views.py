"""Pages, typed views, JSON views and edits of fields and attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.model import MAX_PAGE, require


def _check_page(offset: int, limit: int) -> None:
    require(1 <= limit <= MAX_PAGE, f"a page has 1 to {MAX_PAGE} rows")
    require(offset >= 0, "the offset must not be negative")


def typed_instances(instances: DataFrame, fields: DataFrame) -> DataFrame:
    """Cells as their field's type shows them: text, or text with a number.

    There are few fields, so they are sent to the cells; by key, all cells of a field would meet in a task.
    """
    numeric = F.col("type") == "NUMERIC"
    shown = instances.join(F.broadcast(fields.select("field", "type")), "field").where(
        ~numeric | F.col("value_numeric").isNotNull()
    )
    return shown.select(
        "id",
        "field",
        "value_nominal",
        F.when(numeric, F.col("value_numeric")).alias("value_numeric"),
    )


def instances_page(
    instances: DataFrame, fields: DataFrame, chosen: Sequence[int], offset: int, limit: int
) -> DataFrame:
    """Cells of the chosen fields (none chosen: all) with ids in (offset, offset+limit].

    The window is a range of ids, which prunes files by their statistics.
    """
    _check_page(offset, limit)
    window = instances.where((F.col("id") > offset) & (F.col("id") <= offset + limit))
    if chosen:
        window = window.where(F.col("field").isin(list(chosen)))
    return typed_instances(window, fields)


def aggregated_page(
    instances: DataFrame,
    fields: DataFrame,
    chosen: Sequence[int],
    offset: int,
    limit: int,
    size: int,
) -> DataFrame:
    """One row per id of the window with its cells; an empty array where all are missing."""
    page = instances_page(instances, fields, chosen, offset, limit)
    grouped = page.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("field", "value_nominal", "value_numeric"))).alias("cells")
    )
    ids = instances.sparkSession.range(offset + 1, min(offset + limit, size) + 1)
    empty = F.array().cast(grouped.schema["cells"].dataType)
    return ids.join(grouped, "id", "left").select("id", F.coalesce("cells", empty).alias("cells"))


def values_page(values: DataFrame, fields: DataFrame, field: int, offset: int, limit: int) -> DataFrame:
    """A page of a field's values by number, then text; numeric fields show numbers only."""
    _check_page(offset, limit)
    shown = values.where(F.col("field") == field).join(
        F.broadcast(fields.where(F.col("field") == field).select("field", "type")), "field"
    )
    shown = shown.where((F.col("type") == "NOMINAL") | F.col("value_numeric").isNotNull())
    return (
        shown.select("field", "value_nominal", "value_numeric", "frequency")
        .orderBy(F.col("value_numeric").asc_nulls_first(), "value_nominal")
        .offset(offset)
        .limit(limit)
    )


def items_page(item_values: DataFrame, attribute: int, offset: int, limit: int) -> DataFrame:
    """A page of an attribute's items in the order of their ids."""
    _check_page(offset, limit)
    return (
        item_values.where(F.col("attribute") == attribute).orderBy("item").offset(offset).limit(limit)
    )


def change_field_type(profile: DataFrame, field: int) -> DataFrame:
    """Flip a field's type; to numeric only if it has numbers.  ``changed`` tells what happened."""
    here = F.col("field") == field
    to_nominal = here & (F.col("type") == "NUMERIC")
    to_numeric = here & (F.col("type") == "NOMINAL") & (F.col("support_numeric") > 0)
    flipped = F.when(to_nominal, F.lit("NOMINAL")).when(to_numeric, F.lit("NUMERIC"))
    return profile.withColumn("changed", to_nominal | to_numeric).withColumn(
        "type", F.coalesce(flipped, F.col("type"))
    )


def drop_field(
    fields: DataFrame, instances: DataFrame, values: DataFrame, field: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without a field."""
    keep = F.col("field") != field
    return fields.where(keep), instances.where(keep), values.where(keep)


def drop_attribute(
    attributes: DataFrame, item_instances: DataFrame, item_values: DataFrame, attribute: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without an attribute."""
    keep = F.col("attribute") != attribute
    return attributes.where(keep), item_instances.where(keep), item_values.where(keep)


def values_as_json(values: DataFrame) -> DataFrame:
    """Values as JSON objects; a number shows its original text."""
    shown = F.struct(F.col("value_nominal").alias("value"), F.col("frequency"))
    return values.select("field", F.to_json(shown).alias("json"))


def intervals_as_json(bins: DataFrame) -> DataFrame:
    """Histogram bins as JSON objects; borders of a null bin are null."""
    shown = F.struct(
        F.col("from"),
        F.col("to"),
        F.col("from_inclusive").alias("fromInclusive"),
        F.col("to_inclusive").alias("toInclusive"),
        F.col("frequency"),
    )
    return bins.select("bin", F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))


def instances_as_json(page: DataFrame) -> DataFrame:
    """Aggregated instances as JSON objects with their cells."""
    cells = F.transform(
        "cells",
        lambda c: F.struct(c["field"].alias("field"), c["value_nominal"].alias("value")),
    )
    return page.select("id", F.to_json(F.struct("id", cells.alias("values"))).alias("json"))
