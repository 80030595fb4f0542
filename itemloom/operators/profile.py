"""Value frequencies, field statistics and histograms of a narrow data source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.functions.numbers import equal_width_bin
from itemloom.model import MAX_BINS, Border, require


SKETCH_PRECISION = 12  # 1.3 per cent of standard error


def value_frequencies(instances: DataFrame) -> DataFrame:
    """How often each distinct value of a field occurs."""
    return instances.groupBy("field", "value_nominal", "value_numeric").agg(
        F.count(F.lit(1)).alias("frequency")
    )


def field_support(instances: DataFrame) -> DataFrame:
    """Non-missing cells per field, read as text and read as numbers."""
    return instances.groupBy("field").agg(
        F.count(F.lit(1)).alias("support_nominal"),
        F.count("value_numeric").alias("support_numeric"),
    )


def field_cardinality(values: DataFrame) -> DataFrame:
    """Distinct values per field; exact, from the frequency table."""
    return values.groupBy("field").agg(
        F.count(F.lit(1)).alias("distinct_nominal"),
        F.count("value_numeric").alias("distinct_numeric"),
    )


def field_sketches(instances: DataFrame, precision: int = SKETCH_PRECISION) -> DataFrame:
    """``field, nominal, numeric``: a sketch of the distinct texts and of the distinct numbers of each field.

    A sketch has a fixed size, at most 2 ** precision bytes, and sketches of several loads merge, so
    distinct counts of a growing source need no pass over what was loaded before.
    """
    # zero has two signs
    number = (F.col("value_numeric") + F.lit(0.0)).cast("string")
    return instances.groupBy("field").agg(
        F.hll_sketch_agg("value_nominal", precision).alias("nominal"), F.hll_sketch_agg(number, precision).alias("numeric")
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row for each field from the sketches of any number of loads."""
    return sketches.groupBy("field").agg(*[F.hll_union_agg(c).alias(c) for c in ("nominal", "numeric")])


def sketched_cardinality(sketches: DataFrame) -> DataFrame:
    """Estimated distinct values per field; the standard error is about 0.8 / sqrt(2 ** precision)."""
    merged = merge_sketches(sketches)
    return merged.select("field", *[F.hll_sketch_estimate(c).alias(f"distinct_{c}") for c in ("nominal", "numeric")])


def field_stats(instances: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of every field that has a number."""
    return (
        instances.where(F.col("value_numeric").isNotNull())
        .groupBy("field")
        .agg(
            F.min("value_numeric").alias("min"),
            F.max("value_numeric").alias("max"),
            F.avg("value_numeric").alias("avg"),
        )
    )


def data_source_size(wide: DataFrame) -> DataFrame:
    """Number of instances, those without any value included."""
    return wide.agg(F.count(F.lit(1)).alias("size"))


def profile_fields(fields: DataFrame, instances: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """The field table with supports, distinct counts and numeric statistics.

    All counts come from the frequency table, so the cells are read once.
    """
    values = value_frequencies(instances) if values is None else values
    number, weight = F.col("value_numeric"), F.col("frequency")
    numeric_weight = F.sum(F.when(number.isNotNull(), weight))
    summary = values.groupBy("field").agg(
        F.sum(weight).alias("support_nominal"),
        F.coalesce(numeric_weight, F.lit(0)).alias("support_numeric"),
        F.count(F.lit(1)).alias("distinct_nominal"),
        F.count(number).alias("distinct_numeric"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        (F.sum(number * weight) / numeric_weight).alias("avg"),
    )
    counts = ["support_nominal", "support_numeric", "distinct_nominal", "distinct_numeric"]
    return fields.join(summary, "field", "left").fillna(0, subset=counts)


def field_detail(profile: DataFrame) -> DataFrame:
    """Support and distinct count in the reading that the field's type selects."""
    nominal = F.col("type") == "NOMINAL"

    def effective(name: str):
        return F.when(nominal, F.col(f"{name}_nominal")).otherwise(F.col(f"{name}_numeric"))

    return profile.select(
        "field",
        "name",
        "type",
        effective("distinct").alias("unique_values"),
        effective("support").alias("support"),
    )


def numeric_stats(fields: DataFrame, stats: DataFrame, field: int) -> DataFrame:
    """Statistics of one field, empty unless the field is numeric."""
    chosen = fields.where((F.col("field") == field) & (F.col("type") == "NUMERIC"))
    return stats.join(chosen.select("field"), "field", "left_semi")


def histogram(
    values: DataFrame,
    field: int,
    bins: int,
    low: Border | None = None,
    high: Border | None = None,
) -> DataFrame:
    """Equal-width bins over the numbers of a field, empty bins included.

    Missing borders default to the field's minimum and maximum.  The last bin ends
    with the upper border; a field without numbers gives no bins.
    """
    require(2 <= bins <= MAX_BINS, f"the number of bins must be 2 to {MAX_BINS}")
    if low is not None and high is not None:
        require(high.value > low.value, "the upper border must exceed the lower one")
    numbers = values.where((F.col("field") == field) & F.col("value_numeric").isNotNull()).select(
        "field", F.col("value_numeric").alias("_v"), "frequency"
    )
    # one row: the borders and the width
    borders = (
        numbers.groupBy("field")
        .agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        .select(
            "field",
            (F.lit(low.value) if low else F.col("_min")).cast("double").alias("_lo"),
            (F.lit(high.value) if high else F.col("_max")).cast("double").alias("_hi"),
        )
        .withColumn("_width", (F.col("_hi") - F.col("_lo")) / bins)
        .select(
            "field",
            "_lo",
            F.when(F.col("_hi") > F.col("_lo"), F.col("_hi"))
            .otherwise(F.raise_error(F.lit("the upper border must exceed the lower one")).cast("double"))
            .alias("_hi"),
            "_width",
        )
    )
    low_inclusive = low is None or low.inclusive
    high_inclusive = high is None or high.inclusive
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    inside = ((v >= lo) if low_inclusive else (v > lo)) & ((v <= hi) if high_inclusive else (v < hi))
    index = equal_width_bin(v, lo, F.col("_width"), bins)
    counted = (
        numbers.join(F.broadcast(borders), "field")  # borders is a single row
        .where(inside)
        .groupBy(index.alias("bin"))
        .agg(F.sum("frequency").alias("frequency"))
    )
    bin_number = F.col("bin")
    frame = borders.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi", "_width"
    )
    last = bin_number == bins - 1
    return frame.join(counted, "bin", "left").select(
        "bin",
        (lo + bin_number * F.col("_width")).alias("from"),
        F.when(last, hi).otherwise(lo + (bin_number + 1) * F.col("_width")).alias("to"),
        ((bin_number > 0) | F.lit(low_inclusive)).alias("from_inclusive"),
        (last & F.lit(high_inclusive)).alias("to_inclusive"),
        F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"),
    )


def attribute_cardinality(item_values: DataFrame) -> DataFrame:
    """Distinct items per attribute."""
    return item_values.groupBy("attribute").agg(F.count(F.lit(1)).alias("unique_values"))
