"""Mixing sources to target weights by repetition rates.

Words are added up per source, targets are derived from weights, and a document of a source
with rate r is taken floor(r) times, plus once more with the probability of the fraction,
decided by a hash of its id, so reruns agree.

Targets share the total by weight, but stop at a multiple of the source's own size; what
exceeds it is shared again among the others by weight, until no target is above.  The
rounds add up a small table with a row per source; only totals come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.texts import WHITE, text_of
from itemloom.runtime import materialize, number_rows

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
UNIT = 1 << 32
SALTS = 16  # parts a source is dealt to when the table of sources is not small


def word_count(text: str = "text") -> Column:
    """Words of a text: the parts between white space, without empty ones at either end."""
    value = text_of(text)
    ends = F.when(value.rlike(f"\\A{WHITE}"), 1).otherwise(0) + F.when(value.rlike(f"{WHITE}\\z"), 1).otherwise(0)
    return F.when(value == "", 0).otherwise(F.size(F.split(value, WHITE)) - ends).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources are ordered by code point with null last and take the weights in turn.
    """
    # map-side sums first: a source that holds a third of all rows is one row per task
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    placed = number_rows(totals, [F.col("source").asc_nulls_last()], "place", start=0)
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(placed.select("source", "source_size", turn.cast("long").alias("weight")), "mix-weights")
    cap = F.col("source_size") * most
    capped, rest, shares = F.lit(False), 0, 0
    held = -1
    while True:
        sums = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, cap).otherwise(0)).alias("used"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("shares"),
            F.sum(capped.cast("long")).alias("capped"),
        ).first()
        rest, shares = (sums["all"] or 0) - (sums["used"] or 0), sums["shares"] or 0
        if sums["capped"] in (held, None) or not shares:
            break
        held = sums["capped"]
        # exact in whole numbers: the share weight * rest / shares lies above the cap
        wide = F.col("weight").cast("decimal(38,0)")
        capped = wide * F.lit(rest).cast("decimal(20,0)") > cap.cast("decimal(24,0)") * F.lit(shares).cast("decimal(12,0)")
    share = F.col("weight") * F.lit(rest).cast("double") / F.lit(max(1, shares)).cast("double")
    target = F.when(capped, cap.cast("double")).otherwise(share)
    return table.select("source", "source_size", F.least(target, cap.cast("double")).alias("target"))


def repetitions(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies.

    ``copies`` is floor(rate) plus one with the fraction's probability, the rate being target
    over source size.  A null text has size 0; a null source is a source of its own, last in
    order; rows of one id share their chance; a source without words has rate 0.  Other
    columns are ignored.
    """
    sizes = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")
        ),
        "mix-sizes",
    )
    found = _with_copies(sizes, source_targets(sizes, weights, most), seed)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken."""
    sizes = docs.select(F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    packed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    found = _with_copies(packed, source_targets(sizes, weights, most), seed).where("copies > 0")
    return found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def _with_copies(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Add source_size, target and copies to rows with doc_id and source.

    A small table of sources is sent to every task; a large one meets the rows by source and
    salt, so a source that holds a third of all rows is spread.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    salted = targets.withColumnRenamed("source", "of").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted, dealt["source"].eqNullSafe(salted["of"]) & (dealt["salt"] == salted["part"]))
    digest = F.md5(F.concat(key, F.lit(":" + seed)).cast("binary"))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(UNIT))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = unit < F.col("rate") - F.floor("rate")
    return joined.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + more.cast("long")).cast("long"))
