"""Transactions and frequent itemsets.

Equal transactions are counted once with a weight, which for recoded tables
shrinks the input to the number of distinct item combinations.  Itemsets grow one
item at a time inside each transaction: a row carries the itemset reached so far
and the items that may still follow, so a level needs no join between rows of a
transaction, only a lookup of the itemsets just found and one partially
pre-aggregated count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.model import min_count
from itemloom.runtime import materialize, union_all

# A transaction is spread over rows that are each responsible for so many first items.
SLICE = 256

ROOT = -1  # id of the empty itemset

# Counters that pairs of items are hashed to before they are counted one by one.
PAIR_COUNTERS = 1 << 22


def transactions(item_instances: DataFrame, distinct: bool = False) -> DataFrame:
    """The set of items of each id, sorted; ids without items do not occur.

    Duplicates are removed before rows of an id meet, so an id that owns a large
    share of all rows arrives with no more rows than it has different items.
    """
    pairs = item_instances.select("id", "item")
    if not distinct:
        pairs = pairs.distinct()
    return pairs.groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))


def max_transaction_length(item_instances: DataFrame) -> DataFrame:
    """The most items an id has; counted, so no list of them is made."""
    sizes = item_instances.select("id", "item").distinct().groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return sizes.agg(F.max("size").alias("max_length"))


def weighted(tx: DataFrame) -> DataFrame:
    """Distinct transactions with their number of occurrences."""
    return tx.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def weighted_columns(
    rows: DataFrame, columns: list[tuple[int, str]], class_attribute: int | None = None
) -> DataFrame:
    """The same from rows with an item column per attribute.

    Rows are counted by those columns, before any array is made.  With a
    ``class_attribute`` its item is also given as ``labels``.
    """
    counted = rows.groupBy(*[name for _, name in columns]).agg(F.count(F.lit(1)).alias("weight"))

    def present(names: list[str]) -> Column:
        return F.sort_array(F.array_compact(F.array(*names)))

    chosen = [present([name for _, name in columns]).alias("items")]
    if class_attribute is not None:
        chosen.append(present([name for a, name in columns if a == class_attribute]).alias("labels"))
    return counted.select(*chosen, "weight")


def spread(baskets: DataFrame) -> DataFrame:
    """Add ``first``/``last``: the positions of first items a row is responsible for.

    A transaction is repeated per slice and the slices are dealt anew, so one long
    transaction is counted by many tasks.
    """
    slices = F.sequence(F.lit(0), F.size("items") - 1, F.lit(SLICE))
    return (
        baskets.where(F.size("items") > 0)
        .select("items", "weight", F.explode(slices).alias("first"))
        .withColumn("last", F.least(F.col("first") + SLICE, F.size("items")))
        .repartition(F.xxhash64("items"), "first")
    )


@dataclass(frozen=True)
class Itemsets:
    """State of a search: the tables of frequent itemsets by size, and where they were found.

    A level table has one row per itemset: ``set_id``, ``prefix`` (id without the
    last item), ``tail`` (id without the first), the last ``item``, the sorted
    ``items``, the ``count``, and ``right_only``, the number of items that may not
    stand on the left of a rule.  ``state`` has a row for every transaction and every
    itemset of the largest size in it: ``set_id``, ``tail``, ``weight``, and ``rest``, the
    items of the transaction that come after.
    """

    n: int
    least: int
    baskets: DataFrame
    levels: tuple[DataFrame, ...]
    state: DataFrame

    def grown(self, level: DataFrame) -> "Itemsets":
        return replace(self, levels=self.levels + (level,), state=_advanced(self.state, level))


def first_level(counts: DataFrame, least: int, sides: DataFrame | None) -> DataFrame:
    """Frequent single items.  ``sides`` gives ``item, can_lhs, can_rhs``; without it all sides are open."""
    frequent = counts.where(f"count >= {least}")
    if sides is None:
        frequent = frequent.selectExpr("*", "true AS can_lhs", "true AS can_rhs")
    else:
        frequent = frequent.join(sides, "item")
    return frequent.selectExpr(
        "item AS set_id",
        f"{ROOT}L AS prefix",
        f"{ROOT}L AS tail",
        "item",
        "array(item) AS items",
        "count",
        "CAST(NOT can_lhs AS INT) AS right_only",
        "can_rhs",
    )


def begin(n: int, least: int, level: DataFrame, baskets: DataFrame) -> Itemsets:
    """A search from its first level and its weighted transactions."""
    written = materialize(spread(baskets), "baskets")
    # the transactions hold frequent items only, and a single item is its own set id
    singles = written.selectExpr("items", "weight", "first", "last", "posexplode(items) AS (pos, set_id)").where(
        "pos >= first AND pos < last"
    )
    state = singles.selectExpr("set_id", f"{ROOT}L AS tail", "weight", "slice(items, pos + 2, size(items)) AS rest")
    return Itemsets(n, least, written, (level,), state)


def start_search(item_instances: DataFrame, min_support: float, sides: DataFrame | None = None) -> Itemsets:
    """Begin from narrow instances; duplicates of an (id, item) pair count once.

    Items are pruned before the items of an id are brought together, so a
    transaction is never longer than the list of frequent items: at most (mean
    transaction length / support), however many rows one id owns.
    """
    pairs = materialize(item_instances.select("id", "item").distinct(), "pairs")
    n = pairs.select("id").distinct().count()
    least = min_count(min_support, n)
    level = materialize(first_level(pairs.groupBy("item").count(), least, sides), "level-1")
    held = transactions(pairs.join(level.select("item"), "item", "left_semi"), distinct=True)
    return begin(n, least, level, weighted(held))


def _advanced(state: DataFrame, level: DataFrame) -> DataFrame:
    """The state one size up: every itemset followed by each item that makes a frequent one."""
    known = level.selectExpr("prefix AS set_id", "item", "set_id AS _next", "tail AS _tail")
    return (
        state.selectExpr("set_id", "weight", "rest", "posexplode(rest) AS (at, item)")
        .join(known, ["set_id", "item"])
        .selectExpr("_next AS set_id", "_tail AS tail", "weight", "slice(rest, at + 2, size(rest)) AS rest")
    )


def occurrences(search: Itemsets) -> DataFrame:
    """``set_id, tail, item, weight``: each known itemset of a transaction with each item that may follow."""
    return search.state.selectExpr("set_id", "tail", "weight", "explode(rest) AS item")


def _counter() -> Column:
    return F.pmod(F.xxhash64("set_id", "item"), F.lit(PAIR_COUNTERS))


def pair_filter(search: Itemsets) -> DataFrame:
    """One row with a bitmap of the counters that reach the least count.

    Pairs are hashed to a fixed number of counters, whose sums are at least those of any pair
    in them.  A task holds no more than the counters, and the bitmap has one bit for each, so both
    are of one size whatever the number of pairs that occur.
    """
    sums = occurrences(search).groupBy(_counter().alias("at")).agg(F.sum("weight").alias("count"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = sums.where(f"count >= {search.least}").groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(bit).alias("word"))
    every = search.state.sparkSession.range(PAIR_COUNTERS // 64).join(words, "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))))
    return materialize(every.agg(F.transform(listed, lambda w: w["word"]).alias("bits")), "pair-filter")


def candidates(search: Itemsets) -> DataFrame:
    """Occurrences that the next level has to count.

    Of pairs, those in a counter below the least count are left out before they are moved.  With as
    many counters as there are possible pairs or more, the counters would be the counts themselves.
    """
    found = occurrences(search)
    if len(search.levels) > 1:
        return found
    singles = search.levels[0].count()
    if singles * (singles - 1) // 2 <= PAIR_COUNTERS:
        return found
    word = F.get(pair_filter(search).scalar(), F.shiftright(_counter(), 6).cast("int"))
    return found.where(F.getbit(word, (_counter() % 64).cast("int")) == 1)


def next_level(search: Itemsets) -> DataFrame:
    """Frequent itemsets one item larger than the largest known ones.

    A candidate needs both its prefix and its tail to be frequent; at most one of
    its items may be limited to the right side of a rule.
    """
    last, singles = search.levels[-1], search.levels[0]
    tails = last.selectExpr("prefix AS tail", "item", "set_id AS _tail")
    # counted first, so that only sums meet the table of itemsets
    counted = candidates(search).groupBy("set_id", "item", "tail").agg(F.sum("weight").alias("count"))
    counted = counted.where(f"count >= {search.least}").join(tails, ["tail", "item"])
    prefixes = last.selectExpr("set_id", "items", "right_only AS _before")
    added = singles.selectExpr("item", "right_only AS _added")
    return (
        counted.join(prefixes, "set_id")
        .join(added, "item")
        .where("_before + _added <= 1")
        .selectExpr(
            "monotonically_increasing_id() AS set_id",
            "set_id AS prefix",
            "_tail AS tail",
            "item",
            "concat(items, array(item)) AS items",
            "count",
            "_before + _added AS right_only",
        )
    )


def grow(search: Itemsets, max_length: int) -> Iterator[Itemsets]:
    """The search after each further level, until a level is empty or long enough."""
    while (size := len(search.levels)) < max_length:
        if 1 < size < max_length - 1:  # read for this level and again for the next state
            search = replace(search, state=materialize(search.state, f"state-{size}"))
        level = materialize(next_level(search), f"level-{size + 1}")
        if level.isEmpty():
            return
        search = search.grown(level)
        yield search


def frequent_itemsets(item_instances: DataFrame, min_support: float, max_length: int) -> DataFrame:
    """``items, size, count, support`` of all frequent itemsets up to a size."""
    search = start_search(item_instances, min_support)
    for search in grow(search, max_length):
        pass
    return itemset_table(search)


def itemset_table(search: Itemsets) -> DataFrame:
    return union_all([level.select("items", "count") for level in search.levels]).select(
        "items", F.size("items").alias("size"), "count", (F.col("count") / search.n).alias("support")
    )
