"""Attributes: recoding the values of fields into items."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.functions.labels import interval_label
from itemloom.functions.numbers import equal_width_bin, segment
from itemloom.model import (
    AttributeSpec,
    Enumeration,
    Equidistant,
    Equifrequent,
    Equisized,
    Field,
    FieldType,
    Intervals,
    require,
)
from itemloom.operators.cuts import (
    equifrequent_bins,
    equisized_bins,
    load_running_counts,
    merge_cut_points,
    running_counts_table,
)
from itemloom.operators.profile import value_frequencies
from itemloom.runtime import join_spread, materialize, number_rows, union_all
from itemloom.sources.narrow import cell, to_instances

VALUE = ["attribute", "value"]
SMALL_DICTIONARY = 100_000  # entries that are left to the optimizer to send
HEAVY = 1_000  # an entry that owns more than 1 / HEAVY of the rows is heavy, so there are fewer than HEAVY

BIN_SCHEMA = "attribute int, bin int, `from` double, `to` double, frequency long"
BORDER_SCHEMA = (
    "attribute int, bin int, `from` double, `to` double, "
    "from_inclusive boolean, to_inclusive boolean"
)


@dataclass(frozen=True)
class DataSource:
    """A narrow table with its fields.

    ``wide`` is the table it was made from, if it has one row per instance; its
    columns are named like the fields.  ``counted`` is the frequency table, if it has been
    made already.
    """

    fields: tuple[Field, ...]
    instances: DataFrame
    counted: DataFrame | None = None
    wide: DataFrame | None = None
    locale: str = "en"

    @cached_property
    def values(self) -> DataFrame:
        """The frequency table of all fields, written when first asked for."""
        if self.counted is not None:
            return self.counted
        return materialize(value_frequencies(self.instances), "values")

    def cells(self, fields: Sequence[int]) -> DataFrame:
        """The instances of some fields; of a wide table, only their columns are read."""
        if self.wide is None:
            return self.instances.where(F.col("field").isin(list(fields)))
        return to_instances(self.wide, "id", [f for f in self.fields if f.field in fields], self.locale)

    def frequencies(self, fields: Sequence[int]) -> DataFrame:
        """The frequency table of some fields, not written."""
        if self.counted is not None or "values" in self.__dict__:
            return self.values.where(F.col("field").isin(list(fields)))
        return value_frequencies(self.cells(fields))

    def field(self, number: int) -> Field | None:
        return next((f for f in self.fields if f.field == number), None)

    @cached_property
    def size(self) -> int:
        """Number of instances, those without any value included."""
        if self.wide is not None:
            return self.wide.count()
        return self.instances.select("id").distinct().count()


@dataclass(frozen=True)
class Dataset:
    """Recoded data: the item dictionary and the items of each instance.

    ``rows`` recodes a wide source row by row; with it an instance has at most one
    item per attribute, and transactions need no shuffle.
    """

    attributes: tuple[AttributeSpec, ...]
    item_values: DataFrame
    item_instances: DataFrame
    source: DataSource
    rows: tuple["RowRecoder", ...] | None = None

    @property
    def size(self) -> int:
        return self.source.size

    def names(self) -> DataFrame:
        rows = [(a.attribute, a.name) for a in self.attributes]
        return self.item_values.sparkSession.createDataFrame(rows, "attribute int, name string")


def usable_specs(source: DataSource, specs: Sequence[AttributeSpec]) -> list[AttributeSpec]:
    """Specs whose field exists and has a fitting type; it is an error if none is left."""
    kept = []
    for spec in specs:
        spec.check()
        field = source.field(spec.field)
        if field is None or (spec.numeric_only and field.type != FieldType.NUMERIC):
            continue
        kept.append(spec)
    require(len(kept) > 0, "no attribute can be built")
    return kept


# --------------------------------------------------------------------------
# Labelled attributes: simple, enumeration, user intervals


def _interval_name(spec: Intervals, value: Column) -> Column:
    """The name of the last bin that holds the number, else null."""
    borders = sorted(
        {(b.value, side) for _, group in spec.bins for i in group for b in (i.start, i.end) for side in (0, 1)}
    )

    def winner(number: float, just_after: bool) -> str | None:
        for name, group in reversed(spec.bins):
            if any(i.contains(number, just_after) for i in group):
                return name
        return None

    # between two neighbouring cuts nothing changes, so its start decides
    names = [winner(float("-inf"), False)] + [winner(number, side == 1) for number, side in borders]
    return segment(value, borders, [F.lit(n).cast("string") for n in names])


def _label(spec: AttributeSpec, field: Field, text: Column, number: Column) -> Column:
    """The recoded text of a cell before enumerations; numeric fields show only numbers."""
    shown = text if field.type == FieldType.NOMINAL else F.when(number.isNotNull(), text)
    if isinstance(spec, Intervals):
        return F.when(number.isNotNull(), F.coalesce(_interval_name(spec, number), shown))
    return shown


def _renaming(spark, specs: Sequence[AttributeSpec]) -> DataFrame | None:
    """``attribute, value, _name`` of the enumerations; as small as the specification."""
    rows = [(s.attribute, text, name) for s in specs if isinstance(s, Enumeration) for text, name in s.mapping().items()]
    return spark.createDataFrame(rows, "attribute int, value string, _name string") if rows else None


def labelled(cells: DataFrame, source: DataSource, specs: Sequence[AttributeSpec]) -> DataFrame:
    """Cells with ``attribute`` and the recoded ``value``, all attributes in one pass."""
    by_field: dict[int, list[Column]] = {}
    for spec in specs:
        value = _label(spec, source.field(spec.field), F.col("value_nominal"), F.col("value_numeric"))
        by_field.setdefault(spec.field, []).append(
            F.struct(F.lit(spec.attribute).alias("attribute"), value.alias("value"))
        )
    choice = None
    for field, options in by_field.items():
        here = F.col("field") == field
        choice = F.when(here, F.array(*options)) if choice is None else choice.when(here, F.array(*options))
    others = [c for c in cells.columns if c not in ("field", "value_nominal", "value_numeric")]
    rows = cells.where(F.col("field").isin(list(by_field))).select(
        *others, F.inline(choice)
    ).where(F.col("value").isNotNull())
    renamed = _renaming(cells.sparkSession, specs)
    if renamed is not None:
        rows = rows.join(renamed, ["attribute", "value"], "left").select(
            *others, "attribute", F.coalesce("_name", "value").alias("value")
        )
    return rows


def assign_item_ids(values: DataFrame, start: int = 0) -> DataFrame:
    """Dense ids above ``start`` for ``attribute, value, frequency``, by attribute and value."""
    return number_rows(values.select("attribute", "value", "frequency"), ["attribute", "value"], "item", start + 1)


def _fields_of(specs: Sequence[AttributeSpec]) -> list[int]:
    return sorted({s.field for s in specs})


def labelled_items(source: DataSource, specs: Sequence[AttributeSpec], start: int = 0) -> DataFrame:
    counted = (
        labelled(source.frequencies(_fields_of(specs)), source, specs)
        .groupBy("attribute", "value")
        .agg(F.sum("frequency").alias("frequency"))
    )
    return assign_item_ids(counted, start)


def labelled_instances(source: DataSource, specs: Sequence[AttributeSpec], items: DataFrame, size: int = 0) -> DataFrame:
    """Instances joined to their items.

    A small dictionary is sent whole by the optimizer, which knows the written table's size.  Of a
    larger one, of ``size`` entries, only the values that own much of the cells are sent.
    """
    cells = labelled(source.cells(_fields_of(specs)), source, specs)
    entries = items.select("attribute", "value", "item")
    if size <= SMALL_DICTIONARY:
        found = cells.join(entries, VALUE)
    else:
        found = join_spread(cells, entries, VALUE, heavy_entries(items, F.col("frequency")).select(entries.columns))
    return found.select("id", "attribute", "item")


def heavy_entries(entries: DataFrame, rows: Column) -> DataFrame:
    """The fewer than HEAVY entries that own more than 1 / HEAVY of all rows each."""
    total = entries.agg(F.sum(rows)).scalar()
    return entries.where(rows * HEAVY > total)


# --------------------------------------------------------------------------
# Binned attributes: computed intervals, at most a thousand bins each


@dataclass(frozen=True)
class BinnedAttribute:
    """``index`` maps a number to the number of its bin in ``bins``."""

    spec: AttributeSpec
    bins: DataFrame
    count: int
    index: Callable[[Column], Column]


def _equal_width_index(lo: float, width: float, count: int) -> Callable[[Column], Column]:
    if count == 1:
        return lambda number: F.lit(0)
    return lambda number: equal_width_bin(number, F.lit(lo), F.lit(width), count)


def _between_cuts(cuts: list[tuple[float, int]]) -> Callable[[Column], Column]:
    return lambda number: segment(number, cuts, [F.lit(i) for i in range(len(cuts) + 1)])


def equidistant(source: DataSource, specs: Sequence[Equidistant]) -> list[BinnedAttribute]:
    """Bins of equal width; empty ones keep frequency 0, a constant field gives one bin."""
    found = source.frequencies(_fields_of(specs)).where(F.col("value_numeric").isNotNull())
    # equal numbers written differently count as one
    numbers = materialize(found.groupBy("field", "value_numeric").agg(F.sum("frequency").alias("frequency")), "numbers")
    ranges = {
        row["field"]: (row["lo"], row["hi"])
        for row in numbers.groupBy("field")
        .agg(F.min("value_numeric").alias("lo"), F.max("value_numeric").alias("hi"))
        .collect()
    }
    spark, made = source.instances.sparkSession, []
    for spec in specs:
        if spec.field not in ranges:
            continue
        lo, hi = ranges[spec.field]
        count = spec.bins if hi > lo else 1
        width = (hi - lo) / count
        index = _equal_width_index(lo, width, count)
        frame = spark.createDataFrame(
            [
                (
                    spec.attribute,
                    i,
                    lo + i * width,
                    hi if i == count - 1 else lo + (i + 1) * width,
                    True,
                    i == count - 1,
                )
                for i in range(count)
            ],
            BORDER_SCHEMA,
        )
        counted = (
            numbers.where(F.col("field") == spec.field)
            .groupBy(index(F.col("value_numeric")).alias("bin"))
            .agg(F.sum("frequency").alias("frequency"))
        )
        bins = frame.join(counted, "bin", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
        made.append(BinnedAttribute(spec, bins, count, index))
    return made


def balanced(source: DataSource, specs: Sequence[Equifrequent | Equisized]) -> list[BinnedAttribute]:
    """Equal-frequency and minimum-support bins, smoothed, with half-way borders."""
    fields = _fields_of(specs)
    table = materialize(running_counts_table(source.frequencies(fields), fields), "running-counts")
    sequences = load_running_counts(table, fields)
    spark, made = source.instances.sparkSession, []
    for spec in specs:
        counts = sequences.get(spec.field)
        if counts is None:
            continue
        if isinstance(spec, Equifrequent):
            closed = equifrequent_bins(counts, spec.bins, source.size)
        else:
            closed = equisized_bins(counts, math.ceil(source.size * spec.support))
        rows = [(spec.attribute, i, a, b, f) for i, (a, b, f) in enumerate(closed)]
        bins = merge_cut_points(spark.createDataFrame(rows, BIN_SCHEMA))
        cuts = [((left[1] + right[0]) / 2.0, 0) for left, right in zip(closed, closed[1:])]
        made.append(BinnedAttribute(spec, bins, len(closed), _between_cuts(cuts)))
    return made


def binned_items(binned: Sequence[BinnedAttribute], start: int = 0) -> DataFrame:
    """Dictionary rows of computed bins, numbered by attribute and lower border."""
    frames = []
    for entry in binned:
        frames.append(
            entry.bins.select(
                (F.lit(start + 1) + F.col("bin")).cast("long").alias("item"),
                "attribute",
                interval_label(
                    F.col("from"), F.col("to"), F.col("from_inclusive"), F.col("to_inclusive")
                ).alias("value"),
                F.col("frequency").cast("long").alias("frequency"),
            )
        )
        start += entry.count
    return union_all(frames)


def binned_instances(source: DataSource, binned: Sequence[BinnedAttribute], start: int = 0) -> DataFrame:
    """Items of computed bins straight from the number; neither join nor shuffle."""
    by_field: dict[int, list[Column]] = {}
    for entry in binned:
        item = (F.lit(start + 1) + entry.index(F.col("value_numeric"))).cast("long")
        by_field.setdefault(entry.spec.field, []).append(
            F.struct(F.lit(entry.spec.attribute).alias("attribute"), item.alias("item"))
        )
        start += entry.count
    choice = None
    for field, options in by_field.items():
        here = F.col("field") == field
        choice = F.when(here, F.array(*options)) if choice is None else choice.when(here, F.array(*options))
    cells = source.cells(list(by_field)).where(F.col("value_numeric").isNotNull())
    return cells.select("id", F.inline(choice))


# --------------------------------------------------------------------------
# Row-wise recoding of a wide table

Keep = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class RowRecoder:
    """Turns rows of a wide table into items, row by row.

    Labels find their item by a join per attribute with that attribute's part of
    the dictionary; computed bins need no join.
    """

    source: DataSource
    specs: tuple[AttributeSpec, ...] = ()
    items: DataFrame | None = None
    binned: tuple[BinnedAttribute, ...] = ()
    start: int = 0

    def _cells(self, spec: AttributeSpec) -> tuple[Column, Column]:
        return cell(self.source.wide, self.source.field(spec.field), self.source.locale)

    def present(self) -> Column:
        """Whether a row has any item at all."""
        found = F.lit(False)
        for spec in self.specs:
            text, number = self._cells(spec)
            found = found | _label(spec, self.source.field(spec.field), text, number).isNotNull()
        for entry in self.binned:
            found = found | self._cells(entry.spec)[1].isNotNull()
        return found

    def recode(
        self, rows: DataFrame, keep: Keep | None = None, frequent: DataFrame | None = None
    ) -> tuple[DataFrame, list[tuple[int, str]]]:
        """``rows`` with one nullable item column per attribute, and those columns.

        ``keep`` selects items by attribute and id, ``frequent`` by a table of ids,
        which also bounds the joined dictionaries.
        """
        renamed, columns = _renaming(rows.sparkSession, self.specs), []
        for spec in self.specs:
            text, number = self._cells(spec)
            value = _label(spec, self.source.field(spec.field), text, number)
            column, label = f"_item_{spec.attribute}", f"_label_{spec.attribute}"
            rows = rows.withColumn(label, value)
            if isinstance(spec, Enumeration):
                mapping = renamed.where(F.col("attribute") == spec.attribute)
                rows = rows.join(mapping.select(F.col("value").alias(label), "_name"), label, "left")
                rows = rows.withColumn(label, F.coalesce("_name", label)).drop("_name")
            known = self.items.where(F.col("attribute") == spec.attribute)
            if keep is not None:
                known = known.where(keep(F.col("attribute"), F.col("item")))
            if frequent is not None:
                known = known.join(frequent.select("item"), "item", "left_semi")
            known = known.select(F.col("value").alias(label), F.col("item").alias(column))
            rows = rows.join(known, label, "left").drop(label)
            columns.append((spec.attribute, column))
        start = self.start
        for entry in self.binned:
            number = self._cells(entry.spec)[1]
            item = F.when(number.isNotNull(), F.lit(start + 1) + entry.index(number)).cast("long")
            chosen = F.lit(True) if keep is None else keep(F.lit(entry.spec.attribute), item)
            if frequent is not None:
                own = frequent.where((F.col("item") > start) & (F.col("item") <= start + entry.count))
                # at most a thousand bins per attribute
                chosen = chosen & item.isin([row["item"] for row in own.select("item").collect()])
            column = f"_item_{entry.spec.attribute}"
            rows = rows.withColumn(column, F.when(chosen, item))
            columns.append((entry.spec.attribute, column))
            start += entry.count
        return rows, columns


def item_columns(
    recoders: Sequence[RowRecoder], keep: Keep | None = None, frequent: DataFrame | None = None
) -> tuple[DataFrame, list[tuple[int, str]]]:
    """Every instance with an item column per attribute, without a shuffle; and those columns."""
    rows, columns = recoders[0].source.wide, []
    for recoder in recoders:
        rows, added = recoder.recode(rows, keep, frequent)
        columns += added
    return rows.select(*[name for _, name in columns]), columns


def rows_with_items(recoders: Sequence[RowRecoder], keep: Keep | None = None) -> DataFrame:
    """The instances that have at least one item."""
    if keep is None:
        present = F.lit(False)
        for recoder in recoders:
            present = present | recoder.present()
        return recoders[0].source.wide.where(present)
    rows, columns = item_columns(recoders, keep)
    return rows.where(F.coalesce(*[F.col(name) for _, name in columns]).isNotNull())


# --------------------------------------------------------------------------


def build_attributes(source: DataSource, specs: Sequence[AttributeSpec], start: int = 0) -> Dataset:
    """All attributes at once: one pass over the values and one over the instances per kind."""
    specs = usable_specs(source, specs)
    with_labels = [s for s in specs if not isinstance(s, (Equidistant, Equifrequent, Equisized))]
    values, instances, built, items = [], [], [], None
    if with_labels:
        items = materialize(labelled_items(source, with_labels, start), "items")
        size = items.count()
        start += size
        values.append(items.select("item", "attribute", "value", "frequency"))
        instances.append(labelled_instances(source, with_labels, items, size))
        built += with_labels
    evenly = [s for s in specs if isinstance(s, Equidistant)]
    by_count = [s for s in specs if isinstance(s, (Equifrequent, Equisized))]
    binned = (equidistant(source, evenly) if evenly else []) + (balanced(source, by_count) if by_count else [])
    if binned:
        values.append(binned_items(binned, start))
        instances.append(binned_instances(source, binned, start))
        built += [entry.spec for entry in binned]
    recoder = RowRecoder(source, tuple(with_labels), items, tuple(binned), start)
    rows = (recoder,) if source.wide is not None else None
    return Dataset(tuple(built), union_all(values), union_all(instances), source, rows)


def extend(dataset: Dataset, specs: Sequence[AttributeSpec]) -> Dataset:
    """Add attributes to a dataset; new ids continue above the largest existing one."""
    top = dataset.item_values.agg(F.max("item").alias("top")).first()["top"] or 0
    added = build_attributes(dataset.source, specs, top)
    return Dataset(
        dataset.attributes + added.attributes,
        dataset.item_values.unionByName(added.item_values),
        dataset.item_instances.unionByName(added.item_instances),
        dataset.source,
        None if dataset.rows is None else dataset.rows + added.rows,
    )


def _looked_up(pairs: DataFrame, entries: DataFrame, keys: list[str], spread: bool) -> DataFrame:
    if not spread:
        return pairs.join(entries, keys, "left")
    counted = pairs.groupBy(keys).agg(F.count(F.lit(1)).alias("_rows"))
    # also those that are not in the dictionary
    heavy = materialize(heavy_entries(counted, F.col("_rows")), "heavy").join(entries, keys, "left").drop("_rows")
    return join_spread(pairs, entries, keys, heavy, "left")


def lookup_items(pairs: DataFrame, item_values: DataFrame, spread: bool = False) -> DataFrame:
    """Item ids of (attribute, value) texts; null where there is none.

    ``spread`` is for dictionaries too large to send: pairs that own much of the table are then counted
    first, and their entries sent.
    """
    return _looked_up(pairs, item_values.select("attribute", "value", "item"), VALUE, spread)


def lookup_values(pairs: DataFrame, item_values: DataFrame, spread: bool = False) -> DataFrame:
    """Texts of (attribute, item) ids; null where there is none."""
    return _looked_up(pairs, item_values.select("attribute", "item", "value"), ["attribute", "item"], spread)
