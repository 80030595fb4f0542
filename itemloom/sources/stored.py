"""Data sources and datasets kept as catalog tables, partitioned by field and by attribute.

A field or an attribute is a partition of each of its tables, so it is read alone, added without touching
the others, and removed by dropping partitions, for which no data file is read.  Item ids go on from a
maximum that is committed in the catalog before any row is written, so builds never share ids.

The tables are managed ones of the session's catalog, so a dropped partition is gone with its files, and its
number may be used again.  A name can be qualified by a database, whose location then holds the files.
With a persistent catalog the tables outlive the session.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.model import AttributeSpec, Field, FieldType, require
from itemloom.operators.attributes import DataSource, build_attributes
from itemloom.runtime import materialize
from itemloom.sources.narrow import fields_frame

_CELL = "value_nominal STRING, value_numeric DOUBLE"
NEXT_ITEM = "itemloom.next_item"


def _create(spark: SparkSession, table: str, columns: str, by: str) -> None:
    spark.sql(f"CREATE TABLE {table} ({columns}, {by} INT) USING parquet PARTITIONED BY ({by})")


def _insert(rows: DataFrame, table: str, by: str) -> None:
    # a partition is written by as many tasks as its rows ask for, not by one
    rows.select(rows.sparkSession.table(table).columns).sortWithinPartitions(by).write.insertInto(table)


def _numbers(spark: SparkSession, table: str, by: str) -> list[int]:
    """The partitions of a table, from the catalog."""
    return sorted(int(row[0].split("=", 1)[1]) for row in spark.sql(f"SHOW PARTITIONS {table}").collect())


def _drop(spark: SparkSession, tables: Sequence[str], by: str, number: int) -> None:
    for table in tables:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({by} = {int(number)})")


@dataclass(frozen=True)
class StoredSource:
    """Tables ``<name>_fields``, ``<name>_instances`` and ``<name>_values``, partitioned by field."""

    spark: SparkSession
    name: str

    @property
    def tables(self) -> list[str]:
        return [f"{self.name}_{part}" for part in ("fields", "instances", "values")]

    @classmethod
    def create(cls, name: str, source: DataSource) -> StoredSource:
        """Write a source; fails when there already is one of that name."""
        spark = source.instances.sparkSession
        stored = cls(spark, name)
        id_type = source.instances.schema["id"].dataType.simpleString()
        columns = ["name STRING, type STRING", f"id {id_type}, {_CELL}", f"{_CELL}, frequency BIGINT"]
        for table, own in zip(stored.tables, columns):
            _create(spark, table, own, "field")
        frames = [fields_frame(spark, source.fields), source.instances, source.values]
        # the fields come last: a source that was not written whole has none
        for table, frame in list(zip(stored.tables, frames))[::-1]:
            _insert(frame, table, "field")
        return stored

    def load(self) -> DataSource:
        fields, instances, values = (self.spark.table(t) for t in self.tables)
        listed = [Field(r["field"], r["name"], FieldType(r["type"])) for r in fields.orderBy("field").collect()]
        return DataSource(tuple(listed), instances, values)

    def drop_field(self, field: int) -> None:
        """Remove a field; no data file is read, and the other fields are not touched."""
        require(field in _numbers(self.spark, self.tables[0], "field"), f"no field {field}")
        # the field first: a source never has a field without its cells
        _drop(self.spark, self.tables, "field", field)


@dataclass(frozen=True)
class StoredDataset:
    """Tables ``<name>_attributes``, ``<name>_item_values`` and ``<name>_item_instances``, partitioned by attribute."""

    spark: SparkSession
    name: str

    @property
    def tables(self) -> list[str]:
        return [f"{self.name}_{part}" for part in ("attributes", "item_values", "item_instances")]

    @classmethod
    def create(cls, spark: SparkSession, name: str, id_type: str = "bigint") -> StoredDataset:
        """An empty dataset; fails when there already is one of that name."""
        stored = cls(spark, name)
        columns = ["name STRING", "item BIGINT, value STRING, frequency BIGINT", f"id {id_type}, item BIGINT"]
        for table, own in zip(stored.tables, columns):
            _create(spark, table, own, "attribute")
        spark.sql(f"ALTER TABLE {stored.tables[0]} SET TBLPROPERTIES ('{NEXT_ITEM}' = '1')")
        return stored

    def attributes(self) -> list[int]:
        return _numbers(self.spark, self.tables[0], "attribute")

    def _reserve(self, count: int) -> int:
        """Commit the next ``count`` item ids to this build; a build that fails leaves a gap."""
        row = self.spark.sql(f"SHOW TBLPROPERTIES {self.tables[0]} ('{NEXT_ITEM}')").first()
        first = int(row["value"])
        self.spark.sql(f"ALTER TABLE {self.tables[0]} SET TBLPROPERTIES ('{NEXT_ITEM}' = '{first + count}')")
        return first

    def add(self, source: DataSource, specs: Sequence[AttributeSpec]) -> tuple[int, int]:
        """Build attributes and append them; gives the first and the last of their item ids.

        Ids are not used again, also not those of attributes that were dropped.
        """
        known = set(self.attributes())
        require(not known & {s.attribute for s in specs}, "an attribute of that number is there already")
        built = build_attributes(source, specs)
        values = materialize(built.item_values, "item-values")
        count = values.agg(F.max("item")).first()[0] or 0
        first = self._reserve(count)
        shift = (F.col("item") + F.lit(first - 1)).alias("item")
        _insert(built.item_instances.select("id", "attribute", shift), self.tables[2], "attribute")
        _insert(values.select("attribute", "value", "frequency", shift), self.tables[1], "attribute")
        # the names come last: an attribute that was not written whole is none
        _insert(built.names(), self.tables[0], "attribute")
        return first, first + count - 1

    def names(self) -> DataFrame:
        return self.spark.table(self.tables[0]).select("attribute", "name")

    def item_values(self) -> DataFrame:
        return self._complete(self.tables[1])

    def item_instances(self) -> DataFrame:
        return self._complete(self.tables[2])

    def _complete(self, table: str) -> DataFrame:
        """The rows of attributes that are there; what a failed build left is not read."""
        return self.spark.table(table).where(F.col("attribute").isin(self.attributes()))

    def drop_attribute(self, attribute: int) -> None:
        """Remove an attribute; no data file is read, and the others keep their item ids."""
        require(attribute in self.attributes(), f"no attribute {attribute}")
        _drop(self.spark, self.tables, "attribute", attribute)
