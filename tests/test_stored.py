import glob
import uuid

import pytest
from pyspark.sql import functions as F

from itemloom.model import Equidistant, Field, FieldType, Simple
from itemloom.operators import attributes as attr
from itemloom.operators import profile
from itemloom.sources import stored
from itemloom.sources.stored import StoredDataset, StoredSource
from itemloom.sources.tables import data_source

FIELDS = [Field(1, "a", FieldType.NOMINAL), Field(2, "b", FieldType.NOMINAL), Field(3, "n", FieldType.NUMERIC)]


@pytest.fixture(scope="module")
def source(spark):
    rows = [(i, "xyz"[i % 3], "pq"[i % 2] if i % 5 else None, float(i % 7)) for i in range(60)]
    return data_source(spark.createDataFrame(rows, "id long, a string, b string, n double"), FIELDS)


@pytest.fixture
def fresh(spark, tmp_path):
    """A name in a database whose files lie in the test's folder."""
    database = f"d_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{tmp_path}'")
    yield f"{database}.t"
    spark.sql(f"DROP DATABASE {database} CASCADE")


def spoil(folder, pattern):
    """Make data files unreadable, so that whoever reads them fails."""
    files = glob.glob(f"{folder}/{pattern}/*.parquet")
    assert files
    for file in files:
        with open(file, "wb") as out:
            out.write(b"not a table")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_a_dropped_field_is_not_read(spark, source, tmp_path, fresh):
    kept = StoredSource.create(fresh, source)
    loaded = kept.load()
    assert loaded.fields == tuple(FIELDS)
    assert rows(loaded.instances.select("id", "field", "value_nominal")) == rows(source.instances.select("id", "field", "value_nominal"))
    for table in kept.tables:
        spoil(tmp_path, f"{table.split('.')[1]}/field=2")
    kept.drop_field(2)
    after = kept.load()
    assert [f.field for f in after.fields] == [1, 3]
    # nothing of the dropped field is touched afterwards either
    assert rows(profile.field_support(after.instances)) == rows(profile.field_support(source.instances).where("field <> 2"))
    assert rows(after.values.select("field", "value_nominal", "frequency")) == rows(
        source.values.where("field <> 2").select("field", "value_nominal", "frequency")
    )
    made = attr.build_attributes(after, [Simple(1, "a", 1)])
    assert made.item_values.count() == 3
    with pytest.raises(ValueError):
        kept.drop_field(2)


def test_builds_never_share_ids(spark, source, tmp_path, fresh):
    dataset = StoredDataset.create(spark, fresh)
    assert dataset.add(source, [Simple(1, "a", 1), Equidistant(3, "n", 3, bins=4)]) == (1, 7)
    assert dataset.add(source, [Simple(2, "b", 2)]) == (8, 9)
    for table in dataset.tables:
        spoil(tmp_path, f"{table.split('.')[1]}/attribute=2")
    dataset.drop_attribute(2)
    assert dataset.attributes() == [1, 3] and rows(dataset.names()) == [(1, "a"), (3, "n")]
    # ids of a dropped attribute are not given again, and nothing of it comes back with its number
    assert dataset.add(source, [Simple(2, "again", 2)]) == (10, 11)
    values = dataset.item_values()
    assert values.select("item").distinct().count() == values.count() == 9
    counted = dataset.item_instances().groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    assert rows(counted.select("item", "n")) == rows(values.select("item", "frequency"))
    with pytest.raises(ValueError):
        dataset.add(source, [Simple(1, "a", 1)])
    with pytest.raises(ValueError):
        dataset.drop_attribute(9)


def test_a_build_that_fails_leaves_a_gap_only(spark, source, monkeypatch, fresh):
    dataset = StoredDataset.create(spark, fresh)
    real = stored._insert

    def failing(frame, table, by):
        if table.endswith("_attributes"):
            raise OSError("lost")
        real(frame, table, by)

    monkeypatch.setattr(stored, "_insert", failing)
    with pytest.raises(OSError):
        dataset.add(source, [Simple(1, "a", 1)])
    monkeypatch.undo()
    assert dataset.attributes() == [] and dataset.item_values().count() == dataset.item_instances().count() == 0
    assert dataset.add(source, [Simple(2, "b", 2)]) == (4, 5)
    assert rows(dataset.item_values().select("item", "value")) == [(4, "p"), (5, "q")]
