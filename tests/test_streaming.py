import pytest
from pyspark.errors import StreamingQueryException

from itemloom.model import Field, FieldType
from itemloom.streaming import support
from itemloom.streaming.support import SupportTable, keep_support, running_support, stream_field_support

FIELDS = [Field(1, "kind", FieldType.NOMINAL), Field(2, "v", FieldType.NUMERIC)]
SCHEMA = "id long, kind string, v double"


def test_supports_grow_with_the_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    first = spark.createDataFrame([(1, "a", 1.0), (2, None, None)], SCHEMA)
    second = spark.createDataFrame([(3, "b", None), (4, "b", 2.0)], SCHEMA)
    first.coalesce(1).write.parquet(path)
    second.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query, name = stream_field_support(stream, "id", FIELDS)
    query.awaitTermination()
    assert len(query.recentProgress) >= 2
    streamed = sorted(tuple(r) for r in spark.table(name).collect())
    batch = sorted(tuple(r) for r in running_support(first.union(second), "id", FIELDS).collect())
    assert streamed == batch == [(0, 4, 0), (1, 3, 0), (2, 2, 2)]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("moment", ["before", "after"])
def test_totals_survive_a_loss_at_any_moment(spark, tmp_path, monkeypatch, moment):
    """The third batch is lost before or after its totals are written; then more data come."""
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    parts = [spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else None, float(i) if i % 2 else None)], SCHEMA) for i in range(9)]
    for part in parts[:5]:
        part.coalesce(1).write.mode("append").parquet(path)
    table = SupportTable(spark, str(tmp_path / "totals"))
    assert table.last_batch() is None and table.totals().count() == 0

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)

    real = SupportTable.add

    def failing(self, batch, own):
        if moment == "after":
            real(self, batch, own)
        if batch == 2:
            raise OSError("lost")
        if moment == "before":
            real(self, batch, own)

    monkeypatch.setattr(support, "SLOTS", 3)
    with monkeypatch.context() as lost, pytest.raises(StreamingQueryException):
        lost.setattr(SupportTable, "add", failing)
        keep_support(stream(), "id", FIELDS, table, checkpoint).awaitTermination()
    assert table.last_batch() == (1 if moment == "before" else 2)
    seen = 2 if moment == "before" else 3
    assert {r.field: r.support_nominal for r in table.totals().collect()}[support.WHOLE_SOURCE] == seen
    # a new table object stands for a new session
    again = SupportTable(spark, str(tmp_path / "totals"))
    keep_support(stream(), "id", FIELDS, again, checkpoint).awaitTermination()
    for part in parts[5:]:  # more batches than there are slots
        part.coalesce(1).write.mode("append").parquet(path)
    keep_support(stream(), "id", FIELDS, again, checkpoint).awaitTermination()
    assert again.last_batch() == len(parts) - 1
    assert rows(again.totals()) == rows(running_support(spark.read.schema(SCHEMA).parquet(path), "id", FIELDS))
    assert len(list((tmp_path / "totals").glob("slot=*"))) <= support.SLOTS


def test_a_batch_twice_counts_once(spark, tmp_path):
    table = SupportTable(spark, str(tmp_path / "totals"))
    own = spark.createDataFrame([(0, 2, 0), (1, 2, 1)], "field int, support_nominal long, support_numeric long")
    for batch in (0, 1, 1, 1):
        table.add(batch, own)
    assert rows(table.totals()) == [(0, 4, 0), (1, 4, 2)]
