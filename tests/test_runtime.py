from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from itemloom import runtime


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake(master, setting=None):
    conf = SimpleNamespace(get=lambda key, default: setting or default)
    return SimpleNamespace(sparkContext=Context(master), conf=conf)


def test_scratch_folder_comes_from_the_session():
    assert runtime.scratch_root(fake("spark://host", "/shared/tables/")) == "/shared/tables"


def test_a_cluster_needs_a_named_folder():
    with pytest.raises(RuntimeError):
        runtime.scratch_root(fake("spark://host"))


def test_a_local_session_gets_a_folder():
    session = fake("local[2]")
    assert runtime.scratch_root(session) == session.sparkContext.folder


def test_written_tables_keep_their_schema(spark):
    frame = spark.range(5).select("id", F.array("id").alias("items"), F.lit("x").alias("t"))
    written = runtime.materialize(frame, "test")
    assert written.columns == frame.columns
    assert sorted(tuple(r) for r in written.collect()) == sorted(tuple(r) for r in frame.collect())
