"""The digest index: lost results, later batches and compaction."""

import uuid

from itemloom.llm.exact_dedup import DigestIndex, deduplicate, fresh_index
from itemloom.runtime import scratch_path

COLUMNS = ("doc_id", "keep_id", "group_size", "kept")


def found(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_a_lost_result_is_made_again(spark):
    """The index has the batch, its result is gone: the same documents under the same name keep their rows."""
    docs = spark.createDataFrame([(3, "a b"), (1, "a  b"), (2, "c")], "doc_id long, text string")
    index = fresh_index(spark)
    deduplicate(docs, index, batch="monday")  # only planned: the driver is lost before it is written
    wanted = [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)]
    assert found(deduplicate(docs, index, batch="monday")) == wanted
    # opened again in another session, under another name
    reopened = DigestIndex(spark, f"{index.table}_again", index.path).open()
    assert found(deduplicate(docs, reopened, batch="monday")) == wanted
    assert reopened.rows().count() == 2
    # a later batch with the same texts keeps none of them, also when it is made twice
    for _ in range(2):
        assert found(deduplicate(docs, index, batch="tuesday")) == [(1, 1, 2, False), (2, 2, 1, False), (3, 1, 2, False)]


def test_compaction_keeps_the_index(spark):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", scratch_path(spark, "index"), buckets=2).open()
    for day in range(3):
        rows = [(10 * day + i, f"text {i + day}") for i in range(4)]
        deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), index, batch=str(day))
    small = index.compacted()
    assert sorted(map(tuple, small.rows().collect())) == sorted(map(tuple, index.rows().collect()))
    files = [f.rsplit("/", 1)[-1].rsplit("_", 1)[-1].split(".")[0] for f in small.rows().inputFiles()]
    assert len(files) == len(set(files)) < len(index.rows().inputFiles())
    again = spark.createDataFrame([(99, "text 5"), (98, "text 9")], "doc_id long, text string")
    assert found(deduplicate(again, small)) == [(98, 98, 1, True), (99, 23, 1, False)]
