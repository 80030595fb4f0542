"""Exact deduplication against a persistent digest index.

The index is a table with a row per text known so far, bucketed and sorted by digest.  New
documents are digested, counted per digest, and merged against the index by a sort-merge
anti-join that does not move the index; the rest is appended.  Everything is DataFrame and SQL work.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.components import join_spread
from itemloom.llm.texts import WHITE, text_of
from itemloom.runtime import materialize, scratch_path

BUCKETS = 64


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with each run of white space replaced by a space; null is empty."""
    return F.sha2(F.regexp_replace(text_of(text), WHITE, " ").cast("binary"), 256)


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed table of digests, the id that stands for each, and the batch that brought it.

    The folder outlives the session: opening it again under any table name goes on from there.
    """

    spark: SparkSession
    table: str
    path: str
    id_type: str = "bigint"
    buckets: int = BUCKETS

    def open(self) -> DigestIndex:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id {self.id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests that the index does not have; ``groups`` has digest and keep_id once each."""
        new = groups.select("digest", "keep_id").hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        # written first: a table cannot be read and appended to in one step
        self._add(materialize(new.withColumn("batch", F.lit(batch)), "new-digests"))

    def _add(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)

    def compacted(self) -> DigestIndex:
        """The same index in a new folder with one sorted file per bucket, so that reads need no sort again.

        Each append adds a file to each bucket.  The old folder stays as it is.
        """
        new = DigestIndex(
            self.spark, f"digests_{uuid.uuid4().hex}", scratch_path(self.spark, "digest-index"), self.id_type, self.buckets
        ).open()
        # a plain copy first: from a bucketed table the optimizer would drop the repartitioning
        new._add(materialize(self.rows().select("digest", "keep_id", "batch"), "compacting"))
        return new


def fresh_index(spark: SparkSession, id_type: str = "bigint") -> DigestIndex:
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}", scratch_path(spark, "digest-index"), id_type).open()


def deduplicate(
    docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", batch: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; appends to the index.

    Texts are equal when they are so after each run of white space became one space.  Of equal
    texts the row with the smallest id stays, or the one the index already has; then none of
    ``docs`` is kept.  ``group_size`` counts the rows of ``docs``.  Null texts are empty, and equal
    to empty ones.  Null ids come after all others; a group of null ids only has a null
    keep_id.  Of repeated rows with the id that stays, all are kept.  Other columns are ignored.

    The index is appended to before the result is written.  ``batch`` names the documents: a result
    that was lost is made again by the same documents under the same name, as digests
    of the own batch count as new.  Without a name each call is a batch of its own.
    """
    batch = batch or uuid.uuid4().hex
    digests = materialize(docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest")), "digests")
    groups = materialize(
        digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups"
    )
    before = index.rows().where(~F.col("batch").eqNullSafe(F.lit(batch))).select("digest", F.lit(True).alias("known"))
    fresh = groups.hint("merge").join(before.hint("merge"), "digest", "left_anti").select("digest")
    marked = materialize(groups.join(fresh.withColumn("fresh", F.lit(True)), "digest", "left"), "digest-marks")
    index.append(marked.select("digest", F.col("first_id").alias("keep_id")), batch)
    held = index.rows().select("digest", "keep_id")
    final = materialize(marked.hint("merge").join(held.hint("merge"), "digest"), "digest-keepers")
    return join_spread(digests, final, "digest", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("fresh").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
