"""Running size and supports of a data source that is still being loaded.

Supports add up, so a micro-batch needs no state but the totals before it.  They are kept in a table
on reliable storage that is committed by batch: a batch that is processed again after a
failure writes the same totals in the same place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from itemloom.model import Field
from itemloom.runtime import scratch_path
from itemloom.sources.narrow import to_instances

WHOLE_SOURCE = 0  # stands for the source itself in the ``field`` column


def running_support(wide: DataFrame, id_column: str, fields: Sequence[Field]) -> DataFrame:
    """Supports per field, and under field 0 the number of instances.

    Works on a stream and on a table alike; the state is one row per field.
    """
    with_marker = wide.withColumn("_row", F.lit("row"))
    marker = Field(WHOLE_SOURCE, "_row", fields[0].type)
    cells = to_instances(with_marker, id_column, [marker, *fields])
    return cells.groupBy("field").agg(
        F.count(F.lit(1)).alias("support_nominal"), F.count("value_numeric").alias("support_numeric")
    )


def stream_field_support(
    stream: DataFrame, id_column: str, fields: Sequence[Field], table: str | None = None
) -> tuple[StreamingQuery, str]:
    """Start keeping the supports of a stream in an in-memory table of one row per field.

    Returns the query, which ends when all data present at its start are
    processed, and the name of the table.
    """
    name = table or f"support_{uuid.uuid4().hex}"
    query = (
        running_support(stream, id_column, fields)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", scratch_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    return query, name


SLOTS = 16  # batches of which the totals are kept
_TOTALS = "field int, support_nominal long, support_numeric long, batch long, slot int"


@dataclass(frozen=True)
class SupportTable:
    """Totals after each of the last batches, in a folder that outlives the session.

    Batch ``b`` owns the folder ``slot=b % SLOTS``, so the table stays small however long the
    stream runs, and the totals of the batch before are still there while one is written.
    """

    spark: SparkSession
    folder: str

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(_TOTALS).parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _TOTALS)

    def last_batch(self) -> int | None:
        return self.history().agg(F.max("batch")).first()[0]

    def totals(self) -> DataFrame:
        """``field, support_nominal, support_numeric`` after the last committed batch."""
        return self._after(self.last_batch())

    def _after(self, batch: int | None) -> DataFrame:
        return self.history().where(F.col("batch") == F.lit(batch).cast("long")).drop("batch", "slot")

    def add(self, batch: int, own: DataFrame) -> None:
        """Commit the totals of a batch from its own supports; the same again if it is already there."""
        earlier = self.history().where(F.col("batch") < batch).agg(F.max("batch")).first()[0]
        totals = own.unionByName(self._after(earlier)).groupBy("field")
        summed = totals.agg(*[F.sum(c).alias(c) for c in ("support_nominal", "support_numeric")])
        # one row per field in one file, so the batch appears as a whole; read before its slot is written
        rows = self.spark.createDataFrame(summed.withColumn("batch", F.lit(batch).cast("long")).collect(), _TOTALS.rsplit(",", 1)[0])
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/slot={batch % SLOTS}")


def keep_support(
    stream: DataFrame, id_column: str, fields: Sequence[Field], table: SupportTable, checkpoint: str
) -> StreamingQuery:
    """Start adding what is there of a stream to a table of supports.

    Started again with the same table and checkpoint it goes on where it was, also in a new session
    and after it was lost at any moment: no row counts twice and none is missed.
    """

    def commit(batch: DataFrame, number: int) -> None:
        table.add(number, running_support(batch, id_column, fields))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_support(spark: SparkSession, stream: DataFrame, id_column: str, fields: Sequence[Field]) -> DataFrame:
    """Process what is there and return the final state."""
    table = SupportTable(spark, scratch_path(spark, "support"))
    keep_support(stream, id_column, fields, table, scratch_path(spark, "stream")).awaitTermination()
    return table.totals()
