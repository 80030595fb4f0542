"""Shared plumbing: scratch tables on reliable storage and distributed numbering."""

from __future__ import annotations

import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Result = TypeVar("Result")

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; on a
    cluster the folder must be visible to every executor, so it has to be named.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="itemloom-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Cuts the lineage, survives lost executors and gives the optimizer true
    sizes, so it chooses broadcasts from facts.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share_package(spark: SparkSession) -> None:
    """Let the workers import this package from where the driver has it."""
    environment = spark.sparkContext.environment
    home = str(Path(__file__).parents[1])
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, home])


class Overdue(Exception):
    """Work was not done by its deadline; its jobs were cancelled."""


def run_until(spark: SparkSession, deadline: float | None, work: Callable[[], Result]) -> Result:
    """The result of ``work``, or :class:`Overdue` after cancelling all its jobs.

    The jobs run under a tag of their own, so no other job of the session is touched.  ``deadline`` is a
    time of ``time.monotonic``.  Tables that were written before stay as they are.
    """
    if deadline is None:
        return work()
    context, tag, outcome = spark.sparkContext, f"itemloom-{uuid.uuid4().hex}", {}

    def tagged() -> None:
        context.addJobTag(tag)
        try:
            outcome["result"] = work()
        except BaseException as error:  # handed to the caller below
            outcome["error"] = error
        finally:
            context.removeJobTag(tag)

    thread = threading.Thread(target=tagged, daemon=True)
    thread.start()
    thread.join(max(0.0, deadline - time.monotonic()))
    overdue = thread.is_alive()
    while thread.is_alive():
        # work on the driver may start another job after one was cancelled
        context.cancelJobsWithTag(tag)
        thread.join(0.1)
    if "result" in outcome:
        return outcome["result"]
    if overdue:
        raise Overdue(f"cancelled at the deadline: {type(outcome['error']).__name__}") from outcome["error"]
    raise outcome["error"]


def number_rows(df: DataFrame, order_by: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """Dense numbers ``start, start+1, …`` in the order of ``order_by`` (a total order).

    Range partitions are sorted independently; a row's number is its place in its partition
    plus the number of rows in earlier partitions, so no task sees more than one range.
    """
    columns = df.columns
    placed = materialize(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_range", F.shiftright("_place", _POSITION_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so this window and its broadcast stay tiny
    offsets = (
        placed.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return placed.join(F.broadcast(offsets), "_range").select(
        (F.col("_offset") + within + F.lit(start)).cast("long").alias(name), *columns
    )


def join_spread(rows: DataFrame, table: DataFrame, keys: Sequence[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that has each key at most once, though few keys own most rows.

    ``heavy`` is the bounded part of the table for the keys that own many rows.  It is sent to the
    tasks, so those rows stay where they are.  Rows with a null key are not moved either; all others
    meet their entry by key.  ``how`` is ``inner`` or ``left``.
    """
    keys = list(keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    near = rows.join(F.broadcast(heavy), keys)
    others = rows.where(known).join(F.broadcast(heavy.select(keys)), keys, "left_anti")
    light = table.join(F.broadcast(heavy.select(keys)), keys, "left_anti")
    found = near.unionByName(others.join(light, keys, how))
    if how == "left":
        added = {c: F.lit(None).cast(table.schema[c].dataType) for c in table.columns if c not in keys}
        found = found.unionByName(rows.where(~known).withColumns(added))
    return found


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
