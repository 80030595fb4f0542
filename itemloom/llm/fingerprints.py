"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Three triplets of every window of four bytes are hashed into 128 buckets and counted.  A
bucket is encoded by the quartile of the counts it falls into, two bits each; the header
holds the length on a logarithmic scale.  Two digests differ by the distances of their
quartiles and lengths, each bounded, so the likeness lies between 0 and 1.

The next document is the one after in descending order of doc_id.  Ids are cut into ranges,
each range also gets the first document of the next one, and a range is read in order, so
texts are shuffled once and no task holds more than a piece of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.texts import PIECE_BYTES, in_tasks, pieces, text_of

BUCKETS = 128
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # places of a window of four bytes
STRETCH = 1 << 20  # bytes hashed at once
LENGTH_STEP = math.log(1.25)
MOST_LENGTHS = 24  # a difference of lengths counts up to so many steps
MOST_QUARTILES = BUCKETS * 3


def fingerprint(data: bytes) -> str:
    """The digest in hex: two digits for the length, then two bits for each bucket.

    Texts without a window of four bytes have empty buckets; the empty text has length 0.
    """
    counts = np.zeros(BUCKETS, np.int64)
    values = np.frombuffer(data, np.uint8)
    for start in range(0, max(0, len(values) - 3), STRETCH):
        part = values[start : start + STRETCH + 3].astype(np.uint32)
        window = [part[i : len(part) - 3 + i] for i in range(4)]
        for kind, (a, b, c) in enumerate(TRIPLETS):
            hashed = (window[a] * np.uint32(0x9E3779B1) + window[b] * np.uint32(0x85EBCA77)) ^ (
                window[c] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F * kind & 0xFFFFFFFF)
            )
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(hashed >> np.uint32(25), minlength=BUCKETS)
    ordered = np.sort(counts)
    borders = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (counts[:, None] > borders[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = quartile[:, 0] << 6 | quartile[:, 1] << 4 | quartile[:, 2] << 2 | quartile[:, 3]
    length = min(255, round(math.log(len(data) + 1) / LENGTH_STEP))
    return f"{length:02x}" + packed.tobytes().hex()


def difference(a: str, b: str) -> float:
    """0 for equal digests, 1 at most: quartile distances and the length steps, each bounded."""
    one, other = (np.frombuffer(bytes.fromhex(x[2:]), np.uint8) for x in (a, b))
    shifts = np.array([[6], [4], [2], [0]], np.uint8)
    apart = np.abs((one >> shifts & 3).astype(np.int64) - (other >> shifts & 3)).sum()
    steps = min(MOST_LENGTHS, abs(int(a[:2], 16) - int(b[:2], 16)))
    return (int(apart) + steps) / (MOST_QUARTILES + MOST_LENGTHS)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b)


def _borders(docs: DataFrame, ranges: int) -> list:
    """The ids at which new ranges begin, from the largest id on."""
    found = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(found or ()), reverse=True)


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: the fingerprints of its text, of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's: the next in descending order of doc_id, after the last the
    first.  Null texts are empty.  Null ids come last; rows of one id follow each other by
    text, so repeated rows have a defined next row.  A single row is its own next.  ``ranges``
    only sets how many tasks share the work.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    borders = _borders(rows, ranges) if ranges > 1 else []
    span = F.lit(0)
    for border in _halves(borders):  # a balanced tree of comparisons, as deep as log2(ranges)
        span = border
    placed = rows.withColumn("span", span)
    # the first row of each range that has rows; there are no more of them than ranges
    first = (
        placed.groupBy(F.col("span").alias("of_span"))
        .agg(F.max("doc_id").alias("top_id"))
        .withColumn("before", F.lag("of_span").over(Window.orderBy("of_span")))
        .withColumn("before", F.coalesce("before", F.max("of_span").over(Window.partitionBy())))
    )
    heads = (
        placed.join(F.broadcast(first), (F.col("span") == F.col("of_span")) & F.col("doc_id").eqNullSafe(F.col("top_id")))
        .groupBy("of_span", "before")
        .agg(F.min(F.struct("doc_id", "text")).alias("head"))
        .select("head.doc_id", "head.text", F.col("before").alias("span"), F.lit(True).alias("borrowed"))
    )
    count = max(1, len(borders) + 1)
    dealt = (
        placed.withColumn("borrowed", F.lit(False))
        .unionByName(heads)
        .repartitionByRange(count, "span")
        .sortWithinPartitions("span", "borrowed", F.col("doc_id").desc_nulls_last(), "text")
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    return in_tasks(dealt, _compare, schema)


def _halves(borders: list):
    """One expression for the number of a row's range; none if there is only one."""

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") > F.lit(borders[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return [tree(0, len(borders))] if borders else []


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range; the borrowed row closes a range."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    before, id_type = None, pa.int64()
    made: list[tuple] = []
    held = 0

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*made))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_type, *kinds])], names)

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for piece in pieces(batch, "text"):
            for row in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "borrowed"))):
                doc_id, text, borrowed = row
                print_ = fingerprint(text.encode())
                if before is not None:
                    made.append(_edited(*before, text, print_))
                    held += len(made[-1][2])
                    if held > PIECE_BYTES:
                        yield batch_of()
                        made, held = [], 0
                before = None if borrowed else (doc_id, text, print_)
    if made:
        yield batch_of()


def _edited(doc_id, text: str, own: str, following: str, next_print: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_print = fingerprint(edited.encode())
    return doc_id, len(text), edited, own, edited_print, likeness(own, edited_print), likeness(own, next_print)
