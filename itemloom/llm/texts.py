"""Helpers the text operators share: bounded pieces of Arrow batches and words by number."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 8 << 20
WHITE = r"[\x20\x09-\x0D]+"  # fixed: the white space that separates words


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece are about ``most`` bytes, or one long text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        limit = (total[start - 1] if start else 0) + most
        stop = max(start + 1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def in_tasks(df: DataFrame, function: Callable, schema, operator: str = "") -> DataFrame:
    """``mapInArrow`` for functions of this package, which the workers have to find as well."""
    paths = df.sparkSession.sparkContext.environment
    home = str(Path(__file__).parents[2])
    if home not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), home]))
    operator = operator or function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        try:
            yield from function(batches)
        finally:  # the worker may wait for its next task while others need the memory
            give_back()

    return df.mapInArrow(run, schema)


_DROPS: dict[str, Callable[[], None]] = {}


def keep(operator: str, drop: Callable[[], None]) -> None:
    """Say how the caches that tasks of an operator leave in this worker are dropped."""
    _DROPS[operator] = drop


def begin(operator: str) -> None:
    """Drop what tasks of other operators left in this worker, and give the memory back."""
    others = [o for o in _DROPS if o != operator]
    for o in others:
        _DROPS.pop(o)()
    if others:
        gc.collect()  # closures of dropped caches refer to each other
        give_back()


def give_back() -> None:
    """Return memory that this worker holds and does not use to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    docs: DataFrame,
    columns: list[Column],
    by_piece: Callable[[], Callable[[pa.RecordBatch], dict]],
    schema: T.StructType,
    text: str = "text",
    most: int = PIECE_BYTES,
) -> DataFrame:
    """Apply a function to pieces of the selected columns inside the tasks.

    ``by_piece`` is called once per task and returns the function; that maps a piece to
    the output columns by name.  Only one piece is worked on at a time.
    """
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = by_piece()
        for batch in batches:
            for piece in pieces(batch, text, most):
                made = function(piece)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([_array(made[n]) for n in names], names)
            # else two batches, and what the last one left, are held while the next is read
            batch = piece = made = None
            pa.default_memory_pool().release_unused()

    return in_tasks(docs.select(*columns), run, schema, by_piece.__module__)


def _array(values) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values)


class Words:
    """The words of some texts: the distinct ones, and every text as numbers of them."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy(zero_copy_only=False)
        keep = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
        kept = keep[index]  # white space at either end leaves an empty word
        self.distinct: pa.Array = coded.dictionary.filter(pa.array(keep))
        self.index: np.ndarray = (np.cumsum(keep) - 1)[index[kept]]
        self.bounds: np.ndarray = np.concatenate(([0], np.cumsum(kept)))[bounds]

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """The sum of a number, or of a row of numbers, over the words of each text."""
        values = per_word[self.index]
        zero = np.zeros((1, *values.shape[1:]), values.dtype)
        total = np.concatenate((zero, np.cumsum(values, axis=0)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


class TwoGenerations:
    """A cache of bounded size: when the young entries reach ``most``, the old ones go."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
