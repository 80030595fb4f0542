"""Token counts by a two-tier lookup inside the tasks.

A text is cut at ASCII white space.  The tokenizer drops white space and none of its steps
crosses it, so the tokens of a text are those of its chunks, each as the library itself
counts them.  Tier one is a compact hash table of the frequent chunks' lengths, broadcast
with at most ``FREQUENT`` entries of ``LONGEST`` bytes.  Tier two is a bounded cache of each
worker; only chunks missing there are encoded.

The frequent chunks come from all texts: every task keeps a bounded summary of its heavy
hitters, and only these summaries are added up.  No chunk of the corpus is shuffled.  A
chunk left out of the table costs time, never a wrong count.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.texts import TwoGenerations, Words, in_tasks, map_texts, pieces, text_of

FREQUENT = 1 << 15  # entries of the broadcast table
SUMMARY = 1 << 13  # entries a task hands over
LONGEST = 48  # bytes of a chunk that is kept in a table or cache
CACHED = 200_000  # young entries of a worker's cache


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _lengths(tokenizer, chunks: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


def frequent_chunks(docs: DataFrame, text: str = "text", most: int = FREQUENT) -> DataFrame:
    """The chunks that occur most often by the summaries of all tasks: chunk, n."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"))
                n = np.bincount(words.index, minlength=len(words.distinct))
                short = pc.binary_length(words.distinct).to_numpy(zero_copy_only=False) <= LONGEST
                top = np.flatnonzero(short & (n > 1))
                top = top[np.argsort(-n[top], kind="stable")[: 2 * SUMMARY]]
                for chunk, k in zip(words.distinct.take(pa.array(top)).to_pylist(), n[top].tolist()):
                    counts[chunk] += k
                if len(counts) > 8 * SUMMARY:
                    counts = Counter(dict(counts.most_common(4 * SUMMARY)))
        kept = counts.most_common(SUMMARY)
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([c for c, _ in kept], pa.string()), "n": pa.array([k for _, k in kept], pa.int64())}
        )

    found = in_tasks(docs.select(F.col(text).cast("string").alias("text")), summarise, "chunk string, n long")
    return found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(most)


def token_counts(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens.

    ``tokenizer`` is the path of a tokenizer file that every machine has.  Counts equal the
    library's for whole texts, without begin, end or added special tokens; special strings
    inside texts are handled as by default.  A null or empty text has 0 of both; null ids and
    repeated rows are kept; other columns are ignored.
    """
    # at most ``frequent`` rows of LONGEST bytes come to the driver and go to the tasks
    chunks = [row.chunk for row in frequent_chunks(docs, text, frequent).collect()]
    table = docs.sparkSession.sparkContext.broadcast((chunks, np.array(_lengths(_load(tokenizer), chunks), np.int64)))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def counter() -> Callable:
        chunks, lengths = table.value
        keys = pa.array(chunks, pa.string())
        lengths = np.append(lengths, 0)
        library, cache = _load(tokenizer), _cache(tokenizer)

        def count(piece: pa.RecordBatch) -> dict:
            words = Words(piece.column("text"))
            place = pc.fill_null(pc.index_in(words.distinct, keys), len(chunks)).to_numpy(zero_copy_only=False)
            n = lengths[place]
            rest = np.flatnonzero(place == len(chunks))
            values = words.distinct.take(pa.array(rest)).to_pylist()
            known = [cache.get(v) for v in values]
            missing = [i for i, k in enumerate(known) if k is None]
            for i, k in zip(missing, _lengths(library, [values[i] for i in missing])):
                known[i] = k
                if len(values[i]) <= LONGEST:
                    cache.put(values[i], k)
            n[rest] = known
            size = pc.fill_null(pc.binary_length(piece.column("text")), 0).cast(pa.int64())
            return {"doc_id": piece.column("doc_id"), "n_bytes": size, "n_tokens": words.sums(n)}

        return count

    return map_texts(docs, [F.col(doc_id).alias("doc_id"), text_of(text).alias("text")], counter, schema)


_CACHES: dict[str, TwoGenerations] = {}


def _cache(tokenizer: str) -> TwoGenerations:
    """The cache of this worker process, which later tasks find filled."""
    return _CACHES.setdefault(tokenizer, TwoGenerations(CACHED))
