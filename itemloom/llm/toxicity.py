"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-case words of a text and their first letters, so that inflected forms
share what is learned.  Terms are hashed; the hashed terms that tell the labels apart beyond
chance become features, and a factorization machine learns a weight for each and an
interaction for each pair, such as an insult with a group mentioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.languages import letter_words
from itemloom.llm.texts import map_texts, text_of
from itemloom.runtime import materialize

STEMS = (4, 5, 6)  # first letters of longer words that are terms as well
BITS = 40  # of a hashed term
NONE = -1
THRESHOLD = 0.7
ITERATIONS = 60
STEP = 0.1
PENALTY = 1e-4


@dataclass
class FactorizationMachine:
    """Features are numbers of hashed terms; a text has a feature or has it not."""

    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ascending
    intercept: float = -math.inf
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def scores(self, rows: np.ndarray, features: np.ndarray, count: int) -> np.ndarray:
        """Probabilities of texts from their (row, feature) pairs, each pair once."""
        sums = np.bincount(rows, self.linear[features], count).astype(float)  # whole numbers if there are no pairs
        for weights in self.factors.T:
            own = weights[features]
            sums += (np.bincount(rows, own, count) ** 2 - np.bincount(rows, own * own, count)) / 2
        if self.intercept == -math.inf:
            return np.zeros(count)
        return 1.0 / (1.0 + np.exp(-np.clip(sums + self.intercept, -700, 700)))


def _hashed(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) >> (64 - BITS)


def word_terms(words: list[str]) -> np.ndarray:
    """The hashed terms of each word: itself, and its stems where it is longer."""
    found = np.full((len(words), 1 + len(STEMS)), NONE, np.int64)
    for i, word in enumerate(words):
        found[i, 0] = _hashed(word)
        for k, size in enumerate(STEMS, 1):
            if len(word) > size:
                found[i, k] = _hashed(f"{word[:size]}-")
    return found


def _labelled_terms(rows: DataFrame) -> DataFrame:
    """``label, terms`` of labelled texts."""

    def extract() -> Callable:
        def of(piece: pa.RecordBatch) -> dict:
            words = letter_words(piece.column("text"))
            terms = word_terms(words.distinct.to_pylist())
            lists = []
            for a, b in zip(words.bounds[:-1], words.bounds[1:]):
                found = np.unique(terms[words.index[a:b]])
                lists.append(found[found != NONE])
            return {"label": piece.column("label"), "terms": pa.array(lists, pa.list_(pa.int64()))}

        return of

    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("terms", T.ArrayType(T.LongType()))])
    return map_texts(rows, [F.col("label"), F.col("text")], extract, schema)


def _gain(total: int, positive: int) -> Column:
    """Twice the log-likelihood ratio of a term's labels against those of all texts."""
    rate = positive / total

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    return 2 * (part(p, n * rate) + part(n - p, n * (1 - rate)))


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    most_rows: int = 20_000,
    most_features: int = 4_096,
    factors: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> FactorizationMachine:
    """Learn from the texts of ``docs`` whose ids ``labels`` marks with 0 or 1.

    A classifier is fitted on a bounded sample: about ``most_rows`` labelled rows chosen by a
    hash of the id, with whole texts, and at most ``most_features`` features.  Rows without id
    or label teach nothing; an id labelled twice counts as marked if one label says so.
    Without rows the machine scores 0; without features it scores the share of marked rows.
    """
    marks = labels.select(F.col(doc_id).alias("of"), F.col(label).cast("double").alias("mark"))
    marks = marks.where("of is not null and mark is not null").groupBy("of").agg(F.max("mark").alias("label"))
    marks = materialize(marks, "toxicity-labels")
    share = most_rows / max(1, marks.count())
    unit = F.pmod(F.xxhash64("of", F.lit("toxicity")), F.lit(1 << 20)) / (1 << 20)
    # about most_rows ids, whatever the size of the tables
    sample = F.broadcast(marks.where(unit < share))
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = materialize(_labelled_terms(texts.join(sample, texts["doc_id"] == sample["of"])), "toxicity-terms")
    total, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not total:
        return FactorizationMachine()
    if positive in (0, total):
        return FactorizationMachine(intercept=math.log((positive + 0.5) / (total - positive + 0.5)))
    counted = materialize(
        rows.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
        .where("n > 1"),
        "toxicity-counts",
    )
    chance = math.log(max(2, counted.count()))
    gains = counted.withColumn("gain", _gain(total, int(positive))).where(F.col("gain") > chance)
    best = gains.orderBy(F.desc("gain"), "term").limit(most_features).collect()  # bounded by most_features
    terms = sorted(r.term for r in best)
    if not terms:
        return FactorizationMachine(intercept=math.log(positive / (total - positive)))
    vectors = CountVectorizerModel.from_vocabulary(
        [str(t) for t in terms], inputCol="names", outputCol="features"
    )
    known = rows.withColumn("names", F.col("terms").cast("array<string>"))
    train = materialize(vectors.transform(known).select("label", "features"), "toxicity-vectors")
    trained = FMClassifier(
        factorSize=factors, maxIter=ITERATIONS, stepSize=STEP, regParam=PENALTY, initStd=0.01, tol=1e-5, seed=7
    ).fit(train)
    return FactorizationMachine(
        np.array(terms, np.int64), float(trained.intercept), trained.linear.toArray(), trained.factors.toArray()
    )


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and score (0 to 1, higher where toxic is likelier).

    Only the text is looked at, whole.  Null and empty texts have no terms and score what such
    a text does; null ids and repeated rows are kept; other columns are ignored.
    """
    row = [F.col(doc_id).alias("doc_id"), text_of(text).alias("text")]
    return _scored(docs.select(*row), machine).select("doc_id", "score")


def without_toxic(
    docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD, text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), text_of(text).alias("text"))
    return _scored(packed, machine).where(F.col("score") < threshold).select("doc_id.*")


def _scored(rows: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """``doc_id, score``; doc_id is carried through as it is."""
    sent = rows.sparkSession.sparkContext.broadcast(machine)  # at most most_features rows

    def scorer() -> Callable:
        machine = sent.value
        size = len(machine.terms)

        def score(piece: pa.RecordBatch) -> dict:
            words = letter_words(piece.column("text"))
            count = piece.num_rows
            if not size:
                return {"doc_id": piece.column("doc_id"), "score": machine.scores(np.zeros(0, int), np.zeros(0, int), count)}
            terms = word_terms(words.distinct.to_pylist())
            place = np.minimum(np.searchsorted(machine.terms, terms), size - 1)
            place[machine.terms[place] != terms] = NONE
            useful = (place != NONE).any(axis=1)
            row = np.repeat(np.arange(count), np.diff(words.bounds))
            kept = useful[words.index]
            pairs = row[kept, None] * size + place[words.index[kept]]
            pairs = np.unique(pairs[place[words.index[kept]] != NONE])
            return {"doc_id": piece.column("doc_id"), "score": machine.scores(pairs // size, pairs % size, count)}

        return score

    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]
    )
    return map_texts(rows, [F.col("doc_id"), F.col("text")], scorer, schema)
