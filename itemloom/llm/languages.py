"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The score of a
word is the sum, over all ways to cut it into pieces, of the products of their
probabilities; a forward pass over the word adds them up, for many words and all languages
at once.  A text is the product of its words, and the score of a language its posterior.

The probabilities are learned by expectation maximisation: forward and backward passes over
the counted words give expected counts of pieces, which tasks add up.  Words are the runs of
letters in lower case, cut after ``LONGEST`` letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.texts import Words, in_tasks, map_texts, text_of
from itemloom.runtime import materialize

LONGEST = 32  # letters of a word; longer runs are several words
PIECE = 6  # letters of a piece
CACHED = 1 << 17  # words a task remembers
CELLS = 1 << 19  # words times languages that are worked on at once
SMOOTH = 0.05  # added to every expected count
MOST_CELLS = 1 << 25  # languages times pieces; the model is refused beyond
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def letter_pieces(model: str) -> list[str]:
    """The vocabulary's pieces as lower-case letters, without the sign for a space."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    found = {library.id_to_piece(i).lstrip("▁").lower() for i in range(library.vocab_size())}
    return sorted(p for p in found if p.isalpha() and len(p) <= PIECE)


def crc_rest(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


class Lattice:
    """Finds pieces in many words at once; the last piece number is any other single letter."""

    def __init__(self, pieces: list[str]):
        self.keys = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(self.keys)
        self.keys, self.other = self.keys[self.order], len(pieces)

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def arcs(self, letters: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Start, end, rows and piece numbers, by start; words come longest first."""
        for start in range(letters.shape[1]):
            hashed = np.zeros(len(sizes), np.uint64)
            for end in range(start + 1, min(start + PIECE, letters.shape[1]) + 1):
                live = int(np.searchsorted(-sizes, -end, side="right"))
                if not live:
                    break
                hashed = hashed[:live] * MULTIPLIER + letters[:live, end - 1] + np.uint64(1)
                place = np.searchsorted(self.keys, hashed)
                place[place == len(self.keys)] = 0
                hit = self.keys[place] == hashed
                if end == start + 1:
                    yield start, end, np.arange(live), np.where(hit, self.order[place], self.other)
                elif hit.any():
                    rows = np.flatnonzero(hit)
                    yield start, end, rows, self.order[place[rows]]

    def blocks(self, words: list[str], languages: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers, letters and lengths of bounded parts of the words, longest first."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        step = max(256, CELLS // max(1, languages))
        for at in range(0, len(order), step):
            rows = order[at : at + step]
            letters = np.array([words[i] for i in rows], f"U{int(sizes[rows[0]])}").view(np.uint32)
            yield rows, letters.reshape(len(rows), -1).astype(np.uint64), sizes[rows]

    def log_scores(self, words: list[str], chances: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability in each language."""
        found = np.empty((len(words), chances.shape[1]))
        for rows, letters, sizes in self.blocks(words, chances.shape[1]):
            sums = self._forward(letters, sizes, chances, list(self.arcs(letters, sizes)))
            found[rows] = np.log(sums[sizes, np.arange(len(sizes))])
        return found

    @staticmethod
    def _forward(letters, sizes, chances, arcs) -> np.ndarray:
        sums = np.zeros((letters.shape[1] + 1, len(sizes), chances.shape[1]))
        sums[0] = 1.0
        for start, end, rows, ids in arcs:
            sums[end, rows] += sums[start, rows] * chances[ids]
        return sums

    def expected(self, words: list[str], counts: np.ndarray, chances: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; ``counts`` has words by languages."""
        uses = np.zeros_like(chances)
        for rows, letters, sizes in self.blocks(words, chances.shape[1]):
            arcs = list(self.arcs(letters, sizes))
            sums = self._forward(letters, sizes, chances, arcs)
            weight = counts[rows] / sums[sizes, np.arange(len(sizes))]
            back = np.zeros_like(sums)
            back[sizes, np.arange(len(sizes))] = 1.0
            for start, end, live, ids in reversed(arcs):
                through = back[end, live] * chances[ids]
                back[start, live] += through
                np.add.at(uses, ids, sums[start, live] * through * weight[live])
        return uses


def letter_words(texts: pa.Array) -> Words:
    """Words of letters only, in lower case."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
    words = Words(letters)
    if pc.any(pc.greater(pc.utf8_length(words.distinct), LONGEST)).as_py():
        words = Words(pc.replace_substring_regex(letters, rf"(\pL{{{LONGEST}}})", r"\1 "))
    return words


class LanguageModel:
    """Languages, pieces, and the probabilities of the pieces by language."""

    def __init__(self, languages: list[str], pieces: list[str], chances: np.ndarray):
        self.languages, self.pieces, self.chances = languages, pieces, chances


def learn_languages(
    docs: DataFrame,
    model: str,
    per_language: int = 2_000,
    rounds: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> LanguageModel:
    """Learn from rows with text and lang.

    A classifier is fitted on a bounded sample: about ``per_language`` rows of each language,
    chosen by a hash of the id, whole texts.  The collected tables are languages, and
    languages times pieces; both are checked.
    """
    pieces = letter_pieces(model)
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"),
        F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"),
    ).where("text is not null and lang is not null")
    most = MOST_CELLS // (len(pieces) + 1)
    found = rows.groupBy("lang").count().orderBy("lang").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    languages = [r.lang for r in found]
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    shares = docs.sparkSession.createDataFrame(
        [(r.lang, i, min(1.0, per_language / r["count"])) for i, r in enumerate(found)], "lang string, place int, share double"
    )
    unit = F.pmod(F.xxhash64("key", F.lit("languages")), F.lit(1 << 20)) / (1 << 20)
    sample = rows.join(F.broadcast(shares), "lang").where(unit < F.col("share"))
    words = materialize(_word_counts(sample), "language-words")
    lattice = Lattice(pieces)
    chances = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    for _ in range(rounds):
        uses = np.zeros_like(chances)
        for row in _expected_uses(words, lattice, chances).collect():
            uses[row.piece, row.place] = row.uses
        uses += SMOOTH
        chances = uses / uses.sum(axis=0)
    return LanguageModel(languages, pieces, chances)


def _word_counts(sample: DataFrame) -> DataFrame:
    def count() -> Callable:
        def of(piece: pa.RecordBatch) -> dict:
            words = letter_words(piece.column("text"))
            place = np.repeat(piece.column("place").to_numpy(zero_copy_only=False), np.diff(words.bounds))
            keys, n = np.unique(place.astype(np.int64) << 32 | words.index, return_counts=True)
            return {
                "place": pa.array((keys >> 32).astype(np.int32)),
                "word": words.distinct.take(pa.array(keys & 0xFFFFFFFF)),
                "n": pa.array(n),
            }

        return of

    schema = T.StructType(
        [T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]
    )
    counted = map_texts(sample, [F.col("place"), F.col("text")], count, schema)
    return counted.groupBy("place", "word").agg(F.sum("n").alias("n"))


def _expected_uses(words: DataFrame, lattice: Lattice, chances: np.ndarray) -> DataFrame:
    sent = words.sparkSession.sparkContext.broadcast((lattice, chances))

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, chances = sent.value
        total = np.zeros_like(chances)
        for batch in batches:
            place = batch.column("place").to_numpy()
            counts = np.zeros((len(place), chances.shape[1]))
            counts[np.arange(len(place)), place] = batch.column("n").to_numpy()
            total += lattice.expected(batch.column("word").to_pylist(), counts, chances)
        piece, place = np.nonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"piece": piece.astype(np.int32), "place": place.astype(np.int32), "uses": total[piece, place]}
        )

    found = in_tasks(words, uses, "piece int, place int, uses double")
    return found.groupBy("piece", "place").agg(F.sum("uses").alias("uses"))


def identify_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the posterior, 0 to 1).

    Only the text is looked at.  A text that is null or has no letter is ``und`` with score 0,
    and so is every text if nothing was learned.  Equal posteriors go to the first language in
    order.  Null ids and repeated rows are kept; other columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def identifier() -> Callable:
        model = sent.value
        lattice = Lattice(model.pieces)
        names = [*model.languages, UNKNOWN]
        seen: dict[str, int] = {}  # the first words of the task, which are mostly the frequent ones
        table = np.empty((CACHED, len(model.languages)))

        def scores(words: list[str]) -> np.ndarray:
            place = np.array([seen.get(w, -1) for w in words], np.int64)
            found = table[place]
            new = np.flatnonzero(place < 0)
            found[new] = lattice.log_scores([words[i] for i in new], model.chances)
            kept = new[: CACHED - len(seen)]
            table[len(seen) : len(seen) + len(kept)] = found[kept]
            seen.update({words[i]: len(seen) + k for k, i in enumerate(kept)})
            return found

        def identify(piece: pa.RecordBatch) -> dict:
            words = letter_words(piece.column("text"))
            none = np.diff(words.bounds) == 0
            if model.languages:
                sums = words.sums(scores(words.distinct.to_pylist()))
                best = sums.argmax(axis=1)
                score = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, score, none = np.zeros(len(none), int), np.zeros(len(none)), np.ones(len(none), bool)
            best[none], score[none] = len(names) - 1, 0.0
            return {
                "doc_id": piece.column("doc_id"),
                "lang_pred": pa.array([names[b] for b in best], pa.string()),
                "score": pa.array(score),
            }

        return identify

    return map_texts(docs, [F.col(doc_id).alias("doc_id"), text_of(text).alias("text")], identifier, schema)
