"""SentencePiece encoding of the merge type by prefix tables, and decoding.

Merging is equal to this: every prefix of a text has one last token.  It is the vocabulary
piece that ends there and, joined to the last token of the prefix before it, survives
merging as the same pair.  So one pass of an automaton over the text lists the pieces that
end at each place, a memoised test of token pairs picks the one that fits, and the ids are
read backwards from the end.  Work is linear in the length of the text.

No merge crosses two neighbouring signs that no piece holds side by side, so the table can
start anew between them; a space after another sign is such a place.  Words, and the runs
they fall into, repeat a lot and are kept in bounded caches of each worker until it gets a
task of another operator.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.texts import TwoGenerations, keep, map_texts, text_of

SPACE = "▁"  # fixed: the sign that stands for a space in pieces
CACHED = 120_000  # young entries of each of a worker's two caches
PIECE = 1 << 21  # bytes of text that are encoded at once
LONGEST = 40  # signs of what is kept in a cache
PAIRS = 1 << 18  # remembered pair tests


class Pieces:
    """A merge-type vocabulary with byte fallback, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        plain = set(range(size)) - set(special) - set(self.bytes.values())
        self.piece = {i: model.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece holds white space after another sign")
        self.shown = {i: p.replace(SPACE, " ") for i, p in self.piece.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.pairs: dict[str, dict] = {p: {} for p in self.id}  # by piece and what stands before it
        self.tested = 0
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) > 1:  # single signs need no search
                self.automaton.add_word(p, (len(p), p, self.pairs[p]))
        self.automaton.make_automaton()
        self.neighbours = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.segments = re.compile(rf"\n?[^{SPACE}\n]+|\n|{SPACE}+[^{SPACE}\n]*")
        if any("\n" in n for n in self.neighbours):
            raise ValueError("a piece joins a line break to another sign")

    def merged(self, text: str) -> list[str]:
        """Pieces by plain merging: the best scored neighbours first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: str | None, piece: str) -> bool:
        """Whether merging leaves the pair as it is; for the first piece, the piece alone."""
        known = self.pairs[piece]
        if before not in known:
            pair = [piece] if before is None else [before, piece]
            fits = self.merged("".join(pair)) == pair
            if self.tested >= PAIRS:  # a memory of bounded size: others are tested again
                return fits
            known[before] = fits
            self.tested += 1
        return known[before]

    def split(self, segment: str) -> list[str]:
        """The pieces of a segment from its prefix table."""
        last = [*segment, None]  # where no longer piece fits, the sign itself ends the prefix; at -1, what is before it
        test, settled = self.compatible, -1
        for end, (size, piece, known) in self.automaton.iter(segment):  # by end, the longest first
            if end == settled:
                continue
            before = last[end - size]
            fits = known.get(before)
            if fits or fits is None and test(before, piece):
                last[end] = piece
                settled = end
        found, end = [], len(segment) - 1
        while end >= 0:
            piece = last[end]
            found.append(piece)
            end -= len(piece)
        return found[::-1]

    def runs(self, segment: str) -> list[str]:
        """The segment cut after a line break and before a last sign, where no piece joins them."""
        parts = []
        if segment[0] == "\n":
            parts, segment = ["\n"], segment[1:]
        if len(segment) > 1 and segment[-2:] not in self.neighbours:
            return [*parts, segment[:-1], segment[-1]]
        return [*parts, segment] if segment else parts

    def ids(self, pieces: list[str]) -> list[int]:
        found = []
        for p in pieces:
            known = self.id.get(p)
            found += [known] if known is not None else [self.bytes[b] for b in p.encode()]
        return found

    def encode(self, text: str) -> list[int]:
        """All ids of a text, without begin or end."""
        return [i for s in self.segmented(text) for r in self.runs(s) for i in self.ids(self.split(r))]

    def segmented(self, text: str) -> list[str]:
        """Words with the space before them; a line break starts a segment without a space."""
        return self.segments.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decoded(self, ids: list[int]) -> str:
        """The text of ids with every space, the first one too."""
        try:
            return "".join([self.shown[i] for i in ids])
        except KeyError:  # bytes, which only together are signs
            found, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            found += [raw.decode(errors="replace")] if raw else []
            raw = bytearray()
            found.append(self.shown[i])
        return "".join(found) + raw.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space put before the first word goes."""
        text = self.decoded(ids)
        return text[1:] if text.startswith(" ") else text


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@cache
def caches_of(path: str) -> tuple[TwoGenerations, TwoGenerations]:
    """The caches of this worker for words and runs; tasks reach them by this name, as closures get copies."""
    keep(__name__, drop_caches)
    return TwoGenerations(CACHED), TwoGenerations(CACHED)


def drop_caches() -> None:
    caches_of.cache_clear()
    pieces_of.cache_clear()


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ``ids`` in decimals joined by commas, decoded.

    ``model`` is the path of a model file that every machine has.  The ids are those of the
    library for the whole text, and ``decoded`` is the text of these ids.  A null or empty
    text has no ids and decodes to the empty text; null ids and repeated rows are kept; other
    columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.StringType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def encoder() -> Callable:
        library = pieces_of(model)
        words, runs = caches_of(model)

        def plain_run(value: str) -> tuple[str, str]:
            ids = library.ids(library.split(value))
            return ",".join(map(str, ids)), library.decoded(ids)

        def run(value: str) -> tuple[str, str]:
            # a run that begins with a space is what a word of its own is made of, and kept once
            kept, key = (words, value[1:]) if value[0] == SPACE and len(value) > 1 else (runs, value)
            made = kept.get(key)
            if made is None:
                made = plain_run(value)
                if len(value) <= LONGEST:
                    kept.put(key, made)
            return made

        def word(value: str) -> tuple[str, str]:
            """Ids and text of a word without its space, or of a line break and what follows."""
            made = words.get(value)
            if made is None:
                made = segment(value if value[0] == "\n" else SPACE + value)
                if len(value) <= LONGEST:
                    words.put(value, made)
            return made

        def segment(value: str) -> tuple[str, str]:
            cut = library.runs(value)
            if len(cut) == 1 and value[0] == SPACE:
                return plain_run(value)  # kept as a word
            parts = [run(r) for r in cut]
            return ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])

        def odd(value: str) -> tuple[str, str]:
            """Ids and text of a text that holds the sign for a space, or white space that is not between two words."""
            parts = [run(s) if len(s) <= LONGEST and s[0] == SPACE else segment(s) for s in library.segmented(value)]
            return ",".join([p[0] for p in parts]), "".join([p[1] for p in parts])

        def plain(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
            """Ids and text of texts whose words are divided by one space, or one line break; each word is looked up once."""
            lists = pc.split_pattern(texts, " ")
            coded = lists.flatten().dictionary_encode()
            known = words.young.get
            made = [known(w) or word(w) for w in coded.dictionary.to_pylist()]

            def joined(k: int, between: str) -> pa.Array:
                of_words = pa.array([m[k] for m in made], pa.string()).take(coded.indices)
                return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, of_words), between)

            return joined(0, ","), joined(1, "")

        def encode(piece: pa.RecordBatch) -> dict:
            texts = piece.column("text")
            spaced = pc.replace_substring(texts, "\n", " \n")
            is_odd = pc.or_(pc.match_substring(texts, SPACE), pc.match_substring_regex(spaced, "^ |  | $|^$"))
            ids, decoded = plain(spaced.filter(pc.invert(is_odd)))
            others = [odd(t) for t in texts.filter(is_odd).to_pylist()]
            if others:
                place = pa.array(np.argsort(np.argsort(is_odd.to_numpy(zero_copy_only=False), kind="stable")))
                ids, decoded = (pa.concat_arrays([a, pa.array([o[k] for o in others], pa.string())]).take(place) for k, a in enumerate((ids, decoded)))
            return {
                "doc_id": piece.column("doc_id"),
                "n_tokens": pc.add(pc.count_substring(ids, ","), pc.not_equal(ids, "").cast(pa.int32())).cast(pa.int64()),
                "ids": ids,
                "decoded": pc.replace_substring_regex(decoded, "^ ", ""),
            }

        return encode

    return map_texts(docs, [F.col(doc_id).alias("doc_id"), text_of(text).alias("text")], encoder, schema, most=PIECE)
