"""Line deduplication by a tree of line templates.

A line is parsed down a tree of fixed depth: by its number of words, then by its leading words,
where a word with a digit counts as a variable field.  The lines of a leaf fall into
templates: a line belongs to the first template whose seed agrees with it at enough places, and
what differs is a variable field.  A template that occurs in several documents is dropped from
all of them but the first by doc_id, which keeps its constant words; the other documents' values
of its fields go with their lines.

Only a template with enough constant words stands for its lines.  Where the fields carry the
content, as in short lines and in rows of numbers, a line repeats another one only if all its
words are the same, digits included.

Lines are deduplicated inside a task before they travel.  The lines of every leaf are taken in
the order of their hashes.  A leaf with a large share of all lines is taken in ranges of that
order: parts compare the lines of a range with the seeds of the ranges before it, and only lines
that agree with none of them meet in one task.  That leads to the seeds of a single pass, so the
size of a leaf does not change its templates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.components import HOT, join_spread
from itemloom.llm.texts import in_tasks, map_texts, text_of
from itemloom.runtime import materialize, union_all

LEADING = 3  # words of the path to a leaf, after the number of words
AGREE = 0.8  # share of places at which a line agrees with the seed of its template
CONSTANT = 8  # constant words that a template needs at least
SHARE = 0.5  # share of its words that have to be constant
PARTS = 16  # parts of a hot leaf
RANGES = (b"\x01", b"\x10")  # bounds of the ranges of a hot leaf; each is PARTS times the one before
SEED, GROW, COMPARE = range(3)  # a known seed, a line that may become one, a line only compared
FIELD = b"<*>"
DIGIT = re.compile(rb"[0-9]")


def parsed(line: bytes) -> list[bytes]:
    """The words of a line between ASCII white space, with variable fields marked."""
    words = line.split()
    if DIGIT.search(line):
        words = [FIELD if DIGIT.search(w) else w for w in words]
    return words


def leaf_of(words: list[bytes]) -> int:
    path = b" ".join([b"%d" % len(words), *words[:LEADING]])
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def telling(constant: int, words: list[bytes]) -> bool:
    """Whether so many constant words of a line are enough for a template."""
    return constant >= CONSTANT and constant >= SHARE * len(words)


def form_of(line: bytes) -> tuple[list[bytes], bool]:
    """The words that lines have in common if they are repetitions, and whether they are a template's.

    A line with too few constant words keeps the others as they are.
    """
    words = parsed(line)
    if telling(len(words) - words.count(FIELD), words):
        return words, True
    return line.split(), False


def agree(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two lines of as many words belong to one template."""
    if sum(map(bytes.__eq__, a, b)) < AGREE * len(a):
        return False
    return telling(sum(x == y != FIELD for x, y in zip(a, b)), a)


def template(lines: list[list[bytes]]) -> list[bytes]:
    """The words that all lines of a template share, and fields between them."""
    return [words[0] if len(set(words)) == 1 else FIELD for words in zip(*lines)]


def _lines_of(value: str) -> Iterator[tuple[int, list[bytes], bool]]:
    for place, line in enumerate(value.encode().split(b"\n")):
        words, of_template = form_of(line)
        if words:
            yield place, words, of_template


def _line_table(rows: DataFrame) -> DataFrame:
    """``key, place, leaf, form``: a row for every line with words."""

    def finder() -> Callable:
        def find(piece: pa.RecordBatch) -> dict:
            places, leaves, forms = [], [], []
            for value in piece.column("text").to_pylist():
                found = list(_lines_of(value))
                places.append([p for p, _, _ in found])
                leaves.append([leaf_of(w) for _, w, _ in found])
                forms.append([xxhash.xxh3_128_digest(b" ".join(w)) for _, w, _ in found])
            return {
                "key": piece.column("key"),
                "places": pa.array(places, pa.list_(pa.int32())),
                "leaves": pa.array(leaves, pa.list_(pa.int64())),
                "forms": pa.array(forms, pa.list_(pa.binary())),
            }

        return find

    schema = T.StructType(
        [
            T.StructField("key", rows.schema["key"].dataType),
            T.StructField("places", T.ArrayType(T.IntegerType())),
            T.StructField("leaves", T.ArrayType(T.LongType())),
            T.StructField("forms", T.ArrayType(T.BinaryType())),
        ]
    )
    found = map_texts(rows, [F.col("key"), F.col("text")], finder, schema)
    line = F.explode(F.arrays_zip("places", "leaves", "forms")).alias("line")
    return found.select("key", line).select(
        "key", F.col("line.places").alias("place"), F.col("line.leaves").alias("leaf"), F.col("line.forms").alias("form")
    )


def _forms(rows: DataFrame) -> DataFrame:
    """``leaf, form, line``: the parsed lines that may belong to a template, each once a task."""

    def finder() -> Callable:
        known: set[bytes] = set()

        def find(piece: pa.RecordBatch) -> dict:
            leaves, forms, lines = [], [], []
            for value in piece.column("text").to_pylist():
                for _, words, of_template in _lines_of(value):
                    if not of_template:
                        continue
                    line = b" ".join(words)
                    form = xxhash.xxh3_128_digest(line)
                    if form not in known:
                        known.add(form)
                        leaves.append(leaf_of(words))
                        forms.append(form)
                        lines.append(line)
            return {"leaf": pa.array(leaves, pa.int64()), "form": pa.array(forms, pa.binary()), "line": pa.array(lines, pa.binary())}

        return find

    schema = T.StructType(
        [T.StructField("leaf", T.LongType()), T.StructField("form", T.BinaryType()), T.StructField("line", T.BinaryType())]
    )
    return map_texts(rows, [F.col("text")], finder, schema)


def _parse_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by leaf and part, in order of role and form: the seed of each form that is not a known seed.

    A form that is only compared has a null seed if it agrees with none.  Such forms and new
    seeds keep their line.
    """
    at, seeds, last = None, [], None
    for batch in batches:
        leaves, forms, found, lines = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("leaf", "part", "role", "form", "line"))
        for leaf, part, role, form, line in zip(*columns):
            if (leaf, part) != at:
                at, seeds, last = (leaf, part), [], None
            if form == last:
                continue  # the same line from another task
            last = form
            words = line.split(b" ")
            if role == SEED:
                seeds.append((form, words))
                continue
            seed = next((s for s, its in seeds if agree(words, its)), None)
            if seed is None and role == GROW:
                seeds.append((form, words))
                seed = form
            leaves.append(leaf)
            forms.append(form)
            found.append(seed)
            lines.append(line if seed in (None, form) else None)
        yield pa.RecordBatch.from_pydict(
            {
                "leaf": pa.array(leaves, pa.int64()),
                "form": pa.array(forms, pa.binary()),
                "seed": pa.array(found, pa.binary()),
                "line": pa.array(lines, pa.binary()),
            }
        )


def _in_leaves(rows: DataFrame) -> DataFrame:
    """``leaf, form, seed, line`` of ``leaf, part, role, form, line`` rows, a task for each leaf and part."""
    dealt = rows.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "role", "form")
    return in_tasks(dealt, _parse_leaves, "leaf long, form binary, seed binary, line binary")


def _seeds(forms: DataFrame, hot: DataFrame) -> DataFrame:
    """``form, seed`` for the forms that share a template with others.

    The seed is the one that a single pass over the leaf in order of form finds.
    """
    spread = F.pmod(F.xxhash64("form"), F.lit(PARTS)).cast("int")
    whole = F.lit(PARTS)  # the part of lines that meet in one task
    later = F.coalesce("hot", F.lit(False)) & (F.col("form") >= F.lit(RANGES[0]))
    # fewer than HOT leaves, so they may go to every task
    dealt = forms.join(F.broadcast(hot), "leaf", "left").select(
        "leaf", F.when(later, spread).otherwise(whole).alias("part"), F.when(later, COMPARE).otherwise(GROW).alias("role"), "form", "line"
    )
    # later ranges have no seeds to meet here, and only lose what several tasks sent
    parsed_leaves = _in_leaves(dealt).join(F.broadcast(hot), "leaf", "left").where("hot or form <> seed")
    first = materialize(parsed_leaves.select("leaf", "form", "seed", F.when(F.col("hot"), F.col("line")).alias("line")), "line-seeds")
    steps = [first.where("seed is not null")]
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    for low, high in zip(RANGES, (*RANGES[1:], None)):
        of_range = first.where(F.col("seed").isNull() & (F.col("form") >= F.lit(low)))
        if high is not None:
            of_range = of_range.where(F.col("form") < F.lit(high))
        known = union_all([s.where("form = seed").select("leaf", parts, F.lit(SEED).alias("role"), "form", "line") for s in steps])
        compared = of_range.select("leaf", spread.alias("part"), F.lit(COMPARE).alias("role"), "form", "line")
        met = materialize(_in_leaves(known.unionByName(compared)), "line-met")
        left = met.where("seed is null").select("leaf", whole.alias("part"), F.lit(GROW).alias("role"), "form", "line")
        steps += [met.where("seed is not null"), materialize(_in_leaves(left), "line-grown")]
    return union_all([s.select("form", "seed") for s in steps]).where("form <> seed")


def dropped_lines(rows: DataFrame) -> DataFrame:
    """``key, places`` of the lines to drop, from ``key, text`` rows with a key per document."""
    lines = materialize(_line_table(rows), "lines")
    forms = materialize(
        lines.groupBy("form").agg(
            F.first("leaf").alias("leaf"), F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")
        ),
        "line-forms",
    )
    total = forms.count()
    leaves = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    hot = materialize(leaves.where(F.col("size") * HOT > total).select("leaf", F.lit(True).alias("hot")), "line-leaves")
    seeds = materialize(_seeds(_forms(rows), hot), "line-templates")
    named = materialize(
        forms.join(seeds, "form", "left").select("form", "low", "high", "n", F.coalesce("seed", "form").alias("seed")), "line-named"
    )
    whole = named.groupBy("seed").agg(F.min("low").alias("holder"), F.max("high").alias("other"), F.count(F.lit(1)).alias("forms"))
    repeated = materialize(whole.where("holder <> other").select("seed", "holder", "forms"), "line-repeated")
    holders = materialize(join_spread(named.select("form", "n", "seed"), repeated, "seed", "forms").select("form", "n", "holder"), "line-holders")
    found = join_spread(lines.select("key", "place", "form"), holders, "form", "n").where("key <> holder")
    return found.groupBy("key").agg(F.collect_list("place").alias("places"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as ``row``, with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines end at a line feed.  Lines without words always stay, and are not counted.  Lines with
    too few constant words for a template repeat only lines of the same words.  Rows of equal id
    and text are one document.  Null ids come after all others in the order of documents.  A
    null text has no lines and stays null; an empty one stays empty; a document whose every
    line is dropped stays with what is left, which may be empty.
    """
    key = F.struct(
        F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.unhex(F.md5(text_of(text).cast("binary"))).alias("hash")
    )
    packed = docs.select(
        key.alias("key"), F.col(text).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    drop = dropped_lines(packed.select("key", F.coalesce("text", F.lit("")).alias("text")))
    drop = drop.withColumnRenamed("key", "of")
    same = packed["key"].eqNullSafe(drop["of"])
    joined = packed.join(drop, same, "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places"))
    left = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    count = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return joined.select(
        "row",
        F.when(F.col("places").isNull(), F.col("text")).otherwise(left).alias("kept_text"),
        F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with the repeated lines dropped from the text.

    A column of the name ``n_chars`` is set to the new length.
    """
    found = drop_repeated_lines(docs, doc_id, text)
    made = {text: F.col("kept_text")}
    if n_chars in docs.columns:
        made[n_chars] = F.char_length("kept_text").cast(docs.schema[n_chars].dataType)
    return found.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
