"""Documents with similar sets of word n-grams: an exact Jaccard join and its components.

Documents with equal sets are one class, and only classes are compared.  Two sets of
similarity t share an element among the first floor((1 - t) n) + 1 of either, in any order
common to all; elements that tasks saw often come last in that order, so shared passages
rarely are among the first.  Classes that share such an element and are of nearby size meet in
a tile, which holds one band of sizes and the band below; large tiles are cut into pairs of
blocks.  In a tile, hashed bitmaps of the sets bound the overlap from above by counting
bits.

Only components are wanted, so no step hands over all pairs.  First, pairs that the bitmaps
allow join classes to clusters: each class is paired with the most promising leader of two
groups it falls into; then tiles compare what still lies in different clusters, and hand over a
spanning set of pairs, fewer than a tile has classes.  So every link lies inside one cluster.
Then each cluster gets the sorted arrays of its classes once, and intersecting them decides; what
is found is again a spanning set, of links.  Large clusters are cut into blocks: links inside
blocks come first, then those of one class per component, then what is left between blocks.
Texts are fetched for classes of clusters only.

Elements are 64-bit hashes of n-grams, and classes 63-bit hashes of sorted sets; two sets that
collide are noticed and refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.components import components, join_spread
from itemloom.llm.texts import Words, in_tasks, map_texts, pieces, text_of
from itemloom.runtime import materialize

GRAM = 5
SIMILAR = 75  # per cent of the union that two sets share at least
SUMMARY = 1 << 17  # frequent elements a task hands over
FREQUENT = 1 << 20  # frequent elements of the common order, sent to every task
COUNTED = 1 << 20  # elements that are counted at once
CELLS = 1 << 18  # words of bitmaps that are compared at once
LEADERS = 64  # leaders a class is compared with in the first round
FILTER_BITS = 1 << 24  # of the filter of wanted ids that is sent to every task
TILE = 2_048  # classes of a block of a tile
BLOCK_BYTES = 8 << 20  # bytes of bitmaps of a block of a tile
HELD = 50_000  # pairs a task holds before it hands them on
SMALL = 32  # classes of a tile that is compared with others for being the same
FIRST_BITS = 64
PIECE = 1 << 21  # bytes of text whose sets are made at once


def gram_sets(texts: pa.Array, gram: int = GRAM) -> list[np.ndarray]:
    """The sorted hashes of each text's n-grams; fewer words than n are one n-gram."""
    words = Words(pc.ascii_lower(texts))
    coded = np.array([xxhash.xxh3_64_intdigest(w) for w in words.distinct.to_pylist()], np.uint64)
    flow = coded[words.index] if len(coded) else np.zeros(0, np.uint64)
    size = max(0, len(flow) - gram + 1)
    hashed = np.zeros(size, np.uint64)
    for k in range(gram):
        hashed = _mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + flow[k : k + size])
    found = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if b - a >= gram:
            found.append(np.unique(hashed[a : b - gram + 1]))
        elif b > a:
            value = np.uint64([b - a])
            for word in flow[a:b]:
                value = _mixed(value * np.uint64(0xC2B2AE3D27D4EB4F) + word)
            found.append(value)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def class_of(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) >> 1


def signature(elements: np.ndarray, bits: int = 0) -> np.ndarray:
    """A bitmap of ``bits`` bits, or as many as there are elements, up to the next power of two."""
    bits = bits or max(FIRST_BITS, 1 << int(len(elements) - 1).bit_length())
    place = elements & np.uint64(bits - 1)
    words = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return words


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` words from a longer one of the same elements."""
    return words if len(words) == size else np.bitwise_or.reduce(words.reshape(-1, size), axis=0)


def may_link(n: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, similar: int) -> np.ndarray:
    """Which of the others could share enough: each set bit of one alone is an element of one alone."""
    over = np.minimum(
        n - np.bitwise_count(bits & ~others).sum(axis=1, dtype=np.int64),
        sizes - np.bitwise_count(others & ~bits).sum(axis=1, dtype=np.int64),
    )
    return (100 + similar) * over >= similar * (n + sizes)


def linked(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    """The exact test on sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < similar * len(b) or not len(a):
        return False
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    shared = int((b[place] == a).sum())
    return 100 * shared >= similar * (len(a) + len(b) - shared)


def similar_components(
    docs: DataFrame, similar: int = SIMILAR, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are what lies between white space, with A-Z in lower case.  A text with fewer words
    than ``gram`` is one n-gram; one without words, or null, has none, is linked with nothing
    and has its own id as component.  Two texts link when 100 * overlap >= ``similar`` * union.
    ``component_id`` is the smallest id reachable by links; null ids are never the smallest, and a
    component of null ids only has a null one.  Repeated rows are one class; other columns are
    ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    sketches = materialize(_sketches(rows, gram), "set-sketches")
    members = sketches.where("n is not null").select("doc_id", "n", "cls", "digest")
    classes = materialize(
        members.where("n > 0")
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.first("n").alias("n"),
            F.count(F.lit(1)).alias("rows"),
            F.min("digest").alias("low"),
            F.max("digest").alias("high"),
        ),
        "set-classes",
    )
    if classes.where("low <> high").limit(1).count():
        raise RuntimeError("two different sets have one class number")
    marks = sketches.where("bits is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    tiles = materialize(_tiles(rows, _frequent(sketches), similar, gram), "set-tiles")
    led = materialize(components(_leader_pairs(tiles, marks, similar)), "set-led")
    pairs = materialize(_tile_pairs(tiles, marks, led, similar), "set-pairs")
    clusters = materialize(_merged(led, pairs), "set-clusters")
    sets = _sets_of(clusters.select(F.col("node").alias("a"), F.col("component").alias("b")), rows, classes, gram)
    labels = _links(sets, clusters, similar)
    by_class = classes.join(labels, classes["cls"] == labels["node"], "left").select(
        "cls", "first_id", "rows", F.coalesce("component", "cls").alias("component")
    )
    least = by_class.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("parts"))
    named = join_spread(materialize(by_class, "set-parts"), materialize(least, "set-least"), "component", "parts")
    named = materialize(named.select("cls", "rows", "component_id"), "set-components")
    of_sets = join_spread(members.where("n > 0").select("doc_id", "n", "cls"), named, "cls", "rows")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    alone = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return of_sets.select(*columns).unionByName(alone)


def _sketches(rows: DataFrame, gram: int) -> DataFrame:
    """A row per document: n, class, digest, and the bitmap once a task; and frequent elements."""
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("n", T.LongType()),
            T.StructField("cls", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("bits", T.BinaryType()),
            T.StructField("element", T.LongType()),
            T.StructField("seen", T.LongType()),
        ]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        seen = Summary()
        kind = None
        for batch in batches:
            pa.default_memory_pool().release_unused()
            kind = batch.schema.field("doc_id").type
            for piece in pieces(batch, "text", PIECE):
                sets = gram_sets(piece.column("text"), gram)
                n = [len(s) for s in sets]
                cls, bits, new = [], [], []
                for s in sets:
                    c = class_of(s) if len(s) else None
                    cls.append(c)
                    fresh = c is not None and c not in known
                    bits.append(signature(s).tobytes() if fresh else None)
                    if fresh:
                        known.add(c)
                        new.append(s)
                seen.add(new)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(cls, pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array(bits, pa.binary()),
                        none,
                        none,
                    ],
                    names,
                )
        seen.flush()
        if size := len(seen.values):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(size, kind),
                    pa.nulls(size, pa.int64()),
                    pa.nulls(size, pa.int64()),
                    pa.nulls(size, pa.binary()),
                    pa.nulls(size, pa.binary()),
                    pa.array(seen.values.view(np.int64)),
                    pa.array(seen.counts),
                ],
                names,
            )

    return in_tasks(rows, run, schema)


class Summary:
    """The elements that several sets have, counted in parts; a bounded number of them."""

    def __init__(self):
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.waiting += sets
        self.size += sum(map(len, sets))
        if self.size >= COUNTED:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        values, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.size = [], 0
        often = counts > 1
        values, place = np.unique(np.concatenate((self.values, values[often])), return_inverse=True)
        total = np.bincount(place, np.concatenate((self.counts, counts[often])), len(values)).astype(np.int64)
        top = np.sort(np.argsort(-total, kind="stable")[:SUMMARY])
        self.values, self.counts = values[top], total[top]


def _frequent(sketches: DataFrame) -> np.ndarray:
    """Frequent elements, ascending: at most FREQUENT, whatever the size of the input.

    Which elements these are only decides how much work is saved, never a link.
    """
    seen = sketches.where("element is not null").groupBy("element").agg(F.sum("seen").alias("seen"))
    top = seen.where("seen > 2").orderBy(F.desc("seen"), "element").limit(FREQUENT).select("element").toArrow()
    return np.sort(top.column("element").to_numpy().view(np.uint64))


def first_elements(elements: np.ndarray, frequent: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """The first elements of a set in the common order: rare ones, then frequent ones."""
    need = len(elements) - -(-similar * len(elements) // 100) + 1
    if not len(frequent):
        return elements[:need], elements[:0]
    place = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
    often = frequent[place] == elements
    rare = elements[~often][:need]
    return rare, elements[often][: need - len(rare)]


def _tiles(rows: DataFrame, frequent: np.ndarray, similar: int, gram: int) -> DataFrame:
    """``element, cls, members``: classes by first elements that at least two classes have."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def finder() -> Callable:
        frequent, known = sent.value, set()

        def find(piece: pa.RecordBatch) -> dict | None:
            cls, rare, often = [], [], []
            for s in gram_sets(piece.column("text"), gram):
                c = class_of(s) if len(s) else None
                if c is None or c in known:
                    continue
                known.add(c)
                a, b = first_elements(s, frequent, similar)
                cls.append(c)
                rare.append(a.view(np.int64))
                often.append(b.view(np.int64))
            lists = pa.list_(pa.int64())
            return {"cls": pa.array(cls, pa.int64()), "rare": pa.array(rare, lists), "often": pa.array(often, lists)}

        return find

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("rare", longs), T.StructField("often", longs)])
    found = map_texts(rows, [F.col("text")], finder, schema, most=PIECE)
    exploded = found.select(
        "cls",
        F.explode(
            F.concat(
                F.transform("rare", lambda e: F.struct(e.alias("element"), F.lit(False).alias("often"))),
                F.transform("often", lambda e: F.struct(e.alias("element"), F.lit(True).alias("often"))),
            )
        ).alias("e"),
    ).select("cls", "e.element", "e.often")
    # only rare elements are counted by window; the frequent ones, which very many classes may have, are not
    same = Window.partitionBy("element")
    rare = exploded.where("not often").select(
        "element",
        "cls",
        F.count(F.lit(1)).over(same).alias("members"),
        (F.min("cls").over(same) != F.max("cls").over(same)).alias("shared"),
    )
    often = exploded.where("often").select("element", "cls", F.lit(SMALL + 1).cast("long").alias("members"))
    return rare.where("shared").drop("shared").unionByName(often).distinct()


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with one bit for each id's hash; its size does not depend on the ids."""
    words = ids.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("place")).selectExpr(
        "shiftright(place, 6) AS word", "shiftleft(1L, CAST(place % 64 AS INT)) AS bit"
    )
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for row in found.collect():  # at most FILTER_BITS / 64 rows
        bitmap[row.word] = row.bits
    return bitmap


def _sets_of(pairs: DataFrame, rows: DataFrame, classes: DataFrame, gram: int) -> DataFrame:
    """``cls, elements`` of each class in the pairs: its sorted set, made from one of its documents.

    Most documents are in none.  A filter of fixed size keeps them from being read into sets, and no
    text is shuffled; what the filter lets through by chance the join by class drops.  Filter and
    sets are one step, so that a task needs one worker.
    """
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    ids = materialize(classes.join(wanted, "cls").select("cls", "first_id"), "set-wanted")
    bitmap = rows.sparkSession.sparkContext.broadcast(_filter_of(ids.select(F.xxhash64("first_id").alias("hash"))))

    def marker() -> Callable:
        bits = bitmap.value

        def mark(piece: pa.RecordBatch) -> dict:
            place = piece.column("hash").to_numpy() % FILTER_BITS
            mask = pa.array((bits[place >> 6] >> (place & 63) & 1).astype(bool))
            sets = [s for s in gram_sets(piece.column("text").filter(mask), gram) if len(s)]
            return {"cls": pa.array(map(class_of, sets), pa.int64()), "elements": pa.array((s.tobytes() for s in sets), pa.binary())}

        return mark

    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("elements", T.BinaryType())])
    marked = map_texts(rows, [F.col("text"), F.xxhash64("doc_id").alias("hash")], marker, schema, most=PIECE)
    own = marked.join(ids.select("cls"), "cls", "left_semi")
    # several rows may share the id that stands for a class
    return materialize(own.groupBy("cls").agg(F.first("elements").alias("elements")), "set-elements")


def _leader_pairs(tiles: DataFrame, marks: DataFrame, similar: int) -> DataFrame:
    """Classes with the most promising leader of the groups of their two smallest shared elements."""
    other = F.xxhash64("element")
    keys = tiles.groupBy("cls").agg(F.min("element").alias("one"), F.min(F.struct(other, "element")).alias("two"))
    keys = materialize(keys.select("cls", F.explode(F.array_distinct(F.array("one", "two.element"))).alias("key")), "set-keys")
    # a group of very many classes is led in parts; tiles join what the parts do not
    parts = keys.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts")).where("parts > 1")
    parted = keys.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1))))
    grouped = parted.join(marks, "cls").select("key", "part", "cls", "n", "bits")
    dealt = grouped.repartition("key", "part").sortWithinPartitions("key", "part", "n", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, []
        for piece in (p for batch in batches for p in pieces(batch, "bits")):
            found = []
            columns = (piece.column(c).to_pylist() for c in ("key", "part", "cls", "n", "bits"))
            for key, part, cls, n, raw in zip(*columns):
                if (key, part) != at:
                    at, leaders = (key, part), []
                bits = np.frombuffer(raw, np.uint64)
                best = None
                for leader, its_n, its_bits in leaders:
                    if 100 * its_n < similar * n:
                        continue
                    size = min(len(bits), len(its_bits))
                    mine, its = folded(bits, size), folded(its_bits, size)
                    if may_link(n, mine, np.array([its_n]), its[None], similar)[0]:
                        apart = int(np.bitwise_count(mine ^ its).sum())
                        best = min(best or (apart, leader), (apart, leader))
                if best:
                    found.append((cls, best[1]))
                else:
                    leaders = [*leaders[1 - LEADERS :], (cls, n, bits)]
            yield _pair_batch(found)

    return in_tasks(dealt, run, "a long, b long").distinct()


def _tile_pairs(tiles: DataFrame, marks: DataFrame, labels: DataFrame, similar: int) -> DataFrame:
    """Pairs that join the components of ``labels`` wherever the bitmaps of two classes allow a link."""
    own = labels.withColumnRenamed("node", "cls")
    sized = marks.select("cls", "n", F.octet_length("bits").alias("bytes")).join(own, "cls", "left")
    sized = materialize(sized.withColumn("component", F.coalesce("component", "cls")), "set-sized")
    placed = tiles.join(sized.select("cls", "component"), "cls")
    ends = [F.min("component").alias("low"), F.max("component").alias("high")]
    small = placed.where(F.col("members") <= SMALL).groupBy("element").agg(F.sort_array(F.collect_set("cls")).alias("all"), *ends)
    small = small.where("low <> high").select("all").distinct()
    small = small.select(F.xxhash64("all").alias("tile"), F.explode("all").alias("cls"))
    large = placed.where(F.col("members") > SMALL)
    mixed = large.groupBy("element").agg(*ends).where("low <> high").select("element")
    large = large.join(mixed, "element").select(F.col("element").alias("tile"), "cls")
    rows = materialize(small.unionByName(large).join(sized, "cls"), "tile-rows")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / similar))) + F.lit(1e-9)).cast("int")
    banded = rows.withColumn("home", band).withColumn("band", F.explode(F.array(band, band + 1)))
    # pairs come from bands that hold different components, one class of the band at least
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("bytes") / BLOCK_BYTES))
    groups = banded.groupBy("tile", "band").agg(needed.cast("int").alias("blocks"), F.max("home").alias("top"), *ends)
    groups = materialize(groups.where("top = band and low <> high").select("tile", "band", "blocks"), "tile-groups")
    # a cut band has more than TILE classes or BLOCK_BYTES, so there are few, and their rows stay where they are
    cut = banded.join(F.broadcast(groups.where("blocks > 1")), ["tile", "band"], "left")
    whole = cut.where("blocks is null").drop("blocks").join(groups.where("blocks = 1"), ["tile", "band"])
    cut = cut.where("blocks > 1").unionByName(whole).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # only now the bitmaps, which are most of the bytes
    dealt = cut.join(marks.select("cls", "bits"), "cls").withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "tile", "band", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "home", "cls", "n", "component", "bits"
    )
    key = ["tile", "band", "x", "y"]
    found = in_tasks(dealt.repartition(*key).sortWithinPartitions(*key, "n", "cls"), _spanning(similar), "a long, b long")
    return found.distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int, sized: str) -> Iterator[list[tuple]]:
    """Neighbouring rows that agree in the first columns, if there are two at least; without the first column."""
    at, rows = None, []
    for piece in (p for batch in batches for p in pieces(batch, sized)):
        columns = [piece.column(c).to_pylist() for c in piece.schema.names]
        for row in zip(*columns):
            if at != row[:keys]:
                if len(rows) > 1:
                    yield rows
                at, rows = row[:keys], []
            rows.append(row[1:])
    if len(rows) > 1:
        yield rows


def _spanning(similar: int) -> Callable:
    """Pairs that may link and join all components of a tile that such pairs join; fewer than its rows."""

    def joined(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        band, x, y = rows[0][:3]
        block, home, cls, n, component = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6, 7))
        part = np.unique(component, return_inverse=True)[1]
        size = min(len(r[8]) for r in rows) // 8
        bits = None
        step = max(1, CELLS // size)
        for i in np.flatnonzero(home == band).tolist():
            # sorted by size: smaller ones of this band and the band below, so no pair comes twice
            other = (part[:i] != part[i]) & (100 * n[:i] >= similar * n[i])
            if x != y:
                other &= block[:i] != block[i]
            other = np.flatnonzero(other)
            if len(other) and bits is None:
                bits = np.stack([folded(np.frombuffer(r[8], np.uint64), size) for r in rows])
            for some in (other[k : k + step] for k in range(0, len(other), step)):
                some = some[part[some] != part[i]]
                some = some[may_link(int(n[i]), bits[i], n[some], bits[some], similar)]
                first = np.unique(part[some], return_index=True)[1]
                for j in some[first].tolist():
                    part[part == part[j]] = part[i]
                    yield int(cls[i]), int(cls[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for rows in _groups(batches, 4, "bits"):
            found += joined(rows)
            if len(found) > HELD:
                yield _pair_batch(found)
                found = []
        yield _pair_batch(found)

    return run


def _compare(nearest: bool, similar: int) -> Callable:
    """All pairs of a tile that may link, in bounded batches; the components need only ``_spanning``."""

    def pairs(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For one row after the other: its place, the places it may link with, and how far those are."""
        band, x, y = rows[0][:3]
        block, home, n, component = (np.array([r[k] for r in rows]) for k in (3, 4, 6, 7))
        if len(set(component.tolist())) < 2:
            return
        size = min(len(r[8]) for r in rows) // 8
        bits = np.stack([folded(np.frombuffer(r[8], np.uint64), size) for r in rows])
        step = max(1, CELLS // size)
        for i in np.flatnonzero(home == band).tolist():
            # smaller ones of both bands, and larger ones only below this band, so no pair comes twice
            other = (component != component[i]) & (100 * np.minimum(n, n[i]) >= similar * np.maximum(n, n[i]))
            other &= (np.arange(len(rows)) < i) | (home != band)
            if x != y:
                other &= block != block[i]
            other = np.flatnonzero(other)
            for part in (other[k : k + step] for k in range(0, len(other), step)):
                part = part[may_link(int(n[i]), bits[i], n[part], bits[part], similar)]
                if nearest and len(part):
                    apart = np.bitwise_count(bits[i] ^ bits[part]).sum(axis=1, dtype=np.int64)
                    # the most promising of each component it may link with
                    order = np.lexsort((apart, component[part]))
                    first = np.unique(component[part][order], return_index=True)[1]
                    yield i, part[order][first], apart[order][first]
                elif len(part):
                    yield i, part, np.zeros(len(part), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs in bounded batches; with ``nearest`` one per two components, as far as is remembered."""
        for rows in _groups(batches, 4, "bits"):
            held: dict[tuple, tuple[int, int, int]] = {}
            for i, others, apart in pairs(rows):
                cls, own = rows[i][5], rows[i][7]
                for j, d in zip(others.tolist(), apart.tolist()):
                    pair = (min(cls, rows[j][5]), max(cls, rows[j][5]))
                    key = (min(own, rows[j][7]), max(own, rows[j][7])) if nearest else pair
                    if key not in held or d < held[key][0]:
                        held[key] = (d, *pair)
                if len(held) > HELD:
                    yield _pair_batch((a, b) for _, a, b in held.values())
                    held = {}
            yield _pair_batch((a, b) for _, a, b in held.values())

    return run


def _pair_batch(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_pydict(
        {"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())}
    )


def _links(sets: DataFrame, clusters: DataFrame, similar: int) -> DataFrame:
    """``node, component`` of the classes that links join; all links lie inside ``clusters``."""
    sizes = sets.select("cls", F.octet_length("elements").alias("bytes"))
    held = materialize(sizes.join(clusters.select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "cls"), "set-held")
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("bytes") / BLOCK_BYTES))

    def blocked(rows: DataFrame) -> DataFrame:
        # a cut cluster has more than TILE classes or BLOCK_BYTES, so there are few
        cut = rows.groupBy("cluster").agg(needed.cast("int").alias("blocks")).where("blocks > 1")
        cut = materialize(cut, "set-cuts")
        found = rows.join(F.broadcast(cut), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return found.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))

    def named(rows: DataFrame, labels: DataFrame) -> DataFrame:
        own = rows.drop("component").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        return own.withColumn("component", F.coalesce("component", "cls"))

    def still_apart(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return materialize(ends.where("low <> high").select("cluster"), "set-apart")

    placed = materialize(blocked(held), "set-blocks")
    inside = placed.withColumn("component", F.col("cls")).withColumns({"x": F.col("block"), "y": F.col("block")})
    labels = materialize(components(_decided(inside.join(sets, "cls"), similar)), "set-labels")
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return labels
    large = materialize(named(large, labels), "set-large")
    speakers = large.groupBy("component").agg(F.min("cls").alias("cls")).select("cls")
    spoken = blocked(large.drop("blocks", "block").join(speakers, "cls", "left_semi"))
    edges = _decided(spoken.withColumns({"x": F.col("block"), "y": F.col("block")}).join(sets, "cls"), similar)
    labels = materialize(_merged(labels, materialize(edges, "set-edges")), "set-labels")
    large = named(large, labels)
    rest = large.join(F.broadcast(still_apart(large)), "cluster")
    # each set is fetched once, and then goes to all blocks it meets
    between = rest.join(sets, "cls").withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).where("with <> block")
    between = between.withColumns({"x": F.least("block", "with"), "y": F.greatest("block", "with")})
    return materialize(_merged(labels, materialize(_decided(between, similar), "set-edges")), "set-labels")


def _decided(rows: DataFrame, similar: int) -> DataFrame:
    """Links that join all components of a block, or of two, that links join; fewer than its rows."""
    key = ["cluster", "x", "y"]
    size = F.octet_length("elements")
    dealt = rows.select(*key, "block", "cls", "component", "elements").repartition(*key)

    def joined(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        x, y = rows[0][:2]
        block, cls, component = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
        part = np.unique(component, return_inverse=True)[1]
        if not part.any():
            return
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        n = np.array([len(s) for s in sets])
        # several bits an element, as far as all bitmaps together stay small
        room = max(FIRST_BITS, 8 * BLOCK_BYTES // len(rows))
        size = min(1 << int(4 * n.max() - 1).bit_length(), 1 << (room.bit_length() - 1))
        size = max(FIRST_BITS, size)
        bits = np.stack([signature(s, size) for s in sets])
        step = max(1, CELLS // (size // 64))
        for i in range(1, len(rows)):
            other = (part[:i] != part[i]) & (100 * n[:i] >= similar * n[i])
            if x != y:
                other &= block[:i] != block[i]
            other = np.flatnonzero(other)
            for some in (other[k : k + step] for k in range(0, len(other), step)):
                some = some[part[some] != part[i]]
                some = some[may_link(int(n[i]), bits[i], n[some], bits[some], similar)]
                apart = np.bitwise_count(bits[i] ^ bits[some]).sum(axis=1, dtype=np.int64)
                for j in some[np.argsort(apart, kind="stable")].tolist():
                    if part[j] != part[i] and linked(sets[i], sets[j], similar):
                        part[part == part[j]] = part[i]
                        yield int(cls[i]), int(cls[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for rows in _groups(batches, 3, "elements"):
            found += joined(rows)
            if len(found) > HELD:
                yield _pair_batch(found)
                found = []
        yield _pair_batch(found)

    return in_tasks(dealt.sortWithinPartitions(*key, size, "cls"), run, "a long, b long")


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges: components of the components."""
    node = labels.select("node", "component")
    ends = edges.join(node.withColumnRenamed("component", "ca"), F.col("a") == F.col("node"), "left").drop("node")
    ends = ends.join(node.withColumnRenamed("component", "cb"), F.col("b") == F.col("node"), "left").drop("node")
    ends = materialize(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "set-ends")
    joined = components(ends).select(F.col("node").alias("old"), F.col("component").alias("new"))
    kept = node.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    added = joined.join(node, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return kept.unionByName(added)


def one_of_each(
    docs: DataFrame, similar: int = SIMILAR, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the row with the smallest id, once.

    Rows of equal id and text count as one; ids that are null come after all others, and rows
    that share an id but not the text are told apart by their text.
    """
    key = F.struct(
        F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.unhex(F.md5(text_of(text).cast("binary"))).alias("hash")
    )
    packed = docs.select(
        key.alias("doc_id"), text_of(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    found = similar_components(packed.select("doc_id", "text"), similar, gram)
    stays = materialize(found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("of")).distinct(), "set-stays")
    joined = packed.join(stays, packed["doc_id"] == stays["of"])
    return joined.groupBy("of").agg(F.first("row").alias("row")).select("row.*")
