"""The join of similar sets: what a task holds, and blocks cut by the bytes of their bitmaps."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa

from itemloom.llm import similar_sets

MEASURED = """
import resource, sys
import numpy as np, pyarrow as pa
from itemloom.llm import similar_sets as s
make = np.random.default_rng(1)
base = np.unique(make.integers(0, 2**63, 400).astype(np.uint64))
rows = []
for _ in range(s.TILE):
    own = base.copy()
    own[make.integers(0, len(own), 8)] = make.integers(0, 2**63, 8).astype(np.uint64)
    own = np.unique(own)
    rows.append((1, 5, 0, 0, 0, 5, s.class_of(own), len(own), s.class_of(own), s.signature(own).tobytes()))
names = ["tile", "band", "x", "y", "block", "home", "cls", "n", "component", "bits"]
batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
found = sum(b.num_rows for b in s._compare(sys.argv[1] == "nearest", 75)(iter([batch])))
print(found, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_block_of_near_copies_needs_little_memory():
    """All 2,096,128 pairs of a full block may link; a worker stays below 300 MB."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for kind in ("nearest", "all"):
        shown = subprocess.run(
            [sys.executable, "-c", MEASURED, kind], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": home}
        )
        pairs, megabytes = map(int, shown.stdout.split())
        assert pairs == similar_sets.TILE * (similar_sets.TILE - 1) // 2 and megabytes < 300


def test_blocks_by_bytes_lose_no_link(spark, monkeypatch):
    """Very small blocks, by number and by bytes, and hand-overs after few pairs give the same components."""
    make = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [make.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        own = list(base) if i % 3 else [make.choice(words) for _ in range(60)]
        for _ in range(i % 7):
            own[make.randrange(len(own))] = "x"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    usual = sorted(map(tuple, similar_sets.similar_components(docs).collect()))
    for name, value in (("TILE", 4), ("BLOCK_BYTES", 256), ("HELD", 3), ("SMALL", 2)):
        monkeypatch.setattr(similar_sets, name, value)
    assert sorted(map(tuple, similar_sets.similar_components(docs).collect())) == usual


def test_sets_of_pairs_come_back_whole(spark):
    """The sorted arrays that pairs are decided by are those of the texts."""
    import pyarrow as pa

    texts = ["one two three four five six seven", "a b", "", "One two three four five six seven"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = similar_sets.gram_sets(pa.array(texts))
    ids = [similar_sets.class_of(s) for s in sets[:2]]
    pairs = spark.createDataFrame([tuple(sorted(ids))], "a long, b long")
    classes = spark.createDataFrame([(ids[0], 0), (ids[1], 1)], "cls long, first_id long")
    found = {r.cls: np.frombuffer(bytes(r.elements), np.uint64) for r in similar_sets._sets_of(pairs, rows, classes, 5).collect()}
    assert set(found) == set(ids) and all((found[c] == s).all() for c, s in zip(ids, sets))


def test_a_tile_hands_over_fewer_pairs_than_classes():
    """A full block of near copies is joined by 2,047 pairs, not by all 2,096,128 that may link."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = MEASURED.replace('s._compare(sys.argv[1] == "nearest", 75)', "s._spanning(75)")
    shown = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": home})
    pairs, megabytes = map(int, shown.stdout.split())
    assert pairs == similar_sets.TILE - 1 and megabytes < 300


def test_links_of_a_cut_cluster_are_exact(spark, monkeypatch):
    """A cluster in many blocks: links of a chain, and pairs just below the limit that are not links."""
    own = [list(range(i * 5, i * 5 + 40)) for i in range(60)]  # neighbours share 35 of 45 elements, the next but one 30 of 50
    own += [[*range(10_000, 10_030), *range(11_000 + 100 * i, 11_010 + 100 * i)] for i in range(20)]  # 30 of 50
    sets = [np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in own]
    sets = [np.sort(s) for s in sets]
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "cls long, elements binary").repartition(3)
    clusters = spark.createDataFrame([(i, 0) for i in range(len(sets))], "node long, component long")
    for tile in (2_048, 7):
        monkeypatch.setattr(similar_sets, "TILE", tile)
        found = {r.node: r.component for r in similar_sets._links(rows, clusters, 75).collect()}
        assert found == {i: 0 for i in range(60)}


def test_sets_are_made_in_one_step_of_a_task(spark, monkeypatch):
    """Filter and sets are one Python step, so a task keeps one worker, and texts are not joined."""
    plans, whole = {}, similar_sets.materialize

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return whole(df, label)

    monkeypatch.setattr(similar_sets, "materialize", kept)
    texts = ["one two three four five six seven", "a b", "c d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [similar_sets.class_of(s) for s in similar_sets.gram_sets(pa.array(texts))]
    pairs = spark.createDataFrame([tuple(ids[:2])], "a long, b long")
    classes = spark.createDataFrame([(c, i) for i, c in enumerate(ids)], "cls long, first_id long")
    assert {r.cls for r in similar_sets._sets_of(pairs, rows, classes, 5).collect()} == set(ids[:2])
    assert plans["set-elements"].count("MapInArrow") == 1


IDLE = """
import sys
import numpy as np, pyarrow as pa
from itemloom.llm import texts

class Frame:
    class sparkSession:
        class sparkContext:
            environment = {}
    def mapInArrow(self, run, schema):
        return run

def held():
    return int(open("/proc/self/statm").read().split()[1]) * 4 // 1024

def task(batches):
    for batch in batches:
        yield batch.slice(0, 1)

batch = pa.RecordBatch.from_pydict({"a": np.zeros(1 << 20)})
before = held()
made = texts.in_tasks(Frame(), task, "a double", "some")(pa.concat_batches([batch] * 8) for _ in range(3))
for _ in made:
    pass
del _
print(held() - before)
"""


def test_a_worker_gives_memory_back_after_a_task():
    """Batches of 64 MB are not held by a worker that waits."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shown = subprocess.run([sys.executable, "-c", IDLE], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": home})
    assert int(shown.stdout) < 40


def test_bitmaps_and_sets_are_shuffled_once_for_their_tasks(spark, monkeypatch):
    """What decides about blocks holds no bitmaps and no sets; bands without a class of their own are not dealt."""
    columns, dealt, whole = {}, [], similar_sets.materialize

    def kept(df, label):
        columns.setdefault(label, set()).update(df.columns)
        return whole(df, label)

    def seen(df, function, schema, operator=""):
        if "tile" in df.columns:
            dealt.append(whole(df.drop("bits"), "seen").collect())
        return in_tasks(df, function, schema, operator)

    in_tasks = similar_sets.in_tasks
    monkeypatch.setattr(similar_sets, "materialize", kept)
    monkeypatch.setattr(similar_sets, "in_tasks", seen)
    sets = {i: np.arange(100 * i, 100 * i + 40, dtype=np.uint64) for i in (1, 2)}
    tiles = spark.createDataFrame([(7, i, 2) for i in sets], "element long, cls long, members long")
    marks = spark.createDataFrame([(i, 40, bytearray(similar_sets.signature(s, 64).tobytes())) for i, s in sets.items()], "cls long, n long, bits binary")
    labels = spark.createDataFrame([], "node long, component long")
    similar_sets._tile_pairs(tiles, marks, labels, 75).collect()
    assert len(dealt) == 1 and len(dealt[0]) == 2
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "cls long, elements binary")
    similar_sets._links(rows, spark.createDataFrame([(i, 1) for i in sets], "node long, component long"), 75)
    assert not any({"bits", "elements"} & names for label, names in columns.items())
