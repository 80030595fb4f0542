"""The manifest against a plain tree over lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from itemloom.llm import merkle
from itemloom.llm.merkle import audit_documents

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos long, size long, hash string, path string, key string, n long"
CLASH = (1, 2, 3, "h", "p", "k", 4)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and for each leaf the levels of its path as (hashes before, hashes after)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, place in zip(paths, at):
            run = runs[place // 16]
            path.append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        at, nodes = [p // 16 for p in at], [sha("".join(run)) for run in runs]
    return (nodes[0] if nodes else None), paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts, subroots = [], []
    for source in sources:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        root, paths = tree([leaf(*r) for r in own])
        parts.append((own, root, paths))
        subroots.append(root)
    root, tops = tree(subroots)
    for (own, subroot, paths), top in zip(parts, tops):
        for row, path in zip(own, paths):
            whole = path + top
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf(*row[:4], lowered(row[4])) if tampered else leaf(*row)
            for before, after in whole:
                node = sha(before + node + after)
            proof = sha("".join(a + b for a, b in whole))
            yield (row[0], leaf(*row), subroot, root, proof, node, node == root)


def check(spark, rows):
    frame = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = audit_documents(frame, tampered, F.translate("text", merkle.UPPER, merkle.LOWER))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected(rows), key=repr)


HARD = [
    (7, "b", "en", 1, "Text"), (3, "b", "en", 1, "Text"), (3, "b", "en", 1, "Text"), (3, "b", "de", None, None), (4, "a", "de", 0, ""),
    (None, "a", None, None, None), (None, None, None, None, None), (None, None, None, None, None), (5, "é", "-", 5, "É — A\x00B"),
    (6, "", "x", -3, "x" * 200_000 + "Y"), (8, "-", "1:-", 0, "-"), (9, "Z", "", 0, "A"), (10, "a" * 50, "en", 0, "B"), (12, "b", "en", 1, "Z"),
]


def test_hard_rows(spark):
    check(spark, HARD)


@pytest.mark.parametrize("rows", [[], [r for r in HARD if r[1] == "b"]], ids=["empty", "one source"])
def test_few_rows(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("count", [16, 257, 1_300])
def test_one_source_has_most_rows(spark, count):
    """Full and short runs at each level, over several blocks of a window."""
    make = random.Random(count)
    rows = [(i, "hot", "en", i, f"Text {make.random()}") for i in make.sample(range(10_000), count)]
    check(spark, rows + HARD)


def test_many_sources(spark):
    check(spark, [(i, f"s{i % 300}", "en", 1, f"T{i}") for i in range(700)])
