"""Merkle manifest of a table: leaves in the order of their ids, runs of 16, a tree of each source.

A level of all trees is one table with a row per node.  Windows over small blocks of neighbouring
runs supply siblings: lag and lead columns at fixed offsets, masked by a node's slot in its run and by
the run's length.  The first child of each run hashes the parent, so a level is a sixteenth of the
one below.  Proofs are put together from the root down: the path of a run rides on one extra row
before its first child.  Blocks, not sources, are what a task holds, so a source may be of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemloom.llm.components import join_spread
from itemloom.runtime import materialize, number_rows

FAN = 16
BLOCK = FAN**2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed: what a leaf covers, in order
PATH = "struct<path: array<struct<left: string, right: string>>, subroot: string>"


def sha256(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row, or the one it would have with another text."""
    values = [text if text is not None and name == "text" else F.col(name) for name in FIELDS]
    return sha256(*[field(v) for v in values])


@dataclass(frozen=True)
class Manifest:
    """All nodes of the trees, level by level.

    ``levels[0]`` has the leaves (tree, pos, size, hash, doc_id and the carried columns), each further one
    the parents; ``tops`` are the levels of the tree over the subroots, in the order of the sources.
    """

    levels: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def build_manifest(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of ``docs``; ``carried`` are further columns that leaves keep.

    Within a source, null ids come first and rows of equal id are ordered by their leaf, so repeated
    rows are leaves of their own and their order does not matter.  A null source is a source.  An
    empty table has no root.  Columns other than those a leaf covers are ignored.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"), field(F.col("source")).alias("key"), F.col("source").alias("of"),
        leaf_digest().alias("hash"), *[c.alias(n) for n, c in carried.items()],
    )
    order = [F.col("of").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("hash")]
    placed = number_rows(rows, order, "n", start=0).drop("of")
    # the first number of a source names its tree, so trees are in the order of the sources
    trees = materialize(placed.groupBy("key").agg(F.min("n").alias("tree"), F.count(F.lit(1)).alias("size")), "trees")
    leaves = join_spread(placed, trees, "key", "size").select(
        "tree", (F.col("n") - F.col("tree")).alias("pos"), "size", "hash", F.col("id").alias("doc_id"), *carried
    )
    levels = _levels(materialize(leaves, "leaves"))
    ends = levels[0].where("size = 1").select("tree", "hash")
    for level in levels[1:]:
        ends = ends.unionByName(level.where("size = 1").select("tree", "hash"))
    subroots = number_rows(ends.withColumnRenamed("tree", "of"), ["of"], "pos", start=0)
    tops = _levels(materialize(subroots.select(F.lit(0).cast("long").alias("tree"), "pos", F.lit(trees.count()).alias("size"), "hash", "of"), "subroots"))
    top = tops[-1].where("size = 1").first()
    return Manifest(levels, tops, top["hash"] if top else None)


def prove(manifest: Manifest) -> DataFrame:
    """Each leaf with ``subroot`` and ``path``: from the run of the leaf to that of the root, the hashes
    of a node's siblings before and after it as joined text.  All columns of leaves are kept."""
    root = manifest.tops[-1].where("size = 1")
    above = root.select("tree", F.lit(None).cast(PATH).alias("upper"))
    subroots = _paths(manifest.tops, above).select(
        F.col("of").alias("tree"), F.struct("path", F.col("hash").alias("subroot")).cast(PATH).alias("upper")
    )
    return _paths(manifest.levels, materialize(subroots, "subroot-paths"))


def fold(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda node, step: sha256(step["left"], node, step["right"]))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, left to right and level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def audit_documents(docs: DataFrame, tampered: Column, tampered_text: Column) -> DataFrame:
    """Prove every row, and fold the leaf it has after tampering: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified.

    One row per row of ``docs``.  Rows where ``tampered`` is not true (null ids among them) are folded
    from their own leaf.  A text that tampering leaves as it is still verifies.
    """
    other = F.when(tampered, leaf_digest(tampered_text))
    manifest = build_manifest(docs, other=other)
    root = F.lit(manifest.root).cast("string")
    folded = fold(F.col("path"), F.coalesce("other", "hash")).alias("folded_root")
    found = prove(manifest).select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"), folded
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _slot() -> Column:
    return F.col("pos") % FAN


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """Add ``left`` and ``right``: the joined hashes of the nodes of a run before and after a node."""
    block = Window.partitionBy("tree", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    length = F.least(F.lit(FAN), F.col("size") - F.col("pos") + _slot())
    before = [F.when(_slot() >= k, F.lag("hash", k).over(block)) for k in range(FAN - 1, 0, -1)]
    after = [F.when(_slot() + k < length, F.lead("hash", k).over(block)) for k in range(1, FAN)]
    return nodes.select("*", F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The level itself, and the levels above it until every tree has one node."""
    levels = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        first = _with_siblings(levels[-1].where("size > 1")).where(_slot() == 0)
        parents = first.select(
            "tree",
            F.floor(F.col("pos") / FAN).alias("pos"),
            F.ceil(F.col("size") / FAN).alias("size"),
            sha256(F.col("hash"), F.col("right")).alias("hash"),
        )
        levels.append(materialize(parents, "level"))
        most = -(-most // FAN)
    return levels


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows of the lowest level with ``path`` and ``subroot``; ``above`` has what a tree's root starts from."""
    reached = None
    for depth, level in reversed(list(enumerate(levels))):
        ends = level.where("size = 1").select("tree").join(above, "tree")
        upper = ends.select("tree", F.lit(0).cast("long").alias("pos"), "upper")
        if reached is not None:
            upper = upper.unionByName(reached.select("tree", "pos", F.struct("path", "subroot").cast(PATH).alias("upper")))
        found = _with_upper(level, upper)
        reached = materialize(found.select("tree", "pos", "path", "subroot"), "paths") if depth else found
    return reached


def _with_upper(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Add ``path`` and ``subroot`` to nodes; ``upper`` has those of their parents, by the parent's place.

    A parent's row comes right before the first child of its run and is taken over by the
    rows after it, in the same blocks that the siblings are looked up in.
    """
    heads = upper.select("tree", (F.col("pos") * FAN).alias("pos"), "upper", F.lit(0).alias("kind"))
    both = nodes.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    so_far = Window.partitionBy("tree", F.floor(F.col("pos") / BLOCK)).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    taken = both.withColumn("upper", F.last("upper", ignorenulls=True).over(so_far)).where("kind = 1").drop("kind")
    rest = F.coalesce(F.col("upper.path"), F.array().cast("array<struct<left: string, right: string>>"))
    own = F.when(F.col("size") > 1, F.concat(F.array(F.struct("left", "right")), rest)).otherwise(rest)
    found = _with_siblings(taken).withColumn("path", own)
    return found.select(*nodes.columns, "path", F.col("upper.subroot").alias("subroot"))
