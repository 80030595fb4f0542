"""URL rules by cascades of Bloom filters.

A rule is a host and the start of a path, and lists the key ``host/path``.  The keys a url can fit are
the ends of its host and the starts of its path, cut to the shapes (labels, length of path) that
occur among the rules.  The first filter of a cascade holds the listed keys, the second those keys of
the corpus that wrongly pass the first, the third the listed keys that pass the second, and so on until
none passes wrongly.  As every key of the corpus was tried, membership is exact, and a url is judged
where it is read: filters reach the tasks as one array of bits, and nothing is joined or moved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.runtime import materialize

HASHES = 4
BITS_PER_KEY = 10  # about 1 in 85 other keys passes a filter
MOST_WORDS = 1 << 22  # 32 MB of bits in a cascade: what may be sent to every task
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a url; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column, path: Column) -> Column:
    """A host has no ``/``, so the first one in a key ends it."""
    return F.concat(host, F.lit("/"), path)


@dataclass(frozen=True)
class Level:
    """Where the bits of one filter are in the array of the cascade, and the seed of its hashes."""

    start: int
    words: int
    seed: int


@dataclass(frozen=True)
class Cascade:
    """Filters in one written array; levels with an even number hold listed keys."""

    bits: DataFrame | None
    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Whether a key is listed: exact for listed keys and all keys the cascade was built over."""
        if not self.levels:
            return F.lit(False)
        bits = self.bits.scalar()
        found = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            passes = passes_level(bits, self.levels[number], key)
            found = (passes & found) if number % 2 == 0 else (~passes | found)
        return found


def positions(level: Level, key: Column) -> list[Column]:
    """The bits of a key in a filter, by two halves of one hash."""
    digest = F.xxhash64(F.lit(level.seed), key)
    low, high = digest.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(digest, 32)
    step = high.bitwiseOR(F.lit(1))
    return [F.pmod(low + step * i, F.lit(level.words * 64)) for i in range(HASHES)]


def passes_level(bits: Column, level: Level, key: Column) -> Column:
    word = [F.get(bits, (F.lit(level.start) + F.shiftright(at, 6)).cast("int")) for at in positions(level, key)]
    hits = [F.getbit(w, at.bitwiseAND(F.lit(63)).cast("int")) == 1 for w, at in zip(word, positions(level, key))]
    return reduce(lambda a, b: a & b, hits)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that tells listed keys from all others of the universe; both have a column ``key``.

    Repeated keys count once, null keys are left out.  The universe may hold listed keys.  It is
    read once; only keys that wrongly pass the first filter are written.  An empty list lists nothing.
    """
    keys = materialize(listed.where("key is not null").select("key").distinct(), "listed")
    spark, levels, bits = keys.sparkSession, [], None
    inside, outside = keys, None
    while True:
        holds = inside if len(levels) % 2 == 0 else outside
        count = holds.count()
        if not count:
            break
        start = levels[-1].start + levels[-1].words if levels else 0
        level = Level(start, -(-count * BITS_PER_KEY // 64), len(levels))
        if level.start + level.words > MOST_WORDS:
            raise ValueError(f"filters of more than {MOST_WORDS * 8} bytes are not sent to tasks; split the list")
        levels.append(level)
        bits = _with_level(spark, bits, level, holds)
        passes = passes_level(bits.scalar(), level, F.col("key"))
        if len(levels) % 2 == 0:
            inside = materialize(inside.where(passes), "listed-passing")
        elif outside is None:
            wrong = universe.where("key is not null").where(passes).select("key").distinct()
            outside = materialize(wrong.join(keys, "key", "left_anti"), "others-passing")
        else:
            outside = materialize(outside.where(passes), "others-passing")
    return Cascade(bits, levels)


def _with_level(spark, bits: DataFrame | None, level: Level, keys: DataFrame) -> DataFrame:
    """The array of bits with one more filter; as long as its words, whatever the number of keys."""
    at = keys.select(F.explode(F.array(*positions(level, F.col("key")))).alias("at"))
    set_words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("word")
    )
    words = spark.range(level.words).join(set_words, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    made = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda w: w["word"]).alias("bits"))
    if bits is not None:
        made = made.select(F.concat(bits.scalar(), F.col("bits")).alias("bits"))
    return materialize(made, "filter")


@dataclass(frozen=True)
class UrlFilter:
    """Cascades of blocked and of allowed keys, and the shapes of all rules."""

    blocked: Cascade
    allowed: Cascade
    shapes: list[tuple[int, int]]


def learn_filter(pages: DataFrame, rules: DataFrame, url: str = "url") -> UrlFilter:
    """Cascades for ``rules`` (verdict, host, path), exact on every url of ``pages``."""
    listed = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where("verdict in ('block', 'allow')")
    labels = (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))) + 1
    shaped = listed.select("verdict", key_of(F.col("host"), F.col("path")).alias("key"), labels.alias("labels"), F.length("path").alias("n"))
    shaped = materialize(shaped.where("key is not null"), "rules")
    shapes = sorted((r.labels, r.n) for r in shaped.select("labels", "n").distinct().collect())
    host, path = host_and_path(F.col(url))
    parts = pages.select(host.alias("host"), path.alias("path"))
    empty = F.lit(None).cast("string")
    universe = parts.select(F.explode(F.array(*([_candidate(s) for s in shapes] or [empty]))).alias("key"))
    cascades = [build_cascade(shaped.where(F.col("verdict") == v), universe) for v in ("block", "allow")]
    return UrlFilter(*cascades, shapes)


def _candidate(shape: tuple[int, int]) -> Column:
    """The key of this shape that a url fits, or null if its host or path is too short."""
    labels, length = shape
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    fits = (dots >= labels - 1) & (F.length("path") >= length)
    return F.when(fits, key_of(F.substring_index("host", ".", -labels), F.substring("path", 1, length)))


def judge_urls(pages: DataFrame, known: UrlFilter, url: str = "url") -> DataFrame:
    """All columns of ``pages`` as ``row``, with host, path, rule and verdict.

    The longest rule that fits decides; of equally long ones that with the longer host, and a key both
    blocked and allowed is blocked.  Where no rule fits, the cascades list no key of the url: ``rule`` is
    null and the url allowed.  Null urls and those without ``://`` have an empty host and path.
    Ports and user names are part of the host as written.  Repeated rows are judged alike.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    fits = [_fit(known, shape) for shape in known.shapes]
    nothing = F.lit(None).cast("struct<size: int, labels: int, rule: string, verdict: string>")
    best = F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else nothing
    judged = parts.select("*", best.alias("best"))
    return judged.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def _fit(known: UrlFilter, shape: tuple[int, int]) -> Column:
    """The rule of this shape that a url fits, or null."""
    labels, length = shape
    key = _candidate(shape)
    blocked, allowed = known.blocked.contains(key), known.allowed.contains(key)
    end = F.substring_index("host", ".", -labels)
    rule = F.concat(end, F.substring("path", 1, length))
    found = F.struct(
        F.length(rule).alias("size"), F.length(end).alias("labels"), rule.alias("rule"),
        F.when(blocked, "block").otherwise("allow").alias("verdict"),
    )
    return F.when(key.isNotNull() & (blocked | allowed), found)
