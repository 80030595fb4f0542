"""Secret scan with a trigram index in front of the regular expressions.

Every rule is turned into a Boolean query over lower-case trigrams that any match must
contain.  The documents of a piece of a task form one index segment: a trigram's posting
list is the bitmap of the segment's documents that hold it.  Bitmaps are combined as the
query says, and only the remaining candidates are verified with the expression itself.
A rule whose expression has no mandatory trigram has the query ANY and scans every text.

Segments are never merged, as that would send every posting over the network only to send
the candidates back to their texts: the scan needs no shuffle, a lost task repeats its own
segments, and memory is one segment.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.llm.texts import map_texts

ANY = True
MOST_STRINGS = 64  # exact alternatives kept apart while an expression is analysed
MOST_CHARS = 8  # characters of a class that still count as alternatives


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a group of the match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        # re.ASCII: letters in either case are A-Z and a-z only
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        group, least = self.group, self.least
        return [m.span() for m in compiled.finditer(text) if m.end(group) - m.start(group) >= least]


class Login(Rule):
    """A name and a password in an address, of any length; the scheme before it is read backwards."""

    def spans(self, text: str, compiled: re.Pattern) -> list[tuple[int, int]]:
        found, last = [], 0
        for m in compiled.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in SCHEME:
                start -= 1
            while start < m.start() and text[start] not in string.ascii_letters:
                start += 1
            if start < m.start():
                found.append((start, m.end()))
                last = m.end()
        return found


#: The signs of a scheme, which starts with a letter.
SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")

#: The base kinds.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=12,
        group=2,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs of [0-9a-f]+ are maximal, so the short ones need not match
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Login("login", r"://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str):
    """The trigrams any match holds: ANY, a trigram, or ("and" | "or", queries)."""
    exact, query = _analyse(parser.parse(pattern))
    return query if exact is None else _both(query, _of_strings(exact))


def _both(a, b):
    if a is ANY or b is ANY:
        return b if a is ANY else a
    return ("and", (a, b))


def _either(queries: Sequence):
    return ANY if any(q is ANY for q in queries) else ("or", tuple(queries))


def _of_strings(strings: set[str]):
    if any(len(s) < 3 for s in strings):
        return ANY
    return _either([("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))) for s in sorted(strings)])


def _analyse(nodes) -> tuple[set[str] | None, object]:
    """The strings the nodes match if these are few, and what any match must hold.

    ``run`` collects what is surely adjacent; whatever is not a short list of strings ends
    the run, which then becomes a part of the query.
    """
    run, query, whole = {""}, ANY, True
    for kind, value in nodes:
        exact, inner, ends = _analyse_one(kind, value)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            if not ends:
                continue
            exact = None
        query, whole = _both(query, _both(_of_strings(run), inner)), False
        run = {""}
        if exact is not None:
            run = exact
    return (run, query) if whole else (None, _both(query, _of_strings(run)))


def _analyse_one(kind, value) -> tuple[set[str] | None, object, bool]:
    """Strings, query, and whether more may follow that the strings do not show."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY, False
    if kind is op.IN:
        chars = _class_chars(value)
        return chars, ANY, False
    if kind is op.AT:
        return {""}, ANY, False
    if kind is op.SUBPATTERN:
        exact, query = _analyse(value[-1])
        return exact, query, False
    if kind is op.BRANCH:
        parts = [_analyse(p) for p in value[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_STRINGS:
            return set().union(*(e for e, _ in parts)), ANY, False
        return None, _either([q if e is None else _of_strings(e) for e, q in parts]), False
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, body = value
        exact, query = _analyse(body)
        if least == 0:
            return (exact | {""}, ANY, False) if exact is not None and most == 1 else (None, ANY, False)
        if exact is None:
            return None, query, False
        return exact, ANY, most != 1
    return None, ANY, False


def _class_chars(items) -> set[str] | None:
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST_CHARS:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= MOST_CHARS else None


class Segment:
    """The index of some texts; posting lists are made when a query first names them."""

    def __init__(self, texts: pa.Array):
        lower = pc.ascii_lower(texts).cast(pa.large_string())
        self.size = len(texts)
        self.ends = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + self.size + 1].tolist()
        self.data = lower.buffers()[2].to_pybytes() if lower.buffers()[2] else b""
        self.lists: dict[str, np.ndarray] = {}

    def postings(self, trigram: str) -> np.ndarray:
        if trigram not in self.lists:
            self.lists[trigram] = found = np.zeros(self.size, bool)
            needle, data, ends = trigram.encode(), self.data, self.ends
            at = data.find(needle, ends[0])
            while 0 <= at < ends[-1]:
                row = bisect_right(ends, at) - 1
                inside = at + len(needle) <= ends[row + 1]
                if inside:
                    found[row] = True
                at = data.find(needle, ends[row + 1] if inside else at + 1)
        return self.lists[trigram]

    def candidates(self, query) -> np.ndarray:
        if query is ANY:
            return np.ones(self.size, bool)
        if isinstance(query, str):
            return self.postings(query)
        kind, parts = query
        found = self.candidates(parts[0])
        for part in parts[1:]:
            if kind == "and" and not found.any():
                break
            found = found & self.candidates(part) if kind == "and" else found | self.candidates(part)
        return found


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, a list of (kind, start, end).

    Matches of a kind are leftmost and non-overlapping, then those too short are dropped;
    start and end are code points, end exclusive; spans are in order of start, then of
    ``rules``.  A null text is empty and has no spans; a null doc_id is kept; repeated rows
    each give their row; other columns are ignored.
    """
    rules = tuple(rules)
    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("spans", T.ArrayType(span))])

    def scanner() -> Callable:
        ready = [(rule, rule.compiled(), trigram_query(rule.pattern)) for rule in rules]

        def scan(piece: pa.RecordBatch) -> dict:
            texts = pc.fill_null(piece.column("text"), "")
            segment = Segment(texts)
            found: dict[int, list] = {}
            for place, (rule, compiled, query) in enumerate(ready):
                rows = np.flatnonzero(segment.candidates(query))
                for row, value in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist()):
                    for start, end in rule.spans(value, compiled):
                        found.setdefault(row, []).append((start, place, end))
            spans = [
                [{"kind": rules[p].kind, "start": s, "end": e} for s, p, e in sorted(found.get(i, ()))]
                for i in range(len(texts))
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return {"doc_id": piece.column("doc_id"), "spans": pa.array(spans, kind)}

        return scan

    return map_texts(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")], scanner, schema)
