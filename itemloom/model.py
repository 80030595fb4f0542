"""Plain value objects: reader options, attribute specifications, cedents, tasks.

Nothing here touches Spark.  Each object checks itself with ``check()`` and the
operators call that before they plan any work.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum
from fractions import Fraction

# Fixed limits of the data model.
MAX_TEXT = 255
MAX_BINS = 1000
MAX_PAGE = 1000
MAX_LINE_BYTES = 1_000_000
MIN_MEASURE = 0.001


class FieldType(str, Enum):
    NOMINAL = "NOMINAL"
    NUMERIC = "NUMERIC"


@dataclass(frozen=True)
class Field:
    """A column of a data source; ``field`` is its integer id."""

    field: int
    name: str
    type: FieldType


@dataclass(frozen=True)
class CsvOptions:
    separator: str = ","
    encoding: str = "UTF-8"
    quote: str = '"'
    escape: str = '"'
    compression: str | None = None
    # trimmed cells that stand for a missing value; without any, empty cells are empty texts
    null_values: frozenset[str] = frozenset()
    # one for each column; None leaves a column out
    types: tuple[FieldType | None, ...] | None = None
    # a cell may hold line breaks; such files cannot be split, so large inputs
    # without them should say so
    multi_line: bool = True


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def check_name(name: str) -> None:
    require(0 < len(name) <= MAX_TEXT, f"a name needs 1 to {MAX_TEXT} characters: {name!r}")


# --------------------------------------------------------------------------
# Intervals and attribute specifications


@dataclass(frozen=True)
class Border:
    value: float
    inclusive: bool = True


@dataclass(frozen=True)
class Interval:
    start: Border
    end: Border

    def check(self) -> None:
        lo, hi = self.start, self.end
        single_point = lo.value == hi.value and lo.inclusive and hi.inclusive
        require(lo.value < hi.value or single_point, f"invalid interval {self}")

    def contains(self, value: float, just_after: bool = False) -> bool:
        """Membership of ``value`` or, with ``just_after``, of the points right above it."""
        lo, hi = self.start, self.end
        above = value > lo.value or (value == lo.value and (lo.inclusive or just_after))
        below = value < hi.value or (value == hi.value and hi.inclusive and not just_after)
        return above and below


@dataclass(frozen=True)
class AttributeSpec:
    """Base of the six ways to turn a field into an attribute."""

    attribute: int
    name: str
    field: int

    numeric_only = False

    def check(self) -> None:
        check_name(self.name)


@dataclass(frozen=True)
class Simple(AttributeSpec):
    """One item per distinct value."""


@dataclass(frozen=True)
class Enumeration(AttributeSpec):
    """Named groups of texts; the last group that names a text wins."""

    bins: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def check(self) -> None:
        super().check()
        check_bins(self.bins)

    def mapping(self) -> dict[str, str]:
        return {text: name for name, texts in self.bins for text in texts}


@dataclass(frozen=True)
class Intervals(AttributeSpec):
    """Named groups of intervals; the last group that contains a number wins."""

    bins: tuple[tuple[str, tuple[Interval, ...]], ...] = ()

    numeric_only = True

    def check(self) -> None:
        super().check()
        check_bins(self.bins)
        for _, intervals in self.bins:
            for interval in intervals:
                interval.check()


@dataclass(frozen=True)
class Equidistant(AttributeSpec):
    bins: int = 10
    numeric_only = True

    def check(self) -> None:
        super().check()
        check_bin_count(self.bins)


@dataclass(frozen=True)
class Equifrequent(AttributeSpec):
    bins: int = 10
    numeric_only = True

    def check(self) -> None:
        super().check()
        check_bin_count(self.bins)


@dataclass(frozen=True)
class Equisized(AttributeSpec):
    support: float = 0.1
    numeric_only = True

    def check(self) -> None:
        super().check()
        require(
            1.0 / MAX_BINS < self.support <= 1.0,
            f"interval support must lie in (1/{MAX_BINS}, 1]",
        )


def check_bin_count(bins: int) -> None:
    require(0 < bins <= MAX_BINS, f"the number of bins must be 1 to {MAX_BINS}")


def check_bins(bins) -> None:
    check_bin_count(len(bins))
    for name, members in bins:
        check_name(name)
        require(len(members) > 0, f"bin {name!r} is empty")


# --------------------------------------------------------------------------
# Cedents: the pattern of one side of a rule


@dataclass(frozen=True)
class Cedent:
    def attributes(self) -> frozenset[int]:
        return frozenset()

    def __and__(self, other: "Cedent") -> "Cedent":
        return And(self, other)

    def __or__(self, other: "Cedent") -> "Cedent":
        return Or(self, other)

    def __invert__(self) -> "Cedent":
        return Not(self)


@dataclass(frozen=True)
class AnyItem(Cedent):
    """The bare wildcard ``*``; selects no item by itself."""


@dataclass(frozen=True)
class AllOf(Cedent):
    """Every item of one attribute."""

    attribute: int

    def attributes(self) -> frozenset[int]:
        return frozenset({self.attribute})


@dataclass(frozen=True)
class Is(Cedent):
    """One item of one attribute."""

    attribute: int
    item: int

    def attributes(self) -> frozenset[int]:
        return frozenset({self.attribute})


@dataclass(frozen=True)
class And(Cedent):
    left: Cedent
    right: Cedent

    def attributes(self) -> frozenset[int]:
        return self.left.attributes() | self.right.attributes()


@dataclass(frozen=True)
class Or(Cedent):
    left: Cedent
    right: Cedent

    def attributes(self) -> frozenset[int]:
        return self.left.attributes() | self.right.attributes()


@dataclass(frozen=True)
class Not(Cedent):
    operand: Cedent

    def attributes(self) -> frozenset[int]:
        return self.operand.attributes()


# --------------------------------------------------------------------------
# Mining task


@dataclass(frozen=True)
class MiningTask:
    """What to mine.  In the automatic mode, ``auto_min_rows`` keeps supports below so many rows untried.

    ``max_seconds`` bounds a staged search; a stage that is not done by then is cancelled.
    """

    limit: int
    min_confidence: float | None = None
    min_support: float | None = None
    min_lift: float | None = None
    min_length: int = 1
    max_length: int | None = None
    antecedent: Cedent | None = None
    consequent: Cedent | None = None
    prune: bool = False
    auto: bool = False
    auto_min_rows: int = 0
    max_seconds: float | None = None

    def check(self) -> None:
        require(self.limit is not None and self.limit > 0, "the rule limit must be positive")
        for name, value in (("confidence", self.min_confidence), ("support", self.min_support)):
            require(
                (value is None and self.auto) or (value is not None and MIN_MEASURE <= value <= 1),
                f"{name} must lie in [{MIN_MEASURE}, 1]",
            )
        require(self.min_length > 0, "the minimum rule length must be positive")
        require(self.max_seconds is None or self.max_seconds > 0, "the time limit must be positive")
        require(
            (self.max_length is None and self.auto)
            or (self.max_length is not None and self.max_length >= self.min_length),
            "the maximum rule length must not be below the minimum",
        )
        if self.auto or self.prune:
            require(
                self.consequent is not None and len(self.consequent.attributes()) == 1,
                "classification needs exactly one attribute on the right side",
            )

    def length_bound(self, attribute_count: int) -> int:
        """No rule over instances with one item per attribute is longer than its patterns have attributes."""
        sides = [self.antecedent, self.consequent]
        if any(side is None or not side.attributes() for side in sides):
            reachable = attribute_count
        else:
            reachable = sum(len(side.attributes()) for side in sides)
        return reachable if self.max_length is None else min(reachable, self.max_length)


@dataclass(frozen=True)
class StageNote:
    """Why mining stopped: a limit of rules or of time cut a stage of rules up to ``rule_length``.

    ``size`` counts the rules found by then.
    """

    kind: str
    rule_length: int
    size: int


def min_count(min_support: float, n: int) -> int:
    """Smallest count whose share of ``n`` reaches ``min_support``, without float drift."""
    return max(1, math.ceil(Fraction(str(min_support)) * n))
