"""Cut points of equal-frequency and minimum-support intervals.

A field's distinct numbers, sorted, carry running counts: ``mass(k)`` rows lie
below number ``k``.  A set of bins is a list of start positions, and everything
the two methods need is running counts at a few positions.  Those are looked up
among the positions known so far, at first a coarse index of bounded size; the gap
in which a bin border falls is refined by a bounded number of positions at a time.
Results are exact for any number of distinct values, and what is loaded depends on
the number of bins only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemloom.runtime import materialize

COARSE_ENTRIES = 200_000
GAP_ENTRIES = 64  # positions that one load adds inside a gap

Gap = tuple[int, int]
Points = tuple[np.ndarray, np.ndarray, np.ndarray]


class RunningCounts:
    """Running counts of ``n`` sorted distinct numbers, known at some positions.

    A lookup between known positions is noted in ``missing`` as the gap it falls into and answered by
    interpolation; the caller loads what is missing and asks again.  ``most`` bounds the rows of a number.
    ``load`` returns whole blocks of ``stride`` positions, ``refine`` some positions of each gap.
    """

    def __init__(
        self,
        n: int,
        total: int,
        coarse: np.ndarray,
        numbers: np.ndarray,
        stride: int = 1,
        load: Callable[[list[int]], dict[int, tuple[np.ndarray, np.ndarray]]] | None = None,
        refine: Callable[[list[Gap]], Points] | None = None,
        most: int | None = None,
    ):
        self.n, self.total, self.stride = n, total, stride
        self.most = total if most is None else most
        places = np.arange(0, n, stride, dtype="int64")
        self._points = (
            np.append(places, n),
            np.append(np.asarray(coarse, dtype="int64"), total),
            np.append(np.asarray(numbers, dtype="float64"), math.nan),
        )
        self._refine = refine or (lambda gaps: self._blocks(load, gaps))
        self.missing: set[Gap] = set()

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray) -> "RunningCounts":
        """All in memory."""
        below = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("int64")
        return cls(len(values), int(np.sum(counts)), below, values, most=int(np.max(counts, initial=1)))

    def _blocks(self, load: Callable, gaps: list[Gap]) -> Points:
        found = load(sorted({low // self.stride for low, _ in gaps}))
        places = [block * self.stride + np.arange(len(below)) for block, (below, _) in found.items()]
        return (
            np.concatenate(places),
            np.concatenate([below for below, _ in found.values()]),
            np.concatenate([values for _, values in found.values()]),
        )

    def _note(self, after: np.ndarray) -> None:
        """Note the gaps that end at the known positions of these numbers."""
        places = self._points[0]
        ends = np.unique(after)
        self.missing.update(zip(places[ends - 1].tolist(), places[ends].tolist()))

    def masses(self, ks: np.ndarray) -> np.ndarray:
        places, below, _ = self._points
        at = np.searchsorted(places, np.minimum(ks, self.n))
        found = below[at]
        open_ = places[at] != np.minimum(ks, self.n)
        if open_.any():
            end = at[open_]
            self._note(end)
            share = (ks[open_] - places[end - 1]) * (below[end] - below[end - 1]) // (places[end] - places[end - 1])
            found = found.copy()
            found[open_] = below[end - 1] + share
        return found

    def firsts_reaching(self, masses: np.ndarray) -> np.ndarray:
        """The first positions with at least so many rows below; ``n + 1`` where there is none."""
        places, below, _ = self._points
        at = np.searchsorted(below, np.minimum(masses, self.total))
        open_ = (at > 0) & (masses <= self.total) & (places[at] - places[at - 1] > 1)
        if open_.any():
            self._note(at[open_])
        return np.where(masses > self.total, self.n + 1, places[at])

    def mass(self, k: int) -> int:
        places, below, _ = self._points
        at = min(k, self.n) if len(places) > self.n else int(places.searchsorted(min(k, self.n)))
        return int(below[at]) if places[at] == min(k, self.n) else int(self.masses(np.array([k]))[0])

    def first_reaching(self, mass: int) -> int:
        return int(self.firsts_reaching(np.array([mass]))[0])

    def value(self, k: int) -> float:
        places, _, numbers = self._points
        at = int(np.searchsorted(places, k))
        if places[at] != k:
            self._note(np.array([at]))
            return math.nan
        return float(numbers[at])

    def load_missing(self) -> bool:
        """Fetch positions inside the noted gaps; true when something had been missing."""
        if not self.missing:
            return False
        found = self._refine(sorted(self.missing))
        places, first = np.unique(np.concatenate([self._points[0], found[0]]), return_index=True)
        self._points = (
            places,
            np.concatenate([self._points[1], found[1]])[first],
            np.concatenate([self._points[2], found[2]])[first],
        )
        self.missing.clear()
        return True


def exactly(counts: RunningCounts, step: Callable):
    """Repeat a pure step until it needed nothing that was not loaded."""
    while True:
        result = step()
        if not counts.load_missing():
            return result


# --------------------------------------------------------------------------
# Start positions


def equifrequent_starts(counts: RunningCounts, bins: int, size: int) -> list[int]:
    """Each bin ends at the position whose running count is nearest to its target.

    Enough values stay behind to give every later bin at least one.
    """
    n, target = counts.n, math.ceil(size / bins)
    starts = [0]
    while len(starts) < bins:
        goal = counts.mass(starts[-1]) + target
        end = counts.first_reaching(goal)
        if end <= n and counts.mass(end - 1) + counts.mass(end) >= 2 * goal:
            end -= 1
        end = max(min(end, n - bins + len(starts)), starts[-1] + 1)
        if end >= n:
            break
        starts.append(end)
    return starts


def equisized_starts(counts: RunningCounts, least: int) -> list[int]:
    """Each bin ends as soon as it has ``least`` rows; a short last one joins its neighbour."""
    starts = [0]
    while True:
        end = max(counts.first_reaching(counts.mass(starts[-1]) + least), starts[-1] + 1)
        if end >= counts.n:
            break
        starts.append(end)
    if len(starts) > 1 and counts.total - counts.mass(starts[-1]) < least:
        starts.pop()
    return starts


# --------------------------------------------------------------------------
# Smoothing


def smoothing_pass(counts: RunningCounts, starts: list[int], accept: Callable) -> list[int]:
    """Try to shift every border by one value, from the highest border down.

    A border may take over the value next to it from the fuller bin if ``accept``
    agrees.  Values are used up as the pass moves down: ``reach`` is the highest
    value still unused, ``kept`` says whether the one above it is still at hand.
    """
    starts = starts + [counts.n]
    reach, kept = counts.n - 1, False
    for p in range(len(starts) - 2, 0, -1):
        low, border, high = starts[p - 1 : p + 2]
        left = counts.mass(border) - counts.mass(low)
        right = counts.mass(high) - counts.mass(border)
        if right > left and (reach > border or (reach == border and kept)):
            moved = counts.mass(border + 1) - counts.mass(border)
            if accept(right, left, moved):
                starts[p] = border + 1
            reach, kept = border - 1, False
        elif right < left and border - low >= 2:
            moved = counts.mass(border) - counts.mass(border - 1)
            if accept(left, right, moved):
                starts[p] = border - 1
            reach, kept = border - 3, border - 2 != low
        elif right == left and reach >= border:
            reach, kept = border - 1, False
        else:
            reach, kept = low - 1, False
    return starts[:-1]


@dataclass(frozen=True)
class NearerTo:
    """Accept a move that brings two bins closer together and not farther from the target."""

    target: int
    least = 0

    def __call__(self, fuller: int, emptier: int, moved: int) -> bool:
        before = abs(self.target - fuller) + abs(self.target - emptier)
        after = abs(self.target - fuller + moved) + abs(self.target - emptier - moved)
        return after <= before and abs(fuller - emptier - 2 * moved) < fuller - emptier


@dataclass(frozen=True)
class NotBelow:
    """Accept a move that brings two bins closer together and leaves ``least`` rows behind."""

    least: int

    def __call__(self, fuller: int, emptier: int, moved: int) -> bool:
        return fuller - moved >= self.least and abs(fuller - emptier - 2 * moved) < fuller - emptier


def nearer_to(target: int) -> NearerTo:
    return NearerTo(target)


def not_below(least: int) -> NotBelow:
    return NotBelow(least)


def smooth(counts: RunningCounts, starts: list[int], accept: NearerTo | NotBelow) -> list[int]:
    """Repeat passes until none moves a border; from where all moves go one way, jump to the end.

    Both ways to accept a move ask that the moved value has fewer rows than the two bins differ by;
    two bins that come closer never lie farther from a target, so that clause decides nothing.  Then a
    border may go down if mass(b) + mass(b - 1) > mass(low) + mass(high), with b - low >= 2 and
    mass(b - 1) - mass(low) >= least.  Neighbours that went down only make this easier, and none of it
    lets a border go up that could not before.  So once no border may go up, the moves that remain are
    the same in any order, and the borders end at the highest places from which none may go down.  The
    same holds the other way round while all bins have three values, which they keep if the
    emptiest has three times the rows of any number.
    """
    while True:
        way = exactly(counts, lambda: _only_way(counts, starts, accept))
        if way < 0:
            return [0, *_lowered(counts, counts, starts[1:], accept.least)]
        if way > 0:
            turned = [counts.n - b for b in reversed(starts[1:])]
            return [0, *(counts.n - b for b in reversed(_lowered(counts, _Turned(counts), turned, accept.least)))]
        moved = exactly(counts, lambda: smoothing_pass(counts, starts, accept))
        if moved == starts:
            return starts
        starts = moved


def _only_way(counts: RunningCounts, starts: list[int], accept: Callable) -> int:
    """-1 if no border may go up, 1 if none may go down and every bin keeps three values, else 0."""
    borders = np.array(starts[1:])
    around = [counts.masses(k).tolist() for k in (np.array([*starts, counts.n]), borders - 1, borders + 1)]
    up = down = False
    for p, border in enumerate(starts[1:], 1):
        low, here, high = around[0][p - 1 : p + 2]
        left, right = here - low, high - here
        up = up or (right > left and accept(right, left, around[2][p - 1] - here))
        down = down or (left > right and border - starts[p - 1] >= 2 and accept(left, right, here - around[1][p - 1]))
        if up and down:
            return 0
    if not up:
        return -1
    return int(min(np.diff(around[0])) >= 3 * counts.most)


class _Turned:
    """The same counts read from the last number to the first."""

    def __init__(self, counts: RunningCounts):
        self.counts, self.n, self.total, self.most = counts, counts.n, counts.total, counts.most

    def masses(self, ks: np.ndarray) -> np.ndarray:
        return self.total - self.counts.masses(self.n - ks)

    def firsts_reaching(self, masses: np.ndarray) -> np.ndarray:
        return self.n + 1 - self.counts.firsts_reaching(self.total - masses + 1)


def _lowered(counts: RunningCounts, view: RunningCounts | _Turned, borders: list[int], least: int) -> list[int]:
    """The highest places at or below ``borders`` from which no border may go down.

    Every other border at a time goes as far as its neighbours let it, found by lookups of
    the running counts at once instead of step by step.
    """
    places = np.array(borders, dtype="int64")
    if not least:
        places = _below_ceiling(counts, view, places)
    while True:
        before = places.copy()
        for first in (0, 1):
            own = np.arange(first, len(places), 2)
            fence = np.concatenate([[0], places, [view.n]])
            places[own] = exactly(counts, lambda: _reached(view, fence[own], places[own], fence[own + 2], least))
        if (before == places).all():
            return places.tolist()


def _reached(view: RunningCounts | _Turned, low: np.ndarray, border: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
    """How far each border goes down between fixed neighbours."""
    low_mass = view.masses(low)
    both = low_mass + view.masses(high)
    half = np.minimum(view.firsts_reaching(-(-both // 2)), view.n)
    stop = np.where(view.masses(half) + view.masses(half - 1) <= both, half, half - 1)
    stop = np.maximum(stop, low + 1)
    if least:
        stop = np.maximum(stop, view.firsts_reaching(low_mass + least))
    return np.minimum(border, stop)


def _below_ceiling(counts: RunningCounts, view: RunningCounts | _Turned, places: np.ndarray) -> np.ndarray:
    """Borders brought down to a ceiling that lies above where they end.

    Where no border may go down, mass(b) exceeds the mean of its neighbours' by at most half of
    ``most``.  So border p of B bins has at most total * p / B + most * p * (B - p) / 2 rows below.
    """
    bins = len(places) + 1
    p = np.arange(1, bins)
    ceiling = np.array([(2 * view.total * int(i) + view.most * int(i) * (bins - int(i)) * bins) // (2 * bins) for i in p])
    lowered = exactly(counts, lambda: np.minimum(places, view.firsts_reaching(ceiling + 1) - 1))
    # a bin keeps at least one value
    return np.maximum.accumulate(np.maximum(lowered, p) - p) + p


def closed_bins(counts: RunningCounts, starts: list[int]) -> list[tuple[float, float, int]]:
    """(lowest value, highest value, frequency) of each bin."""
    ends = starts[1:] + [counts.n]

    def read():
        return [
            (counts.value(a), counts.value(b - 1), counts.mass(b) - counts.mass(a))
            for a, b in zip(starts, ends)
        ]

    return exactly(counts, read)


def equifrequent_bins(counts: RunningCounts, bins: int, size: int) -> list[tuple[float, float, int]]:
    starts = exactly(counts, lambda: equifrequent_starts(counts, bins, size))
    if len(starts) > 1:
        starts = smooth(counts, starts, nearer_to(math.ceil(size / bins)))
    return closed_bins(counts, starts)


def equisized_bins(counts: RunningCounts, least: int) -> list[tuple[float, float, int]]:
    starts = exactly(counts, lambda: equisized_starts(counts, least))
    if len(starts) > 1:
        starts = smooth(counts, starts, not_below(least))
    return closed_bins(counts, starts)


# --------------------------------------------------------------------------
# The Spark side


def running_counts_table(values: DataFrame, fields: list[int]) -> DataFrame:
    """``field, k, below, v``: position and running count of every distinct number.

    Equal numbers written differently count as one.  Ranges of (field, number) are
    summed on their own and shifted by the totals of the ranges before them, so
    no task holds a whole field.
    """
    numbers = (
        values.where(F.col("field").isin(fields) & F.col("value_numeric").isNotNull())
        .groupBy("field", F.col("value_numeric").alias("v"))
        .agg(F.sum("frequency").alias("f"))
    )
    ranged = materialize(
        numbers.repartitionByRange("field", "v").withColumn("range", F.spark_partition_id()), "ranged"
    )
    inside = Window.partitionBy("field", "range").orderBy("v")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("field").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per field and range
    shifts = (
        ranged.groupBy("field", "range")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("f").alias("mass"))
        .select(
            "field",
            "range",
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("mass").over(earlier), F.lit(0)).alias("mass_before"),
        )
    )
    placed = ranged.select(
        "field",
        "range",
        "v",
        (F.row_number().over(inside) - 1).alias("row"),
        F.coalesce(F.sum("f").over(before), F.lit(0)).alias("mass"),
        "f",
    )
    return placed.join(F.broadcast(shifts), ["field", "range"]).select(
        "field",
        (F.col("row") + F.col("rows_before")).cast("long").alias("k"),
        (F.col("mass") + F.col("mass_before")).cast("long").alias("below"),
        "v",
        "f",
    )


def load_running_counts(table: DataFrame, fields: list[int], entries: int = COARSE_ENTRIES) -> dict[int, RunningCounts]:
    """A coarse index of at most ``entries`` counts per field, and a loader that refines gaps of it."""
    sizes = {
        row["field"]: row
        for row in table.groupBy("field")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("total"), F.max("f").alias("most"))
        .collect()
    }
    made = {}
    for field in fields:
        if field not in sizes:
            continue
        n = sizes[field]["n"]
        stride = max(1, -(-n // entries))
        own = table.where(F.col("field") == field)

        def refine(gaps: list[Gap], own=own, stride=stride) -> Points:
            at_once = max(1, entries // GAP_ENTRIES)
            parts = [_inside(own, gaps[i : i + at_once], stride) for i in range(0, len(gaps), at_once)]
            return tuple(np.concatenate(column) for column in zip(*parts))

        index = own.where(F.col("k") % stride == 0).select("k", "below", "v").toPandas().sort_values("k")
        made[field] = RunningCounts(
            n,
            sizes[field]["total"],
            index["below"].to_numpy(),
            index["v"].to_numpy(),
            stride,
            refine=refine,
            most=sizes[field]["most"],
        )
    return made


def _inside(own: DataFrame, gaps: list[Gap], stride: int) -> Points:
    """At most GAP_ENTRIES evenly spaced positions inside each gap; a gap lies within one block."""
    rows = [(low // stride, low, high, -(-(high - low) // (GAP_ENTRIES + 1))) for low, high in gaps]
    asked = own.sparkSession.createDataFrame(rows, "block long, low long, high long, step long")
    near = own.where(F.col("k").between(gaps[0][0], gaps[-1][1])).withColumn("block", F.floor(F.col("k") / stride))
    # at most entries / GAP_ENTRIES rows are sent
    found = near.join(F.broadcast(asked), "block").where("k > low AND k < high AND (k - low) % step = 0")
    frame = found.select("k", "below", "v").toPandas()
    return frame["k"].to_numpy("int64"), frame["below"].to_numpy("int64"), frame["v"].to_numpy("float64")


def merge_cut_points(bins: DataFrame) -> DataFrame:
    """Let neighbouring closed bins of an attribute meet half-way between them.

    Input ``attribute, bin, from, to, frequency``; at most a thousand bins each.
    """
    order = Window.partitionBy("attribute").orderBy("bin")
    previous_to, next_from = F.lag("to").over(order), F.lead("from").over(order)
    return bins.select(
        "attribute",
        "bin",
        F.coalesce((previous_to + F.col("from")) / 2.0, F.col("from")).alias("from"),
        F.coalesce((F.col("to") + next_from) / 2.0, F.col("to")).alias("to"),
        F.lit(True).alias("from_inclusive"),
        next_from.isNull().alias("to_inclusive"),
        "frequency",
    )
