"""Repair of damaged conversations: the cheapest edits that give an optional system row and then
turns of user and assistant.

A sequence of roles is in one of four states, so a row is a small table of moves between
states, each with its cost and its edits.  Hirschberg's method finds the way through a run of rows: a vector
of four costs comes forward from the start, one comes backward from the end, they meet in
the middle, the cheapest state there (of equals, the one with the least edits before it) is fixed, and both
halves are solved alike.  A run of a long conversation is summed up as one table of moves, runs of
runs as well, and the crossings between them are fixed from the top down, so a task holds a
bounded number of rows however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.components import join_spread
from itemloom.llm.texts import in_tasks
from itemloom.runtime import materialize, number_rows

RUN = 4096  # rows of a run, and runs of a run of runs
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # fixed costs; the last is for kept rows that end early
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the role of the last row
TAILS = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # what completes a sequence in a state
FAULTS = {"b": "blank", "d": "duplicate", "S": "truncated", "U": "truncated", "A": "truncated", "O": "truncated"}
REPAIRED = "conv_id {id}, turn {turn}, role_before string, fault string, edit string, role string, text string"
SUMMARY = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Move = tuple[int, str | int]
Vector = tuple[tuple[int, int] | None, ...]


def after(state: int, initial: str) -> int | None:
    """The state after a row whose role has this initial, or None where it may not come."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _needed(state: int) -> str:
    return "a" if state == USER else "u"


@cache
def row_moves(symbol: str) -> list[dict[int, Move]]:
    """For each state before a row, the states after it with cost and edits.

    A symbol is the role's initial (``o``: any other), upper case for a text that ends early, or
    ``b`` and ``d`` for blank and repeated rows, which have to go.  More than two inserted
    rows lead back to a state that is cheaper to reach.
    """
    table = []
    for start in range(4):
        found: dict[int, Move] = {}
        state = start
        for inserted in range(3):
            options = [(DELETE, "D", state)]
            if symbol not in "bd":
                extra = CUT_OFF if symbol.isupper() else 0
                options.append((KEEP + extra, "K", after(state, symbol.lower())))
                options.append((REROLE + extra, "R", after(state, _needed(state))))
            for cost, letter, reached in options:
                if reached is not None:
                    move = (cost + INSERT * inserted, "I" * inserted + letter)
                    found[reached] = min(found.get(reached, move), move)
            state = after(state, _needed(state))
        table.append(found)
    return table


def moves(node) -> list[dict[int, Move]]:
    """The moves of a row's symbol, or of a run given by its 16 costs and the order of its edits."""
    if isinstance(node, str):
        return row_moves(node)
    costs, orders = node
    return [{t: (costs[4 * s + t], orders[4 * s + t]) for t in range(4) if costs[4 * s + t] >= 0} for s in range(4)]


def _advance(vector: Vector, node) -> Vector:
    """Costs after one more node, and the order of the edits that lead to each state.

    Ways to different states have different edits, and none is the start of another, as each
    ends with the same row; so the order before a node decides unless the state is the same.
    """
    best: list = [None] * 4
    for held, table in zip(vector, moves(node)):
        if held is not None:
            for state, (cost, label) in table.items():
                way = (held[0] + cost, held[1], label)
                if best[state] is None or way < best[state]:
                    best[state] = way
    ranked = sorted(way[1:] for way in best if way)
    return tuple(None if way is None else (way[0], ranked.index(way[1:])) for way in best)


@lru_cache(maxsize=8192)
def _advance_row(vector: Vector, symbol: str) -> tuple[Vector, int]:
    found = _advance(vector, symbol)
    least = min(way[0] for way in found if way)
    return tuple(way and (way[0] - least, way[1]) for way in found), least


def forward(start: int, nodes: Sequence) -> Vector:
    vector: Vector = tuple((0, 0) if s == start else None for s in range(4))
    if not isinstance(nodes, str):
        for node in nodes:
            vector = _advance(vector, node)
        return vector
    total = 0
    for symbol in nodes:
        vector, cost = _advance_row(vector, symbol)
        total += cost
    return tuple(way and (way[0] + total, way[1]) for way in vector)


def _retreat(costs: tuple[int | None, ...], node) -> tuple[int | None, ...]:
    found = []
    for table in moves(node):
        ways = [cost + costs[state] for state, (cost, _) in table.items() if costs[state] is not None]
        found.append(min(ways, default=None))
    return tuple(found)


@lru_cache(maxsize=8192)
def _retreat_row(costs: tuple[int | None, ...], symbol: str) -> tuple[tuple[int | None, ...], int]:
    found = _retreat(costs, symbol)
    least = min(c for c in found if c is not None)
    return tuple(c if c is None else c - least for c in found), least


def backward(end: int, nodes: Sequence) -> tuple[int | None, ...]:
    costs: tuple[int | None, ...] = tuple(0 if s == end else None for s in range(4))
    total = 0
    for node in reversed(nodes):
        if isinstance(node, str):
            costs, cost = _retreat_row(costs, node)
            total += cost
        else:
            costs = _retreat(costs, node)
    return tuple(c if c is None else c + total for c in costs)


def crossings(nodes: Sequence, start: int, end: int) -> list[int]:
    """The states before, between and after the nodes, on the cheapest way with the least edits."""
    if len(nodes) == 1:
        return [start, end]
    middle = len(nodes) // 2
    ahead, behind = forward(start, nodes[:middle]), backward(end, nodes[middle:])
    meeting = [(a[0] + b, a[1], state) for state, (a, b) in enumerate(zip(ahead, behind)) if a is not None and b is not None]
    state = min(meeting)[2]
    return crossings(nodes[:middle], start, state) + crossings(nodes[middle:], state, end)[1:]


def final_state(nodes: Sequence) -> int:
    """The state after all nodes of a conversation, before its tail."""
    ahead = forward(EMPTY, nodes)
    return min((way[0] + INSERT * len(TAILS[s]), way[1], s) for s, way in enumerate(ahead) if way)[2]


def run_edits(symbols: str, start: int, end: int, tail: str) -> str:
    states = crossings(symbols, start, end)
    return "".join(row_moves(symbol)[a][b][1] for symbol, a, b in zip(symbols, states, states[1:])) + tail


def whole_edits(symbols: str) -> str:
    """The edits of a conversation of one run."""
    end = final_state(symbols)
    return run_edits(symbols, EMPTY, end, TAILS[end])


_short_edits = lru_cache(maxsize=4096)(whole_edits)  # for conversations of at most 64 rows


def summary(nodes: Sequence) -> tuple[list[int], list[int]]:
    """A run as one node: 16 costs (-1: no way) and, for each state before, the order of the edits."""
    ways = [way or (-1, -1) for start in range(4) for way in forward(start, nodes)]
    return [w[0] for w in ways], [w[1] for w in ways]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with one of five faults planted by a checksum of ``conv_id:turn``: conv_id, turn, role, text.

    Of 20 rests, 0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it the user's; null values are one space.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    rows = conversations.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """Every row of each conversation in order with its edit, and the inserted rows: conv_id, turn,
    role_before, fault, edit, role, text; ``role`` is null for deleted rows.

    Rows are taken by turn (null turns first), equal turns by role and digest of the text.  Repeated
    rows are duplicates.  Null conversations are one conversation, null roles and texts one space.
    Inserted rows have no turn, no ``role_before`` and an empty text.  Conversations
    come one after the other, each within one partition.  Other columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("-"))
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = rows.select("conv_id", "turn", role, text, key.alias("key"), digest.alias("digest"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select(
        "key", "turn", "role", "digest", (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut_off")
    )
    numbered = number_rows(slim, [F.col("key"), *order], "n", start=0)
    edits = _edits(_runs(_symbols(numbered)))
    both = rows.withColumn("kind", F.lit(1)).unionByName(edits.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # the entry of a run comes right before its first row
    sorted_rows = both.repartition("key").sortWithinPartitions("key", *order, "kind")
    types = dict(rows.dtypes)
    schema = REPAIRED.format(id=types["conv_id"], turn=types["turn"])
    return in_tasks(sorted_rows.select("key", "kind", "symbols", "edits", "conv_id", "turn", "role", "text"), _apply, schema)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, repair and sum up: one row per conversation of the table, also those with no row left.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  An empty table gives
    no rows.
    """
    repaired = repair(damage(conversations))
    found = in_tasks(repaired, _summaries, SUMMARY.format(id=dict(conversations.dtypes)["conv_id"]))
    every = conversations.select("conv_id").distinct()
    same = every["conv_id"].eqNullSafe(found["conv_id"])
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    values = [F.coalesce(found[c], none.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]]
    return every.join(found, same, "left").select(every["conv_id"], *values)


def _symbols(numbered: DataFrame) -> DataFrame:
    """Key, n, order columns and the symbol of each row; a duplicate has an earlier row of its role and text."""
    said = F.concat(F.length("key").cast("string"), F.lit(":"), F.col("key"), F.hex("digest"), F.col("role"))
    rows = numbered.withColumn("said", F.unhex(F.sha2(said.cast("binary"), 256)))
    firsts = materialize(rows.groupBy("said").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"), "said-again")
    again = join_spread(rows.select("n", "said"), firsts, "said", "times").where("n > first").select("n", F.lit(True).alias("again"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = (
        F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut_off"), F.upper(initial)).otherwise(initial).alias("symbol")
    )
    return rows.join(again, "n", "left").select("key", "n", "turn", "role", "digest", symbol)


def _runs(symbols: DataFrame) -> DataFrame:
    """Bounded runs of each conversation, with the order columns of the first row and the number of runs."""
    run = F.floor(F.col("n") / RUN).alias("run")
    listed = F.array_sort(F.collect_list(F.struct("n", "symbol")))
    first = F.min(F.struct("n", "turn", "role", "digest")).alias("first")
    runs = symbols.groupBy("key", run).agg(F.array_join(F.transform(listed, lambda s: s["symbol"]), "").alias("nodes"), first)
    return _with_parts(materialize(runs.select("key", "run", "nodes", "first.turn", "first.role", "first.digest"), "runs"))


def _with_parts(runs: DataFrame) -> DataFrame:
    parts = runs.groupBy("key").agg(F.count(F.lit(1)).alias("parts"))
    return materialize(join_spread(runs, parts, "key", "parts"), "runs-of-runs")


def _edits(runs: DataFrame) -> DataFrame:
    """Runs with their edits: up by summaries until a conversation is one run, down by crossings."""
    levels = [runs]
    while (levels[-1].agg(F.max("parts")).first()[0] or 0) > 1:
        nodes = in_tasks(
            levels[-1].where("parts > 1").select("key", "run", "nodes"), _summarise, "key string, run long, costs array<int>, orders array<int>"
        )
        listed = F.array_sort(F.collect_list(F.struct("run", "costs", "orders"))).alias("nodes")
        levels.append(_with_parts(materialize(nodes.groupBy("key", F.floor(F.col("run") / RUN).alias("run")).agg(listed), "summaries")))
    given = None
    for level in reversed(levels[1:]):
        given = materialize(in_tasks(_with_ends(level, given), _cross, "key string, run long, start int, end int, tail string"), "crossings")
    solved = in_tasks(_with_ends(levels[0], given), _solve, "key string, run long, edits string")
    return runs.join(solved, ["key", "run"]).select("key", "turn", "role", "digest", F.col("nodes").alias("symbols"), "edits")


def _with_ends(level: DataFrame, given: DataFrame | None) -> DataFrame:
    """Key, run, nodes, start, end and tail; a conversation of one run starts empty and ends as is best."""
    whole = level.where("parts = 1").select(
        "key", "run", "nodes", F.lit(EMPTY).alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("tail")
    )
    if given is None:
        return whole
    return whole.unionByName(level.where("parts > 1").join(given, ["key", "run"]).select(*whole.columns))


def _nodes(value) -> Sequence:
    return value if isinstance(value, str) else [(n["costs"], n["orders"]) for n in value]


def _rows(batches: Iterable[pa.RecordBatch], schema: pa.Schema, per_row) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            made = [out for row in batch.slice(start, 256).to_pylist() for out in per_row(row)]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)


_RUN = [("key", pa.string()), ("run", pa.int64())]
_SIXTEEN = pa.list_(pa.int32())


def _summarise(batches):
    def one(row):
        costs, orders = summary(_nodes(row["nodes"]))
        yield {"key": row["key"], "run": row["run"], "costs": costs, "orders": orders}

    return _rows(batches, pa.schema([*_RUN, ("costs", _SIXTEEN), ("orders", _SIXTEEN)]), one)


def _cross(batches):
    def one(row):
        nodes = _nodes(row["nodes"])
        end = row["end"] if row["end"] is not None else final_state(nodes)
        tail = row["tail"] if row["tail"] is not None else TAILS[end]
        states = crossings(nodes, row["start"], end)
        for place, child in enumerate(row["nodes"]):
            ends = {"start": states[place], "end": states[place + 1], "tail": tail if place == len(nodes) - 1 else ""}
            yield {"key": row["key"], "run": child["run"], **ends}

    return _rows(batches, pa.schema([*_RUN, ("start", pa.int32()), ("end", pa.int32()), ("tail", pa.string())]), one)


def _solve(batches):
    def one(row):
        symbols = row["nodes"]
        if row["end"] is not None:
            edits = run_edits(symbols, row["start"], row["end"], row["tail"])
        elif len(symbols) <= 64:
            edits = _short_edits(symbols)
        else:
            edits = whole_edits(symbols)
        yield {"key": row["key"], "run": row["run"], "edits": edits}

    return _rows(batches, pa.schema([*_RUN, ("edits", pa.string())]), one)


class _Open:
    """A conversation being read: the symbols and edits not used yet and the state so far."""

    def __init__(self, key=None, conv_id=None):
        self.key, self.conv_id, self.state = key, conv_id, EMPTY
        self.symbols, self.edits, self.row, self.at = "", "", 0, 0

    def feed(self, symbols: str, edits: str) -> None:
        self.symbols, self.edits = self.symbols[self.row :] + symbols, self.edits[self.at :] + edits
        self.row = self.at = 0

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            role = "assistant" if self.state == USER else "user"
            self.state = after(self.state, role[0])
            yield (self.conv_id, None, None, None, "I", role, "")

    def take(self, turn, role: str, text: str) -> tuple:
        symbol, edit = self.symbols[self.row], self.edits[self.at]
        self.row, self.at = self.row + 1, self.at + 1
        kept = None if edit == "D" else role if edit == "K" else "assistant" if self.state == USER else "user"
        if kept is not None:
            self.state = after(self.state, kept[0])
        return (self.conv_id, turn, role, FAULTS.get(symbol), edit, kept, text)


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the edits on the rows of each conversation, as they come."""
    names = ["conv_id", "turn", "role_before", "fault", "edit", "role", "text"]
    opened, types = _Open(), None
    for batch in batches:
        if types is None:
            types = [batch.schema.field(n).type for n in ("conv_id", "turn")] + [pa.string()] * 5
        made: list[tuple] = []
        columns = [batch.column(n).to_pylist() for n in ("key", "kind", "symbols", "edits", "conv_id", "turn", "role", "text")]
        for key, kind, symbols, edits, conv_id, turn, role, text in zip(*columns):
            if key != opened.key:
                made.extend(opened.inserted())
                opened = _Open(key)
            if kind == 0:
                opened.feed(symbols, edits)
            else:
                opened.conv_id = conv_id
                made.extend(opened.inserted())
                made.append(opened.take(turn, role, text))
        if made:
            yield _batch(made, names, types)
    rest = list(opened.inserted())
    if rest:
        yield _batch(rest, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class _Report:
    """Sums over the rows of one conversation, as they come."""

    COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def __init__(self, conv_id):
        self.conv_id, self.first, self.last, self.turns = conv_id, None, None, 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = 0
        self.before, self.audit, self.digest, self.lines = None, bytearray(), hashlib.sha256(), 0

    def add(self, turn, role_before, fault, edit, role, text) -> None:
        if role_before is not None:
            pair = (self.before or "") + role_before[:1]
            self.illegal += self.before is not None and pair not in ("su", "ua", "au")
            self.before = role_before[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if fault:
            self.faults[fault] += 1
        self.cost += self.COSTS[edit] + (CUT_OFF if fault == "truncated" and edit != "D" else 0)
        self.audit += edit.encode()
        if role is not None:
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    report, types = None, None
    for batch in batches:
        if types is None:
            types = [batch.schema.field("conv_id").type] + [pa.int64()] * 6 + [pa.string()] * 2
        done: list[tuple] = []
        for conv_id, *row in zip(*[batch.column(n).to_pylist() for n in batch.schema.names]):
            if report is None or conv_id != report.conv_id:
                if report is not None:
                    done.append(report.row())
                report = _Report(conv_id)
            report.add(*row)
        if done:
            yield _batch(done, names, types)
    if report is not None:
        yield _batch([report.row()], names, types)
