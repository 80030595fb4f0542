"""Conversation repair against plain dynamic programming over whole audits."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from itemloom.llm import conversations as conv

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) of the least edits; rows are (role, text, fault)."""
    best = {"": (0, "", ())}

    def with_inserts(states):
        grown = dict(states)
        for _ in range(3):
            for state, (cost, audit, lines) in list(grown.items()):
                for initial in "ua":
                    reached = STEP.get((state, initial))
                    if reached is not None:
                        way = (cost + 3, audit + "I", (*lines, f"{NAMES[initial]}:"))
                        if reached not in grown or way < grown[reached]:
                            grown[reached] = way
        return grown

    for role, text, fault in rows:
        after = {}
        # each number of inserts is kept apart: the cheapest one is not always the best to go on from
        for state, (cost, audit, lines) in best.items():
            for start, way in with_inserts({state: (cost, audit, lines)}).items():
                options = [(start, way[0] + 4, way[1] + "D", way[2])]
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault == "truncated" else 0
                    kept = STEP.get((start, role[:1]))
                    if kept is not None:
                        options.append((kept, way[0] + extra, way[1] + "K", (*way[2], f"{role}:{text}")))
                    for initial in "ua":
                        moved = STEP.get((start, initial))
                        if moved is not None:
                            options.append((moved, way[0] + 3 + extra, way[1] + "R", (*way[2], f"{NAMES[initial]}:{text}")))
                for reached, *found in options:
                    if reached not in after or tuple(found) < after[reached]:
                        after[reached] = tuple(found)
        best = after
    ends = with_inserts(best) if rows else best
    return min(way for state, way in ends.items() if state in ("", "a"))


def fault_of(role, text, seen):
    said = text.rstrip(conv.BLANKS)
    if not said:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return None if said[-1] in ".!?" else "truncated"


def report(rows):
    """The report of one conversation, from rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, judged = set(), []
    for _, role, text in rows:
        judged.append((role, text, fault_of(role, text, seen)))
        seen.add((role, text))
    cost, audit, lines = cheapest(judged)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [sum(f == name for _, _, f in judged) for name in ("blank", "duplicate", "truncated")]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        yield from [(conv_id, turn, role, text)] * (2 if kind == 3 else 1)


symbols = st.text("suaoSUAObd", min_size=1, max_size=24)
ROLE = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "b": "user", "d": "user"}
FAULT = {"b": "blank", "d": "duplicate"}


@settings(max_examples=400, deadline=None)
@given(symbols)
def test_edits_are_the_cheapest_and_least(text):
    rows = [(ROLE[c.lower()], "", FAULT.get(c, "truncated" if c.isupper() else None)) for c in text]
    assert conv.whole_edits(text) == cheapest(rows)[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(symbols, min_size=2, max_size=6))
def test_runs_of_runs_meet_where_the_whole_does(runs):
    """Summaries of runs, with crossings fixed from the top, give the edits of the whole."""
    nodes = [conv.summary(r) for r in runs]
    end = conv.final_state(nodes)
    states = conv.crossings(nodes, conv.EMPTY, end)
    parts = [conv.run_edits(r, a, b, "") for r, a, b in zip(runs, states, states[1:])]
    assert "".join(parts) + conv.TAILS[end] == conv.whole_edits("".join(runs))


def test_long_runs_mostly_repeat_known_steps():
    text = "".join(random.Random(4).choices("suaoSUAObd", k=4096))
    assert len(conv.whole_edits(text)) >= 4096
    info = conv._advance_row.cache_info()
    assert info.currsize <= info.maxsize and info.hits > 5 * info.misses


SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, edits string, kind int"


def rows_like_these(count, seed):
    make = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Why?", "line\nbreak.", "x" * 30_000 + ".", "é…", "Yes. "]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for _ in range(count):
        conv_id = make.choice([1, 2, 3, 4, 5, 6, 7, None])
        rows.append((conv_id, make.choice([None, *range(9)]), make.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], make.choice([*texts, None])))
    return rows


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "key", 1, "edits", 2) for r in rows], SCHEMA).repartition(3)
    found = conv.repair_report(frame)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    order = lambda r: (r[0] is not None, r[0] or 0)
    kept = {k: list(g) for k, g in groupby(sorted(damaged(rows), key=order), key=lambda r: r[0])}
    expected = [(c, *report([r[1:] for r in kept.get(c, [])])) for c in {r[0] for r in rows}]
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("run", [conv.RUN, 3])
def test_report_on_hard_rows(spark, monkeypatch, run):
    """Nulls everywhere, equal turns, repeated rows; runs of three rows need several levels."""
    monkeypatch.setattr(conv, "RUN", run)
    check(spark, rows_like_these(120, 1))


def test_one_conversation_has_nearly_all_rows(spark, monkeypatch):
    monkeypatch.setattr(conv, "RUN", 8)
    make = random.Random(2)
    rows = [(9, t, make.choice(["user", "assistant"]), f"text {t % 50}{make.choice(['.', ''])}") for t in range(700)]
    check(spark, rows + [(1, 0, "user", "Hello.")])


def test_conversations_without_a_row_left_and_none_at_all(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "Hello.")])
    assert conv.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_rows_are_given_as_such(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "tool", "x"), (1, 2, "tool", " ")]
    found = conv.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.role_before, r.fault, r.edit, r.role, r.text) for r in found] == [
        (None, None, None, "I", "user", ""),
        (0, "assistant", None, "K", "assistant", "Hi."),
        (1, "tool", "truncated", "D", None, "x"),
        (2, "tool", "blank", "D", None, " "),
    ]
