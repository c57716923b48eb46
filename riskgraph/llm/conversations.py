"""Conversation repair: secondary-sorted streams that carry the state of a dynamic program across Arrow batches.

A conversation is legal if its role initials are nothing or ``s`` (at most one, first) and then ``ua`` once or more. Rows
may be kept (K), given the role that is due (R), deleted (D), and rows with an empty text may be inserted (I). The automaton of
legal conversations has four states; in each state R and I have one possible role, so the letters alone fix the repair.

1. Small rows without texts are repartitioned by conversation and sorted by turn, last first. ``mapInPandas`` carries the cost of
   the best rest of the conversation for each state, and writes for each row one byte with the best letter of each state and
   one with its fault. These backpointers leave the task in chunks of ``CHUNK`` rows: a conversation of any length holds no more
   than one chunk, and the chunks are a table in the shared folder.
2. The rows with their texts are repartitioned and sorted forwards, each chunk ahead of its rows. The second stream walks from
   state to state, edits the rows and digests the repaired conversation; it holds a conversation's letters, never its texts.

A conversation's digest is one sequential hash, so its rows pass through one task, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskgraph.llm.scratch import Scratch
from riskgraph.operators.joins import attach_group_stats

DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
CHUNK = 4096

START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "DIKR"  # in ASCII order, so the least of equally cheap edits is the first
_DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_END = (0, 2 * INSERT, INSERT, 0)
_END_LETTERS = sum(1 << 2 * s for s in (SYSTEM, USER))  # insert after these two, else stop
FAULTS = ("", "blank", "duplicate", "truncated")

_ORDER = ["has_conv", "conv", "has_turn", "turn", "role", "h"]
_BLANK = r"[^\x20\x09-\x0D]"
_CLOSED = r"[.!?][\x20\x09-\x0D]*+\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): ``conversations`` with faults put in by crc32(``conv_id:turn``) % 20.

    0 drops the row (it stays with ``present`` false, so its conversation isn't forgotten), 1 empties its text, 2 takes out
    ``[.!?]``, 3 repeats it, 4 makes it a user's. Nulls are one space, in the key as well as in role and text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), k.alias("_k"))
    copies = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    new = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), (F.col("_k") != 0).alias("present"), copies.alias("_copy")
    ).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.coalesce(F.col("present").cast("boolean"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    return rows.select(
        F.col("conv_id").isNotNull().cast("int").alias("has_conv"), whole("conv_id").alias("conv"), F.col("turn").isNotNull().cast("int").alias("has_turn"),
        whole("turn").alias("turn"), shown("role").alias("role"), F.unhex(F.md5(shown("text"))).alias("h"), shown("text").alias("text"), present.alias("present"),
    )


def _step(costs: tuple[int, ...], initial: str, must_go: bool, cut_off: bool) -> tuple[tuple[int, ...], int]:
    """Costs of the rest from each state with one more row in front, less their minimum, and the packed best letters."""
    keep = CUT_OFF if cut_off else 0
    options = []
    for state in range(4):
        found = {"D": DELETE + costs[state]}
        if not must_go:
            if initial in _KEEP[state]:
                found["K"] = keep + costs[_KEEP[state][initial]]
            found["R"] = REROLE + keep + costs[_DUE[state]]
        options.append(found)
    best = [min(o.values()) for o in options]
    for _ in range(2):  # insertions lead to another state in front of the same row
        best = [min(best[s], INSERT + best[_DUE[s]]) for s in range(4)]
    packed = 0
    for state, found in enumerate(options):
        found["I"] = INSERT + best[_DUE[state]]
        packed |= next(i for i, letter in enumerate(LETTERS) if found.get(letter) == best[state]) << 2 * state
    return tuple(b - min(best) for b in best), packed


def _backpointers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks (order of the first row, seq, letters, faults) of rows sorted by conversation and by turn backwards."""
    known: dict[tuple, tuple] = {}
    conv, costs, seq = None, _END, 0
    letters, faults, pending, out = bytearray(), bytearray(), None, []

    def decide(row: tuple, again: bool) -> None:
        nonlocal costs
        _, _, _, _, _, _, initial, blank, late, cut_off = row
        fault = 1 if blank else 2 if late or again else 3 if cut_off else 0
        key = costs, initial, fault in (1, 2), fault == 3
        if key not in known:
            known[key] = _step(*key)
        costs, packed = known[key]
        letters.append(packed)
        faults.append(fault)

    def close(row: tuple) -> None:
        nonlocal letters, faults, seq
        out.append((*row[:6], seq, bytes(reversed(letters)), bytes(reversed(faults))))
        letters, faults, seq = bytearray(), bytearray(), seq + 1

    names = [*_ORDER, "seq", "letters", "faults"]
    for frame in frames:
        for row in zip(*[frame[c].tolist() for c in frame.columns]):
            if pending is not None:
                same = pending[:2] == row[:2]
                decide(pending, same and pending[2:6] == row[2:6])
                if not same or len(letters) == CHUNK:
                    close(pending)
            if conv != row[:2]:
                conv, costs, seq = row[:2], _END, 0
            pending = row
        if len(out) >= 256:
            yield pd.DataFrame(out, columns=names)
            out = []
    if pending is not None:
        decide(pending, False)
        close(pending)
    if out:
        yield pd.DataFrame(out, columns=names)


class _Walk:
    """One conversation on its way through the second stream."""

    def __init__(self, conv: tuple[int, int]):
        self.conv, self.state, self.queue, self.audit = conv, START, deque(), bytearray()
        self.turns = self.lo = self.hi = None
        self.distinct = self.cost = self.illegal = self.size = 0
        self.faults, self.before, self.hash = [0, 0, 0, 0], None, hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.size else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.size += 1

    def insert(self) -> tuple:
        self.state = _DUE[self.state]
        self.cost += INSERT
        self.audit += b"I"
        self.say(_ROLE[self.state], "")
        return self.size - 1, "I", None, _ROLE[self.state], ""

    def row(self, has_turn: int, turn: int, role: str, text: str) -> Iterator[tuple]:
        letters, fault = self.queue.popleft()
        self.faults[fault] += 1
        if has_turn:
            if self.turns != turn:
                self.distinct += 1
            self.turns = turn
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        while (letter := LETTERS[letters >> 2 * self.state & 3]) == "I":
            yield self.insert()
        self.audit += letter.encode()
        if letter == "D":
            self.cost += DELETE
            return
        self.cost += (CUT_OFF if fault == 3 else 0) + (REROLE if letter == "R" else 0)
        self.state = _DUE[self.state] if letter == "R" else _KEEP[self.state][role[:1]]
        role = _ROLE[self.state] if letter == "R" else role
        self.say(role, text)
        yield self.size - 1, letter, turn if has_turn else None, role, text

    def end(self) -> Iterator[tuple]:
        while _END_LETTERS >> 2 * self.state & 1:
            yield self.insert()

    def report(self) -> tuple:
        gaps = self.hi - self.lo + 1 - self.distinct if self.lo is not None else 0
        return (*self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


_REPORT = ["has_conv", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_TURNS = ["has_conv", "conv", "position", "edit", "turn", "role", "text"]


def _walker(report: bool):
    names = _REPORT if report else _TURNS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk, out = None, []
        for frame in frames:
            for has_conv, conv, has_turn, turn, role, kind, text, letters, faults in zip(*[frame[c].tolist() for c in frame.columns]):
                if walk is None or walk.conv != (has_conv, conv):
                    out += _finished(walk, report)
                    walk = _Walk((has_conv, conv))
                if kind == 0:
                    walk.queue.extend(zip(letters, faults))
                elif kind == 1:
                    made = [(*walk.conv, *r) for r in walk.row(has_turn, turn, role, text)]
                    out += [] if report else made
            if out:
                yield pd.DataFrame(out, columns=names).astype({} if report else {"turn": "Int64"})
                out = []
        out = _finished(walk, report)
        if out:
            yield pd.DataFrame(out, columns=names).astype({} if report else {"turn": "Int64"})

    return run


def _finished(walk: _Walk | None, report: bool) -> list[tuple]:
    if walk is None:
        return []
    rest = [(*walk.conv, *r) for r in walk.end()]
    return [walk.report()] if report else rest


def _stream(rows: DataFrame, report: bool) -> DataFrame:
    scratch = Scratch(rows.sparkSession)
    keyed = _keyed(rows)
    initial = F.substring("role", 1, 1)
    small = scratch.keep(
        keyed.filter("present").select(
            *_ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"), (~F.col("text").rlike(_BLANK)).alias("blank"),
            (~F.col("text").rlike(_CLOSED)).alias("cut_off"),
        ),
        "turns",
    )
    at = F.struct("has_turn", "turn")
    known = attach_group_stats(small, ["has_conv", "conv", "role", "h"], {"_first": F.min(at)}).withColumn("late", at > F.col("_first"))
    backwards = known.select(*_ORDER, "initial", "blank", "late", "cut_off").repartition("has_conv", "conv").sortWithinPartitions(
        "has_conv", "conv", *[F.col(c).desc() for c in _ORDER[2:]]
    )
    types = "has_conv int, conv long, has_turn int, turn long, role string, h binary, seq long, letters binary, faults binary"
    chunks = scratch.keep(backwards.mapInPandas(_backpointers, types), "letters")
    no = F.lit(None)
    texts = keyed.select(
        "has_conv", "conv", F.when(F.col("present"), F.col("has_turn")).otherwise(2).alias("has_turn"), "turn", "role", "h",
        F.when(F.col("present"), 1).otherwise(2).alias("kind"), F.lit(0).cast("long").alias("seq"), F.when(F.col("present"), F.col("text")).alias("text"),
        no.cast("binary").alias("letters"), no.cast("binary").alias("faults"),
    )
    forwards = (
        texts.unionByName(chunks.withColumns({"kind": F.lit(0), "seq": -F.col("seq"), "text": no.cast("string")})).repartition("has_conv", "conv")
        .sortWithinPartitions(*_ORDER, "kind", "seq").select("has_conv", "conv", "has_turn", "turn", "role", "kind", "text", "letters", "faults")
    )
    made = (
        "has_conv int, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
        if report else "has_conv int, conv long, position long, edit string, turn long, role string, text string"
    )
    out = forwards.mapInPandas(_walker(report), made)
    return out.select(F.when(F.col("has_conv") == 1, F.col("conv")).alias("conv_id"), *out.columns[2:])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the rows of the repaired conversations of ``rows(conv_id, turn, role, text)``.

    ``edit`` is K, R or I; inserted rows have no turn. Ordering, nulls and ties are those of :func:`repair_report`.
    """
    return _stream(rows, report=False)


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a conversation.

    ``rows(conv_id, turn, role, text[, present])`` are taken by turn, nulls first; rows of one turn by role and by the hash of their
    text, so equal rows are neighbours. A row's first fault counts: blank, duplicate (role and text came before) or truncated
    (its last visible character isn't ``[.!?]``). ``audit`` has the letters of the cheapest edits, the ASCII-least of equally cheap
    ones. A null role or text is one space; a null turn has no place in ``gaps``; null ids are one conversation. Rows whose
    ``present`` is false only name their conversation, which has zeros, an empty audit and the hash of nothing if it has no
    other. A role that begins with none of s, u, a is never kept. Other columns are ignored.
    """
    return _stream(rows, report=True)
