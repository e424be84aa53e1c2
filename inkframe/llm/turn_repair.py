"""Repair of conversations by the cheapest edits that make their roles s?(ua)+, by dynamic programming over their rows.

An edit of the program is a macro: a run of inserted turns and what happens to the next row. Macros are written as
prefix-free codes (`I`s and then K, R or D), so audits over as many rows compare as rows of codes do, and of a layer's audits
only their ranks are needed to rank the next layer's: (parent's rank, code). Costs and ranks of the four states of
the grammar go from row to row, parents are kept in a byte each, and audits are read back from those afterwards. Many
conversations of a task advance together, a row each at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar's states: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What can be put in after a state, and the state of a row that is given the role that fits there.
FITTING = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: The runs of insertions after which a state differs from that of any shorter run number two at most.
CODES = sorted("I" * k + e for k in range(3) for e in "DKR")
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NAMES = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
NEVER = 1 << 40
#: Rows after which a task repairs the conversations that it has read whole.
BATCH_ROWS = 20_000


def inserted(state: int, run: int) -> tuple[list[str], int]:
    """The roles of a run of insertions, and the state after it."""
    roles = []
    for _ in range(run):
        roles.append(FITTING[state])
        state = NEXT[roles[-1]][state]
    return roles, state


@functools.cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """cost and target of [initial (s, u, a, other), fault (none, to delete, truncated), state, code]; target -1: not allowed."""
    cost = np.full((4, 3, 4, len(CODES)), NEVER, np.int64)
    target = np.full(cost.shape, -1, np.int8)
    for (i, initial), fault, state, (c, code) in itertools.product(enumerate("sua-"), range(3), range(4), enumerate(CODES)):
        _, at = inserted(state, len(code) - 1)
        to = at if code[-1] == "D" else None if fault == 1 else NEXT.get(initial, {}).get(at) if code[-1] == "K" else NEXT[FITTING[at]][at]
        if to is not None:
            cost[i, fault, state, c] = INSERT * (len(code) - 1) + {"D": DELETE, "K": KEEP, "R": REROLE}[code[-1]] + TRUNCATED * (fault == 2 and code[-1] != "D")
            target[i, fault, state, c] = to
    return cost, target


def cheapest(initials: np.ndarray, faults: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all conversations one after the other. Returns each conversation's cost and last state, and each row's code
    and state before it, of the cheapest audit, the ASCII-least of equals."""
    step_cost, step_target = transitions()
    n, starts = len(lengths), np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")  # conversations with a row there
    cost = np.full((n, 4), NEVER, np.int64)
    cost[:, START] = 0
    rank = np.zeros((n, 4), np.int64)
    parents = []
    for at, m in enumerate(active.tolist()):
        rows = starts[order[:m]] + at
        total = cost[:m, :, None] + step_cost[initials[rows], faults[rows]]
        key = ((total << 8) | (rank[:m, :, None] << 4) | np.arange(len(CODES))).reshape(m, -1)
        to = step_target[initials[rows], faults[rows]].reshape(m, -1)
        key[total.reshape(m, -1) >= NEVER] = NEVER << 8
        parent = np.zeros((m, 4), np.uint8)
        audit = np.empty((m, 4), np.int64)
        for state in range(4):
            best = np.where(to == state, key, NEVER << 8).argmin(axis=1)
            found = np.where(to[np.arange(m), best] == state, key[np.arange(m), best], NEVER << 8)
            cost[:m, state] = found >> 8
            parent[:, state] = best  # the state before it times the codes, and the code
            audit[:, state] = found & 255
        audit[cost[:m] >= NEVER] = 256
        rank[:m] = (audit[:, None, :] < audit[:, :, None]).sum(axis=2)
        parents.append(parent)
    close = np.array([INSERT * len(CLOSING[s]) for s in range(4)])
    last = (((cost + close) << 8) | rank).argmin(axis=1)
    codes, before = np.zeros(len(initials), np.int8), np.zeros(len(initials), np.int8)
    state = last.copy()
    for at in range(len(active) - 1, -1, -1):
        m = active[at]
        rows, chosen = starts[order[:m]] + at, parents[at][np.arange(m), state[:m]].astype(np.int64)
        state[:m], codes[rows] = chosen // len(CODES), chosen % len(CODES)
        before[rows] = state[:m]
    ended = np.empty(n, np.int64)
    ended[order] = cost[np.arange(n), last] + close[last]
    end_state = np.empty(n, np.int64)
    end_state[order] = last
    return ended, end_state, codes, before


class Repairs:
    """A batch of whole conversations, their rows in order; rows that are not live only tell that the conversation is there."""

    def __init__(self, rows: pa.Table) -> None:
        ids = rows.column("conv").to_pylist()
        self.first = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
        self.ids = [ids[i] for i in self.first]
        live = rows.column("live").to_numpy(zero_copy_only=False)
        conv = np.cumsum(np.isin(np.arange(len(ids)), self.first)) - 1
        kept = rows.filter(pa.array(live))
        self.turns, self.roles, self.texts = (kept.column(c).to_pylist() for c in ("turn", "role", "text"))
        self.lengths = np.bincount(conv[live], minlength=len(self.ids))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.faults = [f for a, n in zip(self.starts, self.lengths, strict=True) for f in self._faults(a, a + n)]
        initials = np.array(["sua".find(r[:1]) if r else -1 for r in self.roles], np.int8) % 4
        must = np.array([0 if f == "" else 2 if f == "truncated" else 1 for f in self.faults], np.int8)
        self.cost, self.last, self.codes, self.before = cheapest(initials, must, self.lengths)

    def _faults(self, a: int, b: int) -> Iterator[str]:
        seen = set()
        for role, text in zip(self.roles[a:b], self.texts[a:b], strict=True):
            said = text.strip(" \t\n\x0b\x0c\r")
            yield "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))

    def repaired(self, k: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of conversation k's edits, in order; a deleted row keeps its own role and text."""
        for row in range(self.starts[k], self.starts[k] + self.lengths[k]):
            code = CODES[self.codes[row]]
            roles, state = inserted(int(self.before[row]), len(code) - 1)
            yield from (("I", NAMES[r], "") for r in roles)
            yield code[-1], NAMES[FITTING[state]] if code[-1] == "R" else self.roles[row], self.texts[row]
        yield from (("I", NAMES[r], "") for r in inserted(int(self.last[k]), len(CLOSING[int(self.last[k])]))[0])

    def summary(self, k: int) -> tuple:
        a, b = self.starts[k], self.starts[k] + self.lengths[k]
        known = [t for t in self.turns[a:b] if t is not None]
        initials = [r[:1] for r in self.roles[a:b]]
        edits = list(self.repaired(k))
        said = "\n".join(f"{role}:{text}" for edit, role, text in edits if edit != "D")
        return (
            max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *(self.faults[a:b].count(f) for f in FAULTS),
            sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials)),
            int(self.cost[k]),
            "".join(e for e, _, _ in edits),
            hashlib.sha256(said.encode()).hexdigest(),
        )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[Repairs]:
    """Batches of whole conversations of a partition that is sorted by them."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH_ROWS:
            table = pa.Table.from_batches(held)
            ids, last = table.column("conv"), table.num_rows - 1
            if ids[0].as_py() == ids[last].as_py():
                continue
            cut = next((i for i in range(last, 0, -1) if ids[i - 1].as_py() != ids[last].as_py()), 0)
            if cut:
                yield Repairs(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = 0
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield Repairs(table)


def _dealt(turns: DataFrame, id_col: str, live: Column) -> DataFrame:
    """Rows as the repair reads them, a conversation's together and in order: by turn, nulls first, then role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = turns.select(F.col(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), live.alias("live"))
    return slim.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(turns: DataFrame, id_col: str = "conv_id", live: Column | None = None) -> DataFrame:
    """One row per conversation of turns (id_col, turn, role, text): id_col, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.

    A null role or text is one space; rows that are not live count for nothing, but their conversation is returned. A
    conversation without live rows has zeros, an empty audit and the hash of an empty text. Ties of turn go by role and
    text; conversations of a null id are one; an empty table gives no rows; other columns are not read. A task holds a
    batch of about BATCH_ROWS rows or one conversation: its digest is one over all of it.
    """
    dealt = _dealt(turns, id_col, F.lit(True) if live is None else live)
    kind = dict(dealt.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", *(c.split()[0] for c in SUMMARY.split(", "))]
        for found in _whole(batches):
            columns = zip(*(found.summary(k) for k in range(len(found.ids))), strict=True)
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(found.ids, _arrow(kind)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return dealt.mapInArrow(run, f"conv {kind}, {SUMMARY}").withColumnRenamed("conv", id_col)


def repaired_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The repaired rows and the deleted ones, in order: id_col, position (from 0), edit (K, R, D or I), role, text. Edge cases
    as in repair; a conversation whose rows all go has only deleted rows."""
    dealt = _dealt(turns, id_col, F.lit(True))
    kind = dict(dealt.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _whole(batches):
            rows = [(c, p, *edit) for k, c in enumerate(found.ids) for p, edit in enumerate(found.repaired(k))]
            for part in itertools.batched(rows, 10_000):
                c, p, e, r, t = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, _arrow(kind)), pa.array(p, pa.int64()), *(pa.array(x, pa.string()) for x in (e, r, t))], names=["conv", "position", "edit", "role", "text"])

    return dealt.mapInArrow(run, f"conv {kind}, position long, edit string, role string, text string").withColumnRenamed("conv", id_col)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The rows after the damage that crc32 of `conv_id:turn` deals, with dropped rows still there, and what tells the others.
    A null is one space, in what is hashed as in roles and texts; turn stays null for the order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(dealt < 2, "").when(dealt == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(dealt == 4, "user").otherwise(text("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), said.alias("text"), F.explode(F.array_repeat(dealt, F.when(dealt == 3, 2).otherwise(1))).alias("dealt"))
    return rows, F.col("dealt") != 0


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Every conversation's repair after the damage."""
    rows, live = damaged(turns)
    return repair(rows, live=live)
