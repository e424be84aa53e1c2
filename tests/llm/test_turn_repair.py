"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

from inkframe.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, live boolean, conv string, code int"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows):
    """Best first over (cost, audit): rows done, the roles so far (by their automaton: the pattern that may still be met), lines."""
    bad = faults(rows)
    may = lambda s: re.fullmatch(r"(s?(ua)*u?)", s) is not None
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, "\n".join(lines)
        short = (i, "" if not roles else "s" if roles == "s" else roles[-1])
        if short in done:
            continue
        done.add(short)
        steps = [(3, "I", i, r[0], (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            more = 3 * (bad[i] == "truncated")
            steps.append((4, "D", i + 1, "", ()))
            if bad[i] not in ("blank", "duplicate"):
                steps.append((more, "K", i + 1, role[:1] or "-", (f"{role}:{text}",)))
                steps += [(3 + more, "R", i + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for extra, letter, at, initial, line in steps:
            if may(roles + initial):
                heapq.heappush(queue, (cost + extra, audit + letter, at, roles + initial, lines + line))
    raise AssertionError


def slow(rows):
    """rows: (turn, role, text) in order."""
    said = [(r, t) for _, r, t in rows]
    bad, turns = faults(said), [t for t, _, _ in rows if t is not None]
    cost, audit, text = search(said)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(bad.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:], strict=False)),
        cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def ordered(rows):
    fill = lambda x: " " if x is None else x
    return sorted(((t, fill(r), fill(x)) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))


def draws(n, seed, longest=7):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \t", None, "why? ", "é", "ok.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return {c: [(draw.choice([None, *range(8)]), draw.choice(roles), draw.choice(texts)) for _ in range(draw.randrange(longest + 1))] for c in range(n)}


def frame(spark, convs):
    return spark.createDataFrame([(c, *r, False, "x", 1) for c, rows in convs.items() for r in rows], SCHEMA)


def test_against_search(spark):
    convs = {c: rows for c, rows in draws(1500, 3).items() if rows}
    convs[None] = [(0, "user", "no id."), (0, "user", "no id.")]
    convs[9000] = [(k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(30)] + [(99, "system", "late")]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair(frame(spark, convs)).collect()}
    assert got == {c: slow(ordered(rows)) for c, rows in convs.items()}


def test_batches_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "BATCH_ROWS", 50)
    convs = {c: [(k, "assistant" if k % 2 else "user", f"t {k % 40}.") for k in range(40 + 900 * (c == 3))] for c in range(9)}
    df = frame(spark, convs).repartition(3)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair(df).collect()}
    assert got == {c: slow(ordered(rows)) for c, rows in convs.items()}


def damage(c, turn, role, text):
    fill = lambda x: " " if x is None else str(x)
    role, text, k = fill(role), fill(text), zlib.crc32(f"{fill(c)}:{fill(turn)}".encode()) % 20
    text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
    return [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)


def test_damage(spark):
    convs = {c: rows for c, rows in draws(600, 4, 4).items() if rows}
    after = {c: ordered([x for r in rows for x in damage(c, *r)]) for c, rows in convs.items()}
    assert any(not rows for rows in after.values())
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair_damaged(frame(spark, convs)).collect()}
    assert got == {c: slow(rows) for c, rows in after.items()}
    assert got[next(c for c, rows in after.items() if not rows)] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_conversations(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    convs = {}
    for r in table.collect():
        convs.setdefault(r.conv_id, []).extend(damage(r.conv_id, r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair_damaged(table).collect()}
    assert got == {c: slow(ordered(rows)) for c, rows in convs.items()}


def test_repaired_turns(spark):
    convs = {1: [(0, "system", "Be."), (1, "user", "cut"), (2, "user", "Hi."), (2, "user", "Hi.")], 2: [(0, "assistant", "")]}
    rows = {}
    for r in turn_repair.repaired_turns(frame(spark, convs)).orderBy("conv_id", "position").collect():
        rows.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    audits = {r.conv_id: (r.audit, r.repaired_sha256) for r in turn_repair.repair(frame(spark, convs)).collect()}
    for c, edits in rows.items():
        said = "\n".join(f"{role}:{text}" for e, role, text in edits if e != "D")
        assert ("".join(e for e, _, _ in edits), hashlib.sha256(said.encode()).hexdigest()) == audits[c]
    assert rows[2] == [("D", "assistant", "")]


def test_string_ids_and_empty(spark):
    df = spark.createDataFrame([("a", 0, "user", "x."), ("b", 0, "user", "y.")], "conv_id string, turn int, role string, text string")
    assert {r.conv_id: r.audit for r in turn_repair.repair(df).collect()} == {"a": "KI", "b": "KI"}
    assert turn_repair.repair(df.limit(0)).count() == 0
