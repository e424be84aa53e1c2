"""Chat formatting with Spark expressions: turns of a conversation become one text with marks, and are read back from it.

The turns are collected as structs and sorted; adjacent turns of one role are merged into a block by slices of the sorted
array, since an array that grows inside aggregate() would be copied at each step. Inside texts, a backslash goes behind the
first character of what would read as a mark (and of what already has backslashes there), so marks are unambiguous and
the escape can be undone. A conversation is one row, as its formatted text is one value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The conversation that the query adds, and what both of its turns say.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


@dataclass(frozen=True)
class Template:
    """Marks around a block, by role; other roles are written out between `other`'s first two marks. `following` parts the
    texts of a block. The texts of the roles in `learned` are under the loss mask."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    following: str = "[NEXT]"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        """No mark may hold another or end as another begins: then none can arise where a text and a mark meet."""
        words = [m.strip() for pair in self.roles.values() for m in pair] + [*self.other, self.following]
        marks = {c + rest for c in {w[:1] for w in words} for rest in {w[1:] for w in words}}
        if len(set(words)) < len(words) or any(len(w) < 2 or "\\" in w for w in words):
            raise ValueError("marks differ, have two characters or more, and no backslash")
        for x in marks:
            for y in marks:
                if x != y and x in y or any(y.startswith(x[k:]) for k in range(1, len(x))):
                    raise ValueError(f"marks may not overlap: {x!r}, {y!r}")

    def marked(self, slash: str = "") -> str:
        """Pattern of a mark, or of an escaped one, in three groups: first character, backslashes, rest. Any mark's first
        character counts before any mark's rest; that escapes a little more than it must."""
        words = [m.strip() for pair in self.roles.values() for m in pair] + [*self.other, self.following]
        firsts = "".join(re.escape(c) for c in sorted({w[0] for w in words}))
        return rf"([{firsts}]){slash}(\\*)({'|'.join(re.escape(r) for r in sorted({w[1:] for w in words}))})"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.marked()), F.lit(r"$1\\$2$3"))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.marked(r"\\")), F.lit("$1$2$3"))

    def block(self) -> str:
        """Pattern of a block; its texts are escaped, so the first closing mark ends it."""
        pairs = [*self.roles.values(), (self.other[0], self.other[2])]
        return "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in pairs)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though body names it many times."""
    return F.transform(F.array(value), body)[0]


def _blocks(turns: Column) -> Column:
    """Sorted turns as blocks (role, texts): a block begins where the role differs from the turn's before."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))

    def cut(starts: Column) -> Column:
        # size as the last start, so that each block ends where the next begins
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
        of = lambda p: F.struct(turns[p["starts"]]["role"].alias("role"), F.transform(F.slice(turns, p["starts"] + 1, p["ends"] - p["starts"]), lambda t: t["text"]).alias("texts"))
        return F.transform(F.arrays_zip(starts.alias("starts"), ends.alias("ends")), of)

    return _bound(starts, cut)


def _segments(block: Column, t: Template) -> Column:
    """A block's marks and escaped texts, in order, each with its place in the loss mask."""
    role = block["role"]
    first, last = F.concat(F.lit(t.other[0]), t.escaped(role), F.lit(t.other[1])), F.lit(t.other[2])
    for name, (begin, end) in t.roles.items():
        first, last = F.when(role == name, F.lit(begin)).otherwise(first), F.when(role == name, F.lit(end)).otherwise(last)
    piece = lambda text, loss: F.struct(text.alias("piece"), loss.alias("loss"))
    none, learned = F.lit(False), role.isin(*t.learned)
    texts = F.flatten(F.transform(block["texts"], lambda x, k: F.array(piece(F.when(k == 0, first).otherwise(F.lit(t.following)), none), piece(t.escaped(x), learned))))
    return F.concat(texts, F.array(piece(last, none)))


def format_conversations(turns: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id_col, formatted (string), segments (array of piece and loss; joined they are formatted).

    Turns go by turn_col, nulls first, then role and text; a null role or text is an empty one; rows that are repeated are
    turns of their own. Conversations of a null id are one. An empty table gives no rows; other columns are not read.
    """
    t = template or Template()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    held = turns.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segments = _bound(F.col("turns"), lambda x: F.flatten(F.transform(_blocks(x), lambda b: _segments(b, t))))
    out = _bound(segments, lambda s: F.struct(F.array_join(F.transform(s, lambda x: x["piece"]), "").alias("formatted"), s.alias("segments")))
    return held.select(id_col, out.alias("out")).select(id_col, "out.formatted", "out.segments")


def parsed_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text: array<struct<role: string, text: string>>, unescaped."""
    t = template or Template()
    within = lambda b, begin, end: F.substring(b, begin + 1, F.length(b) - begin - end)

    def turns(block: Column) -> Column:
        texts = lambda body: F.split(body, re.escape(t.following), -1)
        read = lambda role, body: F.transform(texts(body), lambda x: F.struct(role.alias("role"), t.unescaped(x).alias("text")))
        inner = within(block, F.lit(len(t.other[0])), F.lit(len(t.other[2])))
        named = _bound(F.split(inner, re.escape(t.other[1]), 2), lambda p: read(t.unescaped(p[0]), p[1]))
        for name, (begin, end) in t.roles.items():
            named = F.when(block.startswith(begin), read(F.lit(name), within(block, F.lit(len(begin)), F.lit(len(end))))).otherwise(named)
        return named

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(t.block()), F.lit(0)), turns))


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """The unescaped text under the loss mask."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescaped(s["piece"])), "")


def round_trip(turns: DataFrame, template: Template | None = None, id_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations say: id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks."""
    t = template or Template()
    made = format_conversations(turns, t, id_col)
    digests = _bound(parsed_turns(F.col("formatted"), t), lambda x: F.struct(F.size(x).cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform(x, lambda v: F.concat(v["role"], F.lit("\n"), v["text"], F.lit("\n"))), ""), 256).alias("turns_sha256")))
    loss = _bound(loss_text(F.col("segments"), t), lambda x: F.struct(F.length(x).cast("long").alias("loss_chars"), F.sha2(x, 256).alias("loss_sha256")))
    out = made.select(id_col, digests.alias("d"), loss.alias("l"), F.length("formatted").cast("long").alias("formatted_chars"), F.size(F.regexp_extract_all("formatted", F.lit(t.block()), F.lit(0))).cast("long").alias("n_blocks"))
    return out.select(id_col, "d.n_turns", "d.turns_sha256", "l.loss_chars", "l.loss_sha256", "formatted_chars", "n_blocks")


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7: a user and an assistant turn that both say what reads as marks."""
    spark, kinds = turns.sparkSession, dict(turns.dtypes)
    probe = spark.createDataFrame([(PROBE_ID, k, r, PROBE_TEXT) for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe.select(*(F.col(c).cast(kinds[c]) for c in probe.columns)))
