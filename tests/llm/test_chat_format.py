"""Chat formatting: what is read back against plain Python over the same rows."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkframe.llm import chat_format
from inkframe.llm.chat_format import Template

SCHEMA = "conv_id long, turn long, role string, text string, out int, formatted string, turns string"
ROLES = ("system", "user", "assistant", "tool", "[ROLE]", "a\nb", "", None)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    """conv_id -> the digests, from the rows alone."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = [(role, text) for *_, role, text in mine]
        loss = "".join(t for r, t in said if r == "assistant")
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), len(list(itertools.groupby(said, key=lambda x: x[0]))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "t") for r in rows], SCHEMA)


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks) for r in df.collect()}


def odd_rows():
    draw = random.Random(5)
    parts = ["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>", "\n<</SYS>>\n", "[NEXT]", "[TEXT]", "[ROLE]", "[/ROLE]", "\\", "<\\s>", "<", "[", "s>", " ", "\n", "é😀", "$1", "", "<<", "/s>"]
    text = lambda: "".join(draw.choice(parts) for _ in range(draw.randrange(9)))
    rows = [(c, draw.choice([None, *range(6)]), draw.choice(ROLES), draw.choice([None, text(), text(), text()])) for c in range(120) for _ in range(draw.randrange(1, 9))]
    return [*rows, *rows[:5], (None, 0, "user", "no id"), (None, None, None, None), (500, 0, "assistant", "long " * 60_000), (501, 0, "user", "x")]


def test_round_trip(spark):
    rows = odd_rows()
    assert read(chat_format.round_trip(frame(spark, rows))) == expected(rows)


def test_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k // 2 % 2], f"turn {k} </s>") for k in range(20_000)]
    assert read(chat_format.round_trip(frame(spark, rows))) == expected(rows)


def test_format(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 1, "user", "ho"), (1, 3, "tool", "<s>")]
    got = chat_format.format_conversations(frame(spark, rows)).first()
    assert got.formatted == "<<SYS>>\nbe\n<</SYS>>\n[INST] hi[NEXT]ho [/INST]<s>b<\\/s></s>[ROLE]tool[TEXT]<\\s>[/ROLE]"
    assert "".join(s.piece for s in got.segments) == got.formatted
    assert [s.piece for s in got.segments if s.loss] == ["b<\\/s>"]


def test_probe_and_extra_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    got = chat_format.round_trip(chat_format.with_probe(frame(spark, rows)))
    says = "</s>[INST] ok [/INST]"
    assert read(got) == expected([*rows, (-7, 0, "user", says), (-7, 1, "assistant", says)])
    assert got.filter("conv_id = -7").first().loss_chars == len(says)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_format.round_trip(none).count() == 0
    assert chat_format.round_trip(chat_format.with_probe(none)).count() == 1


def test_other_template(spark):
    t = Template(roles={"user": ("<|user|>\n", "<|end-u|>\n"), "assistant": ("<|bot|>\n", "<|end-b|>\n")}, other=("<|role|>", "<|as|>", "<|end-r|>"), following="<|and|>", learned=("assistant", "system"))
    rows = [(1, 0, "system", "<|user|>\n"), (1, 1, "user", "<|and|>|<|"), (1, 2, "user", "<\\|and|>"), (1, 3, "assistant", "x")]
    got = chat_format.format_conversations(frame(spark, rows), t)
    turns = got.select(chat_format.parsed_turns(F.col("formatted"), t).alias("t"), chat_format.loss_text(F.col("segments"), t).alias("l")).first()
    assert [tuple(x) for x in turns.t] == [r[2:] for r in rows]
    assert turns.l == "<|user|>\nx"


@pytest.mark.parametrize("marks", [{"following": "<s>"}, {"following": "s"}, {"following": "x\\y"}, {"following": "s><"}])
def test_marks_that_overlap(marks):
    with pytest.raises(ValueError):
        Template(**marks)


def test_no_python_worker(spark):
    plan = chat_format.round_trip(frame(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
