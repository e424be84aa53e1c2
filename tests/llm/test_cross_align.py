"""Cross-tokenizer alignment against whole-text encoding and a loop over all token pairs."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkframe.llm import cross_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spans(lengths):
    out, at = [], 0
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


class Slow:
    """Encodes whole texts; the byte-level alphabet comes from the library's own decoding."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True

    def tokens(self, text):
        if not text:
            return [], []
        encoded = self.a.encode(" " + text, add_special_tokens=False)
        alphabet = cross_align.byte_level_tokens(self.a)
        a = [(i, alphabet[i]) for i in encoded.ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def document(self, text):
        a, b = self.tokens(text)
        sa, sb = spans(len(x) for _, x in a), spans(len(x) for _, x in b)
        links, first = [], 0
        for (i, _), (s, e) in zip(a, sa, strict=True):
            while first < len(b) and sb[first][1] <= s:
                first += 1
            k = first
            while k < len(b) and sb[k][0] < e:
                links.append((i, b[k][0]))
                k += 1
        shared = {e for _, e in sa} & {e for _, e in sb}
        sides = [[[]], [[]]]
        for side, ids, sp in ((sides[0], a, sa), (sides[1], b, sb)):
            for (i, _), (_, e) in zip(ids, sp, strict=True):
                side[-1].append(str(i))
                if e in shared:
                    side.append([])
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True) if x]
        return len(a), len(b), groups, links


def slow_rows(texts):
    slow = Slow()
    docs = [slow.document(t) for t in texts]
    count = Counter(x for d in docs for x in d[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for n_a, n_b, groups, links in docs:
        said = ";".join(groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


HARD = [
    "two  spaces   and\n\nlines\n  indented\t tab\r\nend", " lead", "trail  ", "trail\n", "\n", " ", "  ", "a\x1cb !\x1c c\x1c", "<|endoftext|> <s>x</s> <unk> <0x41>", "under▁score", "it's we'll I'd 'S", "é́ 日本語 😀 𓀀 ﬁ　x\xa0y",
    "a   b\u0085c", "x" * 3000, "ab12!!cd??  9.5e-3", "﻿bom", "x;\r y );\r\n", "tab\t\tend\t", "\t lead tab",
]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_odd_rows(odd, odd_texts, spark):
    texts = [*(r.text for r in odd.select("text").collect()), *HARD]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    for most_sent in (10**6, 0):  # counts sent, and counts joined by shuffle
        got = cross_align.link_statistics(docs, most_sent=most_sent)
        assert got.columns == ["doc_id", *COLUMNS]
        assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(slow_rows(texts))


def test_documents(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in cross_align.link_statistics(documents).collect()}
    assert got == dict(zip(texts, slow_rows(texts.values()), strict=True))


def test_empty(empty):
    assert cross_align.link_statistics(empty).count() == 0


def test_intervals_and_groups():
    of_a, of_b, closes = cross_align.elementary_intervals(np.array([2, 5, 6]), np.array([3, 5, 6]))
    assert (of_a.tolist(), of_b.tolist(), closes.tolist()) == ([0, 1, 1, 2], [0, 0, 1, 2], [False, False, True, True])


def test_general_outputs(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in cross_align.align_texts(docs).select("doc_id", "groups", cross_align.group_lists().alias("g"), cross_align.group_products().alias("p")).collect()}
    assert ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in rows[1].g) == rows[1].groups
    assert [(p.a_id, p.b_id) for p in rows[1].p] == [(a, b) for g in rows[1].g for a in g.a for b in g.b]
    assert rows[2].groups == "" and rows[2].g is None
    links = cross_align.vocabulary_links(docs).orderBy("a_id", "b_id").collect()
    expected = Counter(Slow().document("hello world")[3])
    assert {(r.a_id, r.b_id): r["count"] for r in links} == expected


def test_whole_texts_when_chunks_do_not_stand_alone(monkeypatch):
    aligner = cross_align.Aligner(A, B)
    by_chunk = aligner.texts(HARD)
    aligner.by_chunk, aligner.known = False, type(aligner.known)(10)
    whole = aligner.texts(HARD)
    assert by_chunk[0] == whole[0]
    for x, y in zip(by_chunk[1:], whole[1:], strict=True):
        assert np.array_equal(x, y)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_ids(spark, kind):
    docs = spark.createDataFrame([("7", "one two")], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    assert dict(cross_align.link_statistics(docs).dtypes)["doc_id"] == kind
