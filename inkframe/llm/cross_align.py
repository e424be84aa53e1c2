"""Alignment of two tokenizers' ids over the same bytes, and the corpus-wide counts of the id pairs that overlap.

Both tokenizers read a space and the text. The ends of A's and B's tokens together cut the bytes into elementary
intervals; each interval lies in one token of either side, so it is one overlap, and an end that both have closes a group.
Neither tokenizer merges across the start of a white-space run that begins with a space or a newline after another
character, so a text is the row of its chunks, a chunk is aligned once while a task remembers it, and a text's groups are
those of its chunks, in order. The counts are a Spark aggregate over each document's distinct pairs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkframe.llm import common

MARK = "▁"
#: A run of white space and what follows it; a run that begins otherwise than with a space or a newline stays inside.
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Chunks in each of the two generations of a task's table.
MOST_CHUNKS = 100_000
#: New chunks that are encoded at once.
BLOCK = 1_000
#: A batch's links are held at once, at some hundred bytes of memory for a byte of text.
BATCH_BYTES = 2_000_000
#: Longer chunks are not remembered.
LONGEST_KEPT = 64
#: A table of pair counts of up to so many rows (each of 20 bytes) is sent to the executors; a larger one is joined by shuffle.
MOST_PAIRS_SENT = 2_000_000


def elementary_intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of A and of B that own each elementary interval, in order, and whether a group closes at its end.
    Ends are ascending, and both sides' last ends are equal. Tokens without bytes own no interval."""
    cuts = np.union1d(ends_a, ends_b)
    of_a, of_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return of_a, of_b, (ends_a[of_a] == cuts) & (ends_b[of_b] == cuts)


class Aligner:
    """chunk -> (groups, tokens of A, tokens of B, groups' number, keys of its links), or None if the bytes differ.

    A link's key is a_id * (number of B's ids) + b_id.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core, not the machine's
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = byte_level_tokens(self.a)
        self.b_bytes = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode() for i in range(b.get_piece_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_text, self.b_text = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.by_chunk = cuts_at_space(a_path) and marks_start_pieces(b)
        self.known = common.Remembered(MOST_CHUNKS)

    def _b_ids(self, chunks: list[str]) -> list[list[int]]:
        """The library puts a marker before its input: it stands for a chunk's first space, or is cut off again."""
        lead = len(self.b.encode("\n"))
        shape = [("\n" + c, lead) if c == " " else (c[1:], 0) if c[0] == " " else (c, lead - 1) for c in chunks]
        return [ids[k:] for ids, (_, k) in zip(self.b.encode([x for x, _ in shape], num_threads=1), shape, strict=True)]

    def align(self, chunks: list[str]) -> list[tuple | None]:
        """Chunks that end in no white space are encoded many at once, as a text of those chunks; then all lie side by side
        on one line of bytes, where each chunk's end is an end of both sides."""
        out: list[tuple | None] = [None] * len(chunks)
        joined = [i for i, c in enumerate(chunks) if self.by_chunk and not c[-1].isspace() and MARK not in c]
        blocks = [joined[k : k + BLOCK] for k in range(0, len(joined), BLOCK)]
        alone = sorted(set(range(len(chunks))).difference(joined))
        alone += self._encoded(chunks, blocks, out)
        self._encoded(chunks, [[i] for i in alone], out)
        return out

    def _encoded(self, chunks: list[str], blocks: list[list[int]], out: list[tuple | None]) -> list[int]:
        """Fills in what the blocks' chunks are; returns the chunks of blocks whose bytes differ."""
        if not blocks:
            return []
        texts = ["".join([chunks[i] for i in block]) for block in blocks]
        a_ids = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b_ids = self._b_ids(texts)
        good, bad = [], []
        for k, text in enumerate(texts):
            same = b"".join([self.a_bytes[i] for i in a_ids[k]]) == text.encode() == b"".join([self.b_bytes[i] for i in b_ids[k]])
            (good if same else bad).append(k)
        held = [i for k in good for i in blocks[k]]
        if held:
            a, b = (np.array([i for k in good for i in ids[k]], np.int64) for ids in (a_ids, b_ids))
            for i, what in zip(held, self._lined_up(a, b, np.cumsum([len(chunks[i].encode()) for i in held])), strict=True):
                out[i] = what
        return [i for k in bad for i in blocks[k]]

    def _lined_up(self, a: np.ndarray, b: np.ndarray, chunk_ends: np.ndarray) -> Iterator[tuple]:
        a_ends, b_ends = self.a_length[a].cumsum(), self.b_length[b].cumsum()
        of_a, of_b, closes = elementary_intervals(a_ends, b_ends)
        keys = (a[of_a] * len(self.b_bytes) + b[of_b]).astype("<i8").tobytes()
        shut = np.flatnonzero(closes)
        a_stop, b_stop = (of_a[shut] + 1).tolist(), (of_b[shut] + 1).tolist()
        a_text, b_text = [self.a_text[i] for i in a.tolist()], [self.b_text[i] for i in b.tolist()]
        groups = [f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip([0, *a_stop[:-1]], a_stop, [0, *b_stop[:-1]], b_stop, strict=True)]
        # a chunk's end closes its last group
        to_group = np.searchsorted(np.maximum.accumulate(a_ends[of_a[shut]]), chunk_ends) + 1
        to_link = (8 * (shut[to_group - 1] + 1)).tolist()
        n_a, n_b = (np.diff(np.searchsorted(ends, chunk_ends, side="right"), prepend=0).tolist() for ends in (a_ends, b_ends))
        g = k = 0
        for g2, k2, x, y in zip(to_group.tolist(), to_link, n_a, n_b, strict=True):
            yield ";".join(groups[g:g2]), x, y, g2 - g, keys[k:k2]
            g, k = g2, k2

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's groups; its tokens of A and B, groups and links; and (text, key, number) of its distinct links."""
        rows = [([" " + t] if not self.by_chunk else CHUNK.findall(" " + t)) if t else [] for t in texts]
        number = {c: i for i, c in enumerate(set().union(*rows))}
        known = self.known.of(set(number), self.align)
        got = [known[c] for c in number]
        if None in got:
            rows = [[] if any(known[c] is None for c in row) else row for row in rows]
            got = [x or ("", 0, 0, 0, b"") for x in got]
        groups = [";".join([known[c][0] for c in row]) for row in rows]
        flat = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(rows)), np.int64)
        of_text = np.repeat(np.arange(len(rows)), np.array([len(row) for row in rows], np.int64))
        links = np.array([len(x[4]) // 8 for x in got], np.int64)
        sizes = np.array([x[1:4] for x in got], np.int64).reshape(-1, 3)
        sums = np.zeros((len(rows), 4), np.int64)
        for k in range(4):
            sums[:, k] = np.bincount(of_text, (links if k == 3 else sizes[:, k])[flat], len(rows))
        keys = np.frombuffer(b"".join([x[4] for x in got]), "<i8")
        lengths = links[flat]
        place = np.arange(lengths.sum()) + np.repeat((links.cumsum() - links)[flat] - (lengths.cumsum() - lengths), lengths)
        span = len(self.a_bytes) * len(self.b_bytes)
        distinct, times = np.unique(np.repeat(of_text, lengths) * span + keys[place], return_counts=True)
        for c in number:
            if len(c) > LONGEST_KEPT:
                known.pop(c, None)
        return groups, sums, distinct // span, distinct % span, times


def byte_level_tokens(tokenizer: Tokenizer) -> list[bytes]:
    """Each id's bytes. A byte-level vocabulary writes printable Latin-1 bytes as themselves and the others, in order,
    as the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    of = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    words = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    return [bytes(of[c] for c in w) if all(c in of for c in w) else w.encode() for w in words]


def cuts_at_space(path: str) -> bool:
    """Whether the tokenizer's file says byte-level matches, none of which goes on from other characters into white space."""
    said = json.loads(Path(path).read_text())
    before = said.get("pre_tokenizer") or {}
    return said.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")


def marks_start_pieces(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece has a marker or a newline after another character, and spaces and newlines are kept."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and all(model.decode(model.encode(x)) == x for x in ("a  b", " a ", "\n", "a\n b"))


@functools.cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


PAIRS = "pairs array<struct<key: long, n: long>>"


def align_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, digests: bool = False) -> DataFrame:
    """One row per row of docs: id_col, row_no, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) or with digests
    groups_sha256, and pairs (the distinct id pairs that overlap, as keys, and how often).

    Null and empty texts, and texts whose joined bytes differ from a space and the text (a literal U+2581), have no
    tokens: zeros, and an empty string in place of the groups or their digest. Repeated rows come each for itself; an
    empty table gives no rows; other columns are not read. Memory is bounded by a batch, of BATCH_BYTES or one text.
    """
    paths = _paths(a_path, b_path)
    kind = docs.schema[id_col].dataType.simpleString()
    last = "groups_sha256" if digests else "groups"

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups, sums, of_text, keys, times = _aligner(*paths).texts(common.text_strings(batch.column("text")))
        if digests:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        ends = np.searchsorted(of_text, np.arange(len(groups) + 1)).astype(np.int32)
        pairs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(keys), pa.array(times.astype(np.int64))], ["key", "n"]))
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row_no"), *(pa.array(sums[:, k]) for k in range(4)), pa.array(groups, pa.string()), pairs], names=["doc", "row_no", "n_a", "n_b", "n_groups", "n_links", last, "pairs"])

    slim = docs.select(F.col(id_col).alias("doc"), F.monotonically_increasing_id().alias("row_no"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(one, common.bounded(batch, BATCH_BYTES))

    out = slim.mapInArrow(run, f"doc {kind}, row_no long, n_a long, n_b long, n_groups long, n_links long, {last} string, {PAIRS}")
    return out.withColumnRenamed("doc", id_col)


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """aligned: a column pairs; b_ids: the number of B's ids. Returns key, count (how many links hold the pair), best (whether
    no pair of its B id has more; ties are all best). A B id has at most as many rows as A has ids."""
    counts = aligned.select(F.inline("pairs")).groupBy("key").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("key") % b_ids)))


def vocabulary_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a_id, b_id, count, best: how often the corpus links two vocabularies' ids."""
    b_ids = len(_aligner(*_paths(a_path, b_path)).b_bytes)
    counts = pair_counts(align_texts(docs, id_col, text_col, a_path, b_path), b_ids)
    return counts.select(F.expr(f"cast(key div {b_ids} AS int)").alias("a_id"), (F.col("key") % b_ids).cast("int").alias("b_id"), "count", "best")


def group_lists(groups: str = "groups") -> F.Column:
    """The text of groups as array<struct<a: array<int>, b: array<int>>>; null for texts without tokens."""
    ids = lambda side, k: F.split(F.split(side, r"\|")[k], ",").cast("array<int>")
    return F.when(F.col(groups) != "", F.transform(F.split(groups, ";"), lambda g: F.struct(ids(g, 0).alias("a"), ids(g, 1).alias("b"))))


def group_products(groups: str = "groups") -> F.Column:
    """Every pair of ids that share a group, as array<struct<group: int, a_id: int, b_id: int>>, in order. A group
    is as long as its tokens, so the pairs grow with the text."""
    product = lambda g, i: F.flatten(F.transform(g["a"], lambda a: F.transform(g["b"], lambda b: F.struct(i.alias("group"), a.alias("a_id"), b.alias("b_id")))))
    return F.flatten(F.transform(group_lists(groups), product))


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, most_sent: int = MOST_PAIRS_SENT) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of the same B
    id outnumbers), count_sum (the pairs' counts over all links), groups_sha256.

    The counts are over all of docs. Edge cases as in align_texts; zeros for texts without tokens.
    """
    aligned = common.stage(align_texts(docs, id_col, text_col, a_path, b_path, digests=True), "aligned")
    counts = common.stage(pair_counts(aligned, len(_aligner(*_paths(a_path, b_path)).b_bytes)), "pairs")
    sent = F.broadcast(counts) if counts.count() <= most_sent else counts
    held = aligned.select("row_no", F.inline("pairs")).join(sent, "key")
    sums = held.groupBy("row_no").agg(F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return aligned.drop("pairs").join(sums, "row_no", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
