"""Best-fit packing by the sum-of-squares rule (Csirik et al., 2006), in groups that Spark deals out.

Documents are tokenized in the scan; only (id, piece, length, checksum) goes on. Pieces that fill a sequence are
sequences at once. The others are dealt to groups of a bounded number of pieces; each group packs its own, longest
first, every piece where the squared counts of open bins per residual gap become smallest. Bins that a group leaves
with a gap give their pieces back to the next round, which has fewer groups, until one group takes all that is left
or a round frees too little. So the waste is that of a few groups, not of all.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkframe.llm import common

CAPACITY = 4096
END_ID = 1
#: Pieces of a group on average. A group is packed in one task.
GROUP_PIECES = 3_000
LAST_GROUP_PIECES = 12_000
#: Bins with at most this gap are final in any round.
CLOSED_GAP = 8
#: Words in each of the two generations of a task's table of tokenized words.
MOST_WORDS = 200_000


class WordTable:
    """word -> its ids, as little-endian 32-bit bytes.

    The tokenizer's rules neither look nor merge across ASCII white space (white space is dropped before its pre-tokenizer's
    matches, and no match holds any), so a text's ids are those of its words, in order. It lowers case, so lowering ASCII
    letters first changes nothing. A word that ends in ASCII signs after a letter or digit falls apart there, so the ids of
    its stem, which more words share, and of the signs are looked up.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core, not the machine's
        self.model = Tokenizer.from_file(path)
        self.known = common.Remembered(MOST_WORDS)

    def _encode(self, words: list[bytes]) -> Iterator[bytes]:
        for got in self.model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False):
            ids = got.ids
            yield struct.pack(f"<{len(ids)}I", *ids)

    def _from_parts(self, words: list[bytes]) -> Iterator[bytes]:
        cut = [stem_length(w) for w in words]
        parts = {w[:k] for w, k in zip(words, cut, strict=True)} | {w[k:] for w, k in zip(words, cut, strict=True)}
        known = self.known.of(parts, self._encode)
        return (known[w[:k]] + known[w[k:]] for w, k in zip(words, cut, strict=True))

    def texts(self, texts: list[bytes]) -> list[bytes]:
        # a special token's mark is matched before case is lowered, so such texts are left as they are
        words = [(text if SPECIAL in text else text.lower()).split() for text in texts]
        known = self.known.of(set().union(*words), self._from_parts)
        return [b"".join([known[w] for w in row]) for row in words]


#: Fixed value: how the tokenizer's special tokens begin.
SPECIAL = b"<|"
#: Fixed value: ASCII signs that, after a letter or digit, begin a match of their own. The apostrophe is not among them.
SIGNS = b".,;:!?*#$%&|"


def stem_length(word: bytes) -> int:
    """Where a word may be cut: before its last signs if a letter or an ASCII digit precedes them, else at its end."""
    stem = word.rstrip(SIGNS)
    if not stem or len(stem) == len(word):
        return len(word)
    # as the tokenizer's normaliser leaves the last character: some letters become a letter and a mark
    last = unicodedata.normalize("NFC", stem[-4:].decode(errors="ignore")[-1:]).lower()[-1:]
    return len(stem) if last.isalpha() or stem[-1:].isdigit() else len(word)


@functools.cache
def _table(path: str) -> WordTable:
    return WordTable(path)


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc, row_no, piece, start, length, ids_crc32): each document's ids and one end id, cut only if longer than capacity."""
    end = np.array([END_ID], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(_table(tokenizer).texts(common.text_bytes(batch.column("text")))):
            ids += end
            for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[first : first + 4 * capacity]
                at.append(i)
                piece.append(k)
                start.append(first // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        at = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("doc").take(at), batch.column("row_no").take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc", "row_no", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).alias("doc"), F.monotonically_increasing_id().alias("row_no"), F.col(text_col).alias("text"))
    return common.map_batches(slim, cut, f"doc {kind}, row_no long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Packs in the order given; returns each item's bin (from 0) and every bin's gap. Lengths are 1 to capacity."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; full bins are not counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, gaps = np.empty(len(lengths), np.int64), []
    for i, size in enumerate(lengths.tolist()):
        # the sum changes by 2 (N[gap - size] - N[gap] + 1), by 1 - 2 N[size] for an exact fit, by 2 N[capacity - size] + 1 for a new bin
        had, then = open_bins[size:capacity], open_bins[: capacity - size]
        cost = 2 * (then - had) + 2
        if len(cost):
            cost[0] -= 1
            cost[had == 0] = np.iinfo(np.int64).max
            gap = int(cost.argmin())
            least, gap = cost[gap], gap + size
        new = 2 * open_bins[capacity - size] + 1 if size < capacity else 0
        if len(cost) and least <= new:
            to = stacks[gap].pop()
            open_bins[gap] -= 1
            gap -= size
            gaps[to] = gap
        else:
            to, gap = len(gaps), capacity - size
            gaps.append(gap)
        if gap:
            open_bins[gap] += 1
            stacks[gap].append(to)
        where[i] = to
    return where, np.array(gaps, np.int64)


def _pack_group(rows: pa.Table, capacity: int, most_gap: int, number: int) -> pa.Table:
    rows = rows.sort_by([("length", "descending"), ("row_no", "ascending"), ("piece", "ascending")])
    lengths = rows.column("length").to_numpy()
    where, gaps = sum_of_squares(lengths, capacity)
    order = np.argsort(where, kind="stable")
    sizes = lengths[order]
    before = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0])
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - np.repeat(before[starts], np.diff(np.r_[starts, len(order)]))
    group = rows.column("grp").to_numpy()
    return pa.table({"row_no": rows.column("row_no"), "piece": rows.column("piece"), "length": rows.column("length"), "sequence_id": (number << 56) + (group << 24) + where, "offset": offset, "done": gaps[where] <= most_gap})


def _final(group_size: int, count: int, last: int) -> int:
    return 1 if count <= last else -(-count // group_size)


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, last_pieces: int = LAST_GROUP_PIECES, closed_gap: int = CLOSED_GAP) -> DataFrame:
    """cut: row_no, piece, length (1 to capacity). Returns row_no, piece, sequence_id, offset for every row."""
    schema = "row_no long, piece int, length long, sequence_id long, offset long, done boolean"
    full = cut.filter(F.col("length") == capacity)
    full = full.select("row_no", "piece", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < capacity).select("row_no", "piece", "length")
    done, number, count = [full], 0, rest.count()
    while count:
        groups = _final(group_pieces, count, last_pieces)
        last = groups == 1
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("row_no", "piece", F.lit(number)), F.lit(groups)))
        run = _packer(capacity, capacity if last else closed_gap, number)
        packed = common.stage(dealt.groupBy("grp").applyInArrow(run, schema), "packed")
        left = 0 if last else packed.filter(~F.col("done")).count()
        if left > 0.8 * count:  # the round closed little: the next would not either
            left = 0
        done.append((packed.filter("done") if left else packed).select("row_no", "piece", "sequence_id", "offset"))
        rest, count, number = packed.filter(~F.col("done")).select("row_no", "piece", "length"), left, number + 1
    return functools.reduce(DataFrame.unionByName, done)


def _packer(capacity: int, most_gap: int, number: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        return _pack_group(rows, capacity, most_gap, number)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than capacity are cut. A null or empty text is the end id alone. Repeated rows are packed
    each for itself. An empty table gives no rows; other columns are not read.
    """
    cut = common.stage(pieces(docs, id_col, text_col, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity), "pieces")
    placed = pack(cut, capacity).withColumnsRenamed({"row_no": "__row", "piece": "__piece"})
    out = cut.join(placed, (cut.row_no == placed["__row"]) & (cut.piece == placed["__piece"]))
    return out.select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
