"""SentencePiece encoding and decoding over a table of distinct chunks.

If no piece of a model has a whitespace marker after another character, no merge crosses the start of a marked word.
A text is then the row of its chunks (markers and what follows them, and runs of newlines, which no piece holds
either), each distinct chunk is segmented once, and a text's ids are those of its chunks, in order. The table of
chunks lives in the task and holds a bounded number of entries, so nothing is shuffled; a model that breaks the rule, or a text
that holds the marker itself, is encoded whole by the library.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import common

MARK = "▁"
CHUNK = re.compile(r"\n+| *[^ \n]+| +")
#: Chunks in a task's table; a full table is emptied. Longer chunks are not kept.
MOST_CHUNKS = 200_000
LONGEST_KEPT = 64


class ChunkTable:
    """chunk -> (ids joined by commas, ids). Encodes whole texts from it and decodes their ids with the library."""

    def __init__(self, path: str) -> None:
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.lead = m.encode("\n")
        #: The chunks stand on their own only if markers only start pieces, newlines are in none, and spaces are kept.
        self.by_chunk = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and all(m.decode(m.encode(x)) == x for x in ("a  b", " a ")) and len(m.encode("\n\n")) == 2 * len(self.lead) - 1
        self.known: dict[str, tuple[str, list[int]]] = {}

    def _encode(self, chunks: list[str]) -> dict[str, tuple[str, list[int]]]:
        # the library puts a marker before every input: it stands for a chunk's first space, or is cut off again
        spaced = [c[0] == " " and len(c) > 1 for c in chunks]
        marked = [c[1:] if s else "\n" + c.strip(" ") for c, s in zip(chunks, spaced, strict=True)]
        out = {}
        for chunk, s, ids in zip(chunks, spaced, self.model.encode(marked, num_threads=1), strict=True):
            ids = ids if s else ids[: len(self.lead) - 1] if chunk == " " else ids[len(self.lead) :]
            out[chunk] = (",".join(map(str, ids)), ids)
        return out

    def texts(self, texts: list[str]) -> list[tuple[str, list[int], str]]:
        """(ids joined by commas, ids, decoded text) of each text."""
        if len(self.known) > MOST_CHUNKS:
            self.known.clear()
        known, whole = self.known, [not self.by_chunk or MARK in text for text in texts]
        chunks = [[] if w or not text else CHUNK.findall(" " + text) for text, w in zip(texts, whole, strict=True)]
        new = set().union(*chunks).difference(known)
        known.update(self._encode(list(new)))
        ids = []
        for text, row, w in zip(texts, chunks, whole, strict=True):
            if w:
                all_ids = self.model.encode(text)
                ids.append((",".join(map(str, all_ids)), all_ids))
            else:
                got = [known[c] for c in row]
                ids.append((",".join([x[0] for x in got]), list(itertools.chain.from_iterable([x[1] for x in got]))))
        for chunk in new:
            if len(chunk) > LONGEST_KEPT:
                del known[chunk]
        decoded = self.model.decode([x[1] for x in ids], num_threads=1) if ids else []
        return [(*x, text) for x, text in zip(ids, decoded, strict=True)]


@functools.cache
def _table(path: str) -> ChunkTable:
    return ChunkTable(path)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digests: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, and ids and decoded (the text that the ids give), or with digests
    ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.

    Ids are exactly the library's for the whole text, without begin or end ids. Null counts as empty: no ids, empty
    text. An empty table gives no rows; other columns are not read.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _table(path).texts(common.text_strings(batch.column("text")))
        n = pa.array([len(i) for _, i, _ in rows], pa.int64())
        if digests:
            out = [pa.array([sha(x) for x, _, _ in rows]), pa.array([sha(x) for _, _, x in rows])]
            return pa.RecordBatch.from_arrays([batch.column("doc"), n, *out], names=["doc", "n_tokens", "ids_sha256", "decoded_sha256"])
        ids = pa.array([i for _, i, _ in rows], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc"), n, ids, pa.array([x for _, _, x in rows], pa.string())], names=["doc", "n_tokens", "ids", "decoded"])

    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return common.map_batches(slim, one, f"doc {kind}, n_tokens long, {rest}").withColumnRenamed("doc", id_col)
