"""Exact dedup over a cuckoo-filter index of live digests.

The index is a table of buckets. Each digest belongs to one bucket (by its own bits), and a bucket is small enough
for one task. In a bucket, a cuckoo filter answers "surely new" without touching the content; a hit is verified
against the bucket's stored digests; an insertion that overflows doubles the filter and refills it from the stored
keys; a digest that is no longer live is deleted from both.

Copies are combined within each input batch before the shuffle, so a text with a third of all rows costs one row per
batch in its bucket. The texts never leave the scan: 32-byte digests do.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import common

SLOTS = 4
MAX_KICKS = 200
#: Digests that one bucket of the index holds on average at most.
DIGESTS_PER_BUCKET = 100_000
LEAST_BUCKETS = 256


class CuckooFilter:
    """A cuckoo filter (Fan et al., 2014) with 4-slot buckets and 16-bit fingerprints (0: a free slot)."""

    def __init__(self, capacity: int = 64) -> None:
        self.size = 16
        while self.size * SLOTS * 0.9 < capacity:
            self.size *= 2
        self.slots = array("H", bytes(2 * self.size * SLOTS))
        self.turn = 0

    def _place(self, key: bytes) -> tuple[int, int]:
        # bytes 8 on: the leading ones chose the index bucket and are alike there
        bits = int.from_bytes(key[8:20], "little")
        return (bits & 0xFFFF) or 1, (bits >> 16) & (self.size - 1)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 & (self.size - 1))

    def _add(self, place: int, mark: int) -> bool:
        for i in range(place * SLOTS, place * SLOTS + SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def contains(self, key: bytes) -> bool:
        mark, place = self._place(key)
        s, a, b = self.slots, place * SLOTS, self._other(place, mark) * SLOTS
        return mark in s[a : a + SLOTS] or mark in s[b : b + SLOTS]

    def insert(self, key: bytes) -> bool:
        """False: the filter overflowed; the caller must resize it from its stored keys, key among them."""
        mark, place = self._place(key)
        if self._add(place, mark) or self._add(place := self._other(place, mark), mark):
            return True
        for _ in range(MAX_KICKS):
            self.turn = (self.turn + 1) % SLOTS
            i = place * SLOTS + self.turn
            mark, self.slots[i] = self.slots[i], mark
            place = self._other(place, mark)
            if self._add(place, mark):
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, place = self._place(key)
        for where in (place, self._other(place, mark)):
            for i in range(where * SLOTS, where * SLOTS + SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return True
        return False


def merge(live: list, row: tuple, count: int, same: int) -> None:
    """Adds a group of copies to another: [row that stays, copies, copies with that row's id]."""
    live[1] += count
    live[2] = live[2] + same if row[0] == live[0][0] else same if row[0] > live[0][0] else live[2]
    live[0] = max(live[0], row)


class LiveDigests:
    """One bucket: the filter, and the content that its hits are verified against."""

    def __init__(self, capacity: int = 64) -> None:
        self.filter = CuckooFilter(capacity)
        self.content: dict[bytes, list] = {}
        self.false_hits = 0
        self.resizes = 0

    def _resize(self) -> None:
        capacity = self.filter.size * SLOTS
        while True:
            self.resizes += 1
            capacity *= 2
            self.filter = CuckooFilter(capacity)
            if all(self.filter.insert(key) for key in self.content):
                return

    def insert(self, key: bytes, row: tuple, count: int, same: int = 1) -> None:
        """row: (id, number), which orders the copies; the largest stays. same: how many of the count rows have its id."""
        if self.filter.contains(key):
            live = self.content.get(key)
            if live is not None:
                merge(live, row, count, same)
                return
            self.false_hits += 1
        self.content[key] = [row, count, same]
        if not self.filter.insert(key):
            self._resize()

    def delete(self, key: bytes) -> bool:
        if not self.filter.contains(key) or key not in self.content:
            return False
        del self.content[key]
        return self.filter.delete(key)


def digest(text_col: str) -> F.Column:
    """SHA-256 of the text's UTF-8, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(common.text_or_empty(text_col).cast("binary"), 256))


_INDEX = "digest binary, keep_id long, keep_row long, group_size long, same_id long"
#: Null ids sort before all others, as Spark's.
_LEAST = -(2**63) - 1


def _combine(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The copies within a batch in one row each: digest, the row that stays, count."""
    found: dict[bytes, list] = {}
    for key, doc, row in zip(*(batch.column(c).to_pylist() for c in ("digest", "doc", "row_no")), strict=True):
        mine = (_LEAST if doc is None else doc, row)
        if (had := found.get(key)) is None:
            found[key] = [mine, 1, 1]
        else:
            merge(had, mine, 1, 1)
    return _rows(found.items())


def _rows(items: Iterable[tuple[bytes, list]]) -> pa.RecordBatch:
    items = list(items)
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in items], pa.binary()), pa.array([None if v[0][0] == _LEAST else v[0][0] for _, v in items], pa.int64()), pa.array([v[0][1] for _, v in items], pa.int64()), pa.array([v[1] for _, v in items], pa.int64()), pa.array([v[2] for _, v in items], pa.int64())],
        names=["digest", "keep_id", "keep_row", "group_size", "same_id"],
    )


def build_index(keyed: DataFrame, retired: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """The live digests of keyed (digest, doc, row_no): digest, keep_id, keep_row, group_size, same_id.

    retired: digests (column digest) to delete from the index once all rows are in.
    """
    buckets = buckets or max(LEAST_BUCKETS, -(-keyed.count() // DIGESTS_PER_BUCKET))
    parts = keyed.select("digest", "doc", "row_no").mapInArrow(lambda batches: (_combine(b) for b in batches if b.num_rows), _INDEX)
    parts = parts.withColumn("gone", F.lit(False))
    if retired is not None:
        parts = parts.unionByName(retired.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("keep_row"), F.lit(0).cast("long").alias("group_size"), F.lit(0).cast("long").alias("same_id"), F.lit(True).alias("gone")))

    def bucket(rows: pa.Table) -> pa.Table:
        live = LiveDigests(64)
        gone = []
        for key, doc, row, count, same, out in zip(*(rows.column(c).to_pylist() for c in ("digest", "keep_id", "keep_row", "group_size", "same_id", "gone")), strict=True):
            if out:
                gone.append(key)
            else:
                live.insert(key, (_LEAST if doc is None else doc, row), count, same)
        for key in gone:
            live.delete(key)
        return pa.Table.from_batches([_rows(live.content.items())])

    place = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(buckets))
    return parts.groupBy(place.alias("bucket")).applyInArrow(bucket, _INDEX)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, and row_no, which tells repeated rows apart.

    Texts are equal if identical; null counts as empty. Of equal texts the row with the largest id stays; a null id is
    smaller than any other; of repeated rows with that id, exactly one stays. An empty table gives no rows. Other
    columns of docs are not read.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row_no"))
    keyed = common.stage(keyed, "digests")
    index = build_index(keyed).withColumnRenamed("digest", "of")
    return keyed.join(index, keyed.digest == index.of, "left").select(
        F.col("doc").alias(id_col), "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row_no"
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, by the rule of exact_dedup(); of repeated rows, one stays."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row_no"))
    index = common.stage(build_index(common.stage(slim, "digests")), "live")
    mark, of, kept = (common.unused(docs, c) for c in ("__digest", "__of", "__id"))
    stay = index.select(F.col("keep_id").alias(kept), F.col("digest").alias(of))
    mine = docs.withColumn(mark, digest(text_col))
    same = F.col(mark) == F.col(of)
    out = mine.join(stay, same & F.col(id_col).eqNullSafe(F.col(kept)), "left_semi")
    again = index.filter("same_id > 1").select(F.col("digest").alias(of))
    if not again.isEmpty():  # rows repeated with id and text: one of each
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([mark]))
    return out.drop(mark)


def sha256_hex(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
