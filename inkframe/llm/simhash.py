"""SimHash near-dedup by multi-index hashing (Norouzi et al., 2012).

A fingerprint is cut into two 32-bit segments, and a table per segment holds it under the segment's value. Two
fingerprints within 2 bits agree in one segment but for one bit at most. So each value's Hamming ball of radius 1 is
enumerated, the buckets found under it are fetched from the table, and the complete distances of their fingerprints
are verified.

A bucket that holds more than BUCKET fingerprints (many near copies that agree in a segment) would meet itself as all
pairs. Its fingerprints are indexed once more, under the ball of radius 1 of their other segment: all in one such place are
within 2 bits of each other and are linked through the smallest; a fingerprint of a neighbouring bucket looks up the
place of its other segment. A place holds 33 fingerprints and 32 that look it up at most, however many copies there
are, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import common
from inkframe.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
DISTANCE = 2
SEGMENT_BITS = 32
#: Fingerprints of a segment's bucket up to which all of them are compared.
BUCKET = 64
#: Shingle hashes whose bits are counted at once.
CHUNK = 100_000


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle, repeats included; fewer words than a shingle has: of the whole sequence; no words: none."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(t), SEED) for t in zip(*(words[k:] for k in range(width)), strict=False)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprints(texts: list[bytes], width: int = SHINGLE_WORDS) -> list[int]:
    """A bit is 1 if it is set in over half of the hashes."""
    out: list[int] = []
    todo: list[list[int]] = []

    def flush() -> None:
        if not todo:
            return
        sizes = np.array([len(x) for x in todo])
        counts = np.zeros((len(todo), 64), np.int64)
        some = np.flatnonzero(sizes)
        if len(todo) == 1 and sizes[0] > CHUNK:
            for start in range(0, sizes[0], CHUNK):
                counts[0] += _bit_counts(np.array(todo[0][start : start + CHUNK], np.uint64)).sum(axis=0, dtype=np.int64)
        elif len(some):
            bits = _bit_counts(np.concatenate([np.array(todo[i], np.uint64) for i in some]))
            starts = np.concatenate([[0], np.cumsum(sizes[some])])
            for k, i in enumerate(some):
                counts[i] = bits[starts[k] : starts[k + 1]].sum(axis=0, dtype=np.int64)
        set_bits = counts * 2 > sizes[:, None]
        out.extend(int(x) for x in (set_bits * _WEIGHTS).sum(axis=1, dtype=np.uint64))
        todo.clear()

    held = 0
    for text in texts:
        hashes = shingle_hashes(text, width)
        if held + len(hashes) > CHUNK:
            flush()
            held = 0
        todo.append(hashes)
        held += len(hashes)
    flush()
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, fp): fp is the fingerprint as a signed long; null texts count as empty (fingerprint zero)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = np.array(fingerprints(common.text_bytes(batch.column("text")), width), np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(marks, pa.int64())], names=["doc", "fp"])

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), one, "doc long, fp long")


_LOW = (1 << SEGMENT_BITS) - 1


def _segment(which: int) -> F.Column:
    """A segment's value, with the segment's number above it: the table's key."""
    value = F.col("fp").bitwiseAND(F.lit(_LOW)) if which == 0 else F.shiftrightunsigned("fp", SEGMENT_BITS)
    return value + F.lit(which << SEGMENT_BITS)


def segment_table(marks: DataFrame) -> DataFrame:
    """(key, fp, rest): a row per segment of each fingerprint; rest is the value of its other segment."""
    row = lambda k: F.struct(_segment(k).alias("key"), _segment(1 - k).bitwiseAND(F.lit(_LOW)).alias("rest"))
    return marks.select("fp", F.explode(F.array(row(0), row(1))).alias("x")).select("x.key", "fp", "x.rest")


def _flips(value: str) -> list[F.Column]:
    return [F.col(value).bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(SEGMENT_BITS)]


def bucket_pairs(table: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): the keys of buckets whose segments agree but for one bit, each pair once, and (a, a) of buckets of two or more."""
    sizes = common.stage(table.groupBy("key").agg(F.count("*").alias("n")), "buckets")
    # 32 rows come of each: they are dealt to all tasks, however small the table is
    dealt = sizes.repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    balls = dealt.select(F.col("key").alias("a"), F.col("n").alias("a_n"), F.explode(F.filter(F.array(*_flips("key")), lambda x: x > F.col("key"))).alias("b"))
    near = balls.join(sizes.select("key", F.col("n").alias("b_n")), F.col("b") == F.col("key")).select("a", "b", "a_n", "b_n")
    return near.unionByName(sizes.filter("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"), F.col("n").alias("a_n"), F.col("n").alias("b_n")))


def links(marks: DataFrame) -> DataFrame:
    """marks: fp, distinct. Edges (u, v) between fingerprints within DISTANCE bits: enough to connect all such pairs."""
    table = common.stage(segment_table(marks), "segments")
    pairs = common.stage(bucket_pairs(table), "bucket_pairs")
    few = pairs.filter(F.greatest("a_n", "b_n") <= BUCKET)
    member = lambda end: table.select(F.col("key").alias(f"key_{end}"), F.col("fp").alias(end))
    met = few.join(member("u"), F.col("a") == F.col("key_u")).join(member("v"), F.col("b") == F.col("key_v"))
    # the first segment's table finds a pair that both would find
    met = met.filter((F.col("a") != F.col("b")) | (F.col("u") > F.col("v")))
    near = met.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    large = pairs.filter(F.greatest("a_n", "b_n") > BUCKET)
    large = large.select(F.when(F.col("b_n") > BUCKET, F.col("b")).otherwise(F.col("a")).alias("hot"), F.when(F.col("b_n") > BUCKET, F.col("a")).otherwise(F.col("b")).alias("beside"))
    hot = large.select(F.col("hot").alias("of")).distinct()
    own = table.join(hot, F.col("key") == F.col("of")).select(F.col("key").alias("hot"), "fp", F.lit(True).alias("own"), F.explode(F.array("rest", *_flips("rest"))).alias("place"))
    asked = large.filter("hot <> beside").join(table, F.col("beside") == F.col("key")).select("hot", "fp", F.lit(False).alias("own"), F.col("rest").alias("place"))
    # by construction at most 33 of the bucket's own and 32 that ask
    places = own.unionByName(asked).groupBy("hot", "place").agg(F.min(F.when(F.col("own"), F.col("fp"))).alias("v"), F.collect_set("fp").alias("all"))
    linked = places.filter("v is not null and size(all) > 1").select("v", F.explode("all").alias("u")).filter("u <> v")
    linked = linked.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    return near.unionByName(linked.select("u", "v"))


def _with_root(rows: DataFrame) -> DataFrame:
    """rows: doc, fp, staged. (of, root): the smallest fingerprint that each distinct fingerprint reaches."""
    marks = common.stage(rows.select("fp").distinct(), "marks")
    roots = components(links(marks))
    return common.stage(marks.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("root", "fp").alias("root")), "roots")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: id_col, fingerprint, component_id. Ids are integers.

    Fingerprints (of shingles of width words) link at 2 or fewer differing bits, equal ones too; component_id is the
    smallest id reachable. Null and empty texts have fingerprint zero and are linked like any other. A null id is never
    a component_id unless all ids of the component are null. An empty table gives no rows; other columns are not read.
    """
    rows = common.stage(with_fingerprint(docs, id_col, text_col, width), "fingerprints")
    roots = _with_root(rows)
    least = rows.groupBy("fp").agg(F.min("doc").alias("least"))
    ids = roots.join(least, F.col("of") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of_root")
    of = roots.join(ids, F.col("root") == F.col("of_root")).select("of", "component_id")
    return rows.join(of, rows.fp == F.col("of"), "left").select(
        F.col("doc").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """One row of docs, with all its columns, per component of near_groups(): the one with the smallest id. A null id comes
    after all others; of rows with the same id, one stays. What stays is chosen by row, so rows that share an id and no text stay apart."""
    number = common.unused(docs, "__row")
    numbered = common.stage(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = common.stage(with_fingerprint(numbered, number, text_col, width), "fingerprints").join(numbered.select(number, F.col(id_col).alias("id")), F.col("doc") == F.col(number))
    rows = common.stage(rows.select("fp", "id", F.col("doc").alias("row")), "identified")
    found = rows.join(_with_root(rows), F.col("fp") == F.col("of")).select("root", "id", "row")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    stay = found.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.row").alias(common.unused(numbered, "stays")))
    return numbered.join(stay, F.col(number) == F.col(stay.columns[0]), "left_semi").select(*docs.columns)
