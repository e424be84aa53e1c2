"""Shards of near-equal bytes by sampled splitters, with DataFrame functions only.

Rows are ordered by (hash of the text, id), so equal texts are neighbours. A size-weighted sample of the keys gives
quantile boundaries; rows are range-partitioned by them; ranges that turn out overfull are sampled again and
subdivided, a hot group of equal texts by id. Only then are ranges sorted, each in a task of its own. Large groups of
equal texts get a shard first, each whole. The ranges' exact sizes place every other row on one line of bytes, and that
line is cut into what room the shards have left: the sample decides how evenly the work is dealt, never where a row
ends up.

The driver sees the samples, the splitters, a line per range and the large groups: their number follows rows / ROWS_PER_RANGE.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe.llm import common

SHARDS = 40
LAW = "bytes"
ROWS_PER_RANGE = 1_000_000
RANGES_PER_SHARD = 8
#: Sampled keys for each range.
OVERSAMPLE = 8
#: A range with more than this many times its share is subdivided.
OVERFULL = 2
#: Groups of equal texts with more than a GROUP_SHARE-th of a shard's bytes are placed before the line is cut.
GROUP_SHARE = 100
MOST_ROUNDS = 12
_LEAST = -(2**63)

#: (hash, id) at which a range begins; _LEAST as id: before all ids.
Splitter = tuple[int, int]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("bytes"),
        F.crc32(common.text_or_empty(text_col).cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(common.text_or_empty(text_col).cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("d"),
        F.monotonically_increasing_id().alias("row_no"),
    ).withColumn("size", F.col("bytes") + 16).withColumn("line", F.col("size"))


def _sample(rows: DataFrame, bytes_per_key: float, number: int) -> DataFrame:
    """Each row with a chance of size / bytes_per_key; the draw is a hash of the row, so a retried task draws the same."""
    draw = F.shiftrightunsigned(F.xxhash64("h", "d", "row_no", F.lit(number)), 11) / F.lit(float(2**53))
    return rows.filter(draw < F.col("size") / F.lit(bytes_per_key))


def _quantiles(keys: list[tuple[int, int, int]], bytes_per_key: float, share: float) -> list[tuple[int, int]]:
    """The keys (h, d, size) at which each further share of bytes begins."""
    out, seen = [], 0.0
    for h, d, size in sorted(keys):
        weight = max(bytes_per_key, float(size))
        if int((seen + weight) / share) > int(seen / share):
            out.append((h, d))
        seen += weight
    return out


def _structs(keys: list[Splitter]) -> str:
    number = lambda x: f"{x}L" if x > _LEAST else "-9223372036854775807L - 1L"
    return f"array({', '.join(f'struct({number(h)} AS h, {number(d)} AS d)' for h, d in keys)})"


def _with_range(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """range: how many splitters are at or before the row's key; counted among every k-th of them, then among the k that follow."""
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    k = max(1, round(len(splitters) ** 0.5))
    tops = [splitters[i] for i in range(k - 1, len(splitters), k)]
    runs = [splitters[i : i + k] for i in range(0, len(splitters), k)]
    before = lambda s: (s["h"] < F.col("h")) | ((s["h"] == F.col("h")) & (s["d"] <= F.col("d")))
    top = F.size(F.filter(F.expr(_structs(tops)), before)) if tops else F.lit(0)
    run = F.get(F.expr(f"array({', '.join(map(_structs, runs))})"), F.col("top"))
    rest = F.coalesce(F.size(F.filter(run, before)), F.lit(0))
    return rows.withColumn("top", top).withColumn("range", F.col("top") * k + F.when(F.col("top") < len(runs), rest).otherwise(0)).drop("top")


def _splitters(rows: DataFrame, total: int, ranges: int) -> tuple[list[Splitter], list]:
    """Splitters under which no range is overfull, and the ranges' sizes, in order."""
    share = total / ranges
    per_key = share / OVERSAMPLE
    first = _quantiles([tuple(r) for r in _sample(rows, per_key, 0).select("h", "d", "size").collect()], per_key, share)
    found: set[Splitter] = {(h, _LEAST) for h, _ in first}
    for number in range(1, MOST_ROUNDS + 1):
        splitters = sorted(found)
        ranged = _with_range(rows, splitters)
        sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("line").alias("line"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1")).orderBy("range").collect()
        over = {r["range"]: r for r in sizes if r["size"] > OVERFULL * share and (r["h0"], r["d0"]) != (r["h1"], r["d1"]) and r["n"] > 1}
        if not over or number == MOST_ROUNDS:
            break
        drawn: dict[int, list] = {r: [] for r in over}
        for x in _sample(ranged.filter(F.col("range").isin(list(over))), per_key, number).select("range", "h", "d", "size").collect():
            drawn[x["range"]].append((x["h"], x["d"], x["size"]))
        for r, line in over.items():
            keys = _quantiles(drawn[r], per_key, share)
            if line["h0"] < line["h1"]:
                found |= {(h, _LEAST) for h, _ in keys if h > line["h0"]} | {(line["h1"], _LEAST)}
            else:  # a single group of equal texts
                found |= {key for key in keys if key[1] > line["d0"]} | {(line["h1"], line["d1"])}
    return splitters, sizes


def _rows(spark: SparkSession, values: list[tuple], names: str) -> DataFrame:
    """A small table of whole numbers; names as in 'h long, home int'."""
    columns = [n.split()[0] for n in names.split(", ")]
    schema = f"array<struct<{', '.join(n.replace(' ', ':') for n in names.split(', '))}>>"
    data = json.dumps([dict(zip(columns, v, strict=True)) for v in values])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(data), schema)))


def place_groups(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int], list[int]]:
    """(hash -> shard, bytes in each shard) for groups (hash, bytes): the largest first, each in the shard with the fewest bytes,
    if the shard's equal share of the total has room for it. Groups without room are left out."""
    heap, homes, loads = [(0, s) for s in range(shards)], {}, [0] * shards
    for h, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, s = heap[0]
        if (load + size) * shards <= total:
            heapq.heapreplace(heap, (load + size, s))
            homes[h], loads[s] = s, load + size
    return homes, loads


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard.

    Law bytes. Equal texts stay in one shard, unless their group has no room in the emptiest one when it is placed. Groups of
    over a GROUP_SHARE-th of a shard are placed first, see place_groups(). All other rows form a line in the order of (hash
    of the text, id), cut where the shards are full; a group goes where its middle falls, the rows of a group without room
    where their own middles fall. Slots count a shard's rows from 0 in that order; ties of repeated rows are in any order. Null
    texts count as empty, null ids come first. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = common.stage(_keyed(docs, id_col, text_col), "keyed")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    total, ranges = max(1, counts["size"]), max(RANGES_PER_SHARD * shards, -(-counts["n"] // ROWS_PER_RANGE))
    # groups over a limit-th of all bytes, fewer than limit; smaller ones never fill a range, so no splitter cuts them
    limit = max(GROUP_SHARE * shards, ranges)
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("size") * limit > total))
    large = [(r["h"], r["size"]) for r in groups.collect()]
    homes, loads = place_groups(large, shards, total)
    known = _rows(spark, [(h, homes.get(h)) for h, _ in large], "h long, home int").withColumn("large", F.lit(True))
    rows = rows.join(F.broadcast(known), "h", "left").withColumn("line", F.when(F.col("home").isNull(), F.col("size")).otherwise(0))

    splitters, sizes = _splitters(rows, total, ranges)
    before, b = [], 0
    for r in sizes:
        before.append((r["range"], b))
        b += r["line"]
    ordered = Window.partitionBy("range").orderBy("h", "d", "row_no")
    group = Window.partitionBy("range", "h")
    out = _with_range(rows, splitters).join(F.broadcast(_rows(spark, before, "range int, before long")), "range")
    out = out.withColumn("start", F.sum("line").over(ordered) - F.col("line") + F.col("before"))
    out = out.withColumns({"group_size": F.sum("size").over(group), "group_start": F.min("start").over(group)})
    middle = F.when(F.col("large"), 2 * F.col("start") + F.col("size")).otherwise(2 * F.col("group_start") + F.col("group_size"))
    # shard s ends where the room of the shards up to it is used up; all in bytes times shards, to stay with whole numbers
    ends, room = [], 0
    for load in loads[:-1]:
        room += total - load * shards
        ends.append(F.lit(2 * room))
    cut = F.size(F.filter(F.array(*ends), lambda end: end <= middle * shards)) if ends else F.lit(0)
    out = out.withColumn("shard", F.coalesce("home", cut).cast("int"))
    nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy("h", "d", "row_no")) - 1
    placed = common.stage(out.select("doc", "size", "text_crc32", "range", "shard", nth.alias("nth")), "placed")
    # a line per range and shard that meet: fewer than ranges + shards + large groups
    met = placed.groupBy("range", "shard").agg(F.count("*").alias("n"))
    first = met.select("range", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("first"))
    slot = (F.col("nth") + F.col("first")).cast("long")
    done = placed.join(F.broadcast(first), ["range", "shard"])
    return done.select(F.col("doc").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
