"""Near copies by word shingles: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First come the candidates of the SimHash index (fingerprints of the same shingles within 2 bits), each verified on its
texts. At a similarity of 0.8 fingerprints differ in ten bits on average, which no set of small Hamming balls reaches, so
the index alone can't give the whole result. What it leaves is found by prefix filtering (Chaudhuri et al., 2006), which
leaves none out: all shingles have one order; a set of n, whose similar sets share at least 0.8 n with it, shares one of
its first n - ceil(0.8 n) + 1 with each of them. The order is by hash, with shingles that are frequent in a sample last,
so that common passages are seldom looked up; the sample has no influence on what is found. Each row is held against the
smallest and the largest of all rows that share a shingle of its prefix first, and then, in a few turns, against some
chosen by hash from other components, which joins most groups of copies. Last, of different components under a shingle only, those outside the shingle's largest component are held against all: that
comparison looks at signatures and grows with the square of the components under a shingle, but gives out only the
pairs that may be similar.

Signatures (parity bitmaps, Sandes et al., 2020) of as many bits as a set has shingles, or more, show nearly all pairs
that are not similar before their texts are fetched. Texts are fetched through a bitmap of the rows that take part, of a
fixed size: what it leaves out takes no part in the shuffle, and what it lets through by chance the join drops.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import common, simhash
from inkframe.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
#: The frequent shingles: those of at least LEAST_COUNT texts of a sample of about SAMPLE texts; MOST_FREQUENT at most.
SAMPLE = 20_000
LEAST_COUNT = 8
MOST_FREQUENT = 200_000
#: A signature has a power of two of bits, LEAST_BITS or as many as the set has shingles.
LEAST_BITS = 512
#: Bits of the bitmap of rows.
BITMAP_BITS = 1 << 24
#: Turns in which rows are held against PIVOTS others each, before all that is left is compared.
TURNS = 3
PIVOTS = 8
#: Shingles are counted in so many slices, one after the other: what that shuffles and spills at once is one slice.
SLICES = 2
_FACTOR, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of shingles, sorted; of fewer words than a shingle has, one of all of them."""
    words = text.lower().split()
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    size = min(width, len(words))
    out = np.zeros(max(1, len(words) - size + 1), np.uint64)
    for k in range(size):
        out *= _FACTOR
        out += h[k : len(words) - size + 1 + k]
    out ^= out >> np.uint64(31)
    out *= _MIXER
    out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray, least: Fraction = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, least: Fraction = SIMILARITY) -> np.ndarray:
    """The shingles under which a set is looked up. frequent: sorted hashes, rank: their order among themselves."""
    size = len(shingles) - math.ceil(least * len(shingles)) + 1
    if not len(frequent):
        return shingles[:size]
    place = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    known = frequent[place] == shingles
    last = shingles[known][np.argsort(rank[place[known]])]
    return np.concatenate([shingles[~known], last])[:size]


def frequent_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent shingles of a sample, and the place of each by its count."""
    n = rows.count()
    if not n:
        return np.array([], np.uint64), np.array([], np.int64)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in common.text_bytes(batch.column("text"))]
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["key", "n"])

    taken = rows.sample(min(1.0, SAMPLE / n), seed=1).select("text")
    counts = common.map_batches(taken, count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    counts = common.stage(counts, "frequent")
    least, held = LEAST_COUNT, 0
    for r in sorted(counts.groupBy("n").count().collect(), reverse=True):
        held += r["count"]
        if held > MOST_FREQUENT:
            least = r["n"] + 1
            break
    found = counts.filter(F.col("n") >= least).toPandas()
    keys, n = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy()
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, n))] = np.arange(len(keys))
    order = np.argsort(keys)
    return keys[order], rank[order]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by their hash: as many bits as two signatures differ in, or more, are shingles of one set only."""
    bits = max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length())
    parity = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def folded_short(mark: np.ndarray) -> np.ndarray:
    """The signature folded to LEAST_BITS: parities of more bits each, so it differs in no more bits than the whole one."""
    return np.bitwise_xor.reduce(mark.reshape(-1, LEAST_BITS // 64), axis=0)


def _apart(a: F.Column, b: F.Column) -> F.Column:
    """The bits in which two signatures differ; the longer one is folded onto the length of the other."""

    def folded(x: F.Column, to: F.Column) -> F.Column:
        # bit k of a signature of half the length is the parity of bits k and k + half
        return F.when(F.size(x) > to, F.zip_with(F.slice(x, F.lit(1), to), F.slice(x, to + 1, to), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    size = F.least(F.size(a), F.size(b))
    differ = F.zip_with(folded(a, size), folded(b, size), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda acc, x: acc + x)


def prefixes(rows: DataFrame, width: int, least: Fraction) -> DataFrame:
    """(row, n, signature, short, keys): the size of each text's set, its signature, that folded to a fixed length, and its prefix."""
    frequent, rank = frequent_shingles(rows, width)
    sent = rows.sparkSession.sparkContext.broadcast((frequent, rank))

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in common.text_bytes(batch.column("text"))]
        lists = lambda arrays: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]), pa.int32()), pa.array(np.concatenate(arrays).view(np.int64)))
        whole = [signature(s) for s in sets]
        marks, short, firsts = lists(whole), lists([folded_short(m) for m in whole]), lists([prefix(s, *sent.value, least) for s in sets])
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(s) for s in sets], pa.int32()), marks, short, firsts], names=["row", "n", "signature", "short", "keys"])

    return common.map_batches(rows.select("row", "text"), keys, "row long, n int, signature array<long>, short array<long>, keys array<long>")


def possible(pairs: DataFrame, marks: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (u, v) without those that sizes and signatures show not to be similar; none that is similar is left out."""
    end = lambda e: marks.select(F.col("row").alias(f"__{e}"), F.col("n").alias(f"{e}_n"), F.col("signature").alias(f"{e}_s"))
    both = pairs.join(end("u"), F.col("u") == F.col("__u")).join(end("v"), F.col("v") == F.col("__v"))
    return both.filter(_may_be_similar("u", "v", least)).select("u", "v")


def _may_be_similar(u: str, v: str, least: Fraction) -> F.Column:
    """By sizes (<end>_n) and signatures (<end>_s); false only for sets that are not similar."""
    u_n, v_n = F.col(f"{u}_n"), F.col(f"{v}_n")
    apart, n = _apart(F.col(f"{u}_s"), F.col(f"{v}_s")), u_n + v_n
    # both / (n - both) >= least, where n is the sum of the sizes and both is (n - apart) / 2 at most; signatures of sets
    # of similar sizes are of one length, or one is twice as long
    fits = F.least(u_n, v_n) * least.denominator >= F.greatest(u_n, v_n) * least.numerator
    return F.when(fits, (n - apart) * least.denominator >= (n + apart) * least.numerator).otherwise(False)


def through_bitmap(ids: DataFrame, row_col: str = "row") -> F.Column:
    """A filter by row_col: true for all rows in ids (column row), and by chance for a few others. Ids of any number make
    a bitmap of BITMAP_BITS, which is all that is sent."""
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = ids.select(place("row").alias("place")).groupBy(F.floor(F.col("place") / 64).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    held = np.zeros(BITMAP_BITS // 64, np.int64)
    held[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    sent = ids.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def passes(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    return passes(place(row_col))


def verified(pairs: DataFrame, rows: DataFrame, width: int, least: Fraction) -> DataFrame:
    """Those of the distinct, staged pairs (u, v) of row numbers whose texts are similar."""
    taking_part = pairs.select(F.explode(F.array("u", "v")).alias("row"))
    texts = common.stage(rows.filter(through_bitmap(taking_part)).select("row", "text"), "texts", "zstd")
    text = lambda end: texts.select(F.col("row").alias(f"__{end}"), F.col("text").alias(f"{end}_text"))
    both = pairs.join(text("u"), F.col("u") == F.col("__u")).join(text("v"), F.col("v") == F.col("__v")).select("u", "v", "u_text", "v_text")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[int, np.ndarray] = {}

        def sets(end: str) -> Iterable[np.ndarray]:
            for row, t in zip(batch.column(end).to_pylist(), common.text_bytes(batch.column(f"{end}_text")), strict=True):
                if row not in known:
                    known[row] = shingle_set(t, width)
                yield known[row]

        good = pa.array([similar(a, b, least) for a, b in zip(sets("u"), sets("v"), strict=True)], pa.bool_())
        return batch.select(["u", "v"]).filter(good)

    found = common.stage(common.map_batches(both, check, "u long, v long"), "near")
    common.drop_staged(rows.sparkSession, texts)
    return found


def simhash_candidates(rows: DataFrame, width: int) -> DataFrame:
    """(u, v): pairs of rows whose fingerprints are equal or linked in the SimHash index, enough to connect all that are."""
    marks = common.stage(simhash.with_fingerprint(rows, "row", "text", width), "fingerprints")
    firsts = common.stage(marks.groupBy("fp").agg(F.min("doc").alias("first")), "firsts")
    alike = marks.join(firsts.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of")).filter("doc <> first").select(F.col("doc").alias("u"), F.col("first").alias("v"))
    edges = simhash.links(firsts.select("fp")).select(F.col("u").alias("a"), F.col("v").alias("b"))
    row = lambda end: firsts.select(F.col("fp").alias(f"fp_{end}"), F.col("first").alias(f"row_{end}"))
    linked = edges.join(row("a"), F.col("a") == F.col("fp_a")).join(row("b"), F.col("b") == F.col("fp_b"))
    return alike.unionByName(linked.select(F.greatest("row_a", "row_b").alias("u"), F.least("row_a", "row_b").alias("v")))


def rooted(members: DataFrame, near: DataFrame) -> DataFrame:
    """(key, row, at, root): the members of keys whose rows are of two components or more, by the edges near."""
    roots = components(near)
    mine = members.join(roots, F.col("row") == F.col("node"), "left").select("key", "row", "at", F.coalesce("root", "row").alias("root"))
    mixed = mine.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select(F.col("key").alias("of"))
    return common.stage(mine.join(mixed, F.col("key") == F.col("of"), "left_semi"), "rooted")


def pivot_pairs(mine: DataFrame, turn: int) -> DataFrame:
    """Each row with a few rows of other components that share a key with it: for each of PIVOTS hashes the one whose hash is
    the smallest. Keys that share rows mostly have the same pivots, so a row has about PIVOTS pairs, whatever its keys hold."""
    hashes = range(turn * PIVOTS, turn * PIVOTS + PIVOTS)
    pivot = lambda k: F.struct(F.xxhash64("row", F.lit(k)).alias("h"), "row", "root")
    of_key = mine.groupBy("key").agg(*(F.min(pivot(k)).alias(f"p{k}") for k in hashes)).withColumnRenamed("key", "of")
    met = mine.join(of_key, F.col("key") == F.col("of"))
    # without its root, which nothing asks for any more: these structs are what is shuffled
    other = lambda k: F.min(F.when(F.col(f"p{k}.root") != F.col("root"), F.struct(f"p{k}.h", f"p{k}.row"))).alias(f"p{k}")
    best = met.groupBy("row").agg(*(other(k) for k in hashes)).select("row", F.explode(F.array_distinct(F.array(*(F.col(f"p{k}.row") for k in hashes)))).alias("pivot"))
    return best.filter("pivot is not null").select(F.greatest("row", "pivot").alias("u"), F.least("row", "pivot").alias("v")).distinct()


def links(rows: DataFrame, width: int = SHINGLE_WORDS, least: Fraction = SIMILARITY) -> DataFrame:
    """rows: row, text, staged. Edges (u, v) between similar texts, enough to connect all such pairs."""
    spark = rows.sparkSession
    looked_up = common.stage(prefixes(rows, width, least), "prefixes")
    keys = looked_up.select("row", F.posexplode("keys").alias("at", "key"))
    counted = lambda k: keys.filter(F.pmod("key", F.lit(SLICES)) == k).groupBy("key").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    slices = [common.stage(counted(k).filter("first < last").withColumnRenamed("key", "of"), "shared") for k in range(SLICES)]
    shared = reduce(DataFrame.unionByName, slices)
    # most shingles are of one row only: they go no further than this filter
    asked = keys.filter(through_bitmap(shared.select(F.col("of").alias("row")), "key"))
    members = common.stage(asked.join(shared, F.col("key") == F.col("of")).select("key", "row", "at", "first", "last"), "members")
    marks = common.stage(looked_up.select("row", "n", "signature", "short"), "marks")
    common.drop_staged(spark, shared)
    common.drop_staged(spark, looked_up)
    ends = members.groupBy("row").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    pairs = ends.filter("first < row").select(F.col("row").alias("u"), F.col("first").alias("v"))
    pairs = pairs.unionByName(ends.filter("row < last").select(F.col("last").alias("u"), F.col("row").alias("v"))).unionByName(simhash_candidates(rows, width)).distinct()
    near = verified(common.stage(possible(pairs, marks, least), "possible"), rows, width, least)

    mine = rooted(members, near)
    common.drop_staged(spark, members)
    for turn in range(TURNS):
        more = verified(common.stage(possible(pivot_pairs(mine, turn), marks, least), "possible"), rows, width, least)
        near, before = common.stage(near.unionByName(more), "near"), mine
        mine = rooted(before.select("key", "row", "at"), near)
        common.drop_staged(spark, before)
    # the component with the most rows under a key
    sizes = mine.groupBy("key", "root").agg(F.count("*").alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select(F.col("key").alias("of"), F.col("m.root").alias("main"))
    # a row is here under each of its shingles, so only the short signature comes along: whole ones would grow with the square of a text
    split = mine.join(most, F.col("key") == F.col("of")).drop("of").join(marks.select(F.col("row").alias("of"), "n", "short"), F.col("row") == F.col("of"))
    split = common.stage(split.select("key", "row", "at", "root", "main", "n", "short").sortWithinPartitions("row"), "split")
    common.drop_staged(spark, mine)
    side = lambda e: split.select(F.col("key").alias(f"key_{e}"), F.col("row").alias(e), F.col("root").alias(f"{e}_root"), (F.col("root") != F.col("main")).alias(f"{e}_small"), F.col("at").alias(f"{e}_at"), F.col("n").alias(f"{e}_n"), F.col("short").alias(f"{e}_s"))
    # at the first shingle of the order that both have, what follows in each set must hold all that they share
    rest = F.least(F.col("u_n") - F.col("u_at"), F.col("v_n") - F.col("v_at"))
    first = rest * (least.numerator + least.denominator) >= (F.col("u_n") + F.col("v_n")) * least.numerator
    apart = (F.col("key_u") == F.col("key_v")) & (F.col("u_root") != F.col("v_root")) & (~F.col("v_small") | (F.col("u") > F.col("v")))
    met = side("u").filter("u_small").join(side("v"), apart & first & _may_be_similar("u", "v", least))
    pairs = common.stage(met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "met")
    common.drop_staged(spark, split)
    pairs = common.stage(possible(pairs, marks, least), "possible")
    return near.unionByName(verified(pairs, rows, width, least))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, least: Fraction = SIMILARITY) -> DataFrame:
    """One row of docs, with all its columns, per component of similar texts: the one with the smallest id. A null id comes
    after all others; of rows with the same id, one stays. Null texts count as empty, and texts without words are similar."""
    number = common.unused(docs, "__row")
    numbered = common.stage(docs.withColumn(number, F.monotonically_increasing_id()), "numbered", "zstd")
    rows = numbered.select(F.col(number).alias("row"), F.col(text_col).alias("text"))
    found = components(links(rows, width, least))
    # the smallest row of a component has no edge to itself
    roots = common.stage(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "components")
    ids = roots.join(numbered.select(number, F.col(id_col).alias("id")), F.col("node") == F.col(number)).select("root", "node", "id")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    stay = ids.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.node").alias("kept"))
    gone = common.stage(roots.join(stay, F.col("node") == F.col("kept"), "left_anti").select(F.col("node").alias("row")), "gone")
    # only what the bitmap lets through is looked up; all others go past the shuffle
    asked = through_bitmap(gone, number)
    at = common.unused(numbered, "row")
    looked_up = numbered.filter(asked).join(gone.withColumnRenamed("row", at), F.col(number) == F.col(at), "left_anti")
    return numbered.filter(~asked).unionByName(looked_up).select(*docs.columns)
