import hashlib
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkframe.llm import components, cuckoo_dedup, simhash

from .conftest import SCHEMA, rows, words


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=600))
def test_filter_has_no_false_negatives(steps):
    live, index = {}, cuckoo_dedup.LiveDigests(16)
    for put, n in steps:
        key = hashlib.sha256(str(n).encode()).digest()
        if put:
            index.insert(key, (n, 0), 1)
            live[key] = live.get(key, 0) + 1
        else:
            assert index.delete(key) == (key in live)
            live.pop(key, None)
        assert all(index.filter.contains(k) for k in live)
    assert {k: v[1] for k, v in index.content.items()} == live


def test_overflow_resizes_from_stored_keys():
    index = cuckoo_dedup.LiveDigests(16)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for k in keys:
        index.insert(k, (0, 0), 1)
    assert index.resizes and all(index.filter.contains(k) for k in keys) and len(index.content) == 5000


def test_hits_are_verified():
    index = cuckoo_dedup.LiveDigests(16)
    first = hashlib.sha256(b"x").digest()
    twin = first[:-1] + bytes([first[-1] ^ 1])  # one fingerprint and place, another digest
    index.insert(first, (1, 0), 1)
    index.insert(twin, (2, 0), 1)
    assert index.false_hits == 1 and len(index.content) == 2


def test_exact_dedup_on_odd_rows(odd, empty):
    out = cuckoo_dedup.exact_dedup(odd).toPandas()
    source = odd.select("doc_id", "text").toPandas()
    assert len(out) == len(source)
    groups = {}
    for i, t in zip(source.doc_id, source.text, strict=True):
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(None if np.isnan(i) else int(i))
    for digest, group in out.groupby("text_sha256"):
        ids = [i for i in groups[digest] if i is not None]
        assert set(group.group_size) == {len(groups[digest])} and group.kept.sum() == 1
        assert set(group.keep_id) == {max(ids)} if ids else group.keep_id.isna().all()
        assert not ids or group[group.kept].doc_id.tolist() == [max(ids)]
    assert cuckoo_dedup.exact_dedup(empty).count() == 0
    assert cuckoo_dedup.kept_documents(odd).count() == len(groups)
    assert cuckoo_dedup.kept_documents(odd).columns == odd.columns
    assert cuckoo_dedup.kept_documents(empty).count() == 0


def test_retired_digests_leave_the_index(spark):
    docs = spark.createDataFrame(rows(["a", "a", "b"]), SCHEMA)
    keyed = docs.select(F.col("doc_id").alias("doc"), cuckoo_dedup.digest("text").alias("digest"), F.monotonically_increasing_id().alias("row_no"))
    index = cuckoo_dedup.build_index(keyed, retired=keyed.filter("doc = 0").select("digest"))
    assert [r.keep_id for r in index.collect()] == [2]


def brute_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_match_brute_force(odd_texts, monkeypatch):
    texts = [t or "" for t in odd_texts]
    want = [brute_fingerprint(t) for t in texts]
    assert simhash.fingerprints([t.encode() for t in texts]) == want
    monkeypatch.setattr(simhash, "CHUNK", 500)
    assert simhash.fingerprints([t.encode() for t in texts]) == want


def brute_components(marks):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(marks))]


def test_links_reach_all_pairs_within_two_bits(spark):
    draw = random.Random(5)
    marks = []
    for _ in range(12):
        mark = draw.getrandbits(64)
        for _ in range(25):  # chains: each a flip or two away from the one before
            marks.append(mark)
            for _ in range(draw.randrange(1, 4)):
                mark ^= 1 << draw.randrange(64)
    marks = list(dict.fromkeys(marks))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"))
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    found = {r.node: r.root for r in components.components(edges).collect()}
    want = brute_components(marks)
    mine = [found.get(s, s) for s in signed]
    assert len(set(want)) == len(set(mine)) == len(set(zip(want, mine, strict=True)))


def test_links_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    draw, marks = random.Random(8), []
    for _ in range(4):
        mark = draw.getrandbits(64)
        for _ in range(120):  # bursts around one mark: most share a whole segment
            marks.append(mark ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) % 2**64)
    marks = list(dict.fromkeys(marks))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "fp long")
    assert simhash.bucket_pairs(simhash.segment_table(frame)).filter("a_n > 3 or b_n > 3").count()
    edges = simhash.links(frame)
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    found = {r.node: r.root for r in components.components(edges).collect()}
    want, mine = brute_components(marks), [found.get(s, s) for s in signed]
    assert len(set(want)) == len(set(mine)) == len(set(zip(want, mine, strict=True)))


def test_complete_distances_are_verified(spark):
    # the first segments agree, or differ in one bit; the second ones differ in 1, 2, 3 and 30 bits
    marks = [5, 5 ^ 1 << 40, 4 ^ 3 << 50, 5 ^ 7 << 33, 4 ^ (2**30 - 1) << 33]
    frame = spark.createDataFrame([(m,) for m in marks], "fp long")
    candidates = [(a, b) for i, a in enumerate(marks) for b in marks[:i]]
    near = {(max(a, b), min(a, b)) for a, b in candidates if (a ^ b).bit_count() <= 2}
    assert len(near) < len(candidates) and {(r.u, r.v) for r in simhash.links(frame).collect()} == near


def test_rows_that_share_an_id_are_kept_apart(spark):
    text = " ".join(words(4000, 3, 5000))
    other = " ".join(words(300, 12, 5000))
    data = [(5, text), (7, text + " "), (7, other), (None, text + "  "), (5, text + "\t")]
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert len(kept) == 2 and (7, other) in kept and any(i == 5 for i, _ in kept)


def test_near_groups(spark, odd, empty):
    text = " ".join(words(4000, 3, 5000))
    near = text.replace(" ", "  ", 3)
    out = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame([*rows([text, near, text + " tail", " ".join(words(400, 9))], 10), (7, text, "en", "s", 0)], SCHEMA)).collect()}
    assert out[10].component_id == out[11].component_id == out[7].component_id == 7
    assert out[13].component_id == 13 and out[10].fingerprint == f"{brute_fingerprint(text):016x}"
    rest = simhash.near_groups(odd).toPandas()
    assert len(rest) == odd.count()
    blank = rest[rest.fingerprint == "0" * 16]
    assert set(blank.component_id) == {0} and simhash.near_groups(empty).count() == 0
    assert simhash.one_of_each(odd).columns == odd.columns and simhash.one_of_each(empty).count() == 0


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert components.components(edges).select("root").distinct().count() == 1


def test_one_row_of_each_near_group_stays(spark):
    text = " ".join(words(4000, 3, 5000))
    docs = spark.createDataFrame(rows([text, text + " ", "other words entirely " + " ".join(words(50, 8))]), SCHEMA)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [0, 2]
