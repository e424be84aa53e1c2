"""Near copies by five-word shingles against brute force."""

import itertools
import random

import corpus_pipeline
from inkframe.llm import near_texts

from .conftest import SCHEMA, rows, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute_roots(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def families():
    """Texts of 30 to 400 words with copies at all distances, copies of copies, and a passage that many texts have."""
    draw, out = random.Random(3), []
    passage = words(60, 77, 5000)
    for k in range(25):
        text = words(draw.choice((30, 100, 400)), 100 + k, 5000)
        if k % 2:
            text = passage + text
        for _ in range(12):
            out.append(" ".join(text))
            copy = list(text) if draw.random() < 0.5 else list(out[-1].split())
            for _ in range(draw.randrange(0, max(2, len(copy) // 40))):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            text = copy
    return out


def test_stage_drops_all_near_copies(spark, data, monkeypatch):
    texts = families()
    want = brute_roots(texts)
    assert 25 < len(set(want)) < len(texts)
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, data).collect())
    assert kept == sorted(set(want))
    # whatever the frequent shingles are, the groups are the same
    monkeypatch.setattr(near_texts, "MOST_FREQUENT", 3)
    assert sorted(r.doc_id for r in near_texts.one_of_each(docs).collect()) == kept
    # without the turns, the last comparison finds the rest alone
    monkeypatch.setattr(near_texts, "TURNS", 0)
    assert sorted(r.doc_id for r in near_texts.one_of_each(docs).collect()) == kept


def test_near_copy_of_ordinary_length(spark, data):
    text = words(400, 1, 5000)
    copy = [*text[:200], "changed", *text[201:]]
    docs = spark.createDataFrame(rows([" ".join(text), " ".join(copy), " ".join(words(400, 2, 5000))]), SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, data).collect()) == [0, 2]


def test_repeated_and_null_ids(spark, odd, empty):
    text, other = " ".join(words(300, 4, 5000)), " ".join(words(300, 5, 5000))
    data = [(1, text, "en", "s", 0), (5, text + " tail", "en", "s", 0), (5, other, "en", "s", 0), (None, other + " end", "en", "s", 0), (None, "no copy at all of this", "en", "s", 0), (1, text + " more", "en", "s", 0)]
    kept = [(r.doc_id, r.text[-12:]) for r in near_texts.one_of_each(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(kept, key=str) == sorted([(1, text[-12:]), (5, other[-12:]), (None, "no copy at all of this"[-12:])], key=str)
    assert near_texts.one_of_each(odd).columns == odd.columns and near_texts.one_of_each(empty).count() == 0
    texts = [r.text for r in odd.select("text").collect()]
    assert near_texts.one_of_each(odd).count() == len(set(brute_roots(texts)))
