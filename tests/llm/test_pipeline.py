"""The pipeline against a brute-force version of its stages that shares no code with them, but for the token test's spans."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from inkframe.llm import common, cuckoo_dedup, near_texts, quality_rules, secret_scans, simhash

from .conftest import HOST_RULES, SCHEMA, words
from .test_near_texts import brute_roots


def brute_kept(rows):
    """Whether the rules keep each of rows (id, text, lang, source, n_chars)."""
    flags = []
    for _, text, _, _, _ in rows:
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        chars, base = sum(map(len, w)), len(w) < 20 or 100 * len(covered) > 30 * len(w)
        upper = sum(c.isupper() and c.upper() == c for c in text)
        f = {"symbol": 100 * sum(c in "#*$%&|<>" for c in text) > 10 * chars, "upper": 100 * upper > 30 * chars, "dup_line": 100 * (len(lines) - len(set(lines))) > 50 * len(lines)}
        flags.append(f | {"base": base, "any": base or any(f.values())})
    hosts = [r[3] or "" for r in rows]
    sizes, rates, means = Counter(hosts), {}, {}
    for rule in HOST_RULES:
        failed = Counter(h for h, f in zip(hosts, flags, strict=True) if f[rule])
        mean = sum(failed.values()) / len(rows)
        noise = mean * (1 - mean)
        spread = sum(n * (failed[h] / n - mean) ** 2 for h, n in sizes.items()) / len(rows)
        share = (spread - noise * len(sizes) / len(rows)) / noise if noise else 0
        weight = 1 / min(max(share, 1e-4), 0.5) - 1
        means[rule] = mean
        rates[rule] = {h: (failed[h] + mean * weight) / (n + weight) for h, n in sizes.items()}
    fails = lambda f, h, rule: f[rule] and rates[rule][h] >= 0.5 * means[rule]
    return [not f["base"] and rates["any"][h] < 0.8 and not any(fails(f, h, r) for r in ("symbol", "upper", "dup_line")) for f, h in zip(flags, hosts, strict=True)]


def brute_base_spans(text):
    """Spans of the three patterns, from a scan at each place."""
    found = []
    for name, start, least in ((r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 6), (r"", r"AKIA[A-Z0-9]+", 20), (r"", r"[0-9a-f]+", 24)):
        at = 0
        while at < len(text):
            m = re.compile(f"(?a:{name})({start})").match(text, at)
            if m:
                if len(m[1]) >= least:
                    found.append(m.span())
                at = m.end()
            else:
                at += 1
    return found


def brute_run(rows):
    """(id, text) of what is packed."""
    rows = [r for r, k in zip(rows, brute_kept(rows), strict=True) if k]
    last = {}
    order = lambda r: -1 if r[0] is None else r[0]
    for r in rows:
        key = hashlib.sha256((r[1] or "").encode()).digest()
        if key not in last or order(r) > order(last[key]):
            last[key] = r
    rows = sorted(last.values(), key=lambda r: (r[0] is None, r[0] or 0))
    roots = brute_roots([r[1] for r in rows])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = []
    for k, r in enumerate(rows):
        if roots[k] == k:
            spans = brute_base_spans(r[1]) + [(a, b) for a, _, b in secret_scans.token_spans(r[1], path)]
            hidden = np.zeros(len(r[1]) + 1, int)
            for a, b in spans:
                hidden[a:b] = 1
            # touching spans are marks of their own
            starts = {a for a, b in spans if a == 0 or not hidden[a - 1] or any(e == a for _, e in spans)}
            starts = {a for a in starts if not any(s < a < e for s, e in spans)}
            out.append((r[0], "".join(("[SECRET]" if i in starts else "") + ("" if hidden[i] else c) for i, c in enumerate(r[1]))))
    return out


def compare(out, want):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in want)
    whole = Counter()
    for r in out.sort_values(["doc_id", "piece"]).itertuples():
        whole[None if np.isnan(r.doc_id) else int(r.doc_id)] += r.length
    per_id = Counter()
    for (i, n), times in lengths.items():
        per_id[i] += n * times
    assert whole == per_id
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 4096 and (s.offset == s.length.cumsum() - s.length).all()


def test_stages_and_rows(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    docs = common.table(spark, data, "documents")
    want = brute_run([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    out = corpus_pipeline.run(spark, data).toPandas()
    compare(out, want)
    assert out.sequence_id.nunique() <= np.ceil(out.length.sum() / 4096) * 1.05 + 2


def odd_rows():
    text, other, third = (" ".join(words(300, k, 5000)) for k in (21, 22, 23))
    return [
        (5, text, "en", "a", 1), (7, text + " tail", "en", "a", 1), (7, other, "en", None, None), (3, third, "en", "a", 1), (3, "### " * 40, "en", "a", 1), (None, other + " end", "en", "b", 1),
        (None, " ".join(words(100, 24, 5000)), None, "b", 1), (None, None, None, None, None), (9, "", "en", "b", 0), (9, third, "en", "c", 1), (11, text + ' password = "hunter2222"', "en", "c", 1), (12, " ".join(words(9000, 25, 5000)), "en", "c", 1),
    ]


def run_over(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return corpus_pipeline.run(spark, str(path)).toPandas()


def test_nulls_repeated_ids_and_long_texts(spark, tmp_path):
    rows = odd_rows()
    out = run_over(spark, rows, tmp_path)
    want = brute_run(rows)
    # clean rows stay beside others that share their id; a rejected one goes
    assert sorted(i for i, _ in want if i is not None) == [5, 7, 9, 12] and sum(i is None for i, _ in want) == 1
    compare(out, want)


def test_empty_table(spark, tmp_path):
    assert len(run_over(spark, [], tmp_path)) == 0


def test_stages_keep_the_columns(spark, data):
    docs = common.table(spark, data, "documents").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_columns_of_clashing_names(spark):
    """Columns named as the stages name their own keep their values."""
    names = ("__row", "__row_", "__id", "__of", "__digest", "__before", "row", "node", "gone", "stays", "id", "text_sha256")
    rows = [(k, " ".join(words(120, 30 + k // 2, 5000)), "en", "a", 1, *range(-5 - k, -5 - k - len(names), -1)) for k in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} long" for c in names))
    of = {r[0]: r[5:] for r in rows}
    for stage in (cuckoo_dedup.kept_documents, near_texts.one_of_each, simhash.one_of_each, lambda d: corpus_pipeline.without_secrets(spark, d, ""), quality_rules.kept_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(tuple(r[c] for c in names) == of[r.doc_id] for r in got)
