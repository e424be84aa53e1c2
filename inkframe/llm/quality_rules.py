"""Host-level quality rules, with DataFrame functions only.

Each document is measured in one projection over its text. Rule failures are summed per host, a host's failure rates
are shrunk towards the corpus by a beta prior fitted to all hosts (moments), and the hosts' verdicts are joined back
to the documents. The measurements are staged in the shared folder, so the texts are read once; what is joined is a
few numbers per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import common

#: The base rules.
LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: Further rules of a document: symbols and upper-case letters in percent of the characters in words, repeated lines in percent of all.
SYMBOL_PERCENT = 10
UPPER_PERCENT = 30
DUP_LINE_PERCENT = 50
#: A host is rejected if so large a share of its documents is expected to fail; a document's failure of a further rule
#: is forgiven if its host fails that rule at less than this part of the corpus rate.
HOST_REJECTED = 0.8
HOST_CLEAN = 0.5

RULES = ("short", "repeat", "symbol", "upper", "dup_line", "any")


def _bind(value: F.Column, fn) -> F.Column:
    """fn of value, with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _repeat_words(windows: F.Column) -> F.Column:
    """Words covered by windows whose hash occurs twice or more: equal hashes are neighbours once sorted."""

    def covered(ordered: F.Column) -> F.Column:
        same = lambda k, other: F.coalesce(F.get(ordered, other)["h"] == F.get(ordered, k)["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(ordered, lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_bind(ordered, covered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """(__id, host, the base counts and flags of the rules) per row of docs; null texts have no words. carry: __doc, the whole row, too."""
    text = common.text_or_empty(text_col)
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("__doc")] if carry else []
    df = docs.select(F.col(id_col).alias("__id"), *whole, F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("t"))
    df = df.withColumn("words", F.filter(F.split("t", common.GAP), lambda w: w != "")).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        "__id",
        *(["__doc"] if carry else []),
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("t", F.lit(r"([#*$%&|<>]+)"), F.lit(1))).cast("long").alias("symbol_runs"),
        F.length(F.array_join(F.regexp_extract_all("t", F.lit(r"([#*$%&|<>]+)"), F.lit(1)), "")).cast("long").alias("n_symbols"),
        F.length(F.array_join(F.regexp_extract_all("t", F.lit(r"(\p{Lu}+)"), F.lit(1)), "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    ).drop("symbol_runs")
    last = F.size("hashes") - WINDOW
    # two 64-bit hashes of a document's windows agree by chance at odds of its length squared to 2^65
    window = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
    df = df.withColumn("windows", F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("n_repeat_words", _repeat_words(F.col("windows")).cast("long")).drop("hashes", "windows")
    n, chars = F.col("n_words"), F.col("word_chars")
    flags = {
        "short": n < LEAST_WORDS,
        "repeat": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n,
        "symbol": 100 * F.col("n_symbols") > SYMBOL_PERCENT * chars,
        "upper": 100 * F.col("n_upper") > UPPER_PERCENT * chars,
        "dup_line": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
    }
    df = df.withColumns({f"failed_{k}": v for k, v in flags.items()})
    df = df.withColumn("base_failed", F.col("failed_short") | F.col("failed_repeat"))
    return df.withColumn("failed_any", F.col("base_failed") | F.col("failed_symbol") | F.col("failed_upper") | F.col("failed_dup_line"))


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: n_docs, and for each rule its failures and shrunk failure rate (rate_<rule>), with the prior's mean (mean_<rule>)."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(f"failed_{r}").cast("long")).alias(f"n_{r}") for r in RULES])
    hosts = common.stage(hosts, "hosts")
    total, n = F.sum("n_docs"), F.col("n_docs")
    means = hosts.agg(total.alias("docs"), F.count("*").alias("hosts"), *[(F.sum(f"n_{r}") / total).alias(r) for r in RULES]).first()
    if not means["docs"]:
        return hosts.select("*", *[F.lit(0.0).alias(f"{k}_{r}") for r in RULES for k in ("rate", "mean")])
    # the spread of the hosts' rates, beyond what counting alone gives, is the prior's
    spread = hosts.agg(*[(F.sum(n * F.pow(F.col(f"n_{r}") / n - F.lit(means[r]), 2)) / total).alias(r) for r in RULES]).first()
    out = hosts
    for r in RULES:
        m = means[r]
        noise = m * (1 - m)
        share = (spread[r] - noise * means["hosts"] / means["docs"]) / noise if noise > 0 else 0.0
        weight = 1 / min(max(share, 1e-4), 0.5) - 1
        out = out.withColumns({f"rate_{r}": (F.col(f"n_{r}") + F.lit(m * weight)) / (n + F.lit(weight)), f"mean_{r}": F.lit(float(m))})
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: bool = False) -> DataFrame:
    """measure(), with each row's verdict in kept; what the hosts are joined to is staged, so no text is measured twice."""
    measured = common.stage(measure(docs, id_col, text_col, host_col, carry), "measured", "zstd" if carry else "snappy")
    hosts = host_rates(measured)
    fails = lambda r: F.col(f"failed_{r}") & (F.col(f"rate_{r}") >= HOST_CLEAN * F.col(f"mean_{r}"))
    verdict = ~F.col("base_failed") & (F.col("rate_any") < HOST_REJECTED) & ~fails("symbol") & ~fails("upper") & ~fails("dup_line")
    slim = hosts.select(F.col("host").alias("of"), *[f"{k}_{r}" for r in ("symbol", "upper", "dup_line") for k in ("rate", "mean")], "rate_any")
    return measured.join(slim, F.col("host") == F.col("of"), "left").withColumn("kept", verdict)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Kept: the base rules hold, the host is not rejected, and no further rule fails, unless the host is far cleaner by that rule
    than the corpus. Null and empty texts fail as short. Documents without a host (null) share the host ''. An empty
    table gives no rows; other columns are not read. Repeated rows are judged each.
    """
    judged = _judged(docs, id_col, text_col, host_col)
    return judged.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all their columns, each by its own verdict: ids play no part, and may be repeated or null."""
    return _judged(docs, id_col, text_col, host_col, carry=True).filter("kept").select("__doc.*")
