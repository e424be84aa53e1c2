"""Secret scans: three patterns, and a token-efficiency test for random strings that no pattern names.

A random string falls into many short tokens of a byte-pair vocabulary: it has few characters per token. A string is
tested as a whole, and where that finds nothing, its parts between separators and its runs of short tokens are, so that
a path or a name before a secret does not hide it. Strings that are random but no secret (digests of known lengths,
UUIDs), numbers, and identifiers of words that the vocabulary knows are left out of that test; what the patterns find
stays.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.llm import common

#: The patterns and least lengths of the base kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as runs of any length of which short ones are dropped
KINDS = ("assign", "access", "hex", "token")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}")
#: Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words (lower, upper or capitalised, a few digits after them at most) and numbers joined by separators.
IDENTIFIER = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+)(?:[/_.=+-]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+))*[/_.=+-]*")
CAMEL = re.compile(r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+[0-9]{0,4}")
#: The words of an identifier, of which those over SHORT_WORD letters must have CHARS_PER_TOKEN themselves.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SHORT_WORD = 2
SEPARATORS = "/_.=+-"
PART = re.compile(r"[A-Za-z0-9]+")
LEAST = 20
CHARS_PER_TOKEN = 2.0
#: Longer strings are encoded in pieces of this length.
PIECE = 4096


@functools.cache
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(text: str, path: str) -> float:
    encode = _encoding(path).encode_ordinary
    return len(text) / max(1, sum(len(encode(text[i : i + PIECE])) for i in range(0, len(text), PIECE)))


def is_plain(text: str) -> bool:
    """A digest of a known length, a UUID or a number."""
    return bool(len(text) in DIGEST_LENGTHS and DIGEST.fullmatch(text) or UUID.fullmatch(text) or (text.isascii() and text.isdigit()))


def is_known(text: str, path: str, most: float = CHARS_PER_TOKEN) -> bool:
    """A digest of a known length, a UUID, a number, or an identifier whose words have `most` characters per token each."""
    bare = text.strip("=.-_/+")
    if is_plain(bare):
        return True
    if not (IDENTIFIER.fullmatch(bare) or CAMEL.fullmatch(bare)):
        return False
    return all(chars_per_token(w, path) >= most for w in WORD.findall(bare) if len(w) > SHORT_WORD)


def dense_runs(text: str, path: str, most: float = CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """(start, end) of what has under `most` characters per token over LEAST characters or a few more, widened to whole
    parts. Separators do not count; digests, UUIDs and numbers in it end a run."""
    plain = [m.span() for m in UUID.finditer(text)] + [m.span() for m in PART.finditer(text) if is_plain(m[0])]
    in_plain = bytearray(len(text))
    for a, b in plain:
        in_plain[a:b] = b"\1" * (b - a)
    encoding, at = _encoding(path), 0
    tokens: list[tuple[int, int]] = []  # of one stretch: (start, characters that count)
    found: list[tuple[int, int]] = []

    def close() -> None:
        first = held = 0
        for i, (_, size) in enumerate(tokens):
            held += size
            while held - tokens[first][1] >= LEAST:
                held -= tokens[first][1]
                first += 1
            if held >= LEAST and held < most * (i + 1 - first):
                # a long token at an end is not the run's, unless it is of a part of the run
                a, b = first, i
                while a < b and tokens[a][1] > most:
                    a += 1
                while b > a and tokens[b][1] > most:
                    b -= 1
                found.append((tokens[a][0], tokens[b][0] + 1))
        tokens.clear()

    for start in range(0, len(text), PIECE):
        for token in encoding.encode_ordinary(text[start : start + PIECE]):
            end = at + len(encoding.decode_single_token_bytes(token))
            if any(in_plain[at:end]):
                close()
            else:
                place = next((k for k in range(at, end) if text[k] not in SEPARATORS), None)
                if place is not None:
                    tokens.append((place, sum(c not in SEPARATORS for c in text[at:end])))
            at = end
    close()
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and b <= out[-1][1]:
            continue
        while a > 0 and text[a - 1] not in SEPARATORS:
            a -= 1
        while b < len(text) and text[b] not in SEPARATORS:
            b += 1
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the three patterns, in code points."""
    found = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, path: str, most: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Strings with fewer characters per token than most, without known digests and identifiers: whole runs of the
    candidates' characters, or else the parts and dense runs of them that are so."""
    found = []
    for m in CANDIDATE.finditer(text):
        if chars_per_token(m[0], path) < most and not is_known(m[0], path, most):
            found.append((m.start(), 3, m.end()))
            continue
        runs = dense_runs(m[0], path, most)
        for p in PART.finditer(m[0]):
            if len(p[0]) >= LEAST and chars_per_token(p[0], path) < most and not is_known(p[0], path, most) and not any(a < p.end() and p.start() < b for a, b in runs):
                runs.append(p.span())
        found += [(m.start() + a, 3, m.start() + b) for a, b in sorted(runs)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_assign, n_access, n_hex, n_token, base_sha256, spans (kind:start:end, by start).

    Whole texts are read; null counts as empty and has no spans. Spans of different kinds may overlap. An empty table
    gives no rows; other columns are not read.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in common.text_strings(batch.column("text")):
            base = base_spans(text)
            more = token_spans(text, path)
            kinds = [k for _, k, _ in base]
            out.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc", *names])

    names = ["n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    out = common.map_batches(slim, scan, f"doc {kind}, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")
    return out.withColumnRenamed("doc", id_col)


def without_spans(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """Each stretch of overlapping spans becomes one mark."""
    out, at, end = [], 0, -1
    for start, _, stop in sorted(spans):
        if start >= end:
            out += [text[at:start] if end < 0 else text[end:start], mark]
        end = max(end, stop)
    return text if end < 0 else "".join([*out, text[end:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """docs with every secret replaced by mark; null texts stay null, all other columns stay as they are."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    place = docs.columns.index(text_col)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(place)
        texts = [x and without_spans(x, base_spans(x) + token_spans(x, path), mark) for x in column.to_pylist()]
        return batch.set_column(place, batch.schema.field(place), pa.array(texts, column.type))

    return common.map_batches(docs, clean, docs.schema)
