"""The token test on random strings of one case, and on secrets within a longer candidate."""

import random
import string

import public_tokenizers

from inkframe.llm import secret_scans

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def keys(letters, size, n=60):
    draw = random.Random(1)
    return ["".join(draw.choice(letters) for _ in range(size)) for _ in range(n)]


def found(prefix, key):
    """The whole key is in one span."""
    text = f"see {prefix}{key} here"
    start = 4 + len(prefix)
    return any(a <= start and b >= start + len(key) for a, _, b in secret_scans.token_spans(text, RANKS))


def test_random_strings_of_one_case():
    lower, upper = keys(string.ascii_lowercase, 32), keys(string.ascii_uppercase, 32)
    assert sum(found("", k) for k in lower) >= 0.95 * len(lower) and all(found("", k) for k in upper)
    assert sum(found("", f"{k[:16]}-{k[16:]}") for k in upper) >= 0.95 * len(upper)


def test_secrets_after_a_path_or_a_name():
    for prefix in ("//cdn.example.com/downloads/release/", "user_profile_service_configuration_", "//internal.example.com/static/assets/"):
        assert all(found(prefix, k) for k in keys(string.ascii_letters + string.digits, 24))
    key = keys(string.ascii_letters + string.digits, 12, 2)
    assert found("//cdn.example.com/downloads/release/latest/", f"{key[0]}-{key[1]}")
    text = "//internal.example.com/documentation/information/international/pictures/9aXbQ2LmT7vK3pRzW8yNkQ4t"
    assert secret_scans.without_spans(text, secret_scans.token_spans(text, RANKS), "#") == "//internal.example.com/documentation/information/international/pictures/#"


def test_paths_and_names_without_secrets():
    for text in (
        "github.com/apache/spark/blob/master/README.md", "org.apache.spark.sql.catalyst.expressions.codegen.CodeGenerator", "/a/b/c/d/e/f/g/h/i/j/k/l", "getUserProfileByIdentifier",
        "//example.com/downloads/releases/archive/objects/550e8400-e29b-41d4-a716-446655440000/information", "Rechtsschutzversicherungsgesellschaften", "ACCOUNT_CONFIGURATION_TIMEOUT_SECONDS",
        "//example.com/downloads/releases/archive/d41d8cd98f00b204e9800998ecf8427e/documentation/information",
    ):
        assert secret_scans.token_spans(text, RANKS) == [], text
