import hashlib
import math
import random
import re

import pytest

from lapgraph.functions.expressions import prefix_sums
from lapgraph.llm import secrets

PATTERNS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_samples(spark))


def _ratio(token, model):
    width, p, s = len(secrets.ALPHABET) + 1, 0, 0.0
    for ch in token:
        c = secrets.ALPHABET.index(ch) + 1
        s += round(model.ratios[p * width + c], 6)
        p = c
    return s


def _brute(text, model):
    text = text or ""
    base = [(m.start(), i, m.end(), k) for i, (k, (p, g, n)) in enumerate(PATTERNS.items()) for m in p.finditer(text) if len(m[g]) >= n]
    more = [(m.start(), 3, m.end(), "markov") for m in re.finditer(secrets.TOKEN, text) if _ratio(m[0], model) > model.threshold]
    more = [x for x in more if not any(y[0] < x[2] and x[0] < y[2] for y in base)]
    line = lambda xs: ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(xs))
    return hashlib.sha256(line(base).encode()).hexdigest(), line(base + more)


def _texts():
    rng = random.Random(1)
    parts = ["password=", "Secret : '", "token", "API_KEY=", "apikey:", "=", ":", "abcdef", "é🙂", " ", "\n", "AKIA", "AKIA" + "Q" * 16, "deadbeef" * 3, "0123456789abcdef0123456789", "passwd", "xyz", "'", '"', "secret=token:abcdefgh"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    out += ["ghp_" + "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(36)) + " request_handler_configuration_manager", " ".join(["password=abc123xyz"] * 3000)]
    return out


def test_spans_match_brute_force(spark, make_docs, odd_texts, model):
    texts = [*odd_texts, *_texts()]
    docs = make_docs(texts, extra=["spans", "secret_spans", "_base"])
    got = {r["doc_id"]: r for r in secrets.scan_documents(docs, model).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["base_sha256"], got[i]["spans"]) == _brute(t, model)


def test_model_tells_random_strings(spark, model):
    rows = secrets.labelled_samples(spark, 12000).where("length(text) >= 20").collect()[-6000:]
    right = sum((_ratio(re.sub("[^A-Za-z0-9+/_=-]", "", r["text"]), model) > model.threshold) == (r["label"] == 1) for r in rows)
    assert right / len(rows) > 0.97
    assert _ratio("theandthatisofthewithforth", model) < 0


def test_training_counts(spark):
    model = secrets.train(spark.createDataFrame([(1, "ab"), (0, "aa"), (0, None), (None, "a")], "label int, text string"))
    width, a = len(secrets.ALPHABET) + 1, secrets.ALPHABET.index("a") + 1
    assert math.isclose(model.ratios[a * width + a], math.log(0.5 / 1.5))
    assert not any(secrets.train(spark.createDataFrame([], "label int, text string")).ratios)


def test_redaction(spark, make_docs, model):
    docs = make_docs(["my password=abcdef99 and AKIA" + "B" * 16 + " then " + "0a" * 15, None, "clean secret=abc"])
    got = [r[0] for r in docs.select(secrets.redact(docs.text, model)).collect()]
    assert got == ["my password=[REDACTED] and [REDACTED] then [REDACTED]", None, "clean secret=abc"]


def test_prefix_sums(spark):
    df = spark.sql("select array() cast_me, transform(sequence(1, 1000), x -> cast(x as bigint)) v, cast(array() as array<bigint>) e")
    row = df.select(prefix_sums(df.v).alias("a"), prefix_sums(df.e).alias("b")).first()
    assert row["a"] == [i * (i + 1) // 2 for i in range(1, 1001)] and row["b"] == []


def test_empty_table(make_docs, model):
    assert secrets.scan_documents(make_docs([]), model).collect() == []
