import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lapgraph.llm import hmm


def _tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def _texts():
    rng = random.Random(6)
    kinds = [["le", "la", "une", "mer", "rue"], ["der", "die", "ein", "Haus"], ["the", "an", "sea"]]
    out = []
    for i in range(400):
        own = kinds[i % 3]
        out.append(" ".join(rng.choice(own) if rng.random() < 0.8 else f"{rng.choice(own)}{rng.randrange(300)}" for _ in range(rng.randrange(1, 80))))
    return out


def test_counts_and_base_score(spark, make_docs, odd_texts):
    texts = [*_texts(), *odd_texts, "unknownword " * 3]
    ids = [*range(len(texts) - 1), None]
    docs = make_docs(texts, ids, extra=["row", "classes", "n", "h", "score"]).repartition(3)
    rows = hmm.score_documents(docs, head=40).collect()
    assert len(rows) == len(texts)
    count = Counter(t for i, x in zip(ids, texts, strict=True) if not _held(i) for t in _tokens(x))
    total = sum(count.values())
    norm = total + 0.5 * (len(count) + 1)
    held = [0.0, 0.0]
    for r in rows:
        own = _tokens(texts[-1] if r["doc_id"] is None else texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (_held(r["doc_id"]), len(own), sum(t in count for t in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 0.5) / norm) for t in own), abs=1e-6)
        assert r["score"] < 0
        if r["held_out"]:
            held = [held[0] + r["base_score"], held[1] + r["score"]]
    assert held[1] > held[0]
    assert len({round(r["score"], 9) for r in rows if r["doc_id"] in (405, 406)}) == 1  # equal texts


def _paths(model, seq):
    """The likelihood, by summing over all paths."""
    total, paths = 0.0, [()]
    for _ in seq:
        paths = [(*p, s) for p in paths for s in range(len(model.start))]
    for p in paths:
        x = model.start[p[0]] * model.emit[seq[0], p[0]]
        for i in range(1, len(seq)):
            x *= model.move[p[i - 1], p[i]] * model.emit[seq[i], p[i]]
        total += x
    return math.log(total)


def _as_bytes(seqs):
    return [np.array(s, "<u2").tobytes() for s in seqs]


def test_forward_is_exact():
    model = hmm.Model.fresh(np.full(6, 1 / 6), 3, 1)
    seqs = [[0, 1, 5, 2], [3], [], [4, 4, 4, 4, 4, 0], [1, 2]]
    got = hmm.forward(model, hmm.Sequences.of(_as_bytes(seqs)))
    assert got == pytest.approx([_paths(model, s) if s else 0.0 for s in seqs])
    long = hmm.forward(model, hmm.Sequences.of(_as_bytes([[0, 1, 2] * 20000])))
    assert np.isfinite(long).all() and long[0] < -10000


def test_expected_counts_are_derivatives():
    """Emission counts: d log P / d log b."""
    model, seqs = hmm.Model.fresh(np.full(4, 0.25), 2, 2), hmm.Sequences.of(_as_bytes([[0, 1, 1, 3], [2, 0]]))
    starts, moves, emits, loglik = hmm.expected(model, seqs)
    step = 1e-6
    for name, counts in (("start", starts), ("move", moves), ("emit", emits)):
        for at in np.ndindex(counts.shape):
            other = hmm.Model(model.start.copy(), model.move.copy(), model.emit.copy())
            getattr(other, name)[at] *= 1 + step
            assert (hmm.forward(other, seqs).sum() - loglik) / step == pytest.approx(counts[at], abs=1e-4)


def test_baum_welch_climbs():
    rng = np.random.default_rng(0)
    seqs = hmm.Sequences.of(_as_bytes([rng.permutation([k % 2 * 3 + j for j in range(3)] * 8) for k in range(40)]))
    f, seen = np.full(6, 1 / 6), []
    model = hmm.Model.fresh(f, 2, 0)
    for _ in range(15):
        *counts, loglik = hmm.expected(model, seqs)
        seen.append(loglik)
        model = hmm.maximized(*counts, f, 1e-9)
    assert all(b >= a - 1.5 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 100
    assert model.emit.sum(0) == pytest.approx([1, 1])


def test_partitions_add_up(make_docs):
    docs = make_docs(_texts()[:60])
    counts = hmm.count_words(docs)
    vocab = hmm.vocabulary(counts, 30)
    model = hmm.Model.fresh(vocab.frequencies(), 4, 3)
    from lapgraph.storage import materialize

    encoded = materialize(hmm.encode(docs.repartition(5), vocab))
    got = hmm._gathered(encoded, model)
    want = hmm.expected(model, hmm.Sequences.of(encoded.toArrow().column("classes").to_pylist()))
    for a, b in zip(got, want[:3], strict=True):
        assert np.allclose(a, b)
    assert vocab.frequencies().sum() == pytest.approx(1)


def test_tokens():
    h, _, owner = hmm.tokens(pa.array(["A b\ta", None, "", "É é"]))
    assert owner.tolist() == [0, 0, 0, 0, 1, 2, 3, 3, 3]
    assert h[0] == h[2] != h[1] and h[3] == h[4] == h[5] == h[8] == hmm.END and h[6] != h[7]


def test_no_training_rows(make_docs):
    only = next(i for i in range(100) if _held(i))
    r = hmm.score_documents(make_docs(["some words"], ids=[only])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0
    assert hmm.score_documents(make_docs([])).collect() == []


def test_stretches_count_every_token_once():
    rng = np.random.default_rng(4)
    model = hmm.Model.fresh(np.full(12, 1 / 12), 3, 1)
    model.move[:] = [[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.1, 0.2, 0.7]]
    seqs = hmm.Sequences.of(_as_bytes([rng.integers(0, 12, n).tolist() for n in (700, 3, 0, 50, 51, 1)]))
    whole, parts = hmm.expected(model, seqs), hmm.expected(model, seqs, 50, 40)
    assert parts[2].sum() == pytest.approx(len(seqs.flat)) and parts[0].sum() == pytest.approx(5)
    for a, b in zip(whole, parts, strict=True):
        assert np.allclose(a, b, atol=1e-3)


def test_more_states_tell_more_of_held_out_texts(make_docs):
    texts = _texts()
    docs = make_docs(texts)
    held = [sum(r["score"] for r in hmm.score_documents(docs, states=n).collect() if r["held_out"]) for n in (1, 8)]
    assert held[1] > held[0] * 0.95  # scores are negative
