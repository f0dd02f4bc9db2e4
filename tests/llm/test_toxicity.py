import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lapgraph.llm import toxicity, wordhash

BAD = ["idiotic", "scumbag", "vequa", "vequo", "vequi"]


def _corpus(n=1500):
    rng = random.Random(9)
    words = ["the", "of", "and", "river", "stone", "étoile", "straße", *[f"w{i}" for i in range(400)]]
    texts, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        if i % 5 == 0:
            body.insert(rng.randrange(len(body)), rng.choice(BAD) if i % 10 else "vequ" + rng.choice("xyz"))
        texts.append(" ".join(body))
        labels.append(int(i % 5 == 0))
    return texts, labels


@pytest.fixture(scope="module")
def classified(spark, make_docs, odd_texts):
    texts, labels = _corpus()
    docs = make_docs([*texts, *odd_texts, "word " * 200000 + "scumbag"], extra=["score", "logit", "toxic", "predicted"])
    docs = docs.unionByName(make_docs(["null id"], ids=[None], extra=["score", "logit", "toxic", "predicted"]))
    table = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1), (3, None, None), (7, 1, 5)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(docs, table, least=5).collect()
    return texts, labels, odd_texts, rows


def test_held_out_rows_are_classified(classified):
    texts, labels, odd, rows = classified
    assert len(rows) == len(texts) + len(odd) + 2
    own = {r["doc_id"]: r for r in rows}
    for i, r in own.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i in range(len(labels)) if own[i]["held_out"]]
    right = np.mean([own[i]["predicted"] == labels[i] for i in held])
    found = np.mean([own[i]["predicted"] for i in held if labels[i]])
    assert right > 0.95 and found > 0.85
    assert np.mean([own[i]["toxic_in_lang"] == labels[i] for i in held]) > 0.95
    assert own[len(texts) + len(odd)]["predicted"] == 1  # at the end of a million characters
    assert len({own[len(texts) + i]["score"] for i in (0, 1, 2)}) == 1  # null, empty and blank


def test_labels_held_out_do_not_matter(spark, make_docs):
    texts, labels = _corpus(300)
    docs = make_docs(texts)
    flip = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in enumerate(labels)]
    one, two = (toxicity.classify(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (list(enumerate(labels)), flip))
    assert {(r["doc_id"], r["score"]) for r in one.collect()} == {(r["doc_id"], r["score"]) for r in two.collect()}


def test_no_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.classify(make_docs(["a", None]), none).collect()] == [(0.0, 0)] * 2
    assert toxicity.classify(make_docs([]), none).collect() == []


def test_pooling_over_blocks_matches_a_plain_loop(monkeypatch):
    texts = ["a b c d e", "", None, "x", "one two three " * 50, "é ü"]
    net, w = toxicity.Network.fresh(3), toxicity.words_of(pa.array(texts))
    want = np.zeros((len(texts), len(net.shift)), "f4")
    for d, (s, n) in enumerate(zip(w.starts, w.sizes, strict=True)):
        e = net.word[w.word[s : s + n + 2]] + net.prefix[w.prefix[s : s + n + 2]]
        for i, (width, k) in enumerate(zip(toxicity.WIDTHS, net.filters, strict=True)):
            own = slice(i * toxicity.FILTERS, (i + 1) * toxicity.FILTERS)
            want[d, own] = np.maximum(0, max((e[j : j + width].ravel() @ k for j in range(n)), key=lambda v: 0) if n == 1 else np.max([e[j : j + width].ravel() @ k for j in range(n)], axis=0))
    for slots in (7, 32768):
        monkeypatch.setattr(toxicity, "_SLOTS", slots)
        assert np.allclose(net.pooled(w), want, atol=1e-5)


def test_word_hashes():
    texts = ["Hello World hello", "", None, "x", "ab", "b a hello", "éé é", "q " * 300000 + "hello"]
    raw, starts = wordhash.joined(pa.array(texts))
    raw = wordhash.lowered(raw)
    begin, end, text = wordhash.words(raw, raw != 32, starts)
    h = wordhash.hashes(raw, begin, end)[0]
    seen = {}
    for b, e, d, x in zip(begin.tolist(), end.tolist(), text.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(bytes(raw[b:e]), x) == x
    assert len(set(seen.values())) == len(seen) == 9
    assert np.bincount(text, minlength=8).tolist() == [3, 0, 0, 1, 1, 3, 2, 300001]


def test_ids_that_repeat_bring_one_text_each_to_the_driver(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, seed=0: seen.append((texts, labels)))
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 64 * 40)
    ids = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 3 != 1][:12]
    docs = make_docs([f"text {i} {k}" for i in ids for k in range(50)] + ["x" * 5000], ids=[i for i in ids for _ in range(50)] + [ids[0]])
    labels = spark.createDataFrame([(i, 1, j % 2) for j, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels)
    ((texts, known),) = seen
    assert len(texts) == len(ids) and sorted(known) == [0] * 6 + [1] * 6 and max(map(len, texts)) < 20
