import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lapgraph.llm import dartminhash as dm
from lapgraph.llm import wordhash


def _words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def _set(text):
    raw = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).lower().split()
    runs = [tuple(raw[i : i + 5]) for i in range(len(raw) - 4)] or ([tuple(raw)] if raw else [])
    return Counter(runs)


def _similar(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def _brute(texts):
    sets, parent = [_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and _similar(sets[i], sets[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def _texts():
    rng = random.Random(11)
    passage = _words(rng, 120)
    out = []
    for g in range(40):
        base = _words(rng, rng.randrange(40, 300))
        if g % 4 == 0:
            base = passage + base[:130]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(9999)}"
            out.append(" ".join(own))
    chain = _words(rng, 200)
    for step in range(12):  # neighbours are alike, ends are not
        chain = chain[: 190 - step] + [f"c{step}x{i}" for i in range(4)] + chain[194 - step :]
        out.append(" ".join(chain))
    return out


def test_classes_match_brute_force(make_docs, odd_texts):
    texts = [*odd_texts, *_texts(), "one two three", "one two three", "One, two: three!", "one two"]
    docs = make_docs(texts, extra=["node", "bands", "class_id", "component", "rep"]).repartition(4)
    got = {r["doc_id"]: r for r in dm.classes(docs).collect()}
    want = _brute(texts)
    assert [got[i]["class_doc_id"] for i in range(len(texts))] == want
    assert len({(got[i]["class_id"], w) for i, w in enumerate(want)}) == len(set(want)) == len({r["class_id"] for r in got.values()})
    sizes = Counter(want)
    assert all(got[i]["class_size"] == sizes[w] and got[i]["representative"] == (i == w) for i, w in enumerate(want))


def test_deduplicate_keeps_one_of_each(make_docs):
    texts = ["same words in this text here", "same words in this text here", None, "", "other text", "other text"]
    docs = make_docs(texts, ids=[5, 3, None, None, 9, 9], extra=["_id", "node"])
    kept = dm.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, ""), (3, texts[0]), (9, "other text")]


def test_a_hot_group_gives_pairs_in_proportion(make_docs):
    rng = random.Random(2)
    base = _words(rng, 150)
    texts = [" ".join([*base[:i], f"e{i}", *base[i + 1 :]]) for i in range(120)]
    signed = dm.sign(make_docs(texts))
    from pyspark.sql import functions as F

    buckets = signed.select("node", F.explode("bands").alias("bucket"))
    shared = dm._shared(buckets)
    assert dm._star(shared, dm._popular(shared)).count() < 120 * dm.BANDS
    assert {r["class_doc_id"] for r in dm.classes(make_docs(texts)).collect()} == {0}


def test_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(3)
    pool = wordhash.mixed(np.arange(1, 400, dtype=np.uint64))
    for size in (3, 40, 300):
        e = pool[:size]
        w1, w2 = rng.uniform(0.2, 3, size), rng.uniform(0.2, 3, size)
        w2[: size // 2] = w1[: size // 2]
        owner = np.repeat([0, 1], size)
        s = dm.signatures(np.r_[e, e], np.r_[w1, w2], owner, 2, 4096)
        want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
        assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5 + 0.005
    one = dm.signatures(e, np.ones(size), np.zeros(size, int), 1, 256)
    assert (dm.signatures(np.r_[e, e[:5]], np.ones(size + 5), np.r_[np.zeros(size, int), np.ones(5, int)], 3, 256)[0] == one[0]).all()


def test_shingles_count_repeats():
    hashes, owner = dm.shingles(pa.array(["a b c d e a b c d e a", None, "x", "a b c d e"]))
    assert Counter(owner.tolist()) == {0: 7, 2: 1, 3: 1}
    assert sorted(Counter(hashes[owner == 0].tolist()).values()) == [1, 1, 1, 2, 2]
    assert hashes[owner == 3][0] in hashes[owner == 0]


def test_empty_table(make_docs):
    assert dm.classes(make_docs([])).collect() == []
    assert dm.deduplicate(make_docs([])).collect() == []


def test_exact_similarity():
    a, b = np.array([1, 2, 5]), np.array([2, 5, 7])
    assert dm.similarity(a, np.array([1, 2, 1]), b, np.array([1, 3, 1])) == pytest.approx(2 / 7)


def test_pairs_within_a_large_family_just_under_the_bound(make_docs):
    """Texts of one template, all of similarity 0.79 but for a few pairs a little over 0.8: most bands of such a pair are the family's too."""
    n, template, new = 1000, [f"w{i}" for i in range(504)], (f"t{i}" for i in range(10**6))
    tail = lambda k: [next(new) for _ in range(k)]
    texts, planted = [[*template, *tail(66)] for _ in range(n)], {i + 19: i for i in range(20, n, 40)}
    for j, i in planted.items():
        shared = tail(4)
        texts[i], texts[j] = ([*template, *shared, *tail(62)] for _ in range(2))
    texts = [" ".join(t) for t in texts]
    sets = [_set(t) for t in texts]
    assert all(0.8 <= _similar(sets[i], sets[j]) < 0.81 for i, j in planted.items())
    assert all(0.785 < _similar(sets[7], s) < 0.8 for i, s in enumerate(sets) if i != 7)
    got = {r["doc_id"]: r["class_doc_id"] for r in dm.classes(make_docs(texts)).collect()}
    assert got == {i: planted.get(i, i) for i in range(n)}


def test_ids_that_repeat_or_are_null_do_not_join_classes(make_docs):
    texts = [f"text number {i} of several that are quite unlike {i * 7} in all their words {i + 3}" for i in range(5)]
    rows = dm.classes(make_docs([*texts, texts[4]], ids=[9, 9, None, None, 9, None])).collect()
    assert len({r["class_id"] for r in rows}) == 5
    assert sorted(r["class_size"] for r in rows) == [1, 1, 1, 1, 2, 2]
    assert all(len({r["node"] for r in rows if r["class_id"] == c}) == 1 for c in {r["class_id"] for r in rows})
    assert [r["class_doc_id"] for r in rows if r["class_size"] == 2] == [9, 9]


def test_hot_keys_are_spread(spark):
    from lapgraph.llm.texts import spread_join
    from pyspark.sql import functions as F

    from lapgraph.storage import materialize

    left = materialize(spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).alias("k"), "id"))
    right = spark.createDataFrame([(-1, "hot"), (1, "one"), (7, "seven"), (60, "none")], "k long, name string")
    for how in ("inner", "left"):
        got = spread_join(left, right, "k", how)
        assert got.columns == ["k", "id", "name"]
        assert sorted(got.collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)


def test_very_large_group_of_copies_and_of_near_copies(make_docs):
    rng = random.Random(3)
    base = _words(rng, 60)
    near = [" ".join([*base, f"end{i}"]) for i in range(1500)]
    rows = dm.classes(make_docs([" ".join(base)] * 1500 + near + ["something else entirely that nobody wrote before"])).collect()
    assert sorted({(r["class_doc_id"], r["class_size"]) for r in rows}) == [(0, 3000), (3000, 1)]
