import numpy as np
import pytest
from pyspark.sql import functions as F

from lapgraph.llm import mih

SCHEMA = "vec_id long, embedding array<float>, label int, v int, rank int"


@pytest.fixture(scope="module")
def table(spark):
    def make(pairs):
        rows = [(i, None if x is None else [None if y is None else float(y) for y in x], 1, 2, 3) for i, x in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


def _brute(pairs, k):
    ok = {}
    for i, x in pairs:
        if i is None or x is None or any(y is None or not np.isfinite(y) for y in x) or not any(x):
            continue
        ok.setdefault(i, []).append(np.array(x, "f4").astype("f8"))
    out = {}
    for q in (i for i in ok if i % 20 == 0):
        scored = sorted({(-float((x * ok[q][0]).sum()), i) for i, xs in ok.items() if i != q for x in xs})
        out[q] = scored[:k]
    return out


def test_recall_and_scores(table):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype("f4") * rng.uniform(0.5, 1.5, size=(3000, 1)).astype("f4")
    x[1000:1400] = x[0]  # a hot vector
    pairs = list(enumerate(x.tolist()))
    rows = mih.search(table(pairs), F.col("vec_id") % 20 == 0).collect()
    want, got = _brute(pairs, 20), {}
    for r in rows:
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(want)
    hit = 0
    for q, own in got.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert len({r["vec_id"] for r in own}) == 20 and q not in {r["vec_id"] for r in own}
        keys = [(-r["score"], r["vec_id"]) for r in own]
        assert keys == sorted(keys)
        for r in own:
            assert abs(r["score"] - float(x[q].astype("f8") @ x[r["vec_id"]].astype("f8"))) < 1e-9
        hit += len({r["vec_id"] for r in own} & {i for _, i in want[q]})
    assert hit / (20 * len(want)) >= 0.9
    for q in (0, 1000, 1200):
        assert [r["vec_id"] for r in got[q]][:5] == [i for _, i in want[q]][:5]


def test_few_and_unusable_rows(table):
    pairs = [(0, [1, 0, 0]), (1, [0, 0, 0]), (2, None), (3, [1, None, 0]), (4, [float("nan"), 1, 0]), (5, [1, 1, 0]), (5, [1, 1, 0]), (6, [float("inf"), 0, 1]), (7, [-1, 0, 0]), (None, [1, 1, 1]), (8, [1, 0]), (20, [0, 1, 0])]
    got = {}
    for r in mih.search(table(pairs), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(1, 5, 1.0), (2, 20, 0.0), (3, 7, -1.0)]
    assert sorted(got[20]) == [(1, 5, 1.0), (2, 0, 0.0), (3, 7, 0.0)]
    assert mih.search(table([]), F.col("vec_id") % 20 == 0).collect() == []
    assert mih.search(table([(1, [1, 2])]), F.col("vec_id") % 20 == 0).collect() == []


def test_probing_misses_no_code():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, size=(4000, 4), dtype=np.uint8)
    for radius in (0, 3, 5, 9, 14):
        radii = mih.probe_radii(radius, 4)
        apart = np.bitwise_count(codes[:50, None, :] ^ codes[None, :, :])
        probed = (apart <= radii).any(2)
        assert not ((apart.sum(2) <= radius) & ~probed).any()


def _clusters(rng, n, centres, spread, size=64):
    at = rng.normal(size=(centres, size))
    return (at[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, size))).astype("f4")


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(5)
    x = _clusters(rng, 12000, 120, 0.3)
    codes = mih.learn(x[:4096], float(np.linalg.norm(x, axis=1).max()))
    queries = np.arange(0, len(x), 20)
    code, query_code = codes.of(x), codes.of(x[queries], True)
    scores = x[queries].astype("f8") @ x.T.astype("f8")
    scores[np.arange(len(queries)), queries] = -np.inf
    top = np.argsort(-scores, axis=1)[:, :20]
    apart = np.bitwise_count(query_code[:, None, :] ^ code[top]).sum(2)
    radius = int(np.quantile(apart, 0.97, method="higher"))
    assert mih.cheaper_width(code[:4096], query_code, radius, len(x)) == 2
    block = mih.Block(np.arange(len(x)), x, code, radius, 2, 21)
    q, r = block.candidates(query_code[:200])
    assert len(q) < 0.15 * 200 * len(x)
    found = mih.search_block(block, x[queries], query_code, radius, 21)
    got = {}
    for i, m, *_ in found:
        got.setdefault(i, set()).add(m)
    assert np.mean([len(got.get(i, set()) & set(t.tolist())) / 20 for i, t in enumerate(top)]) >= 0.9


@pytest.mark.parametrize("width", [1, 2])
def test_candidates_are_what_probing_says(width):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16)).astype("f4")
    codes = mih.learn(x, float(np.linalg.norm(x, axis=1).max()))
    code, query_code = codes.of(x), codes.of(x[:30], True)
    for radius in (0, 1, 4, 7, 20, 32):
        block = mih.Block(np.arange(700), x, code, radius, width, 5)
        q, r = block.candidates(query_code)
        want = mih.probed(block.code, query_code, radius, width)
        assert sorted(zip(q.tolist(), r.tolist(), strict=True)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
        near = np.bitwise_count(query_code[:, None, :] ^ block.code[None]).sum(2) <= radius
        assert not (near & ~want).any()


def test_several_groups_of_queries(table, monkeypatch):
    monkeypatch.setattr(mih, "QUERIES", 20)
    rng = np.random.default_rng(7)
    pairs = list(enumerate(_clusters(rng, 1500, 30, 0.3, 16).tolist()))
    rows, want = mih.search(table(pairs), F.col("vec_id") % 20 == 0).collect(), _brute(pairs, 20)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(got[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * 20 * len(want)
