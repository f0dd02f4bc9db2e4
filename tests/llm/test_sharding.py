import math
import struct
import zlib
from collections import Counter

import xxhash

from lapgraph.llm import sharding


def _hash(*longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64(struct.pack("<q", x), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def _permute(x, n, seed):
    a = math.isqrt(n) + (math.isqrt(n) ** 2 < n)
    b = (n + a - 1) // a
    while True:
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + _hash(seed, i, right) % a) % a
            else:
                right = (right + _hash(seed, i, left) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_places_match_a_plain_permutation(spark):
    rows = spark.range(1237)
    got = {r["id"]: r for r in sharding.shard_rows(rows, 7, seed=3).collect()}
    assert sorted(r["row_number"] for r in got.values()) == list(range(1237))
    for r in got.values():
        p = _permute(r["row_number"], 1237, 3)
        assert (r["shard"], r["slot"]) == (p % 7, p // 7)


def test_bijection_at_small_sizes(spark):
    for n in (1, 2, 3, 5, 17, 101):
        got = [(r["shard"], r["slot"]) for r in sharding.shard_rows(spark.range(n), 4).collect()]
        assert sorted(slot * 4 + shard for shard, slot in got) == list(range(n))


def test_documents(spark, make_docs, odd_texts):
    ids = [None, None, None, *range(3, len(odd_texts))]
    docs = make_docs(odd_texts, ids, extra=["shard", "slot", "size", "row_number"])
    docs = docs.unionByName(docs.where("doc_id = 5"))
    first = sharding.shard_documents(docs, 3).collect()
    again = sharding.shard_documents(docs.repartition(5), 3).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip([*ids, 5], [*odd_texts, odd_texts[5]], strict=True))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in first) == want
    sizes = Counter(r["shard"] for r in first)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in first if r["shard"] == s) == list(range(sizes[s]))


def test_empty_table(spark, make_docs):
    assert sharding.shard_documents(make_docs([]), 40).collect() == []


def test_a_hot_group_is_made_again_in_spans(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPAN", 7)
    rows = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as _n", "'t' as _bucket", "1 as _start", "id % 2 as c0")
    got = sharding.shard_rows(rows, 4).collect()
    assert sorted(r["row_number"] for r in got) == list(range(300))
    assert got[0].asDict().keys() == {"_n", "_bucket", "_start", "c0", "row_number", "shard", "slot"}
    assert sorted(str((r["_n"], r["c0"])) for r in got) == sorted(str((r["_n"], r["c0"])) for r in rows.collect())
    monkeypatch.setattr(sharding, "SPAN", 65_536)
    assert sorted(got, key=str) == sorted(sharding.shard_rows(rows, 4).collect(), key=str)
