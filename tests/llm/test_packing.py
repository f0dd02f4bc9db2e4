import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lapgraph.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_hold_every_id_once(spark, make_docs, odd_texts, library):
    texts = [*odd_texts, *["a b c d"] * 500, "\x1c\x85 x", "'s 't²½ "]
    docs = make_docs(texts, extra=["ids", "part", "n", "at"]).repartition(4)
    rows = packing.pack(docs, 64).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids, at = _ids(library, t), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert np.frombuffer(r["ids"], "<u2").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    assert sorted(windows) == list(range(len(windows)))
    for s, own in windows.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or s == len(windows) - 1


def test_checksum(spark, make_docs, library):
    docs = make_docs(["hello world", None], ids=[None, 4])
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.checksum(packing.pack(docs)).collect()}
    for i, t in ((None, "hello world"), (4, "")):
        assert got[i] == zlib.crc32(np.array(_ids(library, t), "<u4").tobytes())


def test_encoder_agrees_with_the_library(library, odd_texts):
    encoder = packing.ByteEncoder()
    for t in [*odd_texts, "  \n\n  x \t", "it's I'LL 12ab ½²", "Ünïcödé ĀāĂ", "a" * 100000]:
        assert [*encoder.encode(t or ""), 0] == _ids(library, t)


def test_empty_table_and_bad_length(make_docs):
    assert packing.pack(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(make_docs([]), 0)


def test_digests_made_while_cutting_are_those_of_the_pieces(make_docs, odd_texts):
    docs = make_docs(odd_texts).coalesce(1)
    assert packing.pack(docs, 64, digest=True).collect() == packing.checksum(packing.pack(docs, 64)).collect()
