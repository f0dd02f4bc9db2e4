import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lapgraph.llm import chunked_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _texts():
    rng = random.Random(4)
    words = ["the", "naïve", "Straße", "x1", "don't", "名前", "🙂", "<|endoftext|>", "é", "İ", "ﬁ", "²", "'s", "_", "__init__", "ſ", "\xa0"]
    passage = " ".join(rng.choice(words[:5]) + str(rng.randrange(500)) for _ in range(600))
    out = [rng.choice(["", " ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(900))) for _ in range(60)]
    return [*out, passage, "lead in " + passage, passage + " tail", "z" * 40000, "ab" * 9000 + " " + "é" * 9000]


def test_ids_and_decoding_match_the_library(spark, make_docs, odd_texts, library):
    texts = [*odd_texts, *_texts()]
    docs = make_docs(texts, extra=["ids", "decoded"]).repartition(3)
    for r in chunked_bpe.encode_decode(docs).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_cuts_follow_content():
    rng = random.Random(7)
    body = "".join(rng.choice("abcdefgh é\n") for _ in range(20000)).encode()
    for data in (b"", b"a", body, "é".encode() * 30000, b"\x00" * 50000):
        ends = chunked_bpe.cuts(data)
        assert ends[-1] == len(data) and all(a < b for a, b in zip(ends, ends[1:], strict=False))
        start = 0
        for e in ends:
            assert e - start <= chunked_bpe.GREATEST + 4
            data[start:e].decode()
            start = e
    own, moved = chunked_bpe.cuts(body), chunked_bpe.cuts("a different beginning, été ".encode() + body)
    shift = len("a different beginning, été ".encode())
    assert len(set(own) & {e - shift for e in moved}) > 0.9 * len(own)


def test_shared_chunks_are_encoded_once(library):
    encoder, text = chunked_bpe.ChunkedEncoder(), _texts()[60]
    for prefix in ("", "one ", "another "):
        assert np.frombuffer(encoder.encode(prefix + text), "<u4").tolist() == library.encode(prefix + text, add_special_tokens=False).ids
    assert encoder.encoded_chunks < 0.5 * encoder.seen_chunks


def test_memories_are_emptied_when_full(monkeypatch, library):
    monkeypatch.setattr(chunked_bpe, "WORDS_KEPT", 50)
    monkeypatch.setattr(chunked_bpe, "CHUNKS_KEPT", 2)
    encoder = chunked_bpe.ChunkedEncoder()
    for text in _texts()[:30]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.chunks) <= 2


def test_empty_table(make_docs):
    assert chunked_bpe.encode_decode(make_docs([])).collect() == []
