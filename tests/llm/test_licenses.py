import random
import re

import pytest

from lapgraph.llm import licenses

WORD = re.compile(licenses.WORD)


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _base(words):
    return [(i, k) for k, p in licenses.PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]


@pytest.fixture(scope="module")
def run(spark, make_docs):
    def go(texts, **more):
        docs = make_docs(texts, extra=["words", "key", "spans", "labels"], **more)
        return {r["doc_id"]: r for r in licenses.report(licenses.scan(docs)).collect()}

    return go


def test_base_matches_brute_force(run, odd_texts):
    rng = random.Random(2)
    parts = ["cc", "CC-BY", "by", "all", "Rights", "reserved.", "general public license", "ALL RIGHTS RESERVED", "é", "x2"]
    texts = [*odd_texts, *[" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(100)], "all rights reserved " * 5000]
    got = run(texts)
    for i, t in enumerate(texts):
        words, r = _words(t), got[i]
        base = _base(words)
        assert (r["n_words"], r["n_base"]) == (len(words), len(base)), i
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in base}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_every_template_is_found_where_it_stands(run):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(99)) for _ in range(n))
    texts = [f"{noise(40)} {t} {noise(30)}" for _, t in licenses.TEMPLATES]
    got = run(texts)
    for i, (label, t) in enumerate(licenses.TEMPLATES):
        assert label in got[i]["labels"].split(",")
        assert any(s["label"] == label and s["start"] <= 40 and s["end"] >= 40 + len(_words(t)) - 1 and s["coverage"] == 1 for s in got[i]["spans"]), label
        assert got[i]["score"] == 1


def test_insertions_and_deletions_are_merged(run):
    label, text = licenses.TEMPLATES[4]
    words = text.split()
    edited = " ".join([*words[:12], "extra", *words[12:25], *words[26:]])
    got = run([f"a b c {edited} d e f", "permission is hereby given to nobody of this software", " ".join(words[:10])])
    assert label in got[0]["labels"].split(",")
    assert len([s for s in got[0]["spans"] if s["label"] == label]) == 1
    assert got[1]["labels"] == "" and got[1]["score"] == 0 and got[2]["labels"] == ""


def test_parts_with_a_single_hit_are_merged(run):
    """A notice with words put in at three places, so that some parts keep three words in a row only."""
    label, text = next((k, t) for k, t in licenses.TEMPLATES if k == "mpl-2.0")
    w = text.split()
    broken = [*w[:7], "one", *w[7:10], "two", *w[10:13], "three", *w[13:]]
    got = run([f"lead in {' '.join(broken)} and on", " ".join(w[7:10]) + " alone"])
    assert label in got[0]["labels"].split(",") and got[1]["labels"] == ""


def test_whole_templates_match_direct_search(run):
    """Every place where all words of a template stand in a row, and nothing in texts that hold no run of three of its words."""
    rng = random.Random(8)
    known = [(label, _words(t)) for label, t in licenses.TEMPLATES]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(["alpha", "beta", "the", "of", "license"]) for _ in range(rng.randrange(12))]
            own = list(rng.choice(known)[1])
            parts += own if rng.random() < 0.7 else own[: rng.randrange(1, 3)]
        texts.append(" ".join(parts))
    for i, r in run(texts).items():
        words = _words(texts[i])
        for label, t in known:
            for at in (at for at in range(len(words) - len(t) + 1) if words[at : at + len(t)] == t):
                assert any(s["label"] == label and s["start"] <= at and s["end"] >= at + len(t) and s["coverage"] >= 0.75 for s in r["spans"]), (i, label, at)
        grams = {tuple(words[j : j + 3]) for j in range(len(words))}
        for s in r["spans"]:
            assert any(label == s["label"] and any(tuple(t[j : j + 3]) in grams for j in range(len(t) - 2)) for label, t in known)


def test_copies_and_repeats_agree(run):
    text = "x y. Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."
    got = run([text] * 50 + [None], ids=[*range(49), None, None])
    assert {(r["labels"], len(r["spans"])) for i, r in got.items() if i is not None} == {("cc-by,cc-by-nc-4.0", 2)}


def test_empty_table(run):
    assert run([]) == {}
