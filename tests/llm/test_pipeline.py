import random
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lapgraph.llm import packing
from lapgraph.storage import shared_dir


def _tables(spark, folder):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(600):
        body = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        toxic = i % 6 == 0
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(["scumbag", "idiotic"])
        rows.append((i, " ".join(body), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(600 + i, rows[i + 1][1], "en", "s", 0) for i in range(5)]  # exact copies
    near = rows[9][1].split()
    rows.append((605, " ".join([*near[:-1], "changed"]), "en", "s", 0))
    rows += [(606, None, None, None, None), (607, "", "en", None, 0), (None, "plain words without an id here", "en", "s", 1)]
    rows.append((608, "my password=abc123def456 in clear words", "en", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = _tables(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({(r["doc_id"], r["text"]) for r in docs.collect()} if name != "packing" else docs.collect())
    clean, single, blotted, pieces = seen
    toxic = {i for i in range(600) if i % 6 == 0}
    kept = {i for i, _ in clean}
    assert len(toxic & kept) <= 5 and len(kept - toxic) >= len(rows) - len(toxic) - 5 and None in kept
    texts = dict(single)
    assert not {600, 601, 602, 603, 604, 605, 607} & set(texts) and {1, 9, 606, None, 608} <= set(texts)
    assert len(single) == len(texts) and {i for i, _ in single} <= kept
    assert dict(blotted)[608] == "my password=[REDACTED] in clear words"
    assert {i: t for i, t in blotted if i != 608} == {i: t for i, t in single if i != 608}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in blotted)
    assert {(r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r["doc_id"], r["doc_tokens"]) for r in pieces}


def test_boundaries_do_not_lose_ids(spark, tmp_path):
    _tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.pack(docs, 128).collect()
    assert sum(r["length"] for r in rows) == sum(len(np.frombuffer(r["ids"], "<u2")) for r in rows)
    assert max(r["sequence_id"] for r in rows) + 1 == len({r["sequence_id"] for r in rows})


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_long_texts_and_repeats(spark, tmp_path):
    """No labels, so nothing is toxic; one very long text, rows that repeat, and columns named as the stages' own."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    rows = [(1, long, "en", 3, 0), (1, long, "en", 3, 0), (2, long + " end", "en", 3, 0), (None, None, None, None, None), (3, "token=abcdef123 here", "en", 4, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, logit int, n_chars long").withColumnsRenamed({}).selectExpr(
        "*", "1 as ids", "2 as _base", "3 as _more", "4 as own_node", "5 as threshold", "6 as part"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) == {1, 3, None} and kept[1]["text"] == long and kept[3]["text"] == "token=[REDACTED] here" and kept[3]["_base"] == 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {1, 3, None}


def _scratch(spark, folder):
    """The columns of each table that lies in the shared folder, by its path."""
    return {p: set(spark.read.parquet(str(p)).columns) for p in folder.glob("**/table-*") if any(p.glob("part-*"))}


def test_stages_leave_no_texts_and_no_signatures_behind(spark, tmp_path):
    """Scratch tables of all stages together would lie on the shared disk; only small ones and the ids outlive a stage."""
    _tables(spark, tmp_path)
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(_scratch(spark, shared))
    new = lambda: {frozenset(c) for p, c in _scratch(spark, shared).items() if p not in before}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        left = set().union(*new())
        assert not left & {"text", "bands", "sketch", "hashes", "bucket", "estimate", "cell"}, name
    before |= set(_scratch(spark, shared))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert [c for c in new() if "text" in c or "representative" in c] == [] and any("ids" in c for c in new())
    assert pieces.count() == docs.count()
