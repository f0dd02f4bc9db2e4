import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of texts; ids count up unless given."""

    def make(texts, ids=None, extra=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "src0", len(t) if t else 0) for i, t in zip(ids, texts, strict=True)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(7) for c in extra})
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(5)
    words = ["the", "naïve", "Straße", "x1", "don't", "名前", "🙂", "<|endoftext|>", "é"]
    return [None, "", " ", "a", "\n\n\t", "same text twice", "same text twice", "x" * 3000, " ".join(rng.choice(words) for _ in range(4000)), "İstanbul ǅ ² ½ \x85 \x1c end", "﻿bom ‍ zero"]
