"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of two hashed embeddings, of the whole word and of its first bytes. Filters of several widths run over
the words of a text; the greatest response of each filter anywhere in the text goes into a logistic output. The network
is fitted on a bounded sample of labelled rows. Every document is then scored over its whole text, and all
labelled training rows set the thresholds: one for all, to which the score 0.7 is tied, and one by language.

Scale: documents are read once and keep their place; a row of three numbers each is written. The network has under
3 MB. Only counts by score bin meet in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lapgraph.llm import wordhash
from lapgraph.llm.texts import hashed_sample, slices, small_batches, tidy
from lapgraph.storage import materialize

#: Labelled rows of each label from which the network is fitted, at most.
TOXIC_ROWS, CLEAN_ROWS = 2000, 3000
#: Bytes of their texts in all, at most, half of them for each label; a text of over a 64th of that is not learned from.
SAMPLE_BYTES = 64_000_000
WORD_BITS, PREFIX_BITS, PREFIX_BYTES, SIZE, WIDTHS, FILTERS = 15, 13, 4, 12, (1, 2, 3), 16
#: The score at which a document counts as toxic.
CUT = 0.7
#: Texts of the sample in which a word or prefix must occur to be told from others.
LEAST_TEXTS = 4
_SLOTS = 32768
_BIN = 16  # bins of a unit of the logit
_PAD = max(WIDTHS) - 1


@dataclass
class Words:
    """Buckets of the words of several texts: every text has its words (or one pad) and then _PAD pads."""

    word: np.ndarray
    prefix: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def words_of(texts: pa.Array) -> Words:
    raw, starts = wordhash.joined(texts)
    raw = wordhash.lowered(raw)
    inside = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    begin, end, text = wordhash.words(raw, inside, starts)
    whole, prefix = wordhash.hashes(raw, begin, end, np.minimum(end, begin + PREFIX_BYTES))
    n = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    sizes = np.maximum(n, 1)
    at = np.cumsum(sizes + _PAD) - sizes - _PAD
    slot = at[text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
    out = [np.zeros(int((sizes + _PAD).sum()), np.int64) for _ in range(2)]
    out[0][slot] = 1 + (whole >> np.uint64(64 - WORD_BITS)).astype(np.int64)  # bucket 0 is the pad
    out[1][slot] = 1 + (prefix >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)
    return Words(*out, at, sizes)


@dataclass
class Network:
    word: np.ndarray
    prefix: np.ndarray
    filters: list[np.ndarray]  # by width: (width * SIZE, FILTERS)
    shift: np.ndarray
    out: np.ndarray  # the last is the constant

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(scale=0.1, size=shape).astype("f4")
        word, prefix = draw(2**WORD_BITS + 1, SIZE), draw(2**PREFIX_BITS + 1, SIZE)
        word[0] = prefix[0] = 0
        out = draw(len(WIDTHS) * FILTERS + 1)
        out[-1] = 0
        return Network(word, prefix, [3 * draw(w * SIZE, FILTERS) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, "f4"), out)

    def parts(self) -> list[np.ndarray]:
        return [self.word, self.prefix, *self.filters, self.shift, self.out]

    def pooled(self, w: Words) -> np.ndarray:
        """The greatest response of each filter in each text, at least 0."""
        out = np.zeros((len(w.sizes), len(self.shift)), "f4")
        ends = w.starts + w.sizes
        for lo in range(0, len(w.word), _SLOTS):
            hi = min(lo + _SLOTS, len(w.word))
            e = self.word[w.word[lo : hi + _PAD]] + self.prefix[w.prefix[lo : hi + _PAD]]
            e = np.concatenate([e, np.zeros((hi + _PAD - lo - len(e), SIZE), "f4")])
            first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(w.starts, hi)
            begin, stop = np.maximum(w.starts[first:last], lo) - lo, np.minimum(ends[first:last], hi) - lo
            if first == last:
                continue
            edges = np.column_stack([begin, stop]).ravel()
            edges = edges[:-1] if edges[-1] >= hi - lo else edges
            for i, (width, k) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                y = e[: hi - lo] @ k[:SIZE]
                for j in range(1, width):
                    y += e[j : hi - lo + j] @ k[j * SIZE : (j + 1) * SIZE]
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                top = np.maximum.reduceat(y, edges, axis=0)[::2] + self.shift[own]
                out[first:last, own] = np.maximum(out[first:last, own], top)
        return out

    def logits(self, w: Words) -> np.ndarray:
        return self.pooled(w) @ self.out[:-1] + self.out[-1]


def _gradient(net: Network, w: Words, label: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss over whole texts; only the winning places of a filter carry it."""
    n, e = len(label), net.word[w.word] + net.prefix[w.prefix]
    places = np.zeros((n, len(net.shift)), np.int64)
    value = np.zeros((n, len(net.shift)), "f4")
    for i, (width, k) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        y = e @ k[:SIZE]
        for j in range(1, width):
            y[:-j] += e[j:] @ k[j * SIZE : (j + 1) * SIZE]
        for d in range(n):
            part = y[w.starts[d] : w.starts[d] + w.sizes[d]]
            best = part.argmax(0)
            own = slice(i * FILTERS, (i + 1) * FILTERS)
            places[d, own], value[d, own] = best + w.starts[d], part[best, np.arange(FILTERS)]
    pool = np.maximum(value + net.shift, 0)
    p = 1 / (1 + np.exp(-(pool @ net.out[:-1] + net.out[-1])))
    delta = ((p - label) / n).astype("f4")
    back = delta[:, None] * net.out[:-1] * (value + net.shift > 0)
    grads = [np.zeros_like(x) for x in net.parts()]
    for i, (width, k) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        for j in range(width):
            at, g = places[:, own] + j, back[:, own]
            rows = slice(j * SIZE, (j + 1) * SIZE)
            grads[2 + i][rows] += np.einsum("dfs,df->sf", e[at], g)
            send = g[:, :, None] * k[rows].T[None]
            np.add.at(grads[0], w.word[at], send)
            np.add.at(grads[1], w.prefix[at], send)
    grads[0][0] = grads[1][0] = 0
    grads[-2] += back.sum(0)
    grads[-1][:-1], grads[-1][-1] = pool.T @ delta, delta.sum()
    return grads


def _frequent(texts: list[str | None]) -> list[np.ndarray]:
    """Whether a word bucket, and a prefix bucket, occurs in LEAST_TEXTS of the texts."""
    seen = [np.zeros(2**b + 1, np.int64) for b in (WORD_BITS, PREFIX_BITS)]
    for lo in range(0, len(texts), 256):
        w = words_of(pa.array(texts[lo : lo + 256], pa.string()))
        owner = np.repeat(np.arange(len(w.sizes)), w.sizes + _PAD)
        for count, bucket in zip(seen, (w.word, w.prefix), strict=True):
            pairs = np.unique(owner * len(count) + bucket)
            count += np.bincount(pairs % len(count), minlength=len(count))
    return [c >= LEAST_TEXTS for c in seen]


def fit(texts: list[str | None], labels: list[int], epochs: int = 12, batch: int = 48, rate: float = 0.01, decay: float = 3e-3, seed: int = 0) -> Network:
    """Adam over the given rows; the same rows in the same order give the same network."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed + 1)
    y = np.array(labels, "f4")
    frequent = _frequent(texts)
    for table, mask in zip((net.word, net.prefix), frequent, strict=True):
        table *= mask[:, None]  # buckets that training does not know say nothing
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in net.parts()]
    step, rounds = 0, max(epochs, min(60, 250 * batch // max(1, len(texts))))
    for epoch in range(rounds):
        order = rng.permutation(len(texts))
        now = rate * (1 - epoch / rounds) + rate / 20
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            grads = _gradient(net, words_of(pa.array([texts[i] for i in some], pa.string())), y[some])
            for g, mask in zip(grads, frequent, strict=False):
                g *= mask[:, None]
            step += 1
            for x, g, (m, v) in zip(net.parts(), grads, moments, strict=True):
                g = g + np.float32(decay) * x
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x -= np.float32(now / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            net.word[0] = net.prefix[0] = 0
    return net


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of labelled rows from which may be learned, one a document (1 if any row says so)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, seed: int = 0) -> Network | None:
    """A network from TOXIC_ROWS and CLEAN_ROWS labelled documents at most; None unless both labels occur.

    Of texts that share a doc_id one is taken. Texts of the sample hold SAMPLE_BYTES in all at most.
    """
    known = training_labels(labels)
    there = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    some = lambda y, n: hashed_sample(known.where(F.col("toxic") == y), n, there.get(y, 0), "doc_id")
    chosen = materialize(some(1, TOXIC_ROWS).unionByName(some(0, CLEAN_ROWS)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the limits
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = rows.where(size <= SAMPLE_BYTES // 64).groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    along = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bytes", F.sum(size).over(along)).where(F.col("_bytes") <= SAMPLE_BYTES // 2).drop("_bytes").toArrow().sort_by("doc_id")
    labels_of = rows.column("toxic").to_pylist()
    net = fit(rows.column("text").to_pylist(), labels_of, seed=seed) if len(set(labels_of)) == 2 else None
    del rows
    tidy()  # the driver lives on
    return net


def logits(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, lang, logit`` of every document over its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1_000_000):
                found = sent.value.logits(words_of(piece.column("text")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("lang"), pa.array(found.astype("f8"))], ["doc_id", "lang", "logit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, logit double")


def best_cut(counts: dict[int, tuple[int, int]]) -> float:
    """The logit at which F1 is greatest; the middle of the range, if any value of a range does.

    ``counts``: by bin, how many clean and toxic rows.
    """
    bins = sorted(counts)
    positive = sum(p for _, p in counts.values())
    best, span, true, false = -1.0, (0.0, 0.0), 0, 0
    for i in range(len(bins) - 1, -1, -1):
        n, p = counts[bins[i]]
        true, false = true + p, false + n
        f1 = 2 * true / (true + false + positive)
        low = bins[i - 1] + 1 if i else bins[i]
        if f1 > best:
            best, span = f1, (low, bins[i])
        elif f1 == best:
            span = (low, span[1])
    return (span[0] + span[1]) / 2 / _BIN


def _lang() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def _score(logit: Column, cut: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit - F.lit(cut) + F.lit(float(np.log(CUT / (1 - CUT)))))))


def calibrate(scored: DataFrame, labels: DataFrame, least: int) -> tuple[float, DataFrame]:
    """The logit that suits all labelled training rows best, and ``lang, own``: the score that suits a language best."""
    known = scored.join(training_labels(labels), "doc_id")
    place = F.greatest(F.least(F.floor(F.col("logit") * _BIN), F.lit(1023)), F.lit(-1024)).cast("int")
    count = lambda y: F.sum((F.col("toxic") == y).cast("long"))
    bins = materialize(known.groupBy(_lang().alias("lang"), place.alias("bin")).agg(count(0).alias("clean"), count(1).alias("toxic")))
    total = bins.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    cut = best_cut({r["bin"]: (r["clean"], r["toxic"]) for r in total.collect()})  # 2048 bins at most
    down = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    own = bins.withColumn("true", F.sum("toxic").over(down)).withColumn("false", F.sum("clean").over(down))
    own = own.withColumn("all", F.sum("toxic").over(Window.partitionBy("lang")))
    own = own.withColumn("low", F.coalesce(F.lead("bin").over(Window.partitionBy("lang").orderBy(F.desc("bin"))) + 1, F.col("bin"))).where(F.col("all") >= least)
    f1 = 2 * F.col("true") / (F.col("true") + F.col("false") + F.col("all"))
    cuts = own.groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), ((F.col("bin") + F.col("low")) / 2).alias("mid"))).alias("x"))
    return cut, materialize(cuts.select("lang", _score(F.col("x.mid") / _BIN, cut).alias("own")))


def classify(docs: DataFrame, labels: DataFrame, least: int = 50, seed: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted, lang_threshold, toxic_in_lang`` of every document.

    The score reads the text alone. ``predicted``: score >= 0.7, the cut that suits all labelled training rows best.
    ``lang_threshold``: the cut that suits those of the document's language, where it has ``least`` toxic rows; else
    0.7. Null texts count as empty; a null doc_id is not held out; without labels of both kinds all scores are 0.
    Repeated rows are scored alike.
    """
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    net = train(docs, labels, seed)
    if net is None:
        flat = docs.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
        return flat.withColumn("lang_threshold", F.lit(CUT)).withColumn("toxic_in_lang", F.lit(0))
    scored = materialize(logits(docs, net))
    cut, cuts = calibrate(scored, labels, least)
    found = scored.withColumn("lang", _lang()).join(cuts, "lang", "left").withColumn("score", _score(F.col("logit"), cut)).withColumn("lang_threshold", F.coalesce("own", F.lit(CUT)))
    return found.select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "lang_threshold",
        (F.col("score") >= F.col("lang_threshold")).cast("int").alias("toxic_in_lang"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, least: int = 50, seed: int = 0) -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold; every column stays as it is.

    Rows are judged one by one, beside their own columns: they need no key, and no text is shuffled. No text is written either:
    training rows are scored for the thresholds, then every row on its way out. Null texts count as empty; repeated rows stay
    or go together; an empty table stays empty.
    Without labels of both kinds every row stays. Needs the columns doc_id, text and lang.
    """
    net = train(docs, labels, seed)
    if net is None:
        return docs
    small_batches(docs.sparkSession)
    name, lang, own = (_fresh(docs, n) for n in ("logit", "threshold_lang", "threshold"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        found = [sent.value.logits(words_of(piece.column("text"))).astype("f8") for piece in slices(batch, "text", 1_000_000)]
        return pa.array(np.concatenate([np.zeros(0), *found]))

    # other columns do not pass through Python
    scored = docs.withColumn(name, F.arrow_udf(score, "double")(F.col("text")))
    cut, cuts = calibrate(materialize(logits(docs.where(remainder(F.col("doc_id"), 3) != 1), net)), labels, least)
    cuts = cuts.toDF(lang, own)
    cuts = F.broadcast(cuts) if cuts.count() <= LANGUAGES else cuts  # a row per language with labelled rows
    found = scored.join(cuts, _lang() == F.col(lang), "left")
    return found.where(_score(F.col(name), cut) < F.coalesce(F.col(own), F.lit(CUT))).select(*docs.columns)


#: Languages up to which their thresholds are broadcast instead of shuffling the texts.
LANGUAGES = 10_000


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name
