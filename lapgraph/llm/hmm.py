"""A hidden Markov language model over word classes, and unigram scores to hold it against.

Frequent words are classes of their own; rarer ones share a class by their last bytes. States emit classes, and a class
emits its words by their smoothed counts, with a share for words never seen that singletons suggest (Good and Turing). So
the model is a hidden Markov model over words whose parameters are bounded in number, at any size of corpus.

Training: words of all training documents are counted; documents are written once as class numbers; every round of
Baum-Welch runs over all of them, each partition giving expected counts that are summed by class. Long texts are learned
from in stretches that know BURN tokens on either side, so that no text is a long serial task. Scoring: the scaled forward recursion gives the exact likelihood of the sequence of classes, and a join with
the counts adds that of the rarer words in their classes.

Scale: what grows with the vocabulary (the counts) is joined, never sent whole to one machine. Frequent words, which would
be hot keys of that join, are looked up in a broadcast list of HEAD words. Documents are run in step, many at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapgraph.llm import wordhash
from lapgraph.llm.texts import slices
from lapgraph.storage import materialize

STATES = 8
HEAD = 16384  #: words with a class of their own, at most
TAILS = 2048  #: classes of the other words
#: Rounds of Baum-Welch over all training documents.
ROUNDS = 3
#: Tokens of a stretch of a long text in training, and tokens read on either side of it; tokens worked on at once.
SEGMENT, BURN, PIECE = 1024, 64, 1_000_000
SLICE, SLICE_DOCS = 6_000_000, 4096
SMOOTHING = 20.0  #: tokens of the class frequencies that every state's counts are mixed with
END = 0  #: the hash that stands for the end of a text
_HELD = 500_000  #: distinct words after which a worker passes its counts on


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, tail class, text) of all tokens: words between white space, A-Z lower-cased, then one end a text."""
    raw, starts = wordhash.joined(texts)
    raw = wordhash.lowered(raw)
    begin, end, text = wordhash.words(raw, (raw != 32) & ((raw < 9) | (raw > 13)), starts)
    h = wordhash.hashes(raw, begin, end)[0]
    h[h == END] = 1
    last = np.zeros(len(h), np.uint64)
    for j in range(1, 4):
        at = end - j
        last = (last << np.uint64(8)) | np.where(at >= begin, raw[np.maximum(at, 0)] if len(raw) else 0, 0).astype(np.uint64)
    tail = (wordhash.mixed(last + np.uint64(1)) % np.uint64(TAILS)).astype(np.int32)
    n = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    place = np.arange(len(h)) + text
    full, tails, owner = np.full(len(h) + len(n), END, np.uint64), np.zeros(len(h) + len(n), np.int32), np.repeat(np.arange(len(n)), n + 1)
    full[place], tails[place] = h, tail
    return full, tails, owner


def held_out(doc_id):
    """Whether crc32 of the id as text is 1 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """``h, n, tail`` of every distinct token of ``docs`` (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged():
            h, n, t = (np.concatenate(x) for x in zip(*held, strict=True))
            own, first, of = np.unique(h, return_index=True, return_inverse=True)
            return own, np.bincount(of, n).astype(np.int64), t[first]

        def out():
            h, n, t = merged()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(t)], ["h", "n", "tail"])

        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                h, t, _ = tokens(piece.column("text"))
                own, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((own, n, t[first]))
                size += len(own)
                if size > _HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    found = docs.select("text").mapInArrow(run, "h long, n long, tail int")
    return found.groupBy("h").agg(F.sum("n").alias("n"), F.min("tail").alias("tail"))


@dataclass
class Vocabulary:
    """``head``: hashes in order, ``head_n``: their counts. Classes: head words by place, then TAILS tail classes."""

    head: np.ndarray
    head_n: np.ndarray
    total: int  # N
    types: int  # V
    tail_n: np.ndarray
    tail_types: np.ndarray
    tail_once: np.ndarray

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.types + 1)

    @property
    def classes(self) -> int:
        return len(self.head) + TAILS

    def unseen(self) -> np.ndarray:
        """Of each tail class, the share of words that were never seen."""
        return np.clip((self.tail_once + 0.5) / (self.tail_n + 1.0), 1e-4, 0.9)

    def frequencies(self) -> np.ndarray:
        """Of each class, among all tokens."""
        f = np.concatenate([self.head_n + 0.5, self.tail_n + 0.5 * self.tail_types + 0.5])
        return f / f.sum()


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The frequent words (``head`` at most) and sums over all others by tail class.

    The least count of a frequent word is read off a histogram of counts (16 bins an octave): as many whole bins as fit.
    """
    place = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(((r[0], r[1]) for r in counts.groupBy(place).count().collect()), reverse=True)  # 1,024 at most
    taken, least = 0, None
    for b, size in bins:
        taken += size
        if taken > head:
            break
        least = b
    top = counts.where(place >= least if least is not None else F.lit(False)).toArrow().combine_chunks()  # ``head`` rows at most
    get = lambda t, c: t.column(c).to_numpy() if t.num_rows else np.zeros(0, np.int64)
    h, n, t = (get(top, c) for c in ("h", "n", "tail"))
    by = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("once")).toArrow()
    sums = np.zeros((3, TAILS), np.int64)
    for i, c in enumerate(("n", "types", "once")):
        sums[i, get(by, "tail")] = get(by, c)
    total, types = int(sums[0].sum()), int(sums[1].sum())
    np.subtract.at(sums[0], t, n)
    np.subtract.at(sums[1], t, 1)
    np.subtract.at(sums[2], t, (n == 1).astype(np.int64))
    order = np.argsort(h.view(np.uint64))
    return Vocabulary(h.view(np.uint64)[order], n[order], total, types, *sums)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``row, doc_id, held_out, n_tokens, head_score, classes, words, tails, times`` of each document.

    ``row`` is unique in one evaluation: write the result before use. ``classes``: 16-bit numbers. ``head_score``: base
    score of the frequent words. ``words, tails, times``: the distinct other words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = sent.value, TaskContext.get().partitionId() << 40
        size = max(1, len(v.head))
        score = np.log10((v.head_n + 0.5) / v.norm)
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                h, t, owner = tokens(piece.column("text"))
                docs_here = piece.num_rows
                at = np.minimum(np.searchsorted(v.head, h), size - 1)
                known = v.head[at] == h if len(v.head) else np.zeros(len(h), bool)
                classes = np.where(known, at, len(v.head) + t).astype("<u2")
                n = np.bincount(owner, minlength=docs_here)
                base = np.bincount(owner[known], score[at[known]], docs_here)
                ends = np.cumsum(n)
                data = classes.tobytes()
                lists = [data[2 * (e - m) : 2 * e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                ho, oo, to = h[~known], owner[~known], t[~known]
                order = np.lexsort((ho, oo))
                ho, oo, to = ho[order], oo[order], to[order]
                new = np.r_[True, (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])] if len(ho) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                times = np.diff(np.r_[first, len(ho)]).astype(np.int32)
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(oo[first], minlength=docs_here))].astype(np.int32))
                ragged = lambda x, o=offsets: pa.ListArray.from_arrays(o, pa.array(x))
                columns = [pa.array(row + np.arange(docs_here)), piece.column("doc_id"), piece.column("held_out"), pa.array(n), pa.array(base, "float64"), pa.array(lists, pa.binary())]
                columns += [ragged(ho[first].view(np.int64)), ragged(to[first]), ragged(times)]
                row += docs_here
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "head_score", "classes", "words", "tails", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, head_score double, classes binary, words array<long>, tails array<int>, times array<int>"
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)


@dataclass
class Model:
    """``start`` (states), ``move`` (from, to), ``emit`` (class, state): each state's emissions add up to 1."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def fresh(frequencies: np.ndarray, states: int = STATES, seed: int = 0) -> Model:
        """States that hardly change within a text at first: so they soon part by language and subject, and few rounds do."""
        rng = np.random.default_rng(seed)
        emit = frequencies[:, None] * np.exp(rng.normal(size=(len(frequencies), states)))
        move = rng.uniform(0.5, 1.5, (states, states)) + 30 * states * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Sequences:
    """Class sequences as one array, the longest first: those longer than t are always the first few."""

    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(lists: list[bytes]) -> Sequences:
        size = np.array([len(x) // 2 for x in lists], np.int64)
        order = np.argsort(-size, kind="stable")
        begin = np.cumsum(size) - size
        return Sequences(np.frombuffer(b"".join(lists), "<u2").astype(np.int64), begin[order], size[order], order)

    def running(self) -> np.ndarray:
        """How many are longer than t, for t = 0, 1, ..."""
        longest = int(self.size[0]) if len(self.size) else 0
        return np.searchsorted(-self.size, -np.arange(longest), side="left")


def forward(model: Model, seqs: Sequences) -> np.ndarray:
    """Natural log likelihood of each sequence (as given)."""
    total, ones = np.zeros(len(seqs.size)), np.ones(len(model.start))
    alpha = np.broadcast_to(model.start, (len(seqs.size), len(model.start)))
    for t, m in enumerate(seqs.running().tolist()):
        if t:
            alpha = alpha[:m] @ model.move
        alpha = alpha[:m] * model.emit[seqs.flat[seqs.begin[:m] + t]]
        c = alpha @ ones  # faster than a sum along short rows
        alpha /= c[:, None]
        total[:m] += np.log(c)
    out = np.zeros(len(total))
    out[seqs.order] = total
    return out


@dataclass
class Stretches:
    """Parts of sequences: places in ``flat`` from ``begin`` on, ``size`` of them, of which ``own`` follow the first ``lead``."""

    begin: np.ndarray
    size: np.ndarray
    lead: np.ndarray
    own: np.ndarray
    first: np.ndarray  # whether it is its sequence's first

    @staticmethod
    def of(seqs: Sequences, segment: int, burn: int) -> Stretches:
        count = -(-seqs.size // segment)
        seq = np.repeat(np.arange(len(count)), count)
        at = (np.arange(len(seq)) - np.repeat(np.cumsum(count) - count, count)) * segment
        end = np.minimum(at + segment, seqs.size[seq])
        lo, hi = np.maximum(at - burn, 0), np.minimum(end + burn, seqs.size[seq])
        return Stretches(seqs.begin[seq] + lo, hi - lo, at - lo, end - at, at == 0)

    def pieces(self, most: int) -> Iterator[Stretches]:
        """The same, in runs of about ``most`` tokens, the longest first in each."""
        order = np.argsort(-self.size, kind="stable")
        cut = np.flatnonzero(np.diff(np.cumsum(self.size[order]) // most)) + 1
        for some in np.split(order, cut) if len(order) else []:
            yield Stretches(self.begin[some], self.size[some], self.lead[some], self.own[some], self.first[some])


def expected(model: Model, seqs: Sequences, segment: int = SEGMENT, burn: int = BURN) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of the sequences: starts, moves, emissions (class, state), and their log likelihood.

    Exact for sequences of up to ``segment`` tokens; longer ones are taken in stretches, each with ``burn`` tokens around it
    that set its states but are not counted again.
    """
    states, classes = len(model.start), len(model.emit)
    starts, moves, emits, loglik = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), 0.0
    usual, ones = np.linalg.matrix_power(model.move, 256)[0], np.ones(states)
    for part in Stretches.of(seqs, segment, burn).pieces(PIECE):
        of = np.repeat(np.arange(len(part.size)), part.size)
        t_of = np.arange(len(of)) - np.repeat(np.cumsum(part.size) - part.size, part.size)
        m_of = np.searchsorted(-part.size, -np.arange(int(part.size[0])), side="left")
        first_of = np.cumsum(m_of) - m_of
        place = first_of[t_of] + of  # tokens of one step stand side by side
        flat, own = np.empty(len(of), np.int64), np.empty(len(of), bool)
        flat[place] = seqs.flat[part.begin[of] + t_of]
        own[place] = (t_of >= part.lead[of]) & (t_of < (part.lead + part.own)[of])
        steps = list(zip(first_of.tolist(), (first_of + m_of).tolist(), strict=True))
        alphas, scales = np.empty((len(flat), states)), np.empty(len(flat))
        alpha = np.where(part.first[:, None], model.start, usual)
        for t, (i, j) in enumerate(steps):
            alpha = np.multiply(alpha[: j - i] @ model.move if t else alpha, model.emit[flat[i:j]], out=alphas[i:j])
            scales[i:j] = alpha @ ones  # faster than a sum along short rows
            alpha /= scales[i:j, None]
        loglik += float(np.log(scales[own]).sum())
        stretched = not own.all()
        beta, ahead = np.ones((len(part.size), states)), np.zeros((0, states))
        for i, j in reversed(steps):
            n = len(ahead)
            if n:
                moves += alphas[i : i + n].T @ (ahead * own[j : j + n, None] if stretched else ahead)
                beta[:n] = ahead @ model.move.T
            ahead = model.emit[flat[i:j]]
            ahead *= beta[: j - i]
            ahead /= scales[i:j, None]
            alphas[i:j] *= beta[: j - i]
        starts += alphas[: len(part.size)][part.first].sum(0)
        if stretched:
            alphas, flat = alphas[own], flat[own]
        emits += np.stack([np.bincount(flat, x, classes) for x in np.ascontiguousarray(alphas.T)], axis=1)
    return starts, moves * model.move, emits, loglik


def maximized(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, frequencies: np.ndarray, smoothing: float = SMOOTHING) -> Model:
    """The model that fits the counts, mixed with the class frequencies."""
    emit = emits + smoothing * frequencies[:, None]
    start, move = starts + 0.1, moves + 0.1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _gathered(encoded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all rows of ``encoded``, summed by class across partitions."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    states, classes = len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + states + 1, states))
        for batch in batches:
            for piece in slices(batch, "classes", 2_000_000, SLICE_DOCS):
                starts, moves, emits, _ = expected(sent.value, Sequences.of(piece.column("classes").to_pylist()))
                total[:classes] += emits
                total[classes : classes + states] += moves
                total[-1] += starts
        used = np.flatnonzero(total.any(1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, s]) for s in range(states)]], ["class", *[f"s{s}" for s in range(states)]])

    schema = ", ".join(["class int", *[f"s{s} double" for s in range(states)]])
    rows = encoded.select("classes").mapInArrow(run, schema).groupBy("class").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)])
    found, out = rows.toArrow(), np.zeros((classes + states + 1, states))  # a row per class, whatever the corpus
    if found.num_rows:
        out[found.column("class").to_numpy()] = np.column_stack([found.column(f"s{s}").to_numpy() for s in range(states)])
    return out[-1], out[classes : classes + states], out[:classes]


def fit(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS, seed: int = 0) -> Model:
    """Baum-Welch over the rows of ``encoded`` (written) that are not held out."""
    frequencies = vocab.frequencies()
    model, known = Model.fresh(frequencies, states, seed), encoded.where(~F.col("held_out"))
    for _ in range(rounds if vocab.total else 0):
        model = maximized(*_gathered(known, model), frequencies)
    return model


def likelihoods(encoded: DataFrame, model: Model) -> DataFrame:
    """``encoded`` without its lists, with ``class_score``: log10 likelihood of the class sequence."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "held_out", "n_tokens", "head_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "classes", 2_000_000, SLICE_DOCS):
                score = forward(sent.value, Sequences.of(piece.column("classes").to_pylist())) / math.log(10)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(score)], [*names, "class_score"])

    schema = ", ".join(f"{c} {t}" for c, t in encoded.dtypes if c in names) + ", class_score double"
    return encoded.select(*names, "classes").mapInArrow(run, schema)


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, seed: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document, whole.

    The model learns from the rows that are not held out. A null text counts as empty: its one token is the end. Equal
    rows count as often as they occur. Other columns are ignored. Without training rows every word is unknown.
    """
    text = docs.select("doc_id", "text")
    counts = materialize(count_words(text.where(~held_out(F.col("doc_id")))))
    vocab = vocabulary(counts, head)
    encoded = materialize(encode(text, vocab))
    model = fit(encoded, vocab, states, rounds, seed)
    whole = likelihoods(encoded, model)

    unseen, mass = vocab.unseen(), vocab.tail_n + 0.5 * vocab.tail_types
    seen = np.where(mass > 0, np.log10((1 - unseen) / np.maximum(mass, 0.5)), 0.0)
    constants = pa.table({"tail": pa.array(np.arange(TAILS, dtype=np.int32)), "seen": seen, "new": np.log10(unseen)})
    table = F.broadcast(docs.sparkSession.createDataFrame(constants))  # TAILS rows
    rare = encoded.select("row", F.inline(F.arrays_zip("words", "tails", "times"))).toDF("row", "h", "tail", "times")
    rare = rare.join(counts.select("h", "n"), "h", "left").join(table, "tail")
    lift = F.log10(F.col("n") + 0.5)
    rare = rare.groupBy("row").agg(
        F.sum("times").alias("rare"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.coalesce(lift, F.lit(math.log10(0.5)))).alias("rare_lift"),
        F.sum(F.col("times") * F.coalesce(lift + F.col("seen"), F.col("new"))).alias("rare_score"),
    )
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - at("rare") + at("rare_known")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_score") + at("rare_lift") - at("rare") * math.log10(vocab.norm)).alias("base_score"),
        (F.col("class_score") + at("rare_score")).alias("score"),
    )
