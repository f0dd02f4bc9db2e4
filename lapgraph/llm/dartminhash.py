"""Near-duplicate classes by DartMinHash.

A text is a weighted set: its runs of five words, each with the number of times it occurs. Hashed darts fall on the plane
of (weight, rank) of every element, one on average per unit of area, the same for every text; a text holds the darts below
its weights. Each dart has a coordinate, and the dart of least rank is kept for each. Two texts agree in a coordinate
with the probability of their weighted Jaccard similarity. Only as much of the plane is looked at as fills all
coordinates: the work is in proportion to the elements plus k log k.

Bands of coordinates are joined. In each bucket every text meets one representative (the member that shares most buckets),
so a bucket of any size gives as many pairs as members, and a text meets few representatives. Where the pairs found alike
leave a bucket in several components, it is split by pairs of bands, with representatives drawn anew in each part, which
joins what is dense; pairs within a component need no second look.
Texts that then still share a bucket with a text of another component that they never met go through an exact join by
prefixes: of two alike texts, the first common element in order of rarity stands early in both, so that only early
elements are joined. What a whole family shares stands late, and its members do not meet by it. Pairs are judged
by their sketches (a byte of each coordinate), and exactly, from all elements, where the sketch leaves doubt.

A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**6)**32 = 0.99994, at 0.9 with more than 1 - 1e-9;
a pair that shares a band is in one component, compared, or ruled out by its sizes and the order of its elements.

Scale: texts are read for their sketches, and again for the elements of pairs in doubt; what is shuffled are numbers.
Copies, representatives and classes may hold a third of all rows: joins on them deal such keys over many tasks
(``spread_join``). Joins on buckets, of two numbers a row, read written tables on both sides, so that AQE splits a hot one
as soon as it is large. Everything else about such keys is aggregated before the shuffle. Scratch tables go once they have
been read: of signatures, elements and cells nothing is left when the classes are known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapgraph.llm import wordhash
from lapgraph.llm.texts import slices, small_batches, spread_join
from lapgraph.operators.components import connected_components
from lapgraph.storage import materialize, release, settled

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
#: Estimates from 192 coordinates deviate by 0.03 (standard deviation) at 0.8; between these bounds pairs are computed exactly.
SURELY_NOT, SURELY = 0.66, 0.93
#: Texts signed at once, at most: a text looks at about BANDS * ROWS * 10 cells of the plane, however short it is.
SIGNED = 512
#: Rows up to which a list of keys is broadcast (24 bytes each) instead of shuffling the texts.
BROADCAST_ROWS = 200_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
_LOW48 = np.uint64((1 << 48) - 1)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53


def signatures(element: np.ndarray, weight: np.ndarray | None, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) dart ids of n weighted sets; a row of zeros for an empty set.

    ``element``: hashes (uint64) in order of ``owner`` (0..n-1); an element may repeat in a set only as unit cells whose
    hashes differ. ``weight``: positive; None: 1 each.
    """
    if weight is None:
        cell, of, width = element, owner, None
    else:
        cells = np.ceil(weight).astype(np.int64)
        of = np.repeat(owner, cells)
        j = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        width = np.minimum(1.0, np.repeat(weight, cells) - j)
        cell = wordhash.mixed(np.repeat(element, cells) + _GOLD * j.astype(np.uint64))
    total = np.bincount(of, width, n) if len(of) else np.zeros(n)
    none = np.uint64(2**64 - 1)
    best = np.full(n * k, none)
    height = np.ceil(k * (math.log(k) + 4) / np.maximum(total, 1e-9)).astype(np.int64)
    floor = np.zeros(n, np.int64)
    todo = total > 0
    while todo.any():
        own = todo[of]
        c, d = cell[own], of[own]
        strips = (height - floor)[d]
        area_of = np.repeat(np.arange(len(c)), strips)
        strip = np.arange(len(area_of)) - np.repeat(np.cumsum(strips) - strips, strips) + floor[d][area_of]
        area = wordhash.mixed(c[area_of] ^ (_GOLD * (strip.astype(np.uint64) + np.uint64(1))))
        count = np.searchsorted(_POISSON, _unit(area))
        dart = wordhash.mixed(np.repeat(area, count) + _GOLD * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1).astype(np.uint64))
        rank = (np.repeat(strip, count) + _unit(dart)).astype("f4")
        more = wordhash.mixed(dart ^ np.uint64(0x2545F4914F6CDD1D))
        place = np.repeat(d[area_of], count) * k + (((more >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        key = rank.view(np.uint32).astype(np.uint64) << np.uint64(32) | more & np.uint64(0xFFFFFFFF)
        if width is not None:
            inside = _unit(wordhash.mixed(more + _GOLD)) < np.repeat(width[own][area_of], count)
            place, key = place[inside], key[inside]
        np.minimum.at(best, place, key)
        todo &= (best.reshape(n, k) == none).any(1)
        floor, height = height, 2 * height
    ids = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, k)
    ids[total <= 0] = 0
    return ids


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of 48 bits, text) of every run of WORDS words, sorted by text and hash; repeats stay.

    Words: runs of letters, digits and non-ASCII characters, A-Z lower-cased. A shorter text is one run; one without
    words has none.
    """
    raw, starts = wordhash.joined(texts)
    raw = wordhash.lowered(raw)
    inside = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    begin, end, text = wordhash.words(raw, inside, starts)
    h = wordhash.hashes(raw, begin, end)[0]
    n = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    run = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        run = run * _GOLD + h[j : j + len(run)]
    whole = text[: len(run)] == text[WORDS - 1 :]
    out, of = [run[whole]], [text[: len(run)][whole]]
    at = np.cumsum(n) - n
    for size in range(1, WORDS):
        short = np.flatnonzero(n == size)
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(size):
                own = own * _GOLD + h[at[short] + j]
            out.append(own)
            of.append(short)
    key = (np.concatenate(of).astype(np.uint64) << np.uint64(48)) | (wordhash.mixed(np.concatenate(out)) >> np.uint64(16))
    key.sort()
    return key & _LOW48, (key >> np.uint64(48)).astype(np.int64)


def _cells(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash of each occurrence of an element: weights as unit cells."""
    if not len(hashes):
        return hashes
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    j = np.arange(len(hashes)) - first[np.cumsum(new) - 1]
    return wordhash.mixed(hashes + _GOLD * (j.astype(np.uint64) + np.uint64(1)))


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, node, bands, sketch`` of every document.

    ``node``: 64-bit fingerprint of the text (null: empty). ``bands`` is null for texts without words.
    """
    k = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1_000_000, SIGNED):
                hashes, owner = shingles(piece.column("text"))
                n = piece.num_rows
                ids = signatures(_cells(hashes, owner), None, owner, n, k)
                band = np.zeros((n, BANDS), np.uint64)
                for j in range(ROWS):
                    band = wordhash.mixed(band * _GOLD + ids[:, j::ROWS].astype(np.uint64) + np.uint64(j + 1))
                band = wordhash.mixed(band + np.arange(BANDS, dtype=np.uint64) * _GOLD).view(np.int64)
                empty = np.bincount(owner, minlength=n) == 0 if len(owner) else np.ones(n, bool)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()))
                lists = pa.array([None] * n, lists.type) if empty.all() else pa.compute.if_else(pa.array(empty), pa.scalar(None, lists.type), lists)
                sketch = pa.array([x.tobytes() for x in (ids & 255).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("node"), lists, sketch], ["doc_id", "node", "bands", "sketch"])

    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", F.xxhash64(text).alias("node"), text.alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, node long, bands array<long>, sketch binary")


def _shared(buckets: DataFrame) -> DataFrame:
    """``bucket, node`` of the rows whose bucket has another member."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return buckets.join(materialize(sizes.select("bucket")), "bucket").select("bucket", "node")


def _popular(shared: DataFrame) -> DataFrame:
    """``bucket, rep``: the member that shares most buckets, so that few texts represent many buckets."""
    often = shared.groupBy("node").agg(F.count(F.lit(1)).alias("often"))
    best = F.max(F.struct(F.col("often"), F.col("node")))["node"]
    return shared.join(often, "node").groupBy("bucket").agg(best.alias("rep"))


def _star(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """``node, rep`` of all members but the representative."""
    return shared.join(reps, "bucket").where("node != rep").select("node", "rep").distinct()


def _estimate(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``pairs`` (node, rep) with ``estimate`` of their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a", "b"))
            share = ((a == b).mean(1) - 1 / 256) / (1 - 1 / 256) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rep"), pa.array(share, "float64")], ["node", "rep", "estimate"])

    own = lambda node, name: sketches.select(F.col("node").alias(node), F.col("sketch").alias(name))
    both = spread_join(pairs, own("rep", "b"), "rep").join(own("node", "a"), "node").select("node", "rep", "a", "b")
    return both.mapInArrow(run, "node long, rep long, estimate double")


def elements(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, hashes, counts`` of the texts whose fingerprint is among ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1_000_000):
                hashes, owner = shingles(piece.column("text"))
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                counts = np.diff(np.r_[first, len(hashes)]).astype(np.int32)
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(owner[first], minlength=piece.num_rows))].astype(np.int32))
                columns = [piece.column("node"), pa.ListArray.from_arrays(ends, pa.array(hashes[first].astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(counts))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "hashes", "counts"])

    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    found = named.join(wanted, "node", "left_semi").mapInArrow(run, "node long, hashes array<long>, counts array<int>")
    return found.groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("counts").alias("counts"))


def similarity(h1: np.ndarray, c1: np.ndarray, h2: np.ndarray, c2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets as sorted hashes and their counts."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    both = int(np.minimum(c1[i], c2[j]).sum())
    return both / max(1, int(c1.sum()) + int(c2.sum()) - both)


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (node, rep) with their exact ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for c in ("h1", "c1", "h2", "c2"):
                column = batch.column(c)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                sizes = np.diff(column.offsets.to_numpy())
                lists.append(np.split(flat, np.cumsum(sizes)[:-1]) if batch.num_rows else [])
            found = [similarity(*x) for x in zip(*lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("rep"), pa.array(found, "float64")], ["node", "rep", "similarity"])

    own = lambda node, h, c: sets.select(F.col("node").alias(node), F.col("hashes").alias(h), F.col("counts").alias(c))
    both = spread_join(pairs, own("rep", "h2", "c2"), "rep").join(own("node", "h1", "c1"), "node")
    return both.select("node", "rep", "h1", "c1", "h2", "c2").mapInArrow(run, "node long, rep long, similarity double")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, least: float, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (node, rep) that are similar enough; ``sets``: the elements of their texts, if they are at hand."""
    judged = materialize(_estimate(pairs, sketches).where(F.col("estimate") >= SURELY_NOT - (SIMILARITY - least)))
    sure = judged.where(F.col("estimate") >= SURELY).select("node", "rep")
    doubt = judged.where(F.col("estimate") < SURELY).select("node", "rep")
    if sets is not None:
        return sure.unionByName(_exact(doubt, sets).where(F.col("similarity") >= least).select("node", "rep"))
    nodes = materialize(doubt.select("node").unionByName(doubt.select(F.col("rep").alias("node"))).distinct())
    sets = materialize(elements(docs, nodes))
    return sure.unionByName(_exact(doubt, sets).where(F.col("similarity") >= least).select("node", "rep"))


def _unmet(shared: DataFrame, reps: DataFrame, component: DataFrame) -> DataFrame:
    """``node, component`` of texts that share a bucket with a text of another component, neither being its representative."""
    others = shared.join(reps, "bucket").where("node != rep").select("bucket", "node")
    others = materialize(others.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")))
    return others.join(_mixed(others), "bucket").select("node", "component").distinct()


def _mixed(member: DataFrame) -> DataFrame:
    """``bucket`` of those whose members (bucket, node, component) are of several components."""
    spans = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return materialize(spans.where("lo != hi").select("bucket"))


def _unit_cells(sets: DataFrame) -> DataFrame:
    """``node, cell``: a row of each occurrence of an element, so that a text is a plain set of as many cells as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sizes = pa.compute.list_value_length(piece.column("hashes")).to_numpy()
                hashes, counts = (piece.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("hashes", "counts"))
                owner = np.repeat(np.repeat(piece.column("node").to_numpy(), sizes), counts)
                j = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                cell = wordhash.mixed(np.repeat(hashes, counts).astype(np.uint64) + _GOLD * j.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(cell.view(np.int64))], ["node", "cell"])

    return sets.mapInArrow(run, "node long, cell long")


def _candidates(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (node, rep) of ``nodes`` (node, component) from different components: all that may be similar enough.

    Cells are in order of rarity among ``sets``. Alike sets of a <= b cells have o = least / (1 + least) * (a + b) in
    common at least, so their first common cell has at most a - o cells before it in the one and b - o in the other.
    """
    cells = materialize(_unit_cells(sets))
    often = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = F.array_sort(F.collect_list(F.struct("often", "cell")))  # of a text
    sizes = sets.select("node", F.aggregate("counts", F.lit(0), lambda a, c: a + c).alias("size"))
    ranked = cells.join(materialize(often), "cell").groupBy("node").agg(order.alias("order")).join(sizes, "node").join(nodes, "node")
    alone = F.col("size") - F.size("order")  # cells of no other text come first
    most = lambda share: F.floor(F.col("size") * (1 - share) + 1e-6)
    early = F.slice("order", F.lit(1), F.greatest(F.lit(0), (most(least) + 1 - alone).cast("int")))
    rows = ranked.select("node", "component", "size", alone.alias("alone"), F.posexplode(early).alias("i", "x"))
    rows = materialize(rows.select(F.col("x.cell").alias("cell"), "node", "component", "size", (F.col("alone") + F.col("i")).alias("before")))
    small = rows.where(F.col("before") <= most(2 * least / (1 + least)))
    small = small.select("cell", *[F.col(c).alias(f"s_{c}") for c in ("node", "component", "size", "before")])
    bound = least / (1 + least) * (F.col("size") + F.col("s_size")) - 1e-6
    first = (F.col("s_size") < F.col("size")) | ((F.col("s_size") == F.col("size")) & (F.col("s_node") < F.col("node")))
    room = F.least(F.col("size") - F.col("before"), F.col("s_size") - F.col("s_before")) >= bound
    met = rows.join(small, (rows["cell"] == small["cell"]) & (F.col("component") != F.col("s_component")) & first & room)
    return met.select(F.greatest("node", "s_node").alias("node"), F.least("node", "s_node").alias("rep")).distinct()


def links(signed: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (node, rep) between different texts whose components are the classes."""
    texts = materialize(signed.where("bands is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    sketches = texts.select("node", "sketch")
    buckets = texts.select("node", F.explode("bands").alias("bucket"))
    shared = settled(_shared, buckets)
    reps = materialize(_popular(shared))
    pairs = materialize(_star(shared, reps))
    first = settled(_verified, pairs, sketches, docs, least)
    joined = settled(connected_components, first, "node", "rep")

    member = shared.join(joined.select(F.col("vertex").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = materialize(member)
    # texts that share two bands share two mixed buckets, unless they are in one component already
    own = member.join(_mixed(member), "bucket").groupBy("node", "component").agg(F.array_sort(F.collect_list("bucket")).alias("own"))  # BANDS at most
    both = F.flatten(F.transform("own", lambda b, i: F.transform(F.slice("own", i + 2, BANDS), lambda c: F.xxhash64(b, c))))
    parts = materialize(own.select("node", "component", F.explode(both).alias("bucket")))
    drawn = F.min_by(F.struct("node", "component"), F.xxhash64("node", "bucket"))
    spans = parts.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), drawn.alias("rep")).where("lo != hi")
    spans = materialize(spans.select("bucket", F.col("rep.node").alias("rep"), F.col("rep.component").alias("rep_component")))
    more = parts.join(spans, "bucket").where("component != rep_component")
    more = more.select(F.greatest("node", "rep").alias("node"), F.least("node", "rep").alias("rep")).distinct()
    met = pairs.select(F.greatest("node", "rep").alias("node"), F.least("node", "rep").alias("rep"))
    more = materialize(more.join(met, ["node", "rep"], "left_anti"))
    release(joined, member, parts, spans)
    linked = settled(lambda: first.unionByName(_verified(more, sketches, docs, least)))
    release(first)

    joined = connected_components(linked, "node", "rep").select(F.col("vertex").alias("node"), "component")
    apart = settled(_unmet, shared, reps, joined)
    if apart.isEmpty():
        return linked
    sets = materialize(elements(docs, apart.select("node")))
    rest = settled(lambda: _candidates(apart, sets, least).join(met.unionByName(more), ["node", "rep"], "left_anti"))
    return linked.unionByName(_verified(rest, sketches, docs, least, sets))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, class_id, class_doc_id, class_size, representative`` of every document.

    ``class_id``: the least fingerprint of the class's texts, so that classes are told apart even if doc_ids repeat or are
    null. ``class_doc_id``: the least doc_id among documents of equal or linked texts; a null one gives way to others.
    ``representative``: whether the row has that id (and the least fingerprint among texts with it). Null texts count as
    empty, and texts without words are alike only if they are equal. Equal rows get equal results. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    signed = materialize(sign(docs))
    linked = settled(links, signed, docs, least)

    def place() -> DataFrame:
        labels = connected_components(linked, "node", "rep").select(F.col("vertex").alias("node"), "component")
        placed = spread_join(signed.select("doc_id", "node"), labels, "node", "left")
        return placed.select("doc_id", "node", F.coalesce("component", "node").alias("class_id"))

    placed = settled(place)
    release(signed, linked)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("node"))
    heads = materialize(placed.groupBy("class_id").agg(F.min(first).alias("head"), F.count(F.lit(1)).alias("class_size")))
    named = spread_join(placed, heads, "class_id")
    return named.select(
        "doc_id",
        "node",
        "class_id",
        F.col("head.doc_id").alias("class_doc_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("node") == F.col("head.node"))).alias("representative"),
    )


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: its representative, once."""
    found = settled(lambda: classes(docs, least).select("doc_id", "node", "representative"))
    repeated = found.where("representative").groupBy("doc_id", "node").count().where("count > 1")
    own, other, at = (_fresh(docs, n) for n in ("own_node", "other_id", "other_node"))
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    others = found.where("not representative").select(F.col("doc_id").alias(other), F.col("node").alias(at)).distinct()
    others = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    kept = rows.join(others, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(own) == F.col(at)), "left_anti")
    if not repeated.isEmpty():  # rows that repeat id and text
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.drop(own)


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name
