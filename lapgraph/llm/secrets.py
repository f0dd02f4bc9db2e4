"""Secret scans: fixed patterns, and Character Markov models of random strings against ordinary identifiers.

Everything on the way of a text is a built-in expression: spans are found by ``split`` and ``regexp_extract_all`` with
one pattern, whose pieces and matches give the places by running sums. The model is two first-order Markov chains
over characters, trained from labelled samples by counting pairs; a long token is a secret where its log-likelihood
ratio exceeds a threshold. The table of ratios has under 5,000 entries at any size of corpus.

Nothing is shuffled: each row is judged alone, so copies, hot sources and long texts cost what their bytes cost.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapgraph.functions.expressions import let, prefix_sums

#: The patterns and least lengths of the base kinds, in the order in which spans of one start are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
#: The pattern without its failing matches, which says quickly that a text has none. It need not be exact.
GUARDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Tokens that the model judges.
LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Ordinary words of program text, from which labelled identifiers are composed.
WORDS = """account action address array average batch binary block buffer cache channel client column commit config content
context count current cursor data date default delete device directory document element engine error event example export
field file filter format function group handler header index input instance integer item iterator key language last length
level library list local manager master memory message method model module name network next node number object offset
operator option order output package page parent parser partition path pattern platform pointer policy position prefix
process profile project property protocol provider query queue random range reader record reference region register
request resource response result return route sample schedule schema scope search section select sequence server service
session shared signal size source stage state status storage stream string structure suffix system table target template
thread time token transform type update user value variable vector version view window worker write""".split()


@dataclass(frozen=True)
class MarkovModel:
    """``ratios[prev * (len(ALPHABET) + 1) + cur]``: ln of P(cur | prev) under random strings over that under identifiers.

    Positions count from 1 in ALPHABET; prev 0 is the start.
    """

    ratios: tuple[float, ...]
    threshold: float

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.6f}" for x in self.ratios)), ",").cast("array<double>")


def labelled_samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """``label`` (1: random string, 0: identifier) and ``text``, the same on every call; ``n`` rows of each label."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    raw = F.unhex(F.concat(digest("a"), digest("b")))
    b64 = F.base64(raw)
    long = F.regexp_replace(b64, r"[+/=\r\n]", "")
    kinds = [
        F.concat(digest("h"), digest("i")),
        long,
        F.upper(long),
        F.regexp_replace(b64, r"[\r\n]", ""),
        F.regexp_replace(F.regexp_replace(F.translate(b64, "+/", "-_"), r"[=\r\n]", ""), r"[\r\n]", ""),
    ]
    length = 20 + F.pmod(F.xxhash64("id", F.lit("length")), F.lit(29))
    text = F.coalesce(*[F.when(F.col("id") % len(kinds) == i, k) for i, k in enumerate(kinds)])
    random = spark.range(n).select(F.lit(1).alias("label"), F.substring(text, F.lit(1), length.cast("int")).alias("text"))
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(WORDS))) + 1).cast("int"))
    parts = F.slice(F.array(*[pick(i) for i in range(6)]), 1, (3 + F.pmod(F.xxhash64("id", F.lit("parts")), F.lit(4))).cast("int"))
    forms = [
        F.array_join(parts, "_"),
        F.array_join(parts, "-"),
        F.array_join(F.transform(parts, F.initcap), ""),
        F.upper(F.array_join(parts, "_")),
        F.concat(F.array_join(parts, "_"), F.lit("_"), (F.col("id") % 97).cast("string")),
        F.array_join(parts, "/"),
        F.array_join(parts, ""),
    ]
    text = F.coalesce(*[F.when(F.col("id") % len(forms) == i, f) for i, f in enumerate(forms)])
    return random.unionByName(spark.range(n).select(F.lit(0).alias("label"), text.alias("text")))


def train(samples: DataFrame, threshold: float = 10.0, smoothing: float = 0.5) -> MarkovModel:
    """Count character pairs of ``samples`` (label, text) by label; at most 2 * 68 * 68 counts reach the driver.

    Rows with a null label or text are left out, as are characters outside ALPHABET. Without samples all ratios are 0.
    """
    chars = F.filter(F.split(F.regexp_replace("text", r"[^A-Za-z0-9+/_=-]", ""), ""), lambda c: F.length(c) > 0)
    codes = F.transform(chars, lambda c: F.position(c, F.lit(ALPHABET)))
    pairs = let(codes, lambda v: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0)))), v, lambda p, c: F.struct(p.alias("p"), c.alias("c"))))
    found = samples.where("label is not null and text is not null").select("label", F.explode(pairs).alias("x")).where("x.c is not null")
    counts = {(r[0], r[1], r[2]): r[3] for r in found.groupBy("label", "x.p", "x.c").count().collect()}
    width, rows = len(ALPHABET) + 1, Counter()
    for (label, p, _), n in counts.items():
        rows[label, p] += n
    logp = lambda label, p, c: math.log((counts.get((label, p, c), 0) + smoothing) / (rows[label, p] + smoothing * len(ALPHABET)))
    return MarkovModel(tuple(0.0 if c == 0 else logp(1, p, c) - logp(0, p, c) for p in range(width) for c in range(width)), threshold)


def ratio(token: Column, model: MarkovModel) -> Column:
    """The log-likelihood ratio of a token made of ALPHABET's characters."""
    table, width = model.column(), len(ALPHABET) + 1
    chars = F.filter(F.split(token, ""), lambda c: F.length(c) > 0)
    start = F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("s"))

    def step(acc: Column, c: Column) -> Column:
        return let(F.position(c, F.lit(ALPHABET)), lambda k: F.struct(k.alias("p"), (acc["s"] + F.element_at(table, acc["p"] * width + k + 1)).alias("s")))

    return F.aggregate(chars, start, step, lambda acc: acc["s"])


def _found(text: Column, pattern: str, group: int) -> Column:
    """Struct of arrays: pieces between matches, matches, and the group that is measured."""
    return F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, guard: str, keep) -> Column:
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")

    def places(m: Column) -> Column:
        steps = F.transform(m["all"], lambda _, i: F.length(m["pieces"][i]) + F.when(i > 0, F.length(m["all"][F.greatest(i - 1, F.lit(0))])).otherwise(0).cast("long"))
        spans = F.zip_with(
            prefix_sums(steps),
            F.arrays_zip(m["all"].alias("all"), m["value"].alias("value")),
            lambda s, x: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(x["all"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")),
        )
        kept = F.filter(spans, lambda x: keep(x["value"]))
        return F.transform(kept, lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))

    return F.when(text.rlike(guard), let(_found(text, pattern, group), places)).otherwise(none)


def with_spans(df: DataFrame, model: MarkovModel, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """``df`` with an array of (start, rank, end, kind), by start, then kind; code points from 0, end exclusive.

    Base kinds come first; ``markov`` adds tokens that the model calls random and that no base span overlaps. A null
    text counts as empty, and a column named ``into`` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = [_spans(t, k, i, p, g, GUARDS[k], lambda v, n=least: F.length(v) >= n) for i, (k, (p, g, least)) in enumerate(KINDS.items())]
    more = _spans(t, "markov", len(KINDS), TOKEN, 0, TOKEN, lambda v: ratio(v, model) > model.threshold)
    first, second = _fresh(df, "base"), _fresh(df, "more")
    added = F.filter(second, lambda x: ~F.exists(first, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    found = df.withColumn(first, F.concat(*base)).withColumn(second, more)
    found = found.withColumn(into, F.array_sort(F.concat(first, added)))
    return found.drop(first, second)


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def _replaced(text: Column, mark: str, pattern: str, group: int, guard: str, keep) -> Column:
    def put(match: Column, value: Column) -> Column:
        return F.when(keep(value), F.concat(F.substring(match, F.lit(1), F.length(match) - F.length(value)), F.lit(mark))).otherwise(match)

    def joined(m: Column) -> Column:
        return F.array_join(F.zip_with(m["pieces"], F.zip_with(m["all"], m["value"], put), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(text, lambda t: F.when(t.rlike(guard), let(_found(t, pattern, group), joined)).otherwise(t))


def redact(text: Column, model: MarkovModel, mark: str = "[REDACTED]") -> Column:
    """``text`` with the value of every secret replaced by ``mark``; a null text stays null."""
    rules = [(p, g, GUARDS[k], lambda v, n=least: F.length(v) >= n) for k, (p, g, least) in KINDS.items()]
    rules.append((TOKEN, 0, TOKEN, lambda v: ratio(v, model) > model.threshold))
    for rule in rules:
        text = _replaced(text, mark, *rule)
    return text


def scan_documents(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """Counts by base kind, digest of the base spans, and all spans of each document; other columns are ignored."""
    found = with_spans(docs.select("doc_id", "text"), model)
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("secret_spans", lambda x: x["kind"] != "markov"), line), ",")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], count("markov"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("secret_spans", line), ",").alias("spans")
    )
