"""License scans by diagonal voting.

Word k-grams of a text and of license templates meet in a Spark join on their hashes; a hit says at which template
position the text has those words. Hits with one difference between text and template position lie on a diagonal; their
number votes for it. Diagonals that follow each other closely, as around an inserted or missing word, are merged to a
band; bands with too few votes are left out, and a band is a span if exact comparison of its words covers enough of the
template. Bands are made twice, of all diagonals and of those that have enough votes by themselves, so that
neither a part with a single hit nor a chance hit between two parts is in the way.

Scale: texts are read once. A text none of whose hashes is a template's cannot hit (the lossless semi-join part of the
join) and goes no further than its row of counts; only the words of the others are written, once per distinct text,
and exploded. Templates are a fixed list, so the join's build side is bounded. Copies share one key, and
votes are made per distinct text, so a group of copies is one row until the last join, which deals such keys over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapgraph.functions.expressions import let
from lapgraph.llm.texts import spread_join
from lapgraph.storage import materialize

#: Fixed value: what a word is, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose places are always reported.
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

#: Public notices, as (label, text).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "All rights reserved"),
)


@dataclass(frozen=True)
class Voting:
    """k: words of a gram. gap: words by which a merged diagonal may be shifted or spaced. coverage: least part of the
    template's words that a span must hold. votes: least hits of a band of a template of ``long`` words or more."""

    k: int = 3
    gap: int = 3
    coverage: float = 0.75
    votes: int = 2
    long: int = 12


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, by start."""
    one = lambda i: F.xxhash64(*[F.get(words, (i + j).cast("int")) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), one)).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, label, words`` of the templates; a template's number is its place in the list."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)])
    return spark.range(1).select(F.inline(rows)).select("template", "label", words_of(F.col("text")).alias("words"))


def _places(words: Column) -> Column:
    """Every place of a phrase as (start, label); looked for only where the joined words hold it."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    none = F.array().cast("array<struct<start:int,label:string>>")

    def of(label: str, phrase: tuple[str, ...]) -> Column:
        def here(i: Column) -> Column:
            found = F.lit(True)
            for j, w in enumerate(phrase):
                found = found & (F.get(words, i + j) == F.lit(w))
            return found

        starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), here)
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    return let(line, lambda s: F.concat(*[F.when(F.contains(s, F.lit(f" {' '.join(p)} ")), of(k, p)).otherwise(none) for k, p in PHRASES.items()]))


def scan(docs: DataFrame, templates=TEMPLATES, voting: Voting = Voting()) -> DataFrame:
    """``doc_id, n_words, places, spans`` of each document; other columns are ignored.

    ``places``: every place of a base phrase as (start, label). ``spans``: verified spans as (label, start, end,
    coverage), words from 0, end exclusive; of templates with one label that agree on a start only the best stays. A null
    text counts as empty. Equal texts get equal results.
    """
    spark, k = docs.sparkSession, voting.k
    known = materialize(template_table(spark, templates))
    positions = known.select("template", F.posexplode(grams(F.col("words"), k)).alias("tpos", "h"))
    hashes = F.array(*[F.lit(r[0]) for r in positions.select("h").distinct().collect()])  # of the fixed list of templates

    def judged(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"), _places(w).alias("places"), F.when(F.arrays_overlap(grams(w, k), hashes), w).alias("words")
        )

    rows = docs.select("doc_id", "text").withColumn("s", let(words_of(F.col("text")), judged))
    rows = rows.select("doc_id", F.when(F.col("s.words").isNotNull(), F.md5(F.col("text").cast("binary"))).alias("key"), "s.n_words", "s.places", "s.words")
    rows = materialize(rows)
    texts = materialize(rows.where("key is not null").groupBy("key").agg(F.first("words").alias("words")))

    hits = texts.select("key", F.posexplode(grams(F.col("words"), k)).alias("pos", "h")).join(F.broadcast(positions), "h")
    diagonals = hits.groupBy("key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("tpos").alias("t_lo"), F.collect_list("tpos").alias("tpos")
    )  # a diagonal has as many hits as its template has words, at most
    sizes = known.select("template", "label", F.col("words").alias("template_words"))
    diagonals = materialize(diagonals.join(F.broadcast(sizes), "template"))
    enough = (F.col("votes") >= voting.votes) | (F.size("template_words") < voting.long)
    along = Window.partitionBy("key", "template").orderBy("lo", "diagonal")
    before = lambda c: F.lag(c).over(along)
    follows = (
        (F.abs(F.col("diagonal") - before("diagonal")) <= voting.gap) & (F.col("lo") <= before("hi") + k + voting.gap) & (F.col("t_lo") > before("t_lo"))
    )

    def merged(diagonals: DataFrame) -> DataFrame:
        bands = diagonals.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("band", F.sum("new").over(along))
        bands = bands.groupBy("key", "template", "label", "template_words", "band")
        return bands.agg(F.sum("votes").alias("votes"), F.collect_list(F.struct("diagonal", "tpos")).alias("parts")).where(enough)

    bands = merged(diagonals).unionByName(merged(diagonals.where(enough)))

    equal = lambda d, t: F.forall(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get(F.col("words"), d + t + j) == F.get(F.col("template_words"), t + j))
    exact = F.flatten(F.transform("parts", lambda p: F.transform(F.filter(p["tpos"], lambda t: equal(p["diagonal"], t)), lambda t: F.struct(t.alias("t"), (p["diagonal"] + t).alias("pos")))))
    checked = bands.join(texts, "key").withColumn("exact", exact).where(F.size("exact") > 0)
    covered = F.array_distinct(F.flatten(F.transform("exact", lambda x: F.sequence(x["t"], x["t"] + k - 1))))
    checked = checked.select(
        "key",
        "label",
        F.array_min(F.transform("exact", lambda x: x["pos"])).alias("start"),
        (F.array_max(F.transform("exact", lambda x: x["pos"])) + k).alias("end"),
        (F.size(covered) / F.size("template_words")).alias("coverage"),
    ).where(F.col("coverage") >= voting.coverage)
    best = checked.groupBy("key", "label", "start").agg(F.max(F.struct("coverage", "end")).alias("x"))
    spans = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("label", "start", "x.end", "x.coverage"))).alias("spans"))

    none = F.array().cast("array<struct<label:string,start:int,end:int,coverage:double>>")
    plain = rows.where("key is null").select("doc_id", "n_words", "places", none.alias("spans"))
    found = spread_join(rows.where("key is not null").select("doc_id", "key", "n_words", "places"), materialize(spans), "key", "left")
    return plain.unionByName(found.select("doc_id", "n_words", "places", F.coalesce("spans", none).alias("spans")))


def report(found: DataFrame) -> DataFrame:
    """Counts, labels and a score from 0 to 1 for the rows of ``scan``.

    The score is the best coverage of a verified span, and at least 0.5 where a base phrase stands.
    """
    starts = F.transform("places", lambda x: x["start"].cast("bigint"))
    base, more = F.transform("places", lambda x: x["label"]), F.transform("spans", lambda x: x["label"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    coverage = F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, more)).alias("labels"),
        F.greatest(coverage, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
        "spans",
    )
