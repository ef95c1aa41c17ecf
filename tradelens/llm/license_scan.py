"""License scan by diagonal voting.

Rolling hashes of word pairs meet the positions where a template has the same pair. A match votes for its
diagonal (position in the text minus position in the template); neighbouring diagonals, which a word put in or left
out moves by one or two, are merged. A span is verified by its longest chain of matches that goes forward in text and template,
one match for each position of the template and at most ``merge`` diagonals a step; it counts when the chain holds enough pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.llm.common import WORD_RUN

GRAM = 2


@dataclass(frozen=True)
class Template:
    """``exact`` templates are phrases: every pair must vote on one diagonal."""

    label: str
    words: str
    exact: bool = False


#: The phrases of the contract, and openings of well-known public licenses in lower-cased words.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
LICENSES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced"),
    Template("proprietary", "all rights reserved", True),
)
MERGE, COVER = 2, 0.8


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased. ``lower`` also folds two capital letters of other scripts into ASCII ones, so those two are set aside first."""
    aside = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")), F.lit("\u0130"), F.lit("\u00e5"))
    return F.lower(aside)


def _pair(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def template_positions(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """gram, template, tpos, a, b: one row per word pair of a template, and template -1 for the mark that every document carries."""
    rows = [(i, p, w[p], w[p + 1]) for i, t in enumerate(templates) for w in [t.words.split()] for p in range(len(w) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "template int, tpos int, a string, b string").select(_pair(F.xxhash64("a"), F.xxhash64("b")).alias("gram"), "template", "tpos", "a", "b")
    no_word = F.lit(None).cast("string")
    return grams.unionByName(spark.range(1).select(_mark().alias("gram"), F.lit(-1).alias("template"), F.lit(0).alias("tpos"), no_word.alias("a"), no_word.alias("b")))


def _mark() -> Column:
    """A hash that no pair of words has, but for a collision, as it hashes three values."""
    return F.xxhash64(F.lit("document"), F.lit("mark"), F.lit("row"))


def votes(docs: DataFrame, templates: Sequence[Template], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, template, diagonal, votes, places. Template -1 counts the rows of the document itself.

    Bit t of ``places`` is set if the pair at position t of the template voted, so its match starts at word diagonal + t. Every pair of every whole text is joined. The templates are constants, so their side is bounded and may be broadcast.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), lowered(F.col(text)).alias("t"))
    # an exploded array of one is a column of its own: words and hashes are computed once, not wherever they are used
    rows = rows.select("doc_id", "text_hash", F.explode(F.array(F.regexp_extract_all("t", F.lit(WORD_RUN), F.lit(0)))).alias("words"))
    rows = rows.select("*", F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("hashes"))
    follow = F.slice("hashes", F.lit(2), F.greatest(F.size("hashes"), F.lit(1)))
    rows = rows.select("doc_id", "text_hash", "words", F.size("words").alias("n_words"),
                       F.concat(F.array(_mark()), F.zip_with("hashes", follow, _pair)).alias("grams"))
    grams = rows.select("doc_id", "text_hash", "n_words", "words", F.posexplode("grams").alias("at", "gram"))
    met = grams.join(F.broadcast(template_positions(docs.sparkSession, templates)), "gram")
    # at 0 is the document's mark, so the pair that starts at word p stands at p + 1
    place = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("at") - 1)
    phrase = F.element_at(F.array(*[F.lit(t.words if t.exact else None).cast("string") for t in templates]), F.greatest(F.col("template") + 1, F.lit(1)))
    met = met.withColumns({"diagonal": place - F.col("tpos"), "phrase": F.when(F.col("template") >= 0, phrase)})
    held = F.array_join(F.slice("words", F.greatest(F.col("diagonal") + 1, F.lit(1)), F.size(F.split("phrase", " "))), " ")
    same = (F.get("words", place) == F.col("a")) & (F.get("words", place + 1) == F.col("b"))
    verified = (F.col("template") < 0) | F.when(F.col("phrase").isNull(), same).otherwise((F.col("diagonal") >= 0) & (held == F.col("phrase")))
    return met.filter(verified).groupBy("doc_id", "text_hash", "n_words", "template", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("tpos"))).alias("places"))


def longest_chain(diagonals: Column, pairs: Column, merge: int) -> Column:
    """Struct (n, back) of the longest chain of a span's matches: its length and minus the diagonal it starts on.

    ``diagonals`` holds structs (diagonal, places). A chain goes forward in text and template and moves by at most ``merge`` diagonals from one
    match to the next, so it has a position of the template once and spans few words more than the template. Chains that ended too far back are let go.
    """
    places = F.sequence(F.lit(0), pairs - 1)
    matches = F.array_sort(F.flatten(F.transform(diagonals, lambda d: F.transform(
        F.filter(places, lambda t: F.getbit(d["places"], t) == 1), lambda t: F.struct((d["diagonal"] + t).alias("p"), t.alias("t"))))))

    def grown(ends: Column, m: Column) -> Column:
        before = F.filter(ends, lambda e: (e["p"] < m["p"]) & (e["t"] < m["t"]) & (F.abs(m["p"] - m["t"] - e["p"] + e["t"]) <= merge))
        best = F.array_max(F.transform(before, lambda e: F.struct(e["n"].alias("n"), e["back"].alias("back"))))
        return F.struct(m["p"].alias("p"), m["t"].alias("t"), (F.coalesce(best["n"], F.lit(0)) + 1).alias("n"), F.coalesce(best["back"], m["t"] - m["p"]).alias("back"))

    def step(state: Column, m: Column) -> Column:
        ends = F.concat(F.filter(state["ends"], lambda e: e["p"] >= m["p"] - pairs - merge), F.array(grown(state["ends"], m)))
        top = F.array_max(F.transform(ends, lambda e: F.struct(e["n"].alias("n"), e["back"].alias("back"))))
        return F.struct(ends.alias("ends"), F.greatest(state["top"], top).alias("top"))

    start = F.from_json(F.lit('{"ends": [], "top": {"n": 0, "back": 0}}'), "ends array<struct<p: int, t: int, n: int, back: int>>, top struct<n: int, back: int>")
    return F.aggregate(matches, start, step, lambda state: state["top"])


def scan(docs: DataFrame, phrases: Sequence[Template] = PHRASES, licenses: Sequence[Template] = LICENSES, doc_id: str = "doc_id", text: str = "text",
         merge: int = MERGE, cover: float = COVER) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists (label, first word, share of the template's pairs in the span's longest chain). The score is the largest share, 0 without
    a span. A null or empty text has no words and no span. Rows that repeat with the same id and text are counted once and
    given back as often as they came. An empty table gives no rows.
    """
    templates = [*phrases, *licenses]
    if any(len(t.words.split()) - GRAM + 1 > 64 for t in templates):
        raise ValueError("a template has at most 64 pairs, one for each bit")
    of_template = lambda given: F.element_at(F.array(*[F.lit(x) for x in given]), F.greatest(F.col("template") + 1, F.lit(1)))
    pairs, label = of_template([len(t.words.split()) - GRAM + 1 for t in templates]), of_template([t.label for t in templates])
    doc = ["doc_id", "text_hash", "n_words"]
    by_doc = Window.partitionBy(*doc).orderBy("template", "diagonal")
    found = votes(docs, templates, doc_id, text)
    found = found.withColumn("copies", F.first("votes").over(by_doc))  # the mark sorts first
    reach = of_template([0 if t.exact else merge for t in templates])
    fresh = ~(F.lag("template").over(by_doc).eqNullSafe(F.col("template")) & (F.col("diagonal") - F.lag("diagonal").over(by_doc) <= reach))
    found = found.withColumn("fresh", fresh.cast("int"))
    found = found.withColumn("span", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = found.groupBy(*doc, "template", "span").agg(
        F.max("copies").alias("copies"), F.bit_or("places").alias("places"), F.collect_list(F.struct("diagonal", "places")).alias("diagonals"))
    needed = of_template([1.0 if t.exact else cover for t in templates])
    enough = (F.col("template") >= 0) & (F.bit_count("places") / pairs >= needed)  # else no chain can be long enough
    spans = spans.withColumn("chain", F.when(enough, longest_chain(F.col("diagonals"), pairs, merge)))
    spans = spans.withColumns({"share": F.coalesce(F.col("chain.n") / pairs, F.lit(0.0)), "start": -F.col("chain.back"), "label": label}).withColumn("good", (F.col("template") >= 0) & (F.col("share") >= needed))
    base = F.col("good") & (F.col("template") < len(phrases))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy(*doc).agg(
        F.max("copies").alias("copies"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("good"), F.col("label"))).alias("labels"), F.coalesce(F.max(F.when(F.col("good"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("label", "start", "share")))).alias("spans"))
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return out.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
