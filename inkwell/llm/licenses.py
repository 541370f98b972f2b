"""License scans by diagonal voting: word k-gram hashes of all texts joined to template positions.

A hit of a text's gram at place p on a template's gram at place q votes for the diagonal p - q. Votes are summed per text,
template and diagonal; neighbouring diagonals are merged, so that a few inserted or lost words don't split a match; the spans
are then verified on the words themselves.

Every text is read once: what is written down of it are its number of words and, if a template has one of its grams, those grams
and its words. Votes and verification work on that table, keyed by a row number, so equal rows stay apart.

Words are runs of letters and digits, and of any characters beyond ASCII; A-Z are lower-cased and nothing else is.

Cases: a null text is an empty one (no words); texts shorter than a gram have no hits; repeated rows (same number and text)
get the same result each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, let, table

#: Words in a gram.
K = 3
#: Phrases whose every place counts.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Passages that give a label if most of their grams are found near one diagonal: tell-tale sentences, and whole licences.
PASSAGES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("gpl", "gnu general public license version"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out "
        "of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express "
        "or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of "
        "the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
)
#: Share of a passage's grams that must be found, share of its words that must be in the span, and how far merged diagonals are apart.
VOTES, SHARED, APART = 0.6, 0.7, 3
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    # The Kelvin sign is the one other character whose lower case is in ASCII; it must not become a k.
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ue000")))
    return F.filter(F.split(low, _SEPARATORS, -1), lambda w: w != "")


def grams(words: Column) -> Column:
    """Hashes of all rolling k-grams, in order."""
    return let(
        words,
        lambda ws: F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (K - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, K)])),
    )


def templates(spark: SparkSession, base=BASE, passages=PASSAGES) -> DataFrame:
    """template, label, base, words: a row per phrase or passage, of any length."""
    rows = [(i, label, i < len(base), text.split()) for i, (label, text) in enumerate((*base, *passages))]
    return spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>")


def read_once(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, row, n_words, hits (array of (p, gram)) and words (null without hits) of each row of docs, as a table.

    Grams that no template has are dropped where they stand. The templates' grams are a parameter's, so they are few.
    """
    known = sorted({r[0] for r in templates.select(F.explode(grams(F.col("words")))).collect()})
    rows = docs.select("doc_id", words_of(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    found = F.filter(F.transform(grams(F.col("words")), lambda g, p: F.struct(p.alias("p"), g.alias("gram"))), lambda x: x["gram"].isin(known))
    rows = rows.select("doc_id", "words", found.alias("hits"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), "hits", F.when(F.size("hits") > 0, F.col("words")).alias("words"))
    return cut(rows, "words")


def spans(read: DataFrame, templates: DataFrame) -> DataFrame:
    """row, found: array of (template, start, words, votes) of candidate spans of each text that has some.

    The table of template positions is as small as the templates; it alone is broadcast. On a diagonal every vote is for another
    place in the template, so votes are counted; merged diagonals count places.
    """
    positions = templates.select("template", "base", F.size("words").alias("size"), F.posexplode(grams(F.col("words"))).alias("q", "gram"))
    hits = read.select("row", F.explode("hits").alias("hit")).select("row", "hit.p", "hit.gram").join(F.broadcast(positions), "gram")
    votes = hits.groupBy("row", "template", "base", "size", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_list("q").alias("places"), F.min("p").alias("first"), F.max("p").alias("last"))
    votes = cut(votes, "votes")
    all_grams = F.col("size") - (K - 1)
    exact = votes.where(F.col("base") & (F.size("places") == all_grams)).select("row", "template", F.col("diagonal").alias("start"), F.col("size").alias("words"), F.lit(1.0).alias("votes"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > APART, F.lit(True))
    merged = (
        votes.where(~F.col("base"))
        .withColumn("group", F.sum(apart.cast("int")).over(near))
        .groupBy("row", "template", "size", "group")
        .agg(F.min("first").alias("start"), (F.max("last") + K - F.min("first")).alias("words"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"))
        .withColumn("votes", F.col("n") / (F.col("size") - (K - 1)))
        .where(F.col("votes") >= VOTES)
        .select("row", "template", "start", "words", "votes")
    )
    return exact.unionByName(merged).groupBy("row").agg(F.collect_list(F.struct("template", "start", "words", "votes")).alias("found"))


def scan(docs: DataFrame, base=BASE, passages=PASSAGES) -> DataFrame:
    """doc_id, n_words and verified: array of (label, base, start, words, score) in order of start."""
    known = templates(docs.sparkSession, base, passages)
    read = read_once(docs, known)
    some = F.size("hits") > 0
    texts = read.where(some).join(spans(read, known), "row", "left").select("doc_id", "n_words", "words", "found")
    names = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(i < len(base)).alias("base"), F.array(*map(F.lit, text.split())).alias("words")) for i, (label, text) in enumerate((*base, *passages))])

    def verified(s: Column) -> Column:
        t = F.get(names, s["template"])
        own = F.slice(F.col("words"), s["start"] + 1, s["words"])
        shared = F.size(F.array_intersect(t["words"], own)) / F.size(F.array_distinct(t["words"]))
        ok = F.when(t["base"], own == t["words"]).otherwise(shared >= SHARED)
        score = F.when(t["base"], 1.0).otherwise(F.least(s["votes"], shared))
        return F.struct(ok.alias("ok"), s["start"].cast("long").alias("start"), s["words"].alias("words"), t["label"].alias("label"), t["base"].alias("base"), score.alias("score"))

    checked = F.filter(F.transform(F.coalesce("found", F.array()), verified), lambda x: x["ok"])
    shape = "array<struct<start: bigint, words: int, label: string, base: boolean, score: double>>"
    out = texts.select("doc_id", "n_words", F.sort_array(F.transform(checked, lambda x: F.struct(x["start"], x["words"].cast("int").alias("words"), x["label"], x["base"], x["score"]))).cast(shape).alias("verified"))
    return out.unionByName(read.where(~some).select("doc_id", "n_words", F.array().cast(shape).alias("verified")))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform("base", lambda x: x["start"])
    return (
        scan(table(spark, sf_dir, "documents"))
        .withColumn("base", F.filter("verified", lambda x: x["base"]))
        .select(
            "doc_id",
            "n_words",
            F.size("base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            joined(F.col("base")).alias("base_labels"),
            joined(F.col("verified")).alias("labels"),
            F.coalesce(F.array_max(F.transform("verified", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        )
    )
