"""Operator 10, license scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is as many consecutive words of one paragraph as the template has, from any word on (fewer where the paragraph ends);
paragraphs are parted by lines without a word, so a notice may run over line ends. A template is found in a block that holds
at least ``threshold`` of the template's different words, all its telling words, which part it from other licences' wording,
and none of those it bars, which are other licences'.

Paragraphs without a telling word of any template are left out at once. Of the others the tokens, which are the templates'
different words, stand in one global order, rarest first by the number of paragraphs that hold them. With an overlap of o
needed, one of a template's k - o + 1 rarest tokens must be among the paragraph's n - o + 1 rarest (prefix filter); the
paragraph must have o tokens (length filter); and what follows the shared token in both must suffice (positional filter).
The templates' prefixes are a fixed table of some hundreds of rows, whose size is checked before it is broadcast. Of the
pairs that are left every block is verified, so nothing that meets the threshold is lost.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased. Base labels stand for
phrases whose words follow each other. Null text is empty (no words, score 0). Null ids and repeated rows keep a row each,
an empty table gives an empty table, other columns are ignored. ``score``: 1 with a base label, else the best containment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, id_text

THRESHOLD, MAX_PREFIX_ROWS = 0.8, 10_000
#: Base phrases and their labels (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Wording of public licences and of notices that name them (fixed values): label, words, telling words, barred words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache 2", ""),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache 2", ""),
    ("apache", "released under the apache license", "released apache", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary", ""),
    ("bsd", "released under the bsd license", "bsd", ""),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse promote", ""),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost", ""),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution", "noncommercial sharealike noderivatives"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial", "sharealike noderivatives"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc", "sa nd"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "sharealike", "noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa", "nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "nd", "nc"),
    ("cc0", "the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "dedicated neighboring domain", ""),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general", "lesser affero"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general", "lesser affero"),
    ("gpl", "licensed under the gpl license version 2", "gpl", ""),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser", ""),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee granted", ""),
    ("mit", "released under the mit license", "mit", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted charge", ""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", ""),
    ("public-domain", "this work is dedicated to the public domain", "dedicated domain", "neighboring"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", ""),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "authors arising", ""),
)
#: What parts words.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts paragraphs: line ends with no word between them.
GAP = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"
#: The one character beyond ASCII that lower-cases to a letter of ASCII, and a letter that stays apart (fixed values).
KELVIN, OTHER = "K", "ĸ"


def _places(words: str, phrase: str) -> Column:
    parts = phrase.split()

    def at(i):
        test = F.lit(True)
        for k, part in enumerate(parts):
            test &= F.get(words, i + k) == part
        return test

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), at)).otherwise(F.array().cast("array<int>"))


def vocabulary(templates) -> list[str]:
    return sorted({t for _, text, _, _ in templates for t in text.split()})


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, an array of places for each phrase, paras (the words of each paragraph with a telling word): one pass over the texts."""
    telling = F.array(*(F.lit(t) for t in sorted({t for _, _, tell, _ in templates for t in tell.split()}))).cast("array<string>")
    low = id_text(docs, id_col, text_col).select("doc_id", F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit(KELVIN), F.lit(OTHER))).alias("low"))
    parted = low.select("doc_id", "low", F.transform(F.split("low", GAP), lambda para: F.array_remove(F.split(para, PARTS), "")).alias("paras"))
    some = "|".join(PARTS.join(p.split()) for p, _ in phrases)
    words = F.when(F.col("low").rlike(some), F.flatten("paras")).otherwise(F.array().cast("array<string>"))
    n = F.aggregate("paras", F.lit(0).cast("long"), lambda a, para: a + F.size(para))
    counted = parted.select(F.monotonically_increasing_id().alias("row"), "doc_id", n.alias("n_words"), words.alias("words"), F.filter("paras", lambda para: F.arrays_overlap(para, telling)).alias("paras"))
    return counted.select("row", "doc_id", "n_words", *(_places("words", p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)), "paras")


def find_templates(paras: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, words) to (row, label, containment): of each paragraph and template, the best of the blocks that meet what the template asks."""
    spark, tokens = paras.sparkSession, vocabulary(templates)
    held = paras.select("row", "words", F.array_intersect("words", F.array(*(F.lit(t) for t in tokens)).cast("array<string>")).alias("tokens"))
    seen = {r["t"]: r["n"] for r in held.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row for each token
    order = {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (seen.get(t, 0), t)))}
    prefix = []
    for number, (label, text, tell, bar) in enumerate(templates):
        different = set(text.split())
        ranks = sorted(order[t] for t in different)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        prefix += [(rank, place, number, label, len(text.split()), len(ranks), need, ranks, sorted(different), tell.split(), bar.split()) for place, rank in enumerate(ranks[: len(ranks) - need + 1])]
    if len(prefix) > MAX_PREFIX_ROWS:
        raise ValueError("too many templates to broadcast their prefixes")
    index = spark.createDataFrame(prefix, "rank int, t_place int, template int, label string, reach int, k int, need int, t_ranks array<int>, t_tokens array<string>, tell array<string>, bar array<string>")
    rank_of = F.create_map(*(x for t, i in order.items() for x in (F.lit(t), F.lit(i))))
    least = min((p[6] for p in prefix), default=1)
    ranked = held.filter(F.size("tokens") >= least).select(F.monotonically_increasing_id().alias("para"), "row", "words", F.array_sort(F.transform("tokens", lambda t: F.element_at(rank_of, t))).alias("ranks"))
    n = F.size("ranks")
    pairs = ranked.select("*", F.posexplode("ranks").alias("place", "rank")).join(F.broadcast(index), "rank").filter(
        (n >= F.col("need")) & (F.col("place") <= n - F.col("need")) & (1 + F.least(n - F.col("place") - 1, F.col("k") - F.col("t_place") - 1) >= F.col("need"))
    )
    # A pair with several shared prefix tokens is verified once, at the rarest of them.
    first = F.array_min(F.array_intersect("ranks", "t_ranks")) == F.col("rank")
    able = pairs.filter(first & (F.size(F.array_intersect("ranks", "t_ranks")) >= F.col("need")) & (F.size(F.array_except("tell", "words")) == 0))
    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(F.col("t_tokens"), F.get("words", i)))

    def overlap(at, j):
        """Of the block that begins at a template's word, which any block can be moved up to without losing one."""
        block = F.slice("words", at + 1, F.col("reach"))
        common = F.array_intersect(block, F.col("t_tokens"))
        asks = (F.size(F.array_except("tell", common)) == 0) & ~F.arrays_overlap(block, F.col("bar"))
        return F.when(asks, F.size(common)).otherwise(0)

    met = able.withColumn("overlap", F.array_max(F.transform(hits, overlap))).filter(F.col("overlap") >= F.col("need"))
    return met.select("row", "label", (F.col("overlap") / F.col("k")).alias("containment"))


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scanned = durable(scan(docs, phrases, templates, id_col, text_col), "scanned")
    paras = scanned.select("row", F.explode("paras").alias("words"))
    found = find_templates(paras, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    places = F.flatten(F.array(*(f"p{i}" for i in range(len(phrases)))))
    base = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())))
    joined = scanned.drop("paras").join(found, "row", "left").withColumn("places", places).withColumn("base", base)
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
