"""License scans: exact set-similarity join of text blocks with license templates.

Tokens are ordered by how many documents hold them, rarest first. A block meets a template if it holds ``CONTAINS``
of the template's distinct tokens; then it holds one of the template's first ``size - need + 1`` tokens (prefix
filter), at least ``need`` tokens of templates (length filter), and what follows a shared token in both suffices
(positional filter). Tokens that are in no template can't count and are left out of blocks.

Blocks are runs of words, across lines, as notices are wrapped: some run a template long, with as many other words as
``CONTAINS`` lets miss, must hold the tokens, whether its text has one line or many. The filters take wide runs, that
overlap so far that each such run lies in one of them; what passes is verified in each run of the template's own length.

All of it are DataFrame expressions. One scan counts the documents of each template token, a second one scans; only
rows with a block that may match are exploded, and one narrow shuffle brings a row's blocks together again.

Edge cases: a null text is empty and has no words; an empty table gives an empty result; rows that repeat are scanned
one by one; templates that a block meets alike all count; long texts are scanned whole; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: Share of a template's tokens that a block must hold.
CONTAINS = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices by which licenses are declared, in lower case, and their labels.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def need(size: int) -> int:
    """Shared tokens that meet the threshold, in integers."""
    return -(-size * round(100 * CONTAINS) // 100)


def run_of(size: int) -> int:
    """Words of a run that may hold a template of so many words."""
    return -(-size * 100 // round(100 * CONTAINS))


#: Words by which wide runs advance, half of their length: the longest template's run.
STEP = run_of(max(len(t.split()) for _, t in TEMPLATES))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_tokens() -> list[tuple[str, list[str]]]:
    return [(label, list(dict.fromkeys(t.split()))) for label, t in TEMPLATES]


def token_order(docs: DataFrame) -> list[str]:
    """The templates' tokens, those in the fewest documents first; as many as the templates have, whatever the corpus."""
    vocabulary = sorted({w for _, ws in template_tokens() for w in ws})
    in_doc = F.array_intersect(F.array(*map(F.lit, vocabulary)), tokens(lower_ascii(F.coalesce(F.col("text"), F.lit("")))))
    found = {r["w"]: r["n"] for r in docs.select(F.explode(in_doc).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def places(words: Column, phrase: str) -> Column:
    """Starts of a phrase among the words, from 0. Searched only where the phrase's rarest word occurs."""
    parts = phrase.split()
    whole = F.array(*map(F.lit, parts))
    last = F.size(words) - len(parts)
    return F.when(
        (last >= 0) & F.array_contains(words, max(parts, key=len)),
        F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(words, i) == parts[0]) & (F.slice(words, i + 1, len(parts)) == whole)),
    ).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_words, places (starts of phrases), base_labels, matches (label, share) by template."""
    spark = docs.sparkSession
    order = token_order(docs)
    rank = {w: k for k, w in enumerate(order)}
    templates = [(k, label, sorted(ws, key=rank.get)) for k, (label, ws) in enumerate(template_tokens())]
    runs = [run_of(len(t.split())) for _, t in TEMPLATES]
    prefixes = [(w, k, label, at, len(ws), need(len(ws)), ws, runs[k]) for k, label, ws in templates for at, w in enumerate(ws[: len(ws) - need(len(ws)) + 1])]
    index = spark.createDataFrame(prefixes, "token string, template int, label string, t_at int, t_size int, t_need int, t_tokens array<string>, t_run int")
    fewest = min(p[5] for p in prefixes)
    heads = F.array(*(F.lit(w) for w in sorted({p[0] for p in prefixes}, key=rank.get)))
    ordered = F.array(*map(F.lit, order))

    d = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    d = d.withColumn("lowered", lower_ascii(F.coalesce(F.col("text"), F.lit("")))).drop("text").withColumn("words", tokens(F.col("lowered")))
    d = d.withColumn("places_by", F.array(*(F.struct(F.lit(label).alias("label"), places(F.col("words"), p).alias("at")) for p, label in PHRASES)))
    # A text whose words as a whole fail the filters has no block that passes them.
    may = F.arrays_overlap("words", heads) & (F.size(F.array_intersect(ordered, F.col("words"))) >= fewest)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STEP))
    wide = F.transform(starts, lambda i: F.struct(F.array_intersect(ordered, F.slice("words", i + 1, 2 * STEP)).alias("set"), F.slice("words", i + 1, 2 * STEP).alias("run")))
    block_sets = F.filter(wide, lambda b: (F.size(b["set"]) >= fewest) & F.arrays_overlap(b["set"], heads))
    d = d.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.flatten(F.transform("places_by", lambda x: x["at"])).alias("places"),
        F.transform(F.filter("places_by", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]).alias("base_labels"),
        F.when(may, F.array_distinct(block_sets)).alias("blocks"),
    )
    base = ["row", "doc_id", "n_words", "places", "base_labels"]
    blocks = d.select(*base, F.explode_outer("blocks").alias("b")).select(*base, F.col("b.set").alias("block"), F.col("b.run").alias("run"))
    probes = blocks.select(*base, "block", "run", F.posexplode_outer(F.slice("block", 1, F.greatest(F.size("block") - fewest + 1, F.lit(1)))).alias("b_at", "token"))
    # The index has a row for each prefix token of each template: its size is fixed by the table above.
    pairs = probes.join(F.broadcast(index), "token", "left")
    follow = 1 + F.least(F.col("t_size") - F.col("t_at") - 1, F.size("block") - F.col("b_at") - 1)
    shared = F.size(F.array_intersect("t_tokens", "block"))
    passes = (F.size("block") >= F.col("t_need")) & (follow >= F.col("t_need"))
    at = F.sequence(F.lit(0), F.greatest(F.size("run") - F.col("t_run"), F.lit(0)))
    held = F.array_max(F.transform(at, lambda i: F.size(F.array_intersect("t_tokens", F.slice("run", i + 1, F.col("t_run"))))))
    match = F.when(passes, F.when(shared >= F.col("t_need"), F.when(held >= F.col("t_need"), F.struct("label", (held / F.col("t_size")).alias("share")))))
    out = pairs.withColumn("match", match).groupBy("row").agg(*(F.first(c).alias(c) for c in base[1:]), F.collect_set("match").alias("matches"))
    return out.drop("row")


def joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
