"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a window of ``2 m`` words every ``m`` words, ``m`` being the words of the longest
template, so each notice lies whole within some block. A block meets a template if it holds at
least ``CONTAINMENT`` of the template's distinct tokens.

Tokens are ordered by document frequency over all documents, rarest first. Two sets that share
``need`` tokens share one among the first ``size - need + 1`` of each (prefix filter); a block
needs ``need`` tokens of the vocabulary at all (length filter); and after a shared token enough
tokens must remain on both sides (positional filter). What passes is counted exactly. Tokens
that no template has cannot count, so blocks are cut down to the templates' vocabulary first,
which bounds every array and the broadcast; and documents without any template's prefix token
are set aside before they are cut into blocks.

Base: the places where the words of a phrase stand consecutively.

Defined results: a null text is empty; a text without words has no places, empty labels and
score 0; repeated rows are scanned each for itself; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.common import stored

# Phrases with their labels, and opening words of well-known licenses.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this library is free software under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
)
CONTAINMENT = 0.8

# Whole words: runs of ASCII letters and digits and of everything beyond ASCII, A-Z as a-z.
_PARTS = (
    "split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
# The empty part at either end of a text that starts or ends between words.
_N_WORDS = "size(parts) - IF(parts[0] = '', 1, 0) - IF(size(parts) > 1 AND element_at(parts, -1) = '', 1, 0)"


def _array(values) -> str:
    return f"array({', '.join(repr(v) for v in values)})"


def token_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each token of the vocabulary occurs."""
    found = docs.selectExpr(f"explode(array_intersect({_array(vocabulary)}, {_PARTS})) AS token")
    counts = {r.token: r.n for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: counts.get(t, 0) for t in vocabulary}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    docs = docs.select("doc_id", "text")
    sets = [(label, sorted(set(text.split()))) for text, label in templates]
    vocabulary = sorted({t for _, tokens in sets for t in tokens} | {t for p, _ in phrases for t in p.split()})
    counts = token_frequencies(docs, vocabulary)
    ranked = sorted(vocabulary, key=lambda t: (counts[t], t))
    place = {t: i for i, t in enumerate(ranked)}
    rows = []
    for i, (label, tokens) in enumerate(sets):
        tokens = sorted(tokens, key=place.__getitem__)
        need = max(1, math.ceil(containment * len(tokens) - 1e-9))
        rows += [(i, label, t, at, need, tokens) for at, t in enumerate(tokens[: len(tokens) - need + 1])]
    prefixes = docs.sparkSession.createDataFrame(
        rows, "template int, label string, token string, at int, need int, tokens array<string>"
    )
    least = min(r[4] for r in rows)
    rare = sorted({r[2] for r in rows} | {min(p.split(), key=place.__getitem__) for p, _ in phrases})

    texts = stored(
        docs.selectExpr("doc_id", "monotonically_increasing_id() AS row", f"{_PARTS} AS parts").selectExpr(
            "doc_id", "row", f"CAST({_N_WORDS} AS BIGINT) AS n_words",
            f"CASE WHEN arrays_overlap(parts, {_array(rare)}) THEN filter(parts, p -> p <> '') END AS words",
        ),
        "license-words",
    )
    near = texts.where("words IS NOT NULL").select("row", "words")

    step = max(len(text.split()) for text, _ in templates)
    blocks = near.selectExpr(
        "row", f"posexplode(transform(sequence(1, size(words), {step}), s -> "
        f"array_intersect({_array(ranked)}, slice(words, s, {2 * step})))) AS (block, held)",
    ).where(f"size(held) >= {least}")
    pairs = (
        blocks.selectExpr("*", f"posexplode(slice(held, 1, size(held) - {least} + 1)) AS (held_at, token)")
        .join(F.broadcast(prefixes), "token")
        .where("size(held) >= need AND size(held) - held_at >= need AND size(tokens) - at >= need")
        .selectExpr("row", "block", "template", "label", "need", "size(tokens) AS size",
                    "size(array_intersect(held, tokens)) AS shared")
        .where("shared >= need")
    )
    met = pairs.groupBy("row").agg(
        F.collect_set("label").alias("met"), F.expr("max(CAST(shared AS DOUBLE) / size)").alias("score")
    )

    places, labels = [], []
    for phrase, label in phrases:
        words = phrase.split()
        same = " AND ".join(f"get(words, i + {k}) = {w!r}" for k, w in enumerate(words))
        starts = f"filter(sequence(0, greatest(size(words) - {len(words)}, 0)), i -> coalesce({same}, false))"
        places.append(starts)
        labels.append(f"IF(size({{}}) > 0, {label!r}, NULL)")
    names = [f"p{i}" for i in range(len(places))]
    base = near.selectExpr("row", *[f"{p} AS {n}" for p, n in zip(places, names)]).selectExpr(
        "row", f"concat({', '.join(names)}) AS places",
        f"filter(array({', '.join(f.format(n) for f, n in zip(labels, names))}), l -> l IS NOT NULL) AS base",
    )
    none = "CAST(array() AS array<string>)"
    return (
        texts.drop("words").join(base.join(met, "row", "left"), "row", "left")
        .selectExpr(
            "doc_id", "n_words", "CAST(coalesce(size(places), 0) AS BIGINT) AS n_base",
            "CAST(array_min(places) AS BIGINT) AS first_word", "CAST(array_max(places) AS BIGINT) AS last_word",
            f"array_join(array_sort(array_distinct(coalesce(base, {none}))), ',') AS base_labels",
            f"array_join(array_sort(array_union(coalesce(base, {none}), coalesce(met, {none}))), ',') AS labels",
            "CASE WHEN size(base) > 0 THEN 1D ELSE coalesce(score, 0D) END AS score",
        )
    )
