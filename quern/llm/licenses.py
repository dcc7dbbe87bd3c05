"""License scan: an exact containment join of text blocks with license templates.

A block is a run of consecutive words of a document, wherever its lines end: as long as the template
and a quarter more. A block's set holds its distinct words; it matches a template when it holds at
least `threshold` of the template's distinct words. Runs that begin with a word of the template stand
for all: another run moved up to its first such word loses none.

The corpus count of every template word gives one global order, rarest first. A template's prefix is
its first |T| - ceil(threshold * |T|) + 1 words: a matching block holds one of them, so runs are tried
around prefix words only (prefix filter); a document or a run that has fewer places of template words
than needed is left out (length and positional filters: the places that follow a start within the run),
and the sets of what remains are intersected. Templates are rows of a table of notices, literals of the
plan here, so the join needs no shuffle; the count of template words is the only exchange.

Templates that a text cannot tell apart by the threshold, because their sets share that much of the
smaller one (the CC notices, say), are rivals: of overlapping blocks the one with the most common words
stays, then the one with the greatest containment. Blocks of other templates never compete.

Besides, base phrases label the places where their words stand consecutively; the method's labels are
added to theirs. score is the greatest containment of a block that stays, 1 for a base phrase, else 0.

Edges: null counts as empty: no words, no labels (empty strings), null first_word and last_word. Each
input row gives one row; ids are not used; rows that repeat an id or text are scanned each. Rivals that
tie in both stay both. A very long text is one row's array; work goes with its words around prefix
words. Columns but the id and the text are not read. Only DataFrame functions run.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import plain_words

#: Phrase and label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and notice, words of letters and digits; several notices may share a label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
)
THRESHOLD = Fraction(4, 5)


def least(size: int, threshold: Fraction = THRESHOLD) -> int:
    return -(-size * threshold.numerator // threshold.denominator)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_order(docs: DataFrame, text_col: str, templates) -> list[str]:
    """Template words, the rarest in the corpus first; equal counts by word."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    known = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string"))
    seen = docs.select(F.explode(plain_words(F.col(text_col))).alias("word")).join(known, "word").groupBy("word").count()
    count = {r["word"]: r["count"] for r in seen.collect()}  # a row for each template word at most
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def rivals(templates, threshold: Fraction = THRESHOLD) -> dict[int, list[int]]:
    """Of each template those of other labels that share threshold of the smaller one's words."""
    sets = [set(t.split()) for _, t in templates]
    return {i: [j for j, b in enumerate(sets) if templates[i][0] != templates[j][0] and len(a & b) * threshold.denominator >= min(len(a), len(b)) * threshold.numerator] for i, a in enumerate(sets)}


_MATCH = "array<struct<start:int,end:int,t:int,label:string,n:int,containment:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates=TEMPLATES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, places, base_labels, matches, labels, score): places are (start, label); matches are (start, end, t, label, n, containment), words start up to end."""
    order = word_order(docs, text_col, templates)
    rank = {w: i for i, w in enumerate(order)}
    ordered = [(label, sorted(set(t.split()), key=rank.__getitem__), len(t.split()) * 5 // 4) for label, t in templates]
    of_prefix = lambda t: t[: len(t) - least(len(t), threshold) + 1]
    prefix = sorted({w for _, t, _ in ordered for w in of_prefix(t)}, key=rank.__getitem__)
    none = F.array().cast(_MATCH)

    def place(words: Column, w: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<start:int,label:string>")
        for phrase, label in base.items():
            p = phrase.split()
            hit = w == p[-1]
            for back, word in enumerate(reversed(p[:-1]), 1):
                hit &= F.get(words, i - back) == word
            out = F.when(hit, F.struct((i - len(p) + 1).cast("int").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    def runs(number: int, words: Column) -> Column:
        """The runs that a template matches."""
        label, t, run = ordered[number]
        need = least(len(t), threshold)
        at = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(of_prefix(t)), i)))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.filter(F.sequence(F.greatest(F.lit(0), p - run + 1), p), lambda s: F.get(words, s).isin(t)))))
        own = F.transform(starts, lambda s: F.struct(s.alias("s"), F.size(F.array_intersect(_strings(t), F.slice(words, s + 1, F.lit(run)))).alias("n")))
        found = F.transform(F.filter(own, lambda x: x["n"] >= need), lambda x: F.struct(x["s"].cast("int").alias("start"), (x["s"] + run).cast("int").alias("end"), F.lit(number).alias("t"), F.lit(label).alias("label"), x["n"].alias("n"), (x["n"] / len(t)).alias("containment")))
        # fewer places of template words than needed: no run can hold them
        return F.when(F.arrays_overlap(words, _strings(of_prefix(t))) & (F.size(F.array_intersect(_strings(t), words)) >= need), found).otherwise(none)

    against = rivals(templates, threshold)
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    last_words = sorted({p.split()[-1] for p in base})
    no_place = F.array().cast("array<struct<start:int,label:string>>")
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("words", _strings(last_words)), F.array_compact(F.transform("words", lambda w, i: place(F.col("words"), w, i)))).otherwise(no_place).alias("places"),
        F.when(F.arrays_overlap("words", _strings(prefix)), F.concat(*(runs(i, F.col("words")) for i in range(len(ordered))))).otherwise(none).alias("every"),
    )

    pairs = [i * len(ordered) + j for i, js in against.items() for j in js]
    better = lambda m, x: (x["n"] > m["n"]) | ((x["n"] == m["n"]) & (x["containment"] > m["containment"]))
    lost = lambda m: F.exists("every", lambda x: (m["t"] * len(ordered) + x["t"]).isin(pairs) & (x["start"] < m["end"]) & (m["start"] < x["end"]) & better(m, x))
    stays = F.filter("every", lambda m: ~(m["t"].isin([i for i, js in against.items() if js]) & lost(m))) if pairs else F.col("every")
    rows = rows.select("doc_id", "n_words", "places", F.when(F.size("every") > 0, stays).otherwise(none).alias("matches"))
    base_labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    return rows.select(
        "doc_id",
        "n_words",
        "places",
        F.array_sort(base_labels).alias("base_labels"),
        "matches",
        F.array_sort(F.array_union(base_labels, F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))).alias("score"),
    )
