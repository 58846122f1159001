"""Licence scan by a positional index of rare words.

Templates are parts of licence notices, each with the words of mandatory key phrases. The
index has, for each template, its words that are rarest in the corpus, with all their
places in it; words of most documents are left out where rarer ones are enough. Of those a
file holds, the ones of highest IDF are looked up, per template: each place of such a word
proposes starts, its own place less the word's places in the template. Starts that
enough of the words agree on are candidates; there the key phrases must stand where the
template has them. A file that holds only a later part of a notice is found by the
template of that part, and one that lacks a template's rarest words by the next ones.

Document counts of the template words come from the whole corpus. Texts are never
shuffled: what is collected has a row for each template word. Templates are a small table,
at most ``MOST_WORDS`` words in all.

Built-in functions only. Defined results: null text is empty and has no words, labels ''
and score 0; places of a notice that occurs several times count each; repeated rows give
equal rows; columns other than id and text are ignored; an empty table gives no rows;
templates without words or with a key phrase that they do not hold are refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.functions.columns import quoted
from repaylens.llm.common import table

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a template in the index, words looked up in a file, and how many must agree on a start.
INDEXED, RARE, AGREE = 16, 4, 3
MOST_WORDS = 20_000

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A notice; words of ``phrases`` must stand at their places in it."""

    label: str
    text: str
    phrases: tuple[str, ...]


# Parts of the notices of common licences, in lower case and without punctuation.
TEMPLATES = (
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3 of the license", ("affero general public license", "either version 3")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law", "on an as is basis")),
    Template("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization", "accompanying documentation covered by this license")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain", "list of conditions")),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce", "list of conditions")),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("copyright holders and contributors as is", "are disclaimed")),
    Template("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc0-1.0", "creative commons cc0 1 0 universal", ("cc0 1 0 universal",)),
    Template("cc0-1.0", "waived all copyright and related or neighboring rights to", ("waived all copyright", "neighboring rights")),
    Template("epl", "are made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("gpl", "under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("gpl", "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("in the hope that it will be useful", "without any warranty")),
    Template("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "either version 2")),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "either version 3")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "with or without fee")),
    Template("isc", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("the author disclaims all warranties",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("lesser general public license", "either version 2 1")),
    Template("lgpl-3.0", "gnu lesser general public license as published by the free software foundation either version 3 of the license", ("lesser general public license", "either version 3")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("mit", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("merge publish distribute sublicense",)),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice", "substantial portions of the software")),
    Template("mit", "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("without warranty of any kind", "noninfringement")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", ("copy of the mpl was not distributed",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish", "commercial or non commercial")),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable", "arising from the use of this software")),
)


def read_templates(table: DataFrame) -> tuple[Template, ...]:
    """Templates from a table of ``label, text, phrases``, texts and phrases as in documents."""
    plain = lambda c: F.array_join(F.filter(words_of(c), lambda w: w != ""), " ")
    rows = table.select("label", plain(F.col("text")).alias("text"), F.transform("phrases", plain).alias("phrases"))
    size = rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    if size > MOST_WORDS:
        raise ValueError(f"{size} words in templates, more than {MOST_WORDS}")
    return tuple(
        Template(r["label"], r["text"], tuple(r["phrases"] or ())) for r in rows.orderBy("label", "text").collect()
    )


def words_of(text: Column) -> Column:
    """The pieces between separators; the first and last are empty where a text starts or ends with one."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lower, SEPARATOR, -1)


def places_of(words: Column, wanted: list[str]) -> Column:
    """Places in ``words`` that hold a wanted word."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: words[i].isin(wanted))


def document_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the vocabulary."""
    rows = docs.select(words_of(F.col(text)).alias("w")).select(
        F.array_append(
            F.array_distinct(F.filter("w", lambda x: x.isin(vocabulary))), F.lit("")
        ).alias("held")
    )
    counts = rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}  # a row for each template word
    return found.pop("", 0), found


@dataclass(frozen=True)
class Posting:
    """A word of a template, its places there and its IDF."""

    word: str
    places: tuple[int, ...]
    idf: float


def build_index(
    templates: tuple[Template, ...], total: int, counts: dict[str, int], indexed: int = INDEXED
) -> list[list[Posting]]:
    """Postings of each template, the words of highest IDF first."""
    out = []
    for t in templates:
        words = t.text.split()
        if not words:
            raise ValueError(f"a template of {t.label} has no words")
        idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in words}
        chosen = sorted(idf, key=lambda w: (-idf[w], w))[:indexed]
        # words of every second document or more say nothing where there are rarer ones
        rarer = [w for w in chosen if 2 * counts.get(w, 0) <= total]
        chosen = rarer if len(rarer) >= RARE else chosen[: max(RARE, len(rarer))]
        out.append([Posting(w, tuple(i for i, x in enumerate(words) if x == w), idf[w]) for w in chosen])
    return out


def _stand_at(words: Column, start: Column, phrase: str, offset: int) -> Column:
    """Whether the phrase's words stand from ``start + offset`` on."""
    out = F.lit(True)
    for j, w in enumerate(phrase.split()):
        at = start + (offset + j)
        out = out & F.coalesce(F.get(words, at) == w, F.lit(False))
    return out


def _offset(template: Template, phrase: str) -> int:
    words, part = template.text.split(), phrase.split()
    for i in range(len(words)):
        if words[i : i + len(part)] == part:
            return i
    raise ValueError(f"a template of {template.label} does not hold its key phrase {phrase!r}")


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    agree: int = AGREE,
    templates: DataFrame | None = None,
) -> DataFrame:
    """One row per document: word count, base places and labels, the method's spans and labels, score.

    ``spans`` lists the notices found as (label, start, words, weight), starts counted in words.
    ``templates`` is a small table of label, text and phrases; TEMPLATES without one.
    """
    known = TEMPLATES if templates is None else read_templates(templates)
    vocabulary = sorted({w for t in known for w in t.text.split()})
    index = build_index(known, *document_counts(docs, vocabulary, text))
    wanted = sorted({p.word for own in index for p in own} | {b.split()[0] for b in BASE})
    split = docs.select(F.col(id).alias("doc_id"), words_of(F.col(text)).alias("w"))
    placed = split.select(
        "doc_id", "w", places_of(F.col("w"), wanted).alias("at"), (F.col("w")[0] == "").cast("int").alias("lead")
    ).withColumn("held", F.array_distinct(F.transform("at", lambda i: F.col("w")[i])))
    w, at = F.col("w"), F.col("at")
    base = [_base_places(w, at, phrase) for phrase in BASE]
    spans = [_spans(template, own, agree) for template, own in zip(known, index)]
    found = placed.select(
        "doc_id", "lead", F.concat(*base).alias("base"), F.concat(*spans).alias("spans"),
        (F.size("w") - F.col("lead") - ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")).cast("long").alias("n_words"),
    )
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    moved = F.transform(
        "spans",
        lambda s: F.struct(s["label"].alias("label"), (s["start"] - F.col("lead")).alias("start"), s["words"].alias("words"), s["weight"].alias("weight")),
    )
    return found.select(
        F.col("doc_id").alias(id),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        (F.array_min(F.transform("base", lambda b: b["start"])) - F.col("lead")).cast("long").alias("first_word"),
        (F.array_max(F.transform("base", lambda b: b["start"])) - F.col("lead")).cast("long").alias("last_word"),
        joined(F.transform("base", lambda b: b["label"])).alias("base_labels"),
        joined(F.concat(F.transform("base", lambda b: b["label"]), F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["weight"])), F.lit(0.0)).alias("score"),
        moved.alias("spans"),
    )


def _base_places(w: Column, at: Column, phrase: str) -> Column:
    """Places of a base phrase as (label, start, stop)."""
    size = len(phrase.split())
    return F.transform(
        F.filter(at, lambda i: _stand_at(w, i, phrase, 0)),
        lambda i: F.struct(F.lit(BASE[phrase]).alias("label"), i.alias("start"), (i + size - 1).alias("stop")),
    )


def _spans(template: Template, postings: list[Posting], agree: int) -> Column:
    """Places of one template: starts that enough of the file's rarest words agree on and whose key phrases stand.

    Over the columns ``w`` (words), ``at`` (places of index words) and ``held`` (these words); as
    SQL text, of which Spark builds dozens of such expressions at once.
    """
    entries = ", ".join(
        f"named_struct('word', '{p.word}', 'places', array({', '.join(map(str, p.places))}), 'idf', {p.idf!r}D)" for p in postings
    )
    # postings come by falling IDF, so these are the file's highest
    looked_up = f"slice(filter(array({entries}), p -> array_contains(held, p.word)), 1, {RARE})"
    total = sum(p.idf for p in postings[:RARE])
    agreeing = "filter(rare, p -> exists(p.places, q -> get(w, s + q) <=> p.word))"
    starts = (
        "array_distinct(flatten(transform(rare, p -> flatten(transform(filter(at, i -> get(w, i) = p.word),"
        " i -> transform(p.places, q -> i - q))))))"
    )
    phrases = [(_offset(template, p), p.split()) for p in template.phrases]
    standing = [f"get(w, s + {at + j}) <=> '{word}'" for at, words in phrases for j, word in enumerate(words)]
    tests = " AND ".join([f"size({agreeing}) >= least({agree}, size(rare))", *standing])
    found = (
        f"transform(array({looked_up}), rare -> transform(filter({starts}, s -> {tests}), s -> named_struct("
        f"'label', {quoted(template.label)}, 'start', s, 'words', {len(template.text.split())}, "
        f"'weight', least(1D, aggregate({agreeing}, 0D, (a, p) -> a + p.idf) / {total!r}D))))"
    )
    # the index words of the key phrases are in the file, or nothing needs to be looked up
    indexed = {p.word for p in postings}
    needed = sorted({word for _, words in phrases for word in words if word in indexed})
    possible = " AND ".join([f"array_contains(held, '{word}')" for word in needed] or ["true"])
    return F.expr(f"CASE WHEN {possible} THEN flatten({found}) ELSE array() END")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
