"""Licence scans by a positional rare-token index, in DataFrame functions only.

The words of all templates are counted over all documents. The rarest words of each template's mandatory
phrases are its postings, (template, position). A text's hits on these words each say where the template would begin;
hits that agree on a beginning, but for some words, make it a candidate, and the candidate counts if all
mandatory phrases of the template stand in the text in their order, each near its place: words may have
been added or left out between them. The index is as large as the templates, whatever the corpus, so that
it goes into the plan as literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tollbridge.llm.base import ascii_lower, let

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label: phrase, of the base rule.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: label: (opening words of the notice, mandatory phrases in it).
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee",),
    ),
    "mit-notice": ("released under the mit license", ("released under the mit license",)),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("hereby granted free of charge", "associated documentation files"),
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2 0",),
    ),
}
#: Postings of a template, and how many must agree on a beginning.
RARE_WORDS = 3
AGREEING = 2
#: Words by which beginnings may differ, and phrases be off their places.
SLACK = 10


def license_words(text: Column) -> Column:
    """The lower-case words of a text; none if it is null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def word_weights(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """The inverse document frequency of each vocabulary word over all rows of ``words`` (words)."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", known))).alias("word"))
    count = dict(found.groupBy("word").count().collect())
    return {w: math.log((count.get("", 0) + 1) / (count.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def rare_postings(weights: dict[str, float], templates: dict) -> dict[str, list[tuple[int, str, float]]]:
    """The rarest words of each template's mandatory phrases, which every match holds, with their positions;
    ties go to the first."""
    postings = {}
    for label, (notice, phrases) in templates.items():
        words = notice.split()
        inside = {at + k for at, phrase in _spots(notice, phrases) for k in range(len(phrase))}
        rarest = sorted(inside, key=lambda i: (-weights[words[i]], i))[:RARE_WORDS]
        postings[label] = [(i, words[i], weights[words[i]]) for i in sorted(rarest)]
    return postings


def _spots(notice: str, phrases: tuple[str, ...]) -> list[tuple[int, list[str]]]:
    """The words before each phrase of a notice, and its own."""
    return [(len(notice[: f" {notice} ".index(f" {p} ")].split()), p.split()) for p in phrases]


def _stands(words: Column, start: Column, phrase: list[str]) -> Column:
    same = F.lit(True)
    for k, word in enumerate(phrase):
        same = same & F.coalesce(F.get(words, start + k) == word, F.lit(False))
    return same


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase begins; texts without its last word aren't walked through."""
    last = len(phrase) - 1
    starts = F.filter(
        F.transform(words, lambda w, i: F.when((w == phrase[last]) & (i >= last), i - last)), lambda i: i.isNotNull()
    )
    some = F.filter(starts, lambda i: _stands(words, i, phrase[:last])) if last else starts
    return F.when(F.array_contains(words, phrase[last]), some).otherwise(F.array().cast("array<int>"))


def _matches(words: Column, postings: dict, templates: dict) -> Column:
    """(label, coverage) of each template found, once for each place."""
    kind = "array<struct<label:string,delta:int,weight:double>>"
    looked_up = sorted({word for rows in postings.values() for _, word, _ in rows})
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(looked_up), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())

    def beginnings(hit: Column) -> Column:
        of = F.array().cast(kind)
        for word in looked_up:
            rows = [
                F.struct(F.lit(label).alias("label"), (hit["i"] - at).cast("int").alias("delta"), F.lit(weight).alias("weight"))
                for label, own in postings.items() for at, own_word, weight in own if own_word == word
            ]
            of = F.when(hit["w"] == word, F.array(*rows)).otherwise(of)
        return of

    def of_sorted(found: Column) -> Column:
        def near(x: Column, y: Column) -> Column:
            return (y["label"] == x["label"]) & (x["delta"] - y["delta"] <= SLACK)

        def mates(x: Column, i: Column) -> Column:
            """Hits before this one with the same template and nearly the same beginning; a template has few."""
            own = F.lit(0)
            for back in range(1, RARE_WORDS):
                own = own + F.when(near(x, F.get(found, i - back)), 1).otherwise(0)
            return own

        def coverage(x: Column, i: Column) -> Column:
            got, whole = x["weight"], F.lit(None).cast("double")
            for back in range(1, RARE_WORDS):
                y = F.get(found, i - back)
                got = got + F.when(near(x, y), y["weight"]).otherwise(0.0)
            for label, own in postings.items():
                whole = F.when(x["label"] == label, sum(weight for *_, weight in own)).otherwise(whole)
            return F.least(got / whole, F.lit(1.0))

        def in_order(start: Column, after: Column, spots: list[tuple[int, list[str]]]) -> Column:
            """Whether the phrases stand one after the other, each within the slack around its place."""
            (spot, phrase), *rest = spots
            near_by = F.transform(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda d: start + spot + d)
            at = F.array_min(F.filter(near_by, lambda i: (i > after) & _stands(words, i, phrase)))
            return let(at, lambda p: p.isNotNull() & in_order(start, p + len(phrase) - 1, rest)) if rest else at.isNotNull()

        def verified(x: Column) -> Column:
            good = F.lit(False)
            for label, (notice, phrases) in templates.items():
                good = F.when(x["label"] == label, in_order(x["delta"], F.lit(-1), _spots(notice, phrases))).otherwise(good)
            return good

        agreeing = F.transform(
            found,
            lambda x, i: F.when(
                mates(x, i) >= AGREEING - 1,
                F.struct(x["label"].alias("label"), x["delta"].alias("delta"), coverage(x, i).alias("coverage")),
            ),
        )
        return F.filter(agreeing, lambda x: F.coalesce(verified(x), F.lit(False)))

    none = F.array().cast("array<struct<label:string,delta:int,coverage:double>>")
    found = let(hits, lambda h: F.when(F.size(h) < AGREEING, none).otherwise(let(F.sort_array(F.flatten(F.transform(h, beginnings))), of_sorted)))
    return F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in looked_up])), found).otherwise(none)


def scan_licenses(docs: DataFrame, templates: dict | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the base rule's places, labels and a score.

    A null or empty text has no words and score 0. The score is 1 where the base rule finds a phrase,
    else the weight of the rare words found of the best template. Repeated rows come out each.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for notice, _ in templates.values() for w in notice.split()})
    words = docs.select("doc_id", license_words(F.col("text")).alias("words"))
    postings = rare_postings(word_weights(words.select("words"), vocabulary), templates)

    def result(own: Column) -> Column:
        places = F.array(*[_places(own, phrase.split()) for phrase in PHRASES.values()])
        return let(places, lambda p: let(_matches(own, postings, templates), lambda m: digest(own, p, m)))

    def digest(own: Column, places: Column, matches: Column) -> Column:
        all_places = F.flatten(places)
        base = F.array(*[F.when(F.size(places[k]) > 0, label) for k, label in enumerate(PHRASES)])
        base = F.sort_array(F.filter(base, lambda x: x.isNotNull()))
        more = F.transform(matches, lambda m: m["label"])
        best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["coverage"])), F.lit(0.0))
        return F.struct(
            F.size(own).cast("bigint").alias("n_words"),
            F.size(all_places).cast("bigint").alias("n_base"),
            F.array_min(all_places).cast("bigint").alias("first_word"),
            F.array_max(all_places).cast("bigint").alias("last_word"),
            F.array_join(base, ",").alias("base_labels"),
            F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"),
            F.when(F.size(base) > 0, 1.0).otherwise(best).alias("score"),
        )

    return words.select("doc_id", let(F.col("words"), result).alias("of")).select("doc_id", "of.*")
