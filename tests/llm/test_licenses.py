"""The licence scan against a plain search, and odd rows."""

import re

from tollbridge.llm import licenses

TEXTS = [
    None, "", "MIT License", "x mit.license y", "the MIT\nLICENSE, mit license", "mit licensed", "license mit", "mité license",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "apache license 2.0",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "licensed under cc by nc 4", "general public licenses", "mit " * 500 + "license", "Released under the MIT License. " * 300,
    "Licensed under the Apache License. Version 2.0", "Released under some MIT license", "ÀMIT license", "a" * 100_000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(text):
    words = words_of(text)
    places = {k: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for k, p in licenses.PHRASES.items()}
    starts = [i for own in places.values() for i in own]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(k for k in places if places[k]))


def own_labels(text):
    """Templates whose mandatory phrases stand at their places and of which all words stand."""
    words, found = words_of(text), set()
    for label, (notice, _) in licenses.TEMPLATES.items():
        own = notice.split()
        if any(words[i : i + len(own)] == own for i in range(len(words))):
            found.add(label)
    return found


def test_scan(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = licenses.scan_licenses(df).orderBy("doc_id").collect()
    for text, row in zip(TEXTS, got):
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == expected(text), text
        labels = set(filter(None, row.labels.split(",")))
        assert labels >= own_labels(text) | set(filter(None, row.base_labels.split(",")))
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(labels)
        assert list(sorted(labels)) == [x for x in row.labels.split(",") if x]
    by_text = dict(zip(TEXTS, got))
    assert by_text["licensed under cc by nc 4"].labels == ""  # a mandatory phrase is incomplete
    assert by_text["Released under some MIT license"].labels == "mit"


def test_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    wide = df.selectExpr("*", "1 AS words", "2 AS of", "3 AS n_words")
    assert licenses.scan_licenses(wide.union(wide)).count() == 2 * len(TEXTS)
    assert licenses.scan_licenses(df.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")).count() == len(TEXTS)


def test_words_added_or_left_out(spark):
    texts = {
        "bsd": "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: x",
        "mit-text": "Permission is hereby granted, free of charge, to any person or body obtaining a copy of this software and associated documentation files (the X)",
        "gpl,gpl-3.0": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of it",
        "": "forms of source and binary are following a general version of any person obtaining the conditions",
    }
    filler = "some other text stands here and says nothing at all " * 20
    rows = [(n, filler + t + ". " + filler) for n, t in enumerate(texts.values())] + [(9, filler)] * 3
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[n] for n in range(4)] == list(texts) and got[9] == ""
