"""License scans (operator 8): an exact containment join of text blocks with license templates.

Blocks are, for each template, all runs of twice its words anywhere in the text, across line breaks, so that wrapped
notices are whole; and lines, of which longer ones are cut into windows that overlap by the longest template. A template
and a block match when the block's word set has `threshold` of the template's or more. The words of all templates have
one global order, by their frequency in all documents, rarest first, and a block is its distinct ones in that order
(others are in no template). With m words in a template and t = ceil(threshold * m) needed, one of its first m - t + 1
must be in a matching block (prefix filter), the block needs t words (length filter), and from the first common word on
both must have t words left (positional filter: only the block's place can reject, the template's is in its prefix).
The filters are applied to the whole text first, of which every block is a part; what passes is verified block by
block, so no match is lost.

Notices are made of the same words, so a match alone doesn't tell licenses apart. A template has deciding words, and a
label is given where a span of a matching block has the words that the threshold asks for, all deciding words of the
template, and not all deciding words of another license's template that has the same ones and more (the GNU Lesser
notice has all that decides for the GNU one, and `lesser`). Templates are few and fixed, so they go to every task; texts are read twice, for the
frequencies and for the join, and no text is shuffled.

Base places are those where the words of a fixed phrase stand consecutively. Defined results: a null or empty text
has no words, empty labels and score 0; repeated rows get equal results; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timespan.llm.common import ALNUM, table, utf8

#: Fixed by contract.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the licenses' own texts ask for, or their first sentences. Fixed values.
TEMPLATES = {
    "afl-3": ("Licensed under the Academic Free License version 3.0",),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "apache-2": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License"),
    "artistic-2": ("This package is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsl-1": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Distributed under the Boost Software License, Version 1.0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "cc-by-nc-nd": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Licensed under CC BY-NC-ND 4.0"),
    "cc-by-nc-sa": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Licensed under CC BY-NC-SA 4.0"),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-ND 4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply", "Licensed under CC BY-SA 4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License",),
    "epl-2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "eupl": ("Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL",),
    "fdl": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Released under the MIT License", "Distributed under the MIT License"),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    "odbl": ("This database is made available under the Open Database License",),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "postgresql": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",),
}
#: The deciding words of each notice. Fixed values.
DECIDING = {
    "afl-3": ("academic",), "agpl": ("gnu affero general public",), "apache-2": ("apache", "apache", "apache"), "artistic-2": ("artistic",), "bsd": ("redistribution binary",),
    "bsl-1": ("person organization accompanying", "boost"), "cc-by": ("attribution", "cc by"), "cc-by-nc": ("attribution noncommercial", "cc by nc"),
    "cc-by-nc-nd": ("attribution noncommercial noderivatives", "cc by nc nd"), "cc-by-nc-sa": ("attribution noncommercial sharealike", "cc by nc sa"),
    "cc-by-nd": ("attribution noderivatives", "cc by nd"), "cc-by-sa": ("attribution sharealike", "attribution sharealike", "cc by sa"), "cc0": ("waived",),
    "cddl": ("common development distribution",), "epl-2": ("eclipse",), "eupl": ("eupl",), "fdl": ("gnu free documentation",), "gpl": ("gnu general public",),
    "isc": ("with or fee",), "lgpl": ("gnu lesser general public",), "mit": ("person associated", "mit", "mit"), "mpl-2": ("mozilla", "mozilla"), "odbl": ("open database",),
    "ofl": ("sil",), "postgresql": ("fee written agreement",), "unlicense": ("unencumbered",), "zlib": ("as warranty damages",),
}
THRESHOLD = 0.8


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """term (its place in terms), n: how often each of the terms stands in all texts."""
    place = {t: k for k, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for cell in batch.column(0):
                total.update(filter(place.__contains__, words_of(cell.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([place[w] for w in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return docs.select(utf8().alias("text")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Join:
    """The prefix index over templates. Words stand for their places in the global order."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], threshold: float, deciding: list[list[bytes]] | None = None):
        vocabulary = sorted({w for _, words in templates for w in words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocabulary)}
        self.labels, self.need, self.words, self.run = [], [], [], []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (label, words) in enumerate(templates):
            ordered = sorted({self.rank[w] for w in words})
            need = math.ceil(threshold * len(ordered) - 1e-9)
            self.labels.append(label)
            self.need.append(need)
            self.words.append(frozenset(ordered))
            self.run.append(2 * len(words))
            for place, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(w, []).append((place, k))
        self.deciding = [frozenset(self.rank[w] for w in words) for words in deciding or [[]] * len(templates)]
        self.rivals = [
            list({d for other, d in zip(self.labels, self.deciding, strict=True) if other != label and own and own < d})
            for label, own in zip(self.labels, self.deciding, strict=True)
        ]

    def ranks(self, words: list[bytes]) -> list[int]:
        """The places of the words, -1 for words that are in no template."""
        get = self.rank.get
        return [get(w, -1) for w in words]

    def candidates(self, block: list[int]) -> list[int]:
        """Templates that pass the filters. block: distinct places, ascending."""
        passed: dict[int, bool] = {}
        for at, w in enumerate(block):
            for place, k in self.prefix.get(w, ()):
                if k not in passed:  # its first common word
                    passed[k] = min(len(block) - at, len(self.words[k]) - place) >= self.need[k]
        return [k for k, ok in passed.items() if ok]

    def match(self, block: set[int]) -> list[tuple[int, float]]:
        """Places and containments of the templates that the block holds."""
        found = []
        for k in self.candidates(sorted(block)):
            both = len(block & self.words[k])
            if both >= self.need[k]:
                found.append((k, both / len(self.words[k])))
        return found

    def share(self, words: list[int], k: int, width: int | None = None) -> float:
        """The largest containment of template k in a span that decides for it, of `width` words at most; 0 if there is none."""
        own, deciding, rivals = self.words[k], self.deciding[k], self.rivals[k]
        watched = own.union(*rivals)
        places = [at for at, w in enumerate(words) if w in watched]
        inside: Counter = Counter()
        most = first = held = 0
        for at in places:
            w = words[at]
            held += w in own and not inside[w]
            inside[w] += 1
            while (width and at - places[first] >= width) or any(all(inside[x] for x in r) for r in rivals):
                w = words[places[first]]
                inside[w] -= 1
                held -= w in own and not inside[w]
                first += 1
            if held > most and held >= self.need[k] and all(inside[x] for x in deciding):
                most = held
        return most / len(own)

    def labelled(self, text: bytes, words: list[bytes], longest: int) -> dict[str, float]:
        """Labels and their largest containments in the blocks of a text."""
        best: dict[str, float] = {}

        def take(k: int, share: float) -> None:
            if share:
                best[self.labels[k]] = max(share, best.get(self.labels[k], 0.0))

        ranks = self.ranks(words)
        all_words = set(ranks) - {-1}
        every = [k for k, _ in self.match(all_words) if self.deciding[k] <= all_words]
        for k in every:
            take(k, self.share(ranks, k, self.run[k]))
        for block in blocks(text, longest) if every else ():
            own = self.ranks(block)
            for k, _ in self.match(set(own) - {-1}):
                take(k, self.share(own, k))
        return best


def base_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of each place of a phrase."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        own = b" " + phrase.encode() + b" "
        last = word = 0
        at = joined.find(own)
        while at >= 0:
            word, last = word + joined.count(b" ", last, at), at
            found.append((word, label))
            at = joined.find(own, at + 1)
    return found


def blocks(text: bytes, longest: int) -> Iterator[list[bytes]]:
    """The words of lines, and of windows of longer lines."""
    for line in text.split(b"\n"):
        words = words_of(line)
        for at in range(0, max(1, len(words) - longest), longest):
            yield words[at : at + 2 * longest]


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    pairs = [(label, words_of(t.encode())) for label, texts in (templates or TEMPLATES).items() for t in texts]
    deciding = [] if templates else [words_of(d.encode()) for label in TEMPLATES for d in DECIDING[label]]
    vocabulary = sorted({w for _, words in pairs for w in words})
    frequency = {vocabulary[r["term"]]: r["n"] for r in term_counts(docs, vocabulary).collect()}  # as long as the templates
    join, longest = Join(pairs, frequency, threshold, deciding), max(len(words_of(t.encode())) for texts in (templates or TEMPLATES).values() for t in texts)
    shared = docs.sparkSession.sparkContext.broadcast(join)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                text = cell.as_py()
                words = words_of(text)
                places = base_places(words, BASE_PHRASES)
                base = sorted({label for _, label in places})
                best: dict[str, float] = dict.fromkeys(base, 1.0)
                for label, share in index.labelled(text, words, longest).items():
                    best[label] = max(share, best.get(label, 0.0))
                starts = [at for at, _ in places]
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(best)), max(best.values(), default=0.0)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, schema)


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
