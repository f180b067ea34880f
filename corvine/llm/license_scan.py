"""Licence scans: TF-IDF cosines of headers and licence paragraphs to templates, then inheritance along paths.

Three kinds of pieces of a text are compared by their weighted words (usual words have no weight) with every template: its lines, its paragraphs (between
blank lines, wrapped lines joined) and the sentences of its paragraphs, so that notices count wherever
they stand, wrapped over lines, in a whole licence file, or beside other sentences.  A piece is compared
only if it holds an anchor word: for each template its heaviest words are anchors until the rest cannot
reach the threshold (by Cauchy-Schwarz a piece without anchors has a cosine below it), so nothing is
lost and nearly all text is passed over by one scan.  A second exact bound, of what a piece's
known words can add up to against the length of its unknown ones, passes over most of the rest.  The best piece of a document that
reaches the threshold names its own licence.

A document whose matched pieces of one kind make up ``FILE_SHARE`` of its words, or whose file name says
so, is a licence file and speaks for its directory.  Documents without a licence of their own take the
one of the nearest ancestor directory that has a licence file: the distinct directories are expanded
to their ancestors and joined by path, and the result meets the documents by one equi-join.

DataFrame operations only; the texts are neither exploded nor shuffled.  Defined results: a null
text or path has no licence and no directory; of equal cosines the licence first by name wins; rows
may repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kept
from .quality_rules import _with, words_of

THRESHOLD, FILE_SHARE = 0.6, 0.2
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice|copyright)(\.[a-z]+)?$"
PARAGRAPH, SENTENCE, CUT = r"\n[ \t\r\n]*\n", r"([.!?])[ \t\r\n]+", "\x1e"
#: Identifiers that headers name after "SPDX-License-Identifier:".
SPDX = (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
#: Usual statements, headers, titles and paragraphs of public licences.
STATEMENTS = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License, the Simplified BSD License."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
TEMPLATES = STATEMENTS + tuple((name, f"SPDX-License-Identifier: {name}") for name in SPDX)
#: Words that carry no weight.
USUAL = frozenset("a all an and any are as at be by can do for from has have if in is it its may no nor not of on or so that the this to under was will with you your".split())


def terms(text: str) -> list[str]:
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()
    return [w for w in words if w not in USUAL]


def template_weights(templates=TEMPLATES) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Inverse document frequencies, and the unit vectors of the templates."""
    bags = [(name, Counter(terms(text))) for name, text in templates]
    seen = Counter(w for _, bag in bags for w in bag)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in sorted(seen.items())}
    idf[""] = math.log(1 + len(bags)) + 1
    out = []
    for name, bag in bags:
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        out.append((name, {w: n * idf[w] / norm for w, n in sorted(bag.items())}))
    return idf, out


def anchors(vectors: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """Words, one of which any piece at the threshold has."""
    found: set[str] = set()
    for _, vector in vectors:
        rest = sum(v * v for w, v in vector.items() if w not in found)
        for word, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold**2 * 0.999:
                break
            if word not in found:
                found.add(word)
                rest -= v * v
    return sorted(found)


def trie_pattern(words: list[str]) -> str:
    """A regular expression for any of the words, with shared beginnings tried once."""
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[:1], []).append(word[1:])
    rest = "|".join(head + trie_pattern(tails) for head, tails in sorted(heads.items()) if head)
    return f"(?:{rest})" + ("?" if "" in heads else "") if rest else ""


def _lookup(values: dict[str, float], word: Column, default: float) -> Column:
    """A word's value; words of equal values share one set."""
    of: dict[float, list[str]] = {}
    for w, v in values.items():
        of.setdefault(v, []).append(w)
    found = F.lit(default)
    for v, words in of.items():
        found = F.when(word.isin(words), v).otherwise(found)
    return found


def best_match(piece: Column, threshold: float) -> Column:
    """``struct(score, license)`` of the best template for a lower-case piece, null below the threshold."""
    idf, vectors = template_weights()
    known = [w for w in idf if w]
    weights = {w: idf[w] for w in known}
    most = {w: max(v.get(w, 0.0) for _, v in vectors) * idf[w] for w in known}

    def norm(ordered: Column) -> Column:
        """Length of the piece's vector: words come sorted, so a run's square grows by ``2 run + 1`` with each."""
        start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

        def add(a: Column, w: Column) -> Column:
            run = F.when(w == a["word"], a["run"]).otherwise(0)
            weight = F.when(w.isin(known), _lookup(weights, w, 0.0)).otherwise(idf[""])
            return F.struct(w.alias("word"), (run + 1).alias("run"), (a["sum"] + weight * weight * (2 * run + 1)).alias("sum"))

        return F.aggregate(ordered, start, add, lambda a: F.sqrt(a["sum"]))

    def dot(words: Column, vector: dict[str, float]) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in vector.items() for x in (k, v * idf[k])])
        return F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))

    def ranked(own: Column, length: Column) -> Column:
        dots = [F.struct((-F.round(dot(own, v) / length, 9)).alias("score"), F.lit(n).alias("license")) for n, v in vectors]
        return _with(F.array_min(F.array(*dots)), lambda m: F.struct((-m["score"]).alias("score"), m["license"].alias("license")))

    def compare(words: Column) -> Column:
        def bounded(own: Column) -> Column:
            """No template's product exceeds ``reach``, and each unknown word adds its square at least to the length's."""
            reach = F.aggregate(own, F.lit(0.0), lambda a, w: a + _lookup(most, w, 0.0))
            least = (F.size(words) - F.size(own)) * (0.999 * threshold * idf[""]) ** 2
            return F.when((F.size(own) > 0) & (reach * reach >= least), _with(norm(F.array_sort(words)), lambda n: ranked(own, n)))

        return _with(F.filter(words, lambda w: w.isin(known)), bounded)

    words = F.filter(F.split(piece, "[^a-z0-9]+"), lambda w: ~w.isin("", *sorted(USUAL)))
    return _with(_with(words, lambda ws: F.when(F.size(ws) > 0, compare(ws))), lambda m: F.when(m["score"] >= threshold, m))


def scan(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """``doc_id, path, own_license, score, license_file, license, inherited_from`` for every row."""
    _, vectors = template_weights()
    anchor = "(?:^|[^a-z0-9])" + trie_pattern(anchors(vectors, threshold)) + "(?:[^a-z0-9]|$)"
    folded = F.translate(F.coalesce(docs[text].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    anchored = lambda pieces: F.filter(pieces, lambda x: x.rlike(anchor))
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[path].cast("string").alias("path"), folded.alias("text"))
    docs = docs.select("doc_id", "path", "text", anchored(F.split("text", PARAGRAPH)).alias("paragraphs"))
    within = lambda cut: anchored(F.flatten(F.transform("paragraphs", cut)))
    sentences = within(lambda p: F.split(F.regexp_replace(p, SENTENCE, f"$1{CUT}"), CUT))

    def matched(pieces: Column) -> Column:
        found = F.filter(F.transform(pieces, lambda x: F.struct(best_match(x, threshold).alias("m"), x.alias("x"))), lambda x: x["m"].isNotNull())
        return F.transform(found, lambda x: F.struct((-x["m"]["score"]).alias("score"), x["m"]["license"].alias("license"), F.size(words_of(x["x"])).alias("n")))

    # one list, so that the templates stand in the plan once; repeated pieces of other kinds are told apart by the kind
    kinds = F.array(F.col("paragraphs"), within(lambda p: F.split(p, "\n")), sentences)
    docs = docs.select("doc_id", "path", "text", F.when(F.size("paragraphs") > 0, F.transform(kinds, matched)).alias("found"))
    words = F.aggregate(F.transform("found", lambda k: F.aggregate(k, F.lit(0), lambda a, x: a + x["n"])), F.lit(0), lambda a, n: F.greatest(a, n))
    flat = F.flatten("found")
    docs = docs.select("doc_id", "path", F.array_min(flat).alias("best"), F.when(F.size(flat) > 0, words / F.greatest(F.size(words_of(F.col("text"))), F.lit(1))).otherwise(0.0).alias("share"))
    name = F.element_at(F.split("path", "/"), -1)
    directory = F.when(F.contains(F.col("path"), F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), ""))
    own = docs.select(
        "doc_id", "path", directory.alias("directory"), F.col("best.license").alias("own_license"), (-F.col("best.score")).alias("score"),
        (F.col("best").isNotNull() & ((F.col("share") >= file_share) | F.coalesce(name.rlike(FILE_NAME), F.lit(False)))).alias("license_file"),
    )
    own = kept(own)  # a few short columns, read three times below
    inherited = inherit(own)
    joined = own.join(inherited, own["directory"] == inherited["of_directory"], "left")
    return joined.select(
        "doc_id", "path", "own_license", "score", "license_file",
        F.coalesce("own_license", "from_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from_directory")).alias("inherited_from"),
    )


def inherit(own: DataFrame) -> DataFrame:
    """``of_directory, from_directory, from_license``: the nearest directory up that has a licence file."""
    files = own.where("license_file and directory is not null").groupBy("directory")
    speaks = files.agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own_license").alias("license"))).alias("best"))
    speaks = speaks.select(F.col("directory").alias("from_directory"), F.col("best.license").alias("from_license"))
    folders = own.select(F.col("directory").alias("of_directory")).where("of_directory is not null").distinct()
    parts = F.split("of_directory", "/")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("from_directory")
    reached = folders.select("of_directory", up).distinct().join(speaks, "from_directory")
    deepest = F.max(F.struct(F.length("from_directory").alias("depth"), "from_directory", "from_license")).alias("d")
    return reached.groupBy("of_directory").agg(deepest).select("of_directory", "d.from_directory", "d.from_license")
