"""License scans: Dice coefficient over word bigrams against licence templates.

Text is normalised to lower-case words; what is compared are passages: they begin
and end at lines and sentences (which may go over lines), so a wrapped notice
inside other text is found.  A passage with ``n`` bigrams can reach the
coefficient ``t`` with a template of ``m`` only if ``m`` lies between
``n*t/(2-t)`` and ``n*(2-t)/t``; templates outside are never compared.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from helpdeck.llm.common import arrow_map, strings

_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")

#: Short notices and heads of well-known licences, by SPDX id.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(ws: list[str]) -> Counter:
    """Counts of word bigrams; a single word is paired with nothing."""
    return Counter(zip(ws, ws[1:])) if len(ws) > 1 else Counter((w, "") for w in ws)


def dice(a: Counter, b: Counter) -> float:
    n = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / n if n else 1.0


class Matcher:
    """Templates by size; ``best`` compares a passage with those that its size allows."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        made = [(sum((g := bigrams(words(text))).values()), name, g) for name, text in templates]
        self.templates = sorted(made, key=lambda x: (x[0], x[1]))
        self.sizes = [x[0] for x in self.templates]
        self.threshold = threshold
        self.bigrams = set().union(*(x[2] for x in made)) if made else set()
        self.words = {w for pair in self.bigrams for w in pair}

    def best(self, ws: list[str]) -> tuple[float, str | None]:
        g = bigrams(ws)
        n, t = sum(g.values()), self.threshold
        lo = bisect_left(self.sizes, n * t / (2 - t) - 1e-9)
        hi = bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        found: tuple[float, str | None] = (0.0, None)
        for _, name, own in self.templates[lo:hi]:
            d = dice(g, own)
            if d >= t and (d, name) > (found[0], found[1] or ""):
                found = (d, name)
        return found


def passages(text: str, matcher: Matcher) -> list[tuple[int, list[str]]]:
    """``(start code point, words)`` of the passages worth comparing: from each line or sentence that begins with or holds a
    word pair of some template to the end of each line or sentence, until no template is large enough."""
    cut = {0, *(m.end() for m in _LINE.finditer(text)), *(m.end() for m in _SENTENCE.finditer(text))}
    cut = sorted(cut)
    parts = [(a, ws) for a, b in zip(cut, cut[1:] + [len(text)]) if (ws := words(text[a:b]))]
    most = matcher.sizes[-1] * (2 - matcher.threshold) / matcher.threshold if matcher.sizes else 0
    out = []
    for i, (start, ws) in enumerate(parts):
        after = ws + (parts[i + 1][1][:1] if i + 1 < len(parts) else [])
        if not (any(p in matcher.bigrams for p in zip(after, after[1:])) or len(ws) == 1 and (ws[0], "") in matcher.bigrams):
            continue
        run: list[str] = []
        for j in range(i, len(parts)):
            run = run + parts[j][1]
            if len(run) - 1 > most:
                break
            out.append((start, run))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8,
         text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, license`` (the best template's name; null: none reaches the
    threshold), ``score`` (its coefficient, else 0), ``at`` (code point where the passage begins, else
    null), ``licenses`` (all names found, sorted).

    Null and empty texts have no passages; ties go to the last name in order;
    repeated rows stay; other columns are ignored.  The whole text is read; no shuffle.
    """
    from pyspark.sql import functions as F

    matcher = Matcher(templates, threshold)  # templates: a fixed list

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, spots, alls = [], [], [], []
        for text in strings(batch.column(1)):
            best, where, every = (0.0, None), None, set()
            for at, ws in passages(text, matcher):
                got = matcher.best(ws)
                if got[1] is not None:
                    every.add(got[1])
                    if best[1] is None or got > best:
                        best, where = got, at
            names.append(best[1])
            scores.append(best[0])
            spots.append(where)
            alls.append(sorted(every))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spots, pa.int64()),
             pa.array(alls, pa.list_(pa.string()))], names=["doc_id", "license", "score", "at", "licenses"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run,
                     "doc_id bigint, license string, score double, at bigint, licenses array<string>")
