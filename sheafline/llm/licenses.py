"""License scans: MinHash bands over overlapping windows, verified by shingle containment.

Words are lower-cased and punctuation separates them.  Templates are grouped by
shingle width (five words, or all words of a shorter template) and window
width, a power of two of at least twice their shingles; windows overlap by half, so every run
of a template's length lies whole in one of them.  Each band is one MinHash
coordinate: at containment 0.8 the Jaccard similarity of window and template is
at least about 0.2, and BANDS = 32 bands collide with probability
1 - 0.8^32 = 0.9992 or more.  A band can only collide where the template's least shingle
occurs, so windows without any such shingle are passed over unhashed: that
changes no result.  Each candidate is verified by counting the template's
shingles in the window.

Cases: null and empty texts have no matches; repeated rows repeat their result;
an empty table gives an empty table; overlapping windows with the same template
are one match; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx

SHINGLE, BANDS, CONTAINMENT = 5, 32, 0.8

#: Public licence notices (fixed values).
TEMPLATES: dict[str, str] = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}

_PLAIN = tx.LOWER.copy()
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_BITS = 20


def _words(col: pa.Array) -> tx.Words:
    raw, off = tx.utf8(col)
    return tx.words(tx.padded(_PLAIN[raw]), off)


def _shingles(w: tx.Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that stay in one text, and the word at which each begins."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = w.doc_of()
    s = np.full(n, np.uint64(k))
    for j in range(k):
        s = tx.combine64(s, h[j : j + n])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return s[at], at


def _minima(s: np.ndarray, bands: int) -> np.ndarray:
    """The shingle with the least hash in each band."""
    return np.array([s[tx.mix64(s ^ tx.mix64(np.array([1000 + i], np.uint64))).argmin()] for i in range(bands)])


@dataclass
class Group:
    k: int
    width: int
    names: list[str]
    sets: list[np.ndarray]
    minima: np.ndarray  # templates x bands
    marks: np.ndarray  # bit table of all minima


class Scanner:
    def __init__(self, templates: dict[str, str], shingle: int = SHINGLE, bands: int = BANDS, containment: float = CONTAINMENT) -> None:
        self.bands, self.containment = bands, containment
        parts: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name, text in templates.items():
            w = _words(pa.array([text]))
            k = min(shingle, len(w.starts))
            if not k:
                continue
            s = np.unique(_shingles(w, w.hashes(), k)[0])
            runs = len(w.starts) - k + 1
            parts.setdefault((k, 1 << int(np.ceil(np.log2(2 * runs)))), []).append((name, s))
        self.groups = []
        for (k, width), some in sorted(parts.items()):
            minima = np.stack([_minima(s, bands) for _, s in some])
            marks = np.zeros(1 << _BITS, bool)
            marks[(minima & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.groups.append(Group(k, width, [n for n, _ in some], [s for _, s in some], minima, marks))

    def scan(self, col: pa.Array) -> list[tuple[int, str, float, int, int]]:
        """(row, template, containment, first word, words) of every match."""
        w = _words(col)
        h = w.hashes()
        found: list[tuple[int, str, float, int, int]] = []
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in self.groups:
            if g.k not in kept:
                kept[g.k] = _shingles(w, h, g.k)
            s, at = kept[g.k]
            if not len(s):
                continue
            hot = np.flatnonzero(g.marks[(s & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            hot = hot[np.isin(s[hot], g.minima)]
            if not len(hot):
                continue
            doc = np.searchsorted(w.first, at[hot], "right") - 1
            place = at[hot] - w.first[doc]
            half = max(1, g.width // 2)
            windows = {(int(d), int(p // half) - back) for d, p in zip(doc, place, strict=True) for back in (0, 1) if p // half >= back}
            best: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
            for d, n in sorted(windows):
                a = w.first[d] + n * half
                x, y = np.searchsorted(at, (a, min(a + g.width, w.first[d + 1])))
                part = s[x:y]
                if not len(part):
                    continue
                mine = _minima(part, self.bands)
                for t in np.flatnonzero((g.minima == mine).any(1)).tolist():
                    share = np.isin(g.sets[t], part).mean()
                    if share >= self.containment:
                        inside = np.flatnonzero(np.isin(part, g.sets[t]))
                        first = int(at[x + inside[0]] - w.first[d])
                        last = int(at[x + inside[-1]] - w.first[d]) + g.k
                        best.setdefault((d, t), []).append((float(share), first, last))
            for (d, t), hits in best.items():
                hits.sort(key=lambda v: v[1])
                merged: list[tuple[float, int, int]] = []
                for share, a, b in hits:
                    if merged and a < merged[-1][2]:
                        c, e, f = merged[-1]
                        merged[-1] = (max(c, share), e, max(f, b))
                    else:
                        merged.append((share, a, b))
                found += [(d, g.names[t], share, a, b - a) for share, a, b in merged]
        return sorted(found)


@functools.lru_cache(4)
def _scanner(items: tuple[tuple[str, str], ...], shingle: int, bands: int, containment: float) -> Scanner:
    return Scanner(dict(items), shingle, bands, containment)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """keep columns and, per document, n_matches, the licenses' names, the best containment and all matches."""
    items = tuple((templates if templates is not None else TEMPLATES).items())
    match = pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(col: pa.Array) -> dict:
        by: list[list[tuple[str, float, int, int]]] = [[] for _ in range(len(col))]
        for d, *rest in _scanner(items, shingle, bands, containment).scan(col):
            by[d].append(tuple(rest))
        return {
            "n_matches": np.array([len(x) for x in by], np.int64),
            "licenses": pa.array([sorted({x[0] for x in m}) for m in by], pa.list_(pa.string())),
            "best": pa.array([max((x[1] for x in m), default=None) for m in by], pa.float64()),
            "matches": pa.array([[dict(zip(("license", "containment", "first_word", "n_words"), x, strict=True)) for x in m] for m in by], pa.list_(match)),
        }

    ddl = "n_matches long, licenses array<string>, best double, matches array<struct<license:string,containment:double,first_word:bigint,n_words:bigint>>"
    return tx.map_texts(docs, text, list(keep), ddl, run)
