"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised alike (A-Z lower-cased, ASCII marks
dropped, blanks folded). A template with b bigrams and a window with w
bigrams can reach a Dice coefficient of d only if w lies between
b d / (2 - d) and b (2 - d) / d, and only if the window has at least
b d / (2 - d) of the template's bigrams; templates that a text can't reach by
these bounds are pruned before any window is compared. The best window of a
template begins and ends at one of its bigrams, so windows are tried there
only, wherever they stand in the text. A start that lies g words behind one
that was tried can do better than that one by a bounded factor, so starts that
can't beat the best window so far are passed over; the result is the best one.

Templates are the whole texts in ``licences/``, one file for each SPDX
identifier, and the short notices below. Of windows that overlap by more than
half, the one with most shared bigrams stays (of as many, the one that scores
best), so neither a notice nor a whole licence is also taken for its siblings'.

A notice's window must hold the notice's own version numbers, and a whole text
whose title says another version than the template's isn't that template: such a
hit names the family alone, as GPL for GPL-2.0.

Cases: null, empty and one-word texts have no licence; a very long text is read
whole, in one task; equal rows give equal rows; a null doc_id is carried; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import grams, plain, table, texts, words
from .decontamination import plain_words

#: Public licence notices by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def templates(folder: str | Path = Path(__file__).parent / "licences") -> tuple[tuple[str, str], ...]:
    """The notices and the whole texts of ``folder``: pairs of identifier and text."""
    return NOTICES + tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(folder).glob("*.txt")))


DICE = 0.8
#: Words of a notice at most; longer templates are whole texts, whose version stands in so many words of their title.
NOTICE, TITLE = 80, 40


def family(name: str) -> str:
    """An identifier without its version."""
    return re.sub(r"-v?\d+(\.\d+)*$", "", name)


def _hashes(text: str) -> np.ndarray:
    return words(*plain(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))[2]


#: Keys of the word before a version, and of versions from 0 to 999, as 2.0 stands without its point.
_VERSION = set(_hashes("version v").tolist())
_NUMBERS = dict(zip(_hashes(" ".join(f"{i} v{i} 0{i}" for i in range(1000))).tolist(), [i for i in range(1000) for _ in range(3)], strict=True))


def _said(hashes: list[int]) -> set[int]:
    """Versions that a text says after the word for it."""
    return {_NUMBERS[b] for a, b in zip(hashes, hashes[1:], strict=False) if a in _VERSION and b in _NUMBERS}


class Scanner:
    """Templates as bigram multisets, and the search for their best windows."""

    def __init__(self, known, dice: float = DICE):
        self.names, self.dice = [n for n, _ in known], dice
        every = [_hashes(t).tolist() for _, t in known]
        self.whole = [len(h) > NOTICE for h in every]
        self.versions = [_said(h[:TITLE]) if w else {x for x in h if x in _NUMBERS} for h, w in zip(every, self.whole, strict=True)]
        self.bags = [Counter(grams(plain_words(t), 2).tolist()) for _, t in known]
        self.sizes = np.array([sum(b.values()) for b in self.bags], dtype=np.int64)
        self.keys = np.array(sorted({k for b in self.bags for k in b}), dtype=np.uint64)
        self.mark = np.zeros(1 << 16, dtype=bool)
        self.mark[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        of = [[t for t, b in enumerate(self.bags) if k in b] for k in self.keys.tolist()]
        self.many = np.array([len(x) for x in of], dtype=np.int64)
        self.first, self.of = np.cumsum(self.many) - self.many, np.array([t for x in of for t in x], dtype=np.int64)

    def scan(self, hashes: np.ndarray, bounds: np.ndarray):
        """``{(text, template): (Dice, first word, end)}`` of the best windows."""
        pairs = grams(hashes, 2)
        maybe = np.flatnonzero(self.mark[(pairs >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(self.keys, pairs[maybe])
        maybe, at = maybe[at < len(self.keys)], at[at < len(self.keys)]
        real = self.keys[at] == pairs[maybe]
        maybe, at = maybe[real], at[real]
        text = np.searchsorted(bounds, maybe, "right") - 1
        inside = maybe + 1 < bounds[text + 1]
        maybe, at, text = maybe[inside], at[inside], text[inside]
        # One row for each bigram and template that has it.
        many = self.many[at]
        row = np.repeat(np.arange(len(at)), many)
        template = self.of[np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(len(row))]
        both = text[row] * len(self.names) + template
        codes, back, count = np.unique(both, return_inverse=True, return_counts=True)
        reach = count >= self.sizes[codes % len(self.names)] * self.dice / (2 - self.dice) - 1e-9
        keep = np.flatnonzero(reach[back])
        keep = keep[np.argsort(back[keep], kind="stable")]
        cuts = np.flatnonzero(np.diff(back[keep])) + 1
        found = {}
        for part in np.split(keep, cuts) if len(keep) else ():
            t, k = divmod(int(both[part[0]]), len(self.names))
            best = self._best(k, maybe[row[part]].tolist(), self.keys[at[row[part]]].tolist())
            if best:
                found[t, k] = (best[0], best[1] - int(bounds[t]), best[2] - int(bounds[t]))
        return found

    def name(self, template: int, window: list[int]) -> str:
        """The template's identifier, or its family alone if the window's version is another one."""
        own = self.versions[template]
        if self.whole[template]:
            said = _said(window[:TITLE])
            same = not own or not said or bool(own & said)
        else:
            same = own <= set(window)
        return self.names[template] if same else family(self.names[template])

    def _best(self, template: int, at: list[int], keys: list[int]):
        """Score, first word and end of the best window of the places ``at`` and their bigrams ``keys``; the first of equal ones."""
        size, d, bag = int(self.sizes[template]), self.dice, self.bags[template]
        least, widest = size * d / (2 - d) - 1e-9, size * (2 - d) / d + 1e-9
        need, best, i = max(1, int(np.ceil(least))), None, 0
        while i + need <= len(at):
            first = at[i]
            left, both, top = dict(bag), 0, 0.0
            for j in range(i, len(at)):
                w = at[j] - first + 1
                if w > widest:
                    break
                if left[keys[j]] > 0:
                    left[keys[j]] -= 1
                    both += 1
                score = 2 * both / (size + w)
                if w >= least:
                    top = max(top, score)
                    if score >= d and (best is None or score > best[0]):
                        best = (score, first, at[j] + 2)
            # Behind this start by g words, a window has no more of the bigrams and g words less; windows that end
            # beyond those tried have one more bigram for each word at most.
            goal = best[0] if best else d - 1e-12
            i += 1
            while i + need <= len(at):
                g = at[i] - first
                inner = top * (size + least) / max(size + least - g, 1e-9)
                outer = 2 * min(size, both + g) / max(size + widest - g, 1e-9)
                if max(inner, outer) * (1 + 1e-12) > goal:
                    break
                i += 1
        return best


def chosen(hits: list[tuple[int, float, int, int, str]]) -> list[tuple[int, float, int, int, str]]:
    """Of hits (shared bigrams, score, first, end, licence) of one text, those that no better one covers by more than half."""
    kept: list[tuple[int, float, int, int, str]] = []
    for hit in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[4])):
        _, _, s, e, name = hit
        if not any(min(e, b) - max(s, a) > min(e - s, b - a) / 2 for _, _, a, b, _ in kept) and name not in {k[4] for k in kept}:
            kept.append(hit)
    return kept


def found(docs: DataFrame, known=None, dice: float = DICE) -> DataFrame:
    """doc_id, license, score, first_word and n_words of the best window of each licence in a document."""
    held = docs.sparkSession.sparkContext.broadcast((templates() if known is None else known, dice))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        scanner = Scanner(*held.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, at in texts(batch):
                _, _, hashes, bounds = words(*plain(data, at))
                hits: dict[int, list] = {}
                for (t, k), (score, s, e) in scanner.scan(hashes, bounds).items():
                    both = round(score * (int(scanner.sizes[k]) + e - s - 1) / 2)
                    window = hashes[bounds[t] + s : bounds[t] + e].tolist()
                    hits.setdefault(t, []).append((both, score, s, e, scanner.name(k, window)))
                rows = [{"doc_id": ids[first + t], "license": name, "score": score, "first_word": s, "n_words": e - s} for t, own in sorted(hits.items()) for _, score, s, e, name in sorted(chosen(own), key=lambda h: h[4])]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, score double, first_word long, n_words long")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents: one row for each document and licence."""
    return found(table(spark, sf_dir, "documents"))
