"""License scans: MinHash bands over overlapping windows, then exact shingle containment."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
MIN_CONTAINMENT = 0.8
# Bands of one row: a window and a template with similarity s collide with 1 - (1 - s) ** BANDS.
# A template found at 0.8 has a window of similarity 0.5 or more, so with 0.99998 or more.
BANDS = 16
WORD = re.compile(r"\w+")

# Wordings of licence notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License. You may obtain a copy of the License at"
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation"
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met"
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted"
    ),
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str]) -> list[str]:
    """Runs of SHINGLE words; fewer words make one, none makes none."""
    if len(words) <= SHINGLE:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(SHINGLE)))))


def band_keys(window: list[str]) -> list[int]:
    """The smallest hash of the window's shingles for each band."""
    base = np.array([xxhash.xxh64_intdigest(s) for s in set(window)], dtype=np.uint64)
    keys = []
    for band in range(BANDS):
        mixed = (base ^ np.uint64(xxhash.xxh64_intdigest(b"band %d" % band))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        keys.append(int(mixed.min()))
    return keys


class Index:
    """Templates by band key, and the shingles that can make a band collide.

    A band collides only if the window holds the template's smallest shingle of that band, so
    windows without any such shingle need no MinHash; leaving them out changes no result.
    """

    def __init__(self, templates: Mapping[str, str]):
        self.sets = {name: set(shingles(words_of(t))) for name, t in templates.items()}
        self.sets = {name: s for name, s in self.sets.items() if s}
        self.by_key: dict[tuple[int, int], set[str]] = {}
        self.sizes = sorted({len(s) for s in self.sets.values()})
        smallest = set()
        for name, own in self.sets.items():
            for band, key in enumerate(band_keys(list(own))):
                self.by_key.setdefault((band, key), set()).add(name)
            for s in own:
                if set(band_keys([s])) & set(band_keys(list(own))):
                    smallest.add(s)
        first = {s.split(" ")[0] for s in smallest}
        self.smallest, self.first = smallest, first

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """``template, first word, end word, containment`` of each place found, in order."""
        words = words_of(text)
        if len(words) < SHINGLE:
            hits = [0] if shingles(words) and shingles(words)[0] in self.smallest else []
        else:
            hits = [
                i
                for i, w in enumerate(words)
                if w in self.first and " ".join(words[i : i + SHINGLE]) in self.smallest
            ]
        if not hits:
            return []
        count = max(1, len(words) - SHINGLE + 1)
        places: dict[str, list[tuple[int, int]]] = {}
        for size in self.sizes:
            step = max(1, size // 4)
            starts = {
                s
                for i in hits
                for s in range(max(0, -(-(i - size + 1) // step) * step), i + 1, step)
            }
            for s in sorted(starts):
                window = shingles(words[s : s + size + SHINGLE - 1])
                names = set()
                for band, key in enumerate(band_keys(window)):
                    names |= self.by_key.get((band, key), set())
                for name in names:
                    if len(self.sets[name]) == size:
                        low, high = max(0, s - step), min(count, s + size + step)
                        region = shingles(words[low : high + SHINGLE - 1])
                        if len(self.sets[name] & set(region)) >= MIN_CONTAINMENT * size - 1e-9:
                            places.setdefault(name, []).append((low, high))
        out = []
        for name, found in places.items():
            joined: list[list[int]] = []
            for low, high in sorted(found):
                if joined and low < joined[-1][1]:
                    joined[-1][1] = max(high, joined[-1][1])
                else:
                    joined.append([low, high])
            for low, high in joined:
                region = shingles(words[low : high + SHINGLE - 1])
                at = [low + i for i, s in enumerate(region) if s in self.sets[name]]
                share = len(self.sets[name] & set(region)) / len(self.sets[name])
                end = min(len(words), at[-1] + SHINGLE)
                out.append((name, at[0], end, share))
        return sorted(out, key=lambda m: (m[1], m[0]))


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, license, start_word, end_word, containment`` for each place of each document.

    Words are runs of letters and digits, lower-cased, so comment marks and line breaks don't
    matter.  For each size of template, windows of that many shingles overlap by three
    quarters; a window that collides with a template in any band is verified by the exact share
    of the template's shingles in it and a step on either side.  Places that overlap are one.

    A null or empty text has no match; a template of fewer than SHINGLE words is found only as
    a whole text; repeated rows are scanned each; an empty table gives no rows.  Templates go to
    the tasks with the code, so their number is the caller's to bound.  No shuffle.
    """
    known = dict(TEMPLATES if templates is None else templates)
    index = Index(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, *match)
                for doc, body in zip(*(c.to_pylist() for c in batch.columns))
                for match in index.matches(body)
            ]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)],
                ["doc_id", "license", "start_word", "end_word", "containment"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id bigint, license string, start_word bigint, end_word bigint, containment double",
    )
