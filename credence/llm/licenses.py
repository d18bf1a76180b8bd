"""License scans by MinHash bands over overlapping windows, verified by exact shingle containment.

Templates of a similar number of five-word shingles form a class. A document's shingles are cut into blocks of a quarter
of the class's size, and every stretch of BLOCKS blocks is a window, so some window holds any occurrence whole. Each hash
function is computed once over all shingles; its minimum over a block, and then over a window, gives the signature.

Of a template with n distinct shingles, a window that holds at least 80 % of them has at most BLOCKS * ceil(size / 4)
shingles of its own, where size is the power of two from n on (windows of classes up to 4 have exactly that size). Their
Jaccard similarity is thus at least 0.29 for any n. A band of one row misses with a probability of 0.71 at most, and all
BANDS of them with 0.71 ** 32 < 2e-5. Windows that share a band with a template are verified: the share of the template's
distinct shingles that the window holds must be at least 0.8.

Templates are a list held by the caller, sent to the executors in blocks of bounded size, each of which meets all documents
in a pass of its own. Nulls: a null text is an empty
one; a null id is reported under null. Templates with fewer than five words are one shingle of all their words. Repeated
rows are reported alike; extra columns are ignored; an empty table gives an empty result; texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import FULL_TEXTS
from .shared import chunks, offsets, values
from .tokens import shingles, text_words, words

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
BLOCKS = 5
MAX_TEMPLATE_BYTES = 16 << 20
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Opening or notice texts of well-known licenses, and the full texts of short ones.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
} | FULL_TEXTS


class Class:
    """Templates whose windows have one size; step: shingles of a block."""

    def __init__(self, size: int, members: list[tuple[str, np.ndarray]]):
        self.step, self.members = max(1, -(-size // 4)), members
        self.blocks = BLOCKS if self.step > 1 else size
        low = np.array([[signature(s, b).min() for _, s in members] for b in range(BANDS)])
        self.order = np.argsort(low, axis=1, kind="stable")
        self.known = np.take_along_axis(low, self.order, axis=1)
        self.filter = np.zeros((BANDS, 1 << 16), bool)  # by the low 16 bits, so that few windows are looked up
        for b in range(BANDS):
            self.filter[b, (low[b] & np.uint64(0xFFFF)).astype(np.int64)] = True


def multiplier(band: int) -> np.uint64:
    return np.uint64((2 * band + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def signature(s: np.ndarray, band: int) -> np.ndarray:
    """The band's hash of each shingle."""
    return s * multiplier(band)


def template_shingles(text: str, shortest: int = 1) -> np.ndarray:
    w = text_words(text)
    return np.unique(shingles(w, min(SHINGLE, len(w)))) if len(w) else np.zeros(0, np.uint64)


def classes(templates: dict[str, str]) -> dict[int, list[Class]]:
    """words of a shingle -> classes of templates, by powers of two of their numbers of shingles."""
    groups: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
    for name, text in sorted(templates.items()):
        s, n = template_shingles(text), min(SHINGLE, len(text_words(text)))
        if len(s):
            groups.setdefault((n, 1 << (len(s) - 1).bit_length()), []).append((name, s))
    out: dict[int, list[Class]] = {}
    for (n, size), members in sorted(groups.items()):
        out.setdefault(n, []).append(Class(size, members))
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, start_word) of every document row and template that it holds: the best window, the first of equal ones."""
    blocks: list[dict[str, str]] = [{}]
    held = 0
    for name, text in sorted(templates.items()):
        size = len(name) + len(text)
        if blocks[-1] and held + size > MAX_TEMPLATE_BYTES:
            blocks.append({})
            held = 0
        blocks[-1][name] = text
        held += size
    return reduce(DataFrame.union, [scan_block(docs, x) for x in blocks])


def scan_block(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    by_words = classes(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, begins = words(values(part.column("text")), offsets(part.column("text")))
                best: dict[tuple[int, str], tuple[float, int]] = {}
                for n, own in by_words.items():
                    search(hashes, begins, n, own, best)
                if best:
                    ids = part.column("doc_id").take(pa.array([d for d, _ in best]))
                    score, start = zip(*best.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([t for _, t in best]), pa.array(score), pa.array([-x for x in start], pa.int64())], names=["doc_id", "license", "containment", "start_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, license string, containment double, start_word long")


def search(hashes: np.ndarray, begins: np.ndarray, n: int, own: list[Class], best: dict) -> None:
    """Enter into best the windows of n-word shingles that hold a template of the classes."""
    s = shingles(hashes, n)
    ends = np.maximum(begins[1:] - n + 1, begins[:-1])  # one past each text's last shingle
    full = np.flatnonzero(ends > begins[:-1])
    if not len(full):
        return
    plans = [Plan(c, begins, ends, full) for c in own]
    x = np.full(len(s) + 1, _MOST, np.uint64)
    for band in range(BANDS):
        np.multiply(s, multiplier(band), out=x[:-1])
        for plan in plans:
            plan.look_up(x, band)
    for plan in plans:
        for i, m in plan.found:
            name, wanted = plan.own.members[m]
            end = min(i + plan.own.blocks - 1, int(plan.last[i]))
            held = s[plan.edges[i] : plan.stops[end]]
            inside = np.isin(held, wanted)
            share = len(np.unique(held[inside])) / len(wanted)
            if share >= CONTAINMENT:
                d = int(plan.text[i])
                start = int(plan.edges[i] + np.flatnonzero(inside)[0] - begins[d])
                best[d, name] = max(best.get((d, name), (0.0, 0)), (share, -start))


class Plan:
    """The blocks and windows of a class over some texts."""

    def __init__(self, own: Class, begins: np.ndarray, ends: np.ndarray, full: np.ndarray):
        first = [np.arange(begins[d], ends[d], own.step) for d in full.tolist()]
        count = np.array([len(x) for x in first])
        self.own, self.found = own, set()
        self.edges, self.text = np.concatenate(first), np.repeat(full, count)
        self.stops = np.minimum(self.edges + own.step, ends[self.text])
        self.last = np.repeat(np.cumsum(count) - 1, count)  # the last block of each block's text
        # reduceat runs from one place to the next: what lies between a text's last block and the next text is dropped
        self.both = np.stack([self.edges, self.stops], 1).ravel()
        # blocks of different texts lie so far apart that no window holds both
        self.slot = np.arange(len(self.edges)) + np.repeat(np.arange(len(full)) * (own.blocks - 1), count)
        self.laid = np.full(int(self.slot[-1]) + own.blocks, _MOST, np.uint64)
        self.block = np.full(len(self.laid), -1)
        self.block[self.slot] = np.arange(len(self.slot))

    def look_up(self, x: np.ndarray, band: int) -> None:
        """Enter (first block, member) of windows whose minimum in the band is that of a template."""
        own, laid = self.own, self.laid
        laid[self.slot] = x[self.edges] if own.step == 1 else np.minimum.reduceat(x, self.both)[::2]
        window = laid
        if own.blocks > 1:
            window = np.minimum(laid[:-1], laid[1:])
            for i in range(2, own.blocks):
                window = np.minimum(window[:-1], laid[i:])
        at = np.flatnonzero(own.filter[band][window.view("<u2")[::4]])
        known = own.known[band]
        a, b = np.searchsorted(known, window[at], "left"), np.searchsorted(known, window[at], "right")
        for i in np.flatnonzero(b > a).tolist():
            block = int(self.block[at[i]])
            if block >= 0:
                self.found.update((block, int(m)) for m in own.order[band][a[i] : b[i]])
