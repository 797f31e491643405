"""License scans by conditional compression.

A candidate block is a stretch of text around words that license notices use, taken as
its words in lower case. Each template, taken likewise, serves as a zstandard raw dictionary: how many bytes shorter a part of the
block gets with it, as a share of what the template itself would save, says how much of
the template the part holds. The parts overlap and are bounded by the template's length, so
that the share doesn't depend on the block's. The templates are ranked by their best part,
and those that save enough are confirmed by comparing wordings in the whole block: its words must occur in the block in order, within a tenth, and its decisive
words (names, versions, conditions) must all be there, and none that another variant has
in their place.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: License notices (name, wording), public wordings of common licenses. The scan
#: knows these wordings only.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Standard headers, titles and opening paragraphs. BSD's is the same with two and three clauses.
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    *((f"{short}-{v}.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, {which}")
      for short, name, v in (("GPL", "", 2), ("GPL", "", 3), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3))
      for which in (f"either version {v} of the License, or (at your option) any later version.", f"version {v} of the License.")),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    *((f"CC-{short}-4.0", f"Licensed under {the} Creative Commons {name} 4.0 International License.")
      for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for the in ("a", "the")),
    ("CC0-1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    *((name, f"SPDX-License-Identifier: {name}{more}")
      for name in "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC GPL-2.0 GPL-3.0 LGPL-3.0 AGPL-3.0 MPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC0-1.0 Unlicense".split()
      for more in (("", "-only", "-or-later") if "GPL" in name else ("",))),
)
#: An SPDX identifier that goes on is another one.
_GOES_ON = re.compile(r"-\w")
#: Words that tell one license from another; numbers are decisive too.
DECISIVE = frozenset("apache mit bsd isc gnu general lesser affero mozilla cc by sa nc nd cc0 unencumbered restriction fee commercial noncommercial alike sharealike derivatives noderivatives noderivs".split())
#: Words that make the text around them a candidate block.
ANCHOR = re.compile(r"licen[cs]|permission|public\W+domain|copyright|unencumbered|source\W+code\W+form|redistribut", re.I)
#: Characters of a block before and after an anchor; overlapping blocks are joined.
BEFORE, AFTER = 120, 320
LEVEL = 19
#: Words of a part, as twice one of these; a place of a template has at most one of them.
SPANS = (8, 16, 32, 64, 128)
#: Share of a template's compressed size a part of a block must save; share of its words that must agree.
LEAST_SAVED, LEAST_ALIKE = 0.3, 0.9
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


class Match(NamedTuple):
    license: str
    start: int
    end: int
    saved: float
    alike: float
    differences: list[str]


def wording(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case with their places; hyphens and signs part words."""
    return [(m[0], *m.span()) for m in _WORD.finditer(text.lower())] if len(text.lower()) == len(text) else [(m[0].lower(), *m.span()) for m in re.finditer(r"[A-Za-z0-9]+(?:\.[0-9]+)*", text)]


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks, joined where they overlap; a block of any length is kept whole."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, z = max(0, m.start() - BEFORE), min(len(text), m.end() + AFTER)
        if out and a <= out[-1][1]:
            out[-1][1] = z
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


class Scanner:
    def __init__(self):
        coder = lambda **more: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **more)
        self.plain = coder()
        self.with_ = []
        for name, text in TEMPLATES:
            words = [w for w, _, _ in wording(text)]
            low = " ".join(words).encode()
            given = coder(dict_data=zstandard.ZstdCompressionDict(low, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            # What a block that is the template would save.
            most = len(self.plain.compress(low)) - len(given.compress(low))
            span = next(x for x in SPANS if x > len(words) + len(words) // 10)
            self.with_.append((name, words, [w for w in words if w in DECISIVE or w[0].isdigit()], given, max(1, most), span))

    def ranked(self, words: list[tuple[str, int, int]]) -> list[tuple[float, int]]:
        """Templates by the share of their size that a part of the block saves given them, largest first."""
        only, parts = [w for w, _, _ in words], {}
        for span in {of[5] for of in self.with_}:
            # A place of at most `span` words lies whole in the part it starts in the first half of.
            lows = [" ".join(only[i : i + 2 * span]).encode() for i in range(0, max(1, len(only) - span), span)]
            parts[span] = [(low, len(self.plain.compress(low))) for low in dict.fromkeys(lows)]
        saved = [(max((alone - len(given.compress(low))) / most for low, alone in parts[span]), k) for k, (_, _, _, given, most, span) in enumerate(self.with_)]
        return sorted((s, k) for s, k in saved if s >= LEAST_SAVED)[::-1]

    def confirm(self, words: list[tuple[str, int, int]], k: int, saved: float) -> list[Match]:
        """Every place in the block whose wording is the template's, within LEAST_ALIKE."""
        name, template, decisive, _, _, _ = self.with_[k]
        found, only, i, n = [], [w for w, _, _ in words], 0, len(template)
        starts = [j for j, w in enumerate(only) if w in template[: 1 + n // 5]]
        for j in starts:
            if j < i:
                continue
            here = only[j : j + n + n // 10 + 1]
            parts = difflib.SequenceMatcher(None, template, here, autojunk=False).get_matching_blocks()
            agree = sum(b.size for b in parts)
            if agree < LEAST_ALIKE * n:
                continue
            last = max(b.b + b.size for b in parts if b.size)
            span = here[:last]
            if [w for w in span if w in DECISIVE or w[0].isdigit()] != decisive:
                continue
            alike = 2 * agree / (n + len(span))
            if alike < LEAST_ALIKE:
                continue
            differ = [w for w in difflib.ndiff(template, span) if w[0] in "+-"]
            found.append(Match(name, words[j][1], words[j + last - 1][2], round(saved, 4), round(alike, 4), differ))
            i = j + last
        return found

    def scan(self, text: str | None) -> tuple[int, list[Match]]:
        """Number of candidate blocks, and confirmed notices by place; of those that overlap, the longest."""
        if not text:
            return 0, []
        found, n = [], 0
        for a, z in blocks(text):
            n += 1
            words = wording(text[a:z])
            for saved, k in self.ranked(words):
                here = [m._replace(start=m.start + a, end=m.end + a) for m in self.confirm(words, k, saved)]
                found += [m for m in here if not (self.with_[k][1][0] == "spdx" and _GOES_ON.match(text, m.end))]
        kept: list[Match] = []
        for m in sorted(found, key=lambda m: (m.start - m.end, -m.alike, m.start, m.license)):
            if all(m.start >= x.end or m.end <= x.start for x in kept):
                kept.append(m)
        return n, sorted(kept, key=lambda m: m.start)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_blocks, matches.

    `matches` has (license, start, end, saved, alike, differences) by place; places are
    code points, ends exclusive. Null and empty texts have none; a notice that repeats is
    listed each time; repeated rows have the same matches; an empty table gives an empty
    result; further columns are not read.
    """
    match = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()), ("alike", pa.float64()), ("differences", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                got = [scanner.scan(t) for t in batch.column(1).to_pylist()]
                matches = pa.array([[m._asdict() for m in ms] for _, ms in got], pa.list_(match))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([n for n, _ in got], np.int64)), matches], ["doc_id", "n_blocks", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = "array<struct<license:string,start:bigint,end:bigint,saved:double,alike:double,differences:array<string>>>"
    return small_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))).mapInArrow(run, f"doc_id {kind}, n_blocks long, matches {shape}")


def op6_license_scan(spark, sf_dir):
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    places = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", "n_blocks", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), places.alias("places"))
