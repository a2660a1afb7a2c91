"""Licence scans by sentence rules.

Texts are split into sentences; a normalised sentence that a table knows becomes its identifier; and a licence is
recognised where a document's identifiers contain a rule's in order, with at most GAP unknown sentences between two of
them. Rules are tried in order, longest first, so that a whole licence counts before a notice in it. The tables are fixed and small; each document is scanned whole where it is
read, and nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence names, notices and sentences.
NAMES = {
    "MIT": ("MIT License", "MIT Licence", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL-2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
}
NOTICES = (
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Published under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This software is licensed under the {}", "This project is licensed under the {}", "This file is licensed under the {}",
    "This program is licensed under the {}", "This program is released under the {}", "This software is released under the {}", "This project is released under the {}", "Available under the {}", "License: {}", "SPDX-License-Identifier: {}",
)
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "epl2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-terms")),
    ("LGPL-2.1", ("lgpl21-grant", "lgpl-warranty")),
    ("LGPL-3.0", ("lgpl3-grant", "gpl-warranty")),
    ("AGPL-3.0", ("agpl3-grant", "gpl-warranty")),
    ("Unlicense", ("unlicense-domain", "unlicense-grant")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("MPL-2.0", ("mpl-grant", "mpl-copy")),
    ("GPL-2.0", ("gpl2-grant", "gpl-warranty")),
    ("GPL-3.0", ("gpl3-grant", "gpl-warranty")),
    ("Apache-2.0", ("apache-grant", "apache-terms")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("GPL-2.0", ("gpl2-grant",)),
    ("GPL-3.0", ("gpl3-grant",)),
    ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-grant",)),
    ("MPL-2.0", ("mpl-grant",)),
    ("LGPL-2.1", ("lgpl21-grant",)),
    ("LGPL-3.0", ("lgpl3-grant",)),
    ("AGPL-3.0", ("agpl3-grant",)),
    ("EPL-2.0", ("epl2-grant",)),
    ("Unlicense", ("unlicense-domain",)),
    ("CC0-1.0", ("cc0-waiver",)),
)
#: Unknown sentences that may stand between two of a rule.
GAP = 2
#: A sentence ends with . ; ! or ? (and marks after it) before white space, at an empty line, or with : if it is long:
#: "License: MIT" is one sentence, the grant before a list of conditions another.
END = re.compile(r"[.;!?][^\w\s]*(?=\s|$)|:(?=\s)|\n[ \t]*(?=\n)")
LONG = 60
OTHER = re.compile(r"[\W_]+")


def normal(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower()).strip()


def last_word(sentence: str) -> str:
    """Of its normal form, without making the whole of it."""
    end = len(sentence)
    while end and not sentence[end - 1].isalnum():
        end -= 1
    begin = end
    while begin and sentence[begin - 1].isalnum():
        begin -= 1
    return sentence[begin:end].lower()


def tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Normalised sentences with their identifiers, and rules in the order in which they are tried."""
    known, rules = {}, list(RULES)
    for name, text in SENTENCES.items():
        parts = [text[a:b] for a, b in split(text)]
        for k, part in enumerate(parts):  # a sentence with a mark inside is known by its parts
            known.setdefault(normal(part), name if len(parts) == 1 else f"{name}/{k}")
    parts_of = {name: tuple(dict.fromkeys(known[normal(text[a:b])] for a, b in split(text))) for name, text in SENTENCES.items()}
    rules = [(licence, tuple(p for s in sequence for p in parts_of[s])) for licence, sequence in rules]
    for licence, names in NAMES.items():
        for name in names:
            for notice in NOTICES:
                known.setdefault(normal(notice.format(name)), f"notice/{licence}")
        rules.append((licence, (f"notice/{licence}",)))
    return known, rules


def split(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for m in END.finditer(text):
        if m.group() == ":" and m.end() - at < LONG:
            continue
        spans.append((at, m.end()))
        at = m.end()
    return [*spans, (at, len(text))] if at < len(text) else spans


class Scanner:
    def __init__(self):
        self.known, self.rules = tables()
        self.widest = max(len(k) for k in self.known)
        self.lasts = {k.rsplit(" ", 1)[-1] for k in self.known}

    def identify(self, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
        """Identifiers and spans within a sentence, in order: of the whole, or of all known runs of its lines.

        Notices without a full stop stand in one sentence. Runs are sought from the last line up and don't overlap."""
        own = text[a:b]
        found = self.known.get(normal(own)) if last_word(own) in self.lasts else None
        if found:
            return [(found, a, b)]
        if "\n" not in own.strip():
            return []
        lines = [(m.start(), m.end(), n) for m in re.finditer(r"[^\n]+", own) if (n := normal(m.group()))]
        out, end = [], len(lines) - 1
        while end >= 0:
            begin, run = end, lines[end][2]
            if run.rsplit(" ", 1)[-1] in self.lasts:
                while (found := self.known.get(run)) is None and begin and len(run) < self.widest:
                    begin -= 1
                    run = f"{lines[begin][2]} {run}"
                if found:
                    out.append((found, a + lines[begin][0], a + lines[end][1]))
                    end = begin
            end -= 1
        return out[::-1]

    def scan(self, text: str) -> list[tuple[str, str, int, int]]:
        """Licence, rule, start and length in code points of each match, in the order of their starts."""
        found = []  # (place among sentences, identifier, start, end)
        for place, (a, b) in enumerate(split(text)):
            found += [(place, *x) for x in self.identify(text, a, b)]
        used, out = set(), []
        for licence, rule in self.rules if found else ():
            for i in range(len(found)):
                taken, at = [], i
                for want in rule:
                    while at < len(found) and (at in used or found[at][1] != want) and (not taken or found[at][0] - found[taken[-1]][0] <= GAP):
                        if not taken:
                            break
                        at += 1
                    if at >= len(found) or at in used or found[at][1] != want or taken and found[at][0] - found[taken[-1]][0] > GAP + 1:
                        break
                    taken.append(at)
                    at += 1
                if len(taken) == len(rule):
                    used.update(taken)
                    start, end = found[taken[0]][2], found[taken[-1]][3]
                    lead = len(text[start:end]) - len(text[start:end].lstrip())
                    out.append((licence, "+".join(rule), start + lead, end - start - lead))
        return sorted(out, key=lambda m: m[2])


_scanner: list[Scanner] = []


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, licences (distinct, sorted), matches (licence, rule, start, length).

    Null and empty texts have none. Repeated rows and null ids stay as they are; extra columns don't matter; an empty
    table gives no rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for batch in batches:
            found = [_scanner[0].scan(x) if x else [] for x in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("licence", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            matches = pa.array([[dict(zip(("licence", "rule", "start", "length"), m, strict=True)) for m in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted({m[0] for m in x}) for x in found], pa.list_(pa.string())), matches], names=[id_col, "licences", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(scan, f"`{id_col}` {kind}, licences array<string>, matches array<struct<licence: string, rule: string, start: long, length: long>>")
