"""Licence scans by sentence rules.

A text's sentences are normalised to words; those known from licences and their notices are mapped to
identifiers. The sequence of identifiers is then read from left to right: at each place the first rule,
in the order given, whose identifiers follow there names a licence and consumes them.

Notices ("Distributed under the terms of the X") are built by rule from phrases and the names of
licences, and SPDX lines from their grammar; both give an identifier that holds the licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame

from .cluster import numbered, renumbered

# Sentences of public licences and of the notices that name them.
SENTENCES = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.asis": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "mit.liable": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd.asis": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "zero.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost.title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "apache.title": "Apache License Version 2.0, January 2004",
    "apache.terms": "Terms and conditions for use, reproduction, and distribution",
    "apache.header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache.comply": "you may not use this file except in compliance with the License",
    "gpl1.title": "GNU General Public License Version 1, February 1989",
    "gpl2.title": "GNU General Public License Version 2, June 1991",
    "gpl3.title": "GNU General Public License Version 3, 29 June 2007",
    "lgpl2.title": "GNU Library General Public License Version 2, June 1991",
    "lgpl21.title": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl3.title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "agpl3.title": "GNU Affero General Public License Version 3, 19 November 2007",
    "gnu.verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    "gnu.free.program": "This program is free software",
    "gnu.free.library": "This library is free software",
    "gnu.free.software": "This software is free software",
    "gnu.free.file": "This file is free software",
    "mpl11.title": "Mozilla Public License Version 1.1",
    "mpl2.title": "Mozilla Public License Version 2.0",
    "mpl2.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "epl1.title": "Eclipse Public License - v 1.0",
    "epl2.title": "Eclipse Public License - v 2.0",
    "eupl12.title": "European Union Public Licence v. 1.2",
    "artistic2.title": "The Artistic License 2.0",
    "wtfpl.title": "Do what the fuck you want to public license",
    "cc0.title": "CC0 1.0 Universal",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}

# Names of licences in notices, as "identifier: name; name; ..." (articles do not count; a missing "License" is added by rule).
NAMES = """
MIT: MIT; MIT/X11; X11 License; Expat License
ISC: ISC
0BSD: 0BSD; Zero-Clause BSD
BSD-2-Clause: BSD-2-Clause; BSD 2-Clause; 2-clause BSD; Simplified BSD; FreeBSD License
BSD-3-Clause: BSD-3-Clause; BSD 3-Clause; 3-clause BSD; New BSD; Modified BSD; Revised BSD
Apache-2.0: Apache-2.0; Apache 2.0; Apache 2; Apache License, Version 2.0; Apache License 2.0; Apache License v2.0; Apache License, Version 2; Apache Software License 2.0
GPL-2.0-only: GPL-2.0; GPLv2; GPL v2; GPL 2; GNU GPL v2; GNU General Public License, version 2; GNU General Public License v2.0; GNU General Public License 2; GPL version 2
GPL-2.0-or-later: GPL-2.0-or-later; GPLv2+; GPL 2 or later; GNU General Public License, version 2 or later; GNU General Public License v2.0 or later
GPL-3.0-only: GPL-3.0; GPLv3; GPL v3; GPL 3; GNU GPL v3; GNU General Public License, version 3; GNU General Public License v3.0; GNU General Public License 3; GPL version 3
GPL-3.0-or-later: GPL-3.0-or-later; GPLv3+; GPL 3 or later; GNU General Public License, version 3 or later; GNU General Public License v3.0 or later
LGPL-2.1-only: LGPL-2.1; LGPLv2.1; LGPL v2.1; GNU LGPL v2.1; GNU Lesser General Public License, version 2.1; GNU Lesser General Public License v2.1
LGPL-2.1-or-later: LGPL-2.1-or-later; LGPLv2.1+; GNU Lesser General Public License, version 2.1 or later
LGPL-3.0-only: LGPL-3.0; LGPLv3; LGPL v3; GNU LGPL v3; GNU Lesser General Public License, version 3; GNU Lesser General Public License v3.0
LGPL-3.0-or-later: LGPL-3.0-or-later; LGPLv3+; GNU Lesser General Public License, version 3 or later
AGPL-3.0-only: AGPL-3.0; AGPLv3; AGPL v3; GNU AGPL v3; GNU Affero General Public License, version 3; GNU Affero General Public License v3.0
AGPL-3.0-or-later: AGPL-3.0-or-later; AGPLv3+; GNU Affero General Public License, version 3 or later
MPL-1.1: MPL-1.1; MPL 1.1; Mozilla Public License 1.1; Mozilla Public License, version 1.1
MPL-2.0: MPL-2.0; MPL 2.0; Mozilla Public License 2.0; Mozilla Public License, version 2.0; Mozilla Public License, v. 2.0
EPL-1.0: EPL-1.0; EPL 1.0; Eclipse Public License 1.0; Eclipse Public License v1.0; Eclipse Public License - v 1.0
EPL-2.0: EPL-2.0; EPL 2.0; Eclipse Public License 2.0; Eclipse Public License v2.0; Eclipse Public License - v 2.0
EUPL-1.2: EUPL-1.2; EUPL 1.2; European Union Public Licence v. 1.2; European Union Public Licence 1.2
BSL-1.0: BSL-1.0; Boost Software License 1.0; Boost Software License, Version 1.0; Boost License 1.0
Zlib: zlib; zlib/libpng
Artistic-2.0: Artistic License 2.0; Artistic-2.0
Unlicense: Unlicense
WTFPL: WTFPL
CC0-1.0: CC0; CC0 1.0; CC0-1.0; CC0 1.0 Universal; Creative Commons Zero v1.0 Universal
ODbL-1.0: ODbL; ODbL-1.0; Open Database License; Open Database License 1.0
GFDL-1.3: GFDL 1.3; GNU Free Documentation License; GNU Free Documentation License, version 1.3
"""
#: Creative Commons conditions: code and long name; versions with what may follow them.
CONDITIONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERSIONS = {"4.0": " International", "3.0": " Unported", "2.5": " Generic", "2.0": " Generic", "1.0": " Generic"}
#: What stands before a licence's name in a notice.
NOTICES = [f"{a} {b}" for a, b in product("licensed released distributed published provided available offered redistributable shared".split(), ("under", "under terms of", "under terms and conditions of", "under conditions of", "under either", "under either of"))]
NOTICES += ["subject to terms of", "covered by", "governed by", "use of this source code is governed by", "license", "licence"]
#: Families by the beginning of an identifier; the rest are permissive if they are known.
COPYLEFT = ("GPL", "LGPL", "AGPL", "MPL", "EPL", "EUPL", "CDDL", "OSL", "ODbL", "GFDL", "CC-BY-SA")
RESTRICTED = ("CC-BY-NC", "CC-BY-ND", "BUSL", "SSPL", "PolyForm", "Elastic", "All-rights-reserved")
PERMISSIVE = ("MIT", "ISC", "0BSD", "BSD", "Apache", "BSL", "Zlib", "Artistic", "Unlicense", "WTFPL", "CC0", "CC-BY", "PSF", "Python", "PostgreSQL", "NCSA", "X11", "curl", "OpenSSL", "Ruby", "AFL", "ECL", "UPL", "MS-PL", "OFL", "Libpng", "blessing")
#: Words that may stand between two sentences of a rule.
GAP_WORDS = 60


def names() -> dict[str, list[str]]:
    """Every licence's names in notices."""
    out = {k: [n.strip() for n in v.split(";")] for k, v in (line.split(":", 1) for line in NAMES.strip().splitlines())}
    for (code, long), (version, region) in product(CONDITIONS.items(), VERSIONS.items()):
        spellings = [f"CC {code} {version}", f"CC-{code}-{version}", f"Creative Commons {long} {version}", f"Creative Commons {long} {version}{region}", f"Creative Commons {code} {version}", f"{long} {version}{region}"]
        out[f"CC-{code}-{version}"] = spellings + [f"Creative Commons {long} {version}{region} Public License"]
    return {k: [f"{n}{end}" for n in v for end in ("", " License")] for k, v in out.items()}


def kind_of(licence: str) -> str:
    """permissive, copyleft, restricted (reuse or sale forbidden) or unknown. Of alternatives the freest counts, of parts the strictest."""
    order = ["permissive", "copyleft", "unknown", "restricted"]
    options = []
    for option in re.split(r"\s+OR\s+", re.sub(r"[()]", " ", licence).strip()):
        parts = [re.split(r"\s+WITH\s+", p.strip())[0] for p in re.split(r"\s+AND\s+", option)]
        kinds = ["restricted" if p.startswith(RESTRICTED) else "copyleft" if p.startswith(COPYLEFT) else "permissive" if p.startswith(PERMISSIVE) else "unknown" for p in parts]
        options.append(max(kinds, key=order.index))
    return min(options, key=order.index)


@dataclass(frozen=True)
class LicenceRule:
    licence: str
    sentences: tuple[str, ...]

    @property
    def kind(self) -> str:
        return kind_of(self.licence)


def gnu_sentences() -> dict[str, str]:
    """The grants of GNU notices, by rule: gnu.<identifier>."""
    out = {}
    for (short, long), version in product({"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}.items(), ("2", "2.1", "3")):
        grant = f"you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation"
        number = version if "." in version else f"{version}.0"
        out[f"gnu.{short}-{number}-or-later"] = f"{grant}, either version {version} of the License, or (at your option) any later version"
        out[f"gnu.{short}-{number}-only"] = f"{grant}, version {version} of the License"
        out[f"gnu.{short}-{number}-only.short"] = f"{grant}, version {version}"
    return out


def _rules(*rows: str) -> tuple[LicenceRule, ...]:
    return tuple(LicenceRule(a, tuple(c)) for a, *c in map(str.split, rows))


#: In order: whole licences before single sentences. Notices and SPDX lines name their licence themselves.
RULES = _rules(
    "MIT mit.grant mit.notice mit.asis mit.liable",
    "MIT mit.grant mit.notice",
    "ISC isc.grant",
    "0BSD zero.grant",
    "BSD-4-Clause bsd.grant bsd.source bsd.binary bsd.advertising bsd.names",
    "BSD-3-Clause bsd.grant bsd.source bsd.binary bsd.names",
    "BSD-2-Clause bsd.grant bsd.source bsd.binary",
    "Zlib zlib.asis zlib.grant",
    "Zlib zlib.grant",
    "BSL-1.0 boost.title",
    "Apache-2.0 apache.title apache.terms",
    "Apache-2.0 apache.title",
    "Apache-2.0 apache.header apache.comply",
    "Apache-2.0 apache.header",
    *(f"{licence} {title} {more}" for more in ("gnu.verbatim", "") for licence, title in (("GPL-1.0-only", "gpl1.title"), ("GPL-2.0-only", "gpl2.title"), ("GPL-3.0-only", "gpl3.title"), ("LGPL-2.0-only", "lgpl2.title"), ("LGPL-2.1-only", "lgpl21.title"), ("LGPL-3.0-only", "lgpl3.title"), ("AGPL-3.0-only", "agpl3.title"))),
    *(f"{name.removeprefix('gnu.').removesuffix('.short')} gnu.free.{what} {name}" for name in gnu_sentences() for what in ("program", "library", "software", "file")),
    *(f"{name.removeprefix('gnu.').removesuffix('.short')} {name}" for name in gnu_sentences()),
    "MPL-1.1 mpl11.title",
    "MPL-2.0 mpl2.title",
    "MPL-2.0 mpl2.form",
    "EPL-1.0 epl1.title",
    "EPL-2.0 epl2.title",
    "EUPL-1.2 eupl12.title",
    "Artistic-2.0 artistic2.title",
    "WTFPL wtfpl.title",
    "CC0-1.0 cc0.title",
    "Unlicense unlicense",
    "All-rights-reserved reserved",
)

_WORD = re.compile(r"[^\W_]+")
_EDGE = re.compile(r"\n|[.!?;:]+(?=[\s\"')\]]|\Z)")
#: A bullet or number before a sentence of a list.
_BULLET = re.compile(r"(?:\d{1,2}|[a-z])\Z")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+(?:[ \t()]+[A-Za-z0-9.+-]+)*\)*)", re.I)
_ARTICLES = frozenset(("the", "a", "an"))
_SAME = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def words_of(sentence: str) -> list[str]:
    """The words of a sentence in lower case and one spelling, without articles."""
    return [_SAME.get(w, w) for w in _WORD.findall(sentence.lower()) if w not in _ARTICLES]


def _tree(sentences: Iterable[tuple[str, str]]) -> dict:
    root: dict = {}
    for name, sentence in sentences:
        node = root
        for w in words_of(sentence):
            node = node.setdefault(w, {})
        node[""] = name
    return root


class Scanner:
    def __init__(self, sentences: dict[str, str] | None = None, rules: tuple[LicenceRule, ...] = RULES, named: dict[str, list[str]] | None = None):
        """The tables to use; by default those of this module."""
        sentences = SENTENCES | gnu_sentences() if sentences is None else sentences
        named = names() if named is None else named
        self.rules = {}
        for r in rules:
            self.rules.setdefault(r.sentences[0], []).append(r)
        self.tree = _tree(sentences.items())
        self.notices = _tree((n, n) for n in NOTICES) if named else {}
        self.named = _tree((k, n) for k, v in named.items() for n in v)
        #: Each sentence's longest word: a text with none of them, and no notice, has no known sentence.
        longest = {max(words_of(x), key=len) for x in sentences.values()} | {max(words_of(n), key=len) for n in NOTICES if named}
        self.anchors = sorted({w[:-1] if w.endswith("e") else w for w in longest} | {"licenc", "spdx"})

    def _walk(self, root: dict, words: list, i: int) -> list[tuple[str, int]]:
        """The names that end in the tree on the way from word i, each with its last word."""
        node, k, out = root, i, []
        while k < len(words):
            w = words[k][0]
            if w not in _ARTICLES:
                node = node.get(w)
                if node is None:
                    break
                if "" in node:
                    out.append((node[""], k))
            k += 1
        return out

    def sentences(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(identifier, start, end, first word, last word) of the known sentences, in order.

        A sentence begins after the end of another or of a line, and ends likewise; it may run over line
        ends. A notice begins anywhere, unless "not" stands before it, and ends with a licence's name that
        punctuation, "and" or "or" follows. Of several that begin together the longest counts.
        """
        low = (text or "").lower()
        if not any(a in low for a in self.anchors):
            return []
        spdx = {m.start(): (f"={' '.join(m[1].split())}", m.start(), m.end(1)) for m in _SPDX.finditer(text)}
        words = [(_SAME.get(w := m[0].lower(), w), m.start(), m.end()) for m in _WORD.finditer(text)]
        gaps = [text[a[2] : b[1]] for a, b in zip(words, words[1:], strict=False)] + ["\n"]
        edge = [bool(_EDGE.search(g)) for g in gaps[:-1]] + [True]
        out, i = [], 0
        while i < len(words):
            word, start, _ = words[i]
            if start in spdx:
                name, a, b = spdx[start]
                last = i
                while last + 1 < len(words) and words[last + 1][1] < b:
                    last += 1
                out.append((name, a, b, i, last))
                i = last + 1
                continue
            best, first = None, i
            while words[first][0] in _ARTICLES and first + 1 < len(words):
                first += 1
            if words[first][0] in self.tree and (i == 0 or edge[i - 1] or (bool(_BULLET.match(words[i - 1][0])) and (i == 1 or edge[i - 2]))):
                best = max(((k, name) for name, k in self._walk(self.tree, words, i) if edge[k]), default=None)
            if best:
                out.append((best[1], start, words[best[0]][2], i, best[0]))
                i = best[0] + 1
                continue
            if word in self.notices and not (i and words[i - 1][0] in ("not", "never", "isn", "t")):
                at = i
                for _, k in reversed(self._walk(self.notices, words, i)):
                    after = k + 1
                    while True:
                        found = [(e, name) for name, e in self._walk(self.named, words, after) if gaps[e].strip() or "\n" in gaps[e] or words[e + 1][0] in ("and", "or")]
                        if not found:
                            break
                        e, name = max(found)
                        out.append((f"={name}", words[i][1], words[e][2], i, e))
                        at = e + 1
                        if not (at < len(words) and words[at][0] in ("and", "or")):
                            break
                        after = at + 1
                    if at > i:
                        break
                if at > i:
                    i = at
                    continue
            i += 1
        return out

    def scan(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """(licence, kind, start, end) of each rule that matches, in order. Between two sentences of a rule stand at most GAP_WORDS words."""
        found, out, i = self.sentences(text), [], 0
        while i < len(found):
            name, start, end = found[i][:3]
            if name.startswith("="):
                out.append((name[1:], kind_of(name[1:]), start, end))
                i += 1
                continue

            def follows(rule: LicenceRule) -> bool:
                part = found[i : i + len(rule.sentences)]  # noqa: B023
                return tuple(f[0] for f in part) == rule.sentences and all(b[3] - a[4] - 1 <= GAP_WORDS for a, b in zip(part, part[1:], strict=False))

            rule = next((r for r in self.rules.get(name, ()) if follows(r)), None)
            if rule:
                out.append((rule.licence, rule.kind, start, found[i + len(rule.sentences) - 1][2]))
            i += len(rule.sentences) if rule else 1
        return out


def scan_licences(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """A row per document: doc_id, licences (names in order, each once, joined by a comma), n_matches, restricted
    (whether one forbids reuse or sale) and spans (licence, start, end in code points).

    Null and empty texts match nothing; a very long text is scanned whole. Of rules that match at one
    place the first counts. Repeated rows are scanned each; a null doc_id stays null; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    reader = scanner or Scanner()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [reader.scan(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "no_id": batch["no_id"],
                "licences": [",".join(dict.fromkeys(f[0] for f in x)) for x in found],
                "n_matches": [len(x) for x in found],
                "restricted": [any(f[1] == "restricted" for f in x) for x in found],
                "spans": [[{"licence": f[0], "start": f[2], "end": f[3]} for f in x] for x in found],
            })

    rows = numbered(docs, "doc_id", text="string")
    return renumbered(rows.mapInPandas(scan, "doc_id long, no_id boolean, licences string, n_matches long, restricted boolean, spans array<struct<licence: string, start: long, end: long>>"))
