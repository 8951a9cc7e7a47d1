"""License scans by sentence rules.

A text is cut at line ends, sentence ends and blank lines. From each cut, spans of pieces, up to the length of the longest known sentence (so that
a sentence may be wrapped over any number of lines), are normalised - comment leaders dropped, lower case, only letters, digits and inner dots, spellings unified -
and looked up among the known licence sentences, in which * stands for any words (a holder's name, say), WILD characters at most; the longest known span wins, an exact one before one with a *. The sequence of identifiers is then matched against ordered rules: the longest rule first, its
identifiers in order, with up to GAP words that belong to no known sentence between them. Identifiers that belong to no rule are reported as they are. An SPDX line names its own licences: its expression is taken apart, each
identifier counts, in SPDX's spelling, and exceptions after WITH don't.

Each known sentence holds one of TRIGGERS within a word, however it is wrapped, so texts without any have no licence; they are only searched for that. Null or empty
texts: no licences; an empty table gives no rows. Very long texts are scanned whole. Repeated rows are scanned each; ties go to the rule listed first. Only the text and what the caller names are read, so other columns may have any names;
a named column called sentences or licences stands beside the result of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of no known sentence between two of a rule, and characters (normalised) that a * stands for, at most.
GAP, WILD = 30, 160
TRIGGERS = ("licen", "copyright", "reserved", "warrant", "spdx", "permission", "redistribut", "domain", "liab", "endorse")

#: identifier: sentences, as they are written; * stands for any words.
SENTENCES: dict[str, tuple[str, ...]] = {
    "copyright": ("Copyright *", "(c) Copyright *"),
    "all-rights": ("All rights reserved.",),
    "spdx": ("SPDX-License-Identifier: *",),
    "apache-2": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License")', "This work is licensed under the Apache License, Version 2.0."),
    "apache-use": ("you may not use this file except in compliance with the License.", "You may not use this work except in compliance with the License."),
    "apache-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "apache-asis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',),
    "apache-see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "MIT License", "The MIT License"),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "asis": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',),
    "mit-0": ("Licensed under the MIT-0 License.", "Licensed under the MIT No Attribution License."),
    "isc": ("ISC License", "The ISC License", "Licensed under the ISC License.", "Released under the ISC License."),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "author-disclaims": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',),
    "liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "gpl-3": ("Licensed under the GNU GPL version 3.", "Licensed under the GNU GPL v3.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3."),
    "gpl-2": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."),
    "gpl-3-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "* is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU General Public License, version 3 or later."),
    "gpl-2-later": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "* is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "Licensed under the GNU General Public License, version 2 or later."),
    "gpl-2-only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    "agpl-3-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "* is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "agpl-3": ("Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPLv3."),
    "lgpl-2.1-later": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl-3-later": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "lgpl-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "gpl-warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "* is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "gpl-received": ("You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU Affero General Public License along with this program.", "You should have received a copy of the GNU General Public License along with *"),
    "lgpl-3": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "bsd-redist": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the names of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-disclaimer": ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.', 'THIS SOFTWARE IS PROVIDED BY * "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    "bsd-3": ("BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "Licensed under the 3-Clause BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "bsd-2": ("BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", "Simplified BSD License"),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "zlib": ("zlib License", "Licensed under the zlib License."),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003", "Licensed under the Boost Software License, Version 1.0."),
    "epl-2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at *", "Licensed under the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0."),
    "epl-1": ("Licensed under the Eclipse Public License 1.0.", "Licensed under the Eclipse Public License, version 1.0."),
    "artistic-2": ("Licensed under the Artistic License 2.0.", "The Artistic License 2.0"),
    "eupl-1.2": ("Licensed under the EUPL, Version 1.2.", "Licensed under the European Union Public Licence 1.2."),
    "wtfpl": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "python-2": ("Licensed under the Python Software Foundation License.", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    "ofl-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "odbl": ("Licensed under the Open Database License.", "This database is made available under the Open Database License: *"),
    "bsd": ("Licensed under the BSD License.", "Released under the BSD License."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-nc-nd": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "cc-by-3": ("Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    "cc-by-sa-3": ("Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    "cc-zero": ("Released under the CC0 license.", "This work is dedicated to the public domain."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}

#: licence: ordered rules, each a sequence of identifiers.
RULES: dict[str, tuple[tuple[str, ...], ...]] = {
    "Apache-2.0": (("apache-2", "apache-use", "apache-copy", "apache-asis", "apache-see"), ("apache-2", "apache-use", "apache-copy"), ("apache-2", "apache-use"), ("apache-2",)),
    "MIT": (("mit", "copyright", "mit-grant", "mit-notice", "asis", "liability"), ("mit-grant", "mit-notice", "asis", "liability"), ("mit", "copyright", "mit-grant", "mit-notice", "asis"), ("mit", "mit-grant", "mit-notice", "asis"), ("mit-grant", "mit-notice", "asis"), ("mit-grant", "mit-notice"), ("mit-grant",), ("mit",)),
    "MIT-0": (("mit-0", "copyright", "mit-grant", "asis"), ("mit-0", "mit-grant"), ("mit-0",)),
    "ISC": (("isc", "copyright", "isc-grant", "author-disclaims"), ("isc-grant", "author-disclaims"), ("isc", "isc-grant"), ("isc-grant",), ("isc",)),
    "0BSD": (("0bsd-grant", "author-disclaims"), ("0bsd-grant",)),
    "GPL-3.0-or-later": (("gpl-3-later", "gpl-warranty", "gpl-received"), ("gpl-3-later", "gpl-warranty"), ("gpl-3-later",)),
    "GPL-2.0-or-later": (("gpl-2-later", "gpl-warranty", "gpl-received"), ("gpl-2-later", "gpl-warranty"), ("gpl-2-later",)),
    "AGPL-3.0-or-later": (("agpl-3-later", "gpl-warranty", "gpl-received"), ("agpl-3-later", "gpl-warranty"), ("agpl-3-later",)),
    "LGPL-2.1-or-later": (("lgpl-2.1-later", "gpl-warranty"), ("lgpl-2.1-later",)),
    "LGPL-3.0-or-later": (("lgpl-3-later", "gpl-warranty"), ("lgpl-3-later",)),
    "GPL-3.0-only": (("gpl-3",),),
    "GPL-2.0-only": (("gpl-2-only", "gpl-warranty"), ("gpl-2-only",), ("gpl-2",)),
    "AGPL-3.0-only": (("agpl-3",),),
    "LGPL-3.0-only": (("lgpl-3",),),
    "LGPL-2.1-only": (("lgpl-2.1",),),
    "MPL-2.0": (("mpl-2",),),
    "BSD-3-Clause": (("bsd-redist", "bsd-source", "bsd-binary", "bsd-names", "bsd-disclaimer"), ("bsd-redist", "bsd-source", "bsd-binary", "bsd-names"), ("bsd-3",)),
    "BSD-2-Clause": (("bsd-redist", "bsd-source", "bsd-binary", "bsd-disclaimer"), ("bsd-redist", "bsd-source", "bsd-binary"), ("bsd-2",)),
    "BSD": (("bsd",),),
    "Zlib": (("zlib", "zlib-grant"), ("zlib-grant",), ("zlib",)),
    "BSL-1.0": (("boost",),),
    "EPL-2.0": (("epl-2",),),
    "EPL-1.0": (("epl-1",),),
    "Artistic-2.0": (("artistic-2",),),
    "EUPL-1.2": (("eupl-1.2",),),
    "WTFPL": (("wtfpl",),),
    "PSF-2.0": (("python-2",),),
    "OFL-1.1": (("ofl-1.1",),),
    "ODbL-1.0": (("odbl",),),
    "CC-BY-4.0": (("cc-by",),),
    "CC-BY-SA-4.0": (("cc-by-sa",),),
    "CC-BY-NC-4.0": (("cc-by-nc",),),
    "CC-BY-ND-4.0": (("cc-by-nd",),),
    "CC-BY-NC-SA-4.0": (("cc-by-nc-sa",),),
    "CC-BY-NC-ND-4.0": (("cc-by-nc-nd",),),
    "CC-BY-3.0": (("cc-by-3",),),
    "CC-BY-SA-3.0": (("cc-by-sa-3",),),
    "CC0-1.0": (("cc-zero",),),
    "Unlicense": (("unlicense",),),
    "Proprietary": (("copyright", "all-rights"), ("all-rights",)),
}

#: Further identifiers in SPDX's spelling; those that SPDX has given up, with their successors.
SPDX = (
    "AFL-3.0", "APSL-2.0", "Apache-1.1", "Artistic-1.0", "BSD-1-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BUSL-1.1", "CC-BY-2.0", "CC-BY-2.5", "CC-BY-NC-3.0", "CC-BY-NC-SA-3.0", "CC-BY-NC-ND-3.0", "CC-BY-ND-3.0", "CC-BY-SA-2.5",
    "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EUPL-1.1", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only", "GPL-1.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later", "LPPL-1.3c", "MPL-1.1", "MPL-2.0-no-copyleft-exception",
    "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "NPL-1.1", "ODC-By-1.0", "OLDAP-2.8", "OSL-3.0", "OpenSSL", "PDDL-1.0", "PHP-3.01", "PostgreSQL", "Python-2.0", "QPL-1.0", "RPL-1.5", "Ruby", "SSPL-1.0", "UPL-1.0", "Unicode-DFS-2016", "Unicode-3.0", "Vim", "W3C", "X11", "ZPL-2.1", "curl",
)
RENAMED = {f"{name}{old}": f"{name}-{new}" for name in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.3") for old, new in (("", "only"), ("+", "or-later"))}
_SPELLED = {n.lower(): n for n in (*RULES, *SPDX)} | {old.lower(): new for old, new in RENAMED.items()}
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*(.*)", re.I)


def expression(text: str) -> list[str]:
    """The licences that an SPDX expression names, in order, each once; what follows WITH is no licence."""
    words = re.findall(r"[A-Za-z0-9.+:-]+", text)
    out = []
    for before, w in zip(["", *words], words, strict=False):
        if w.upper() not in ("AND", "OR", "WITH") and before.upper() != "WITH" and re.search("[A-Za-z0-9]", w):
            out.append(_SPELLED.get(w.lower(), w))
        elif before and before.upper() not in ("AND", "OR", "WITH") and w.upper() not in ("AND", "OR", "WITH"):
            break
    return list(dict.fromkeys(out))


_TRIGGER = re.compile("|".join(TRIGGERS), re.I)
_CUT = re.compile(r"\n+|(?<=[.!?])[ \t]+")
_LEADER = re.compile(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|-->|REM\b|dnl\b)[ \t]*", re.M)
_OTHER = re.compile(r"[^a-z0-9.]+")
_DOTS = re.compile(r"\.(?![a-z0-9])|(?<![a-z0-9])\.")


def normalise(sentence: str, leader: bool = True) -> str:
    """With leader, what a comment's line begins with is dropped."""
    s = (_LEADER.sub("", sentence) if leader else sentence).lower().replace("licence", "license").replace("https:", "http:")
    return " ".join(_DOTS.sub(" ", _OTHER.sub(" ", s)).split())


def _known() -> tuple[dict[str, str], list[tuple[str, str, str]], set[str]]:
    """Exact sentences; (beginning, end, identifier) of those with any words in between; the first words of all, or "" where one begins with any words."""
    exact, wild = {}, []
    for name, forms in SENTENCES.items():
        for form in forms:
            if not any(_TRIGGER.search(word) for word in normalise(form).split()):
                raise ValueError(f"no trigger in {form!r}")
            if "*" in form:
                begin, end = (normalise(x) for x in form.split("*"))
                wild.append((begin + " " if begin else "", " " + end if end else "", name))
            else:
                exact[normalise(form)] = name
    return exact, wild, {s.split()[0] for s in exact} | {b.split(" ")[0] for b, *_ in wild if b}


EXACT, WILDS, FIRST = _known()
_LONGEST = max(max(map(len, EXACT)), max(len(b) + len(e) for b, e, _ in WILDS) + WILD)
#: Sentences that begin with any words, by how they end; others by their first word.
_ENDINGS = [(e, name) for b, e, name in WILDS if not b]
_BEGINNINGS = [(b, e, name) for b, e, name in WILDS if b]
_ORDERED = sorted(((rule, name) for name, rules in RULES.items() for rule in rules), key=lambda x: -len(x[0]))


def _wild(s: str) -> tuple[str, str] | None:
    """(identifier, what * stands for) of a known sentence with any words."""
    for b, e, name in _BEGINNINGS:
        if s.startswith(b) and s.endswith(e) and len(b) + len(e) < len(s) <= len(b) + len(e) + WILD:
            return name, s[len(b) : len(s) - len(e)]
    for e, name in _ENDINGS:
        if s.endswith(e) and len(e) < len(s) <= len(e) + WILD:
            return name, s[: len(s) - len(e)]
    return None


def sentences(text: str) -> list[tuple[str, int, int, int, str, int]]:
    """(identifier, first piece, end character's start and end, what any words stand for, number of pieces) of the known sentences, in order."""
    if not _TRIGGER.search(text):
        return []
    cuts, at = [], 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            cuts.append((at, m.start()))
        at = m.end()
    if at < len(text):
        cuts.append((at, len(text)))
    inner: list[str | None] = [None] * len(cuts)  # pieces as they read inside a span, when asked for
    found, k = [], 0
    while k < len(cuts):
        head = normalise(text[cuts[k][0] : cuts[k][1]])
        best = None
        # a sentence that begins with any words may begin at any piece; its other words are looked for before
        if head and (head.partition(" ")[0] in FIRST or _OPEN.search(text, cuts[k][0], cuts[k][0] + 4 * WILD)):
            exact = -1
            s, m = head, k + 1
            while True:
                name = EXACT.get(s)
                if name:
                    best, exact = (name, m - k, ""), m
                elif exact < 0 and (held := _wild(s)) and (best is None or held[0] != best[0]):
                    best = (held[0], m - k, held[1])
                if len(s) > _LONGEST or m == len(cuts):
                    break
                start, stop = cuts[m]
                if inner[m] is None:
                    inner[m] = normalise(text[start:stop], leader=text[start - 1] == "\n")
                s = f"{s} {inner[m]}" if inner[m] else s
                m += 1
        if best:
            start, stop = cuts[k][0], cuts[k + best[1] - 1][1]
            rest = (_EXPRESSION.search(text, start, stop) or [best[2], best[2]])[1] if best[0] == "spdx" else best[2]
            found.append((best[0], k, start, stop, rest, best[1]))
            k += best[1]
        else:
            k += 1
    return found


#: What stands in all known sentences that begin with any words, near their beginning.
_OPEN = re.compile(r"\bis\s+(?:\S+\s+)?(?:free\s+(?:\S+\s+)?software|distributed\s+(?:\S+\s+)?in)\b", re.I)


def licences(found: list[tuple[str, int, int, int, str, int]], text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end) by the rules; each sentence counts for one licence."""
    used: set[int] = set()
    out = []
    near = lambda at, last: len(text[found[last][3] : found[at][2]].split()) <= GAP
    for k, (name, _, start, end, rest, _) in enumerate(found):
        if name == "spdx" and rest:
            out += [(x, start, end) for x in expression(rest)]
            used.add(k)
    for rule, name in _ORDERED:
        for k in range(len(found)):
            chain, at = [], k
            for want in rule:
                while at < len(found) and chain and found[at][0] != want and at not in used and found[at][0] == "copyright" and near(at, chain[-1]):
                    at += 1
                if at >= len(found) or at in used or found[at][0] != want or (chain and not near(at, chain[-1])):
                    break
                chain.append(at)
                at += 1
            if len(chain) == len(rule):
                used.update(chain)
                out.append((name, found[chain[0]][2], found[chain[-1]][3]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, text: str = "text", *more: Column) -> DataFrame:
    """What `more` names; sentences: the known sentences' identifiers in order; licences: struct(name, start, stop) in characters."""
    given = docs.select(*more, F.col(text).cast("string").alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [sentences(t or "") for t in texts]
            out = [[{"name": n, "start": a, "stop": b} for n, a, b in licences(f, t)] if f else [] for f, t in zip(found, texts, strict=True)]
            kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([[f[0] for f in x] for x in found], pa.list_(pa.string())), pa.array(out, kind)], names=[*batch.schema.names[:-1], "sentences", "licences"])

    return given.mapInArrow(run, f"{fields}sentences array<string>, licences array<struct<name:string,start:long,stop:long>>")
