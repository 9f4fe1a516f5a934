"""Licence scan: ordered signature rules over a text's words.

A text is brought to its words (A-Z lower-cased, everything else between words becomes one space), so rules match across line breaks
and punctuation. A rule is a regular expression over words with a priority, a confidence and keywords, of which every match of it holds
one each; it runs only where they stand. Detections are looked at by priority (of equal priority the longer first, then the earlier): one
whose interval lies inside a kept one's is suppressed. One that only shares some words with kept ones stays, since they don't explain all
its words; so does one that contains a kept one of higher priority. The rules are terms (the wording of notices, headers and clauses),
and frames (how a licence is declared) times names (what it is called).

Beside them, base phrases are found at all word positions where their words stand consecutively; no rule suppresses them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches, text_bytes

#: Bytes to a word's bytes (A-Z lower-cased) or a space.
TO_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

VERSION = r"(?: v| version| ver)?"

#: (label, keywords of which one stands in every match, regular expression of the name in words, whether the bare name declares the licence)
NAMES = [
    ("mit", "mit", r"mit", False),
    ("mit-0", "attribution", r"mit no attribution", True),
    ("x11", "x11", r"x11", False),
    ("isc", "isc", r"isc", False),
    ("zlib", "zlib", r"zlib(?: libpng)?", False),
    ("libpng", "libpng", r"libpng", False),
    ("apache-1", "apache", rf"apache(?: software)?(?: license)?{VERSION} 1(?: [01])?", True),
    ("apache-2", "apache", rf"apache(?: software)?(?: license)?{VERSION} 2(?: 0)?", True),
    ("bsd-0-clause", "0bsd|bsd zero", r"0bsd|bsd zero clause", True),
    ("bsd-2-clause", "bsd", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd", True),
    ("bsd-3-clause", "bsd", r"bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", True),
    ("bsd-4-clause", "bsd", r"bsd 4 clause|4 clause bsd|original bsd", True),
    ("gpl-1", "gpl|general public", rf"(?:gnu general public license|gnu gpl|gpl){VERSION} ?1", True),
    ("gpl-2", "gpl|general public", rf"(?:gnu general public license|gnu gpl|gpl){VERSION} ?2", True),
    ("gpl-3", "gpl|general public", rf"(?:gnu general public license|gnu gpl|gpl){VERSION} ?3", True),
    ("gpl", "gpl|general public", r"gnu general public license|gnu gpl|gpl", False),
    ("lgpl-2.1", "lgpl|lesser general|library general", rf"(?:gnu lesser general public license|gnu library general public license|gnu lgpl|lgpl){VERSION} ?2(?: [01])?", True),
    ("lgpl-3", "lgpl|lesser general", rf"(?:gnu lesser general public license|gnu lgpl|lgpl){VERSION} ?3", True),
    ("lgpl", "lgpl|lesser general", r"gnu lesser general public license|gnu lgpl|lgpl", False),
    ("agpl-3", "agpl|affero", rf"(?:gnu affero general public license|affero gpl|gnu agpl|agpl){VERSION} ?3", True),
    ("agpl", "agpl|affero", r"gnu affero general public license|affero gpl|gnu agpl|agpl", False),
    ("gfdl", "free documentation", r"gnu free documentation license", True),
    ("mpl-1", "mpl|mozilla", rf"(?:mozilla public license|mpl){VERSION} 1(?: [01])?", True),
    ("mpl-2", "mpl|mozilla", rf"(?:mozilla public license|mpl){VERSION} 2(?: 0)?", True),
    ("epl-1", "epl|eclipse", rf"(?:eclipse public license|epl){VERSION} 1(?: 0)?", True),
    ("epl-2", "epl|eclipse", rf"(?:eclipse public license|epl){VERSION} 2(?: 0)?", True),
    ("eupl", "eupl|european union", rf"european union public licen[cs]e|eupl{VERSION} 1(?: [0-2])?", True),
    ("cddl", "cddl|common development", rf"common development and distribution license|cddl{VERSION} 1(?: [01])?", True),
    ("cpl", "common public", r"common public license", True),
    ("artistic-1", "artistic", rf"artistic license{VERSION} 1(?: 0)?", True),
    ("artistic-2", "artistic", rf"artistic license{VERSION} 2(?: 0)?", True),
    ("bsl-1", "boost", rf"boost software license(?:{VERSION} 1(?: 0)?)?", True),
    ("unlicense", "unlicense", r"unlicense", False),
    ("wtfpl", "wtfpl", r"wtfpl", True),
    ("ofl-1.1", "ofl|open font", rf"sil open font license(?:{VERSION} 1(?: [01])?)?|ofl", False),
    ("postgresql", "postgresql", r"postgresql", False),
    ("python-2", "python|psf", rf"python software foundation license|psf license|python license{VERSION} 2(?: 0)?", False),
    ("php-3", "php", rf"php license{VERSION} 3(?: [01]+)?", True),
    ("ms-pl", "ms pl|microsoft public", r"microsoft public license|ms pl", False),
    ("ms-rl", "ms rl|microsoft reciprocal", r"microsoft reciprocal license|ms rl", False),
    ("ncsa", "ncsa|illinois", r"university of illinois(?: ncsa)? open source license|ncsa", False),
    ("openssl", "openssl", r"openssl", False),
    ("cc0", "cc0|creative commons", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", True),
    ("cc-by-nc-nd", "cc|creative commons", r"(?:cc|creative commons)(?: by| attribution)(?: nc| non ?commercial)(?: nd| no ?deriv\w+)(?: [1-4](?: [05])?)?", True),
    ("cc-by-nc-sa", "cc|creative commons", r"(?:cc|creative commons)(?: by| attribution)(?: nc| non ?commercial)(?: sa| share ?alike)(?: [1-4](?: [05])?)?", True),
    ("cc-by-nc", "cc|creative commons", r"(?:cc|creative commons)(?: by| attribution)(?: nc| non ?commercial)(?: [1-4](?: [05])?)?", True),
    ("cc-by-nd", "cc|creative commons", r"(?:cc|creative commons)(?: by| attribution)(?: nd| no ?deriv\w+)(?: [1-4](?: [05])?)?", True),
    ("cc-by-sa", "cc|creative commons", r"(?:cc|creative commons)(?: by| attribution)(?: sa| share ?alike)(?: [1-4](?: [05])?)?", True),
    ("cc-by", "cc|creative commons", r"(?:cc|creative commons)(?: by| attribution)(?: [1-4](?: [05])?)?", False),
    ("odbl", "odbl|open database", r"open database license|odbl", True),
    ("odc-by", "odc by|open data commons", r"open data commons attribution license|odc by", True),
    ("public-domain", "public domain", r"(?:the )?public domain", False),
]

GRANT = r"(?:licensed|released|distributed|available|provided|published|covered|shared|redistribute it|used|open sourced)"
#: (priority, confidence, keyword, frame; {} is the name)
FRAMES = [
    (100, 1.0, "spdx", r"spdx license identifier (?:{})"),
    (90, 0.98, "under", GRANT + r" under (?:the )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?(?:{})(?: licen[cs]e)?"),
    (80, 0.95, "th", r"(?:this|the) (?:work|software|program|project|file|code|document|package|library|text|page|content) (?:is|are) (?:\S+ ){{0,3}}(?:{})(?: licen[cs]e)?"),
    (70, 0.9, "licen", r"(?:under|see|with|by) (?:the )?(?:{}) licen[cs]e"),
    (60, 0.8, "licen", r"licen[cs]e (?:is )?(?:the )?(?:{})"),
    (50, 0.7, "licen", r"(?:the )?(?:{}) licen[cs]e"),
    (30, 0.5, "", r"(?:{})"),
]

#: (label, priority, confidence, keyword, regular expression): terms without a licence's name.
TERMS = [
    ("proprietary", 85, 0.9, "reserved", r"all rights (?:are )?reserved"),
    ("proprietary", 95, 0.95, "proprietary", r"proprietary and confidential"),
    ("proprietary", 85, 0.9, "permission", r"may not be (?:copied|reproduced|redistributed|distributed) without (?:prior |express |written )*permission"),
    ("mit", 95, 0.97, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 95, 0.97, "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd-3-clause", 94, 0.95, "endorse or promote", r"neither the name of \S+(?: \S+){0,8} may be used to endorse or promote products"),
    ("bsd-2-clause", 93, 0.9, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("unlicense", 95, 0.97, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", 95, 0.95, "as is", r"this software is provided as is without any express or implied warranty in no event"),
    ("public-domain", 85, 0.85, "public domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("public-domain", 85, 0.85, "copyright", r"(?:no copyright is claimed|the authors? disclaims? copyright to this source code)"),
    ("public-domain", 84, 0.8, "united states government", r"work of the united states government"),
    ("mit", 92, 0.9, "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 91, 0.85, "without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 91, 0.85, "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("x11", 93, 0.9, "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 91, 0.85, "author disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", 91, 0.85, "fee is hereby granted", r"with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", 92, 0.9, "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 92, 0.9, "altered source", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 92, 0.9, "redistribute it freely", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsd-2-clause", 92, 0.85, "list of conditions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", 92, 0.85, "binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-4-clause", 96, 0.95, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", 91, 0.8, "and contributors", r"this software is provided by the (?:copyright holders and contributors|regents and contributors) as is and any express or implied warranties"),
    ("bsd-3-clause", 90, 0.8, "bsd style", r"use of this source code is governed by a bsd style licen[cs]e"),
    ("apache-2", 96, 0.97, "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 90, 0.9, "apache org", r"you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2", 90, 0.85, "limitations under the license", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", 89, 0.8, "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 90, 0.9, "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1", 94, 0.9, "apache", r"this product includes software developed by the apache software foundation http www apache org"),
    ("gpl-2", 97, 0.97, "general public", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-3", 97, 0.97, "general public", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl-2.1", 97, 0.97, "general public", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation (?:either )?version 2(?: 1)?"),
    ("lgpl-3", 97, 0.97, "general public", r"redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl-3", 97, 0.97, "affero", r"redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3"),
    ("gpl", 88, 0.8, "general public", r"see the gnu general public license for more details"),
    ("gpl", 88, 0.8, "general public", r"you should have received a copy of the gnu general public license along with"),
    ("lgpl", 88, 0.8, "general public", r"see the gnu (?:lesser|library) general public license for more details"),
    ("lgpl", 88, 0.8, "general public", r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", 88, 0.8, "affero", r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl", 88, 0.8, "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("gfdl", 96, 0.95, "invariant sections", r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ("mpl-2", 96, 0.97, "mozilla", r"this source code form is subject to the terms of the mozilla public license(?: v| version) 2 0"),
    ("mpl-2", 90, 0.9, "mozilla org", r"you can obtain one at https? (?:www )?mozilla org mpl 2 0"),
    ("mpl-2", 90, 0.85, "incompatible with secondary", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1", 95, 0.95, "mozilla", r"the contents of this file are subject to the mozilla public license(?: version)? 1 1"),
    ("epl-1", 96, 0.95, "eclipse", r"accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2", 96, 0.95, "eclipse", r"accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2 0"),
    ("eupl", 95, 0.95, "eupl", r"licensed under the eupl (?:version|v) 1 [0-2] or as soon they will be approved by the european commission"),
    ("cddl", 95, 0.95, "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", 95, 0.95, "common public", r"the accompanying program is provided under the terms of this common public license"),
    ("artistic-2", 92, 0.9, "modified versions", r"you are permitted to use and create and use modified versions for any purpose without restriction provided that you do not distribute the modified version"),
    ("artistic-1", 92, 0.9, "artistic", r"you may distribute under the terms of either the gnu general public license or the artistic license"),
    ("bsl-1", 96, 0.97, "boost", r"distributed under the boost software license version 1 0"),
    ("bsl-1", 92, 0.9, "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor"),
    ("wtfpl", 95, 0.95, "do what the", r"do what the f\S+ you want to public licen[cs]e"),
    ("unlicense", 92, 0.9, "compiled binary", r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("unlicense", 92, 0.9, "unlicense org", r"please refer to https? unlicense org"),
    ("ofl-1.1", 95, 0.95, "font software", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 90, 0.85, "reserved font name", r"with reserved font names?"),
    ("postgresql", 92, 0.85, "written agreement", r"without fee and without a written agreement is hereby granted provided that the above copyright notice"),
    ("python-2", 92, 0.9, "python software foundation", r"(?:copyright c \S+(?: \S+){0,20} )?python software foundation all rights reserved"),
    ("php-3", 92, 0.9, "php net", r"this product includes php software freely available from https? www php net"),
    ("openssl", 94, 0.9, "this product includes", r"this product includes (?:software developed by the openssl project|cryptographic software written by)"),
    ("ncsa", 92, 0.9, "with the software without restriction", r"to deal with the software without restriction including without limitation the rights to use"),
    ("cc0", 96, 0.95, "waive", r"(?:has|have) (?:dedicated the work to the public domain by )?waived? all (?:of his or her |copyright and related or neighboring )rights"),
    ("cc0", 96, 0.97, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", 90, 0.9, "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-nd", 96, 0.97, "creativecommons", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", 96, 0.97, "creativecommons", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc", 95, 0.97, "creativecommons", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", 95, 0.97, "creativecommons", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-sa", 95, 0.97, "creativecommons", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by", 95, 0.97, "creativecommons", r"creativecommons org licenses by [1-4] [05]"),
    ("odbl", 95, 0.95, "opendatacommons", r"opendatacommons org licenses odbl 1 0"),
    ("odc-by", 95, 0.95, "opendatacommons", r"opendatacommons org licenses by 1 0"),
    ("proprietary", 94, 0.9, "trade secret", r"(?:contains|constitutes?|are|is) (?:the )?(?:confidential|proprietary|valuable)(?: and (?:confidential|proprietary))? (?:information and )?trade secrets?"),
    ("proprietary", 94, 0.9, "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or (?:copying|use|reproduction|distribution))? of this (?:file|document|software|material|work)(?: via any medium)? is (?:strictly )?prohibited"),
    ("proprietary", 85, 0.85, "no part of", r"no part of this (?:publication|book|document|work|material|site) may be (?:copied|reproduced|stored|transmitted|distributed)"),
    ("proprietary", 84, 0.8, "commercial use only", r"for (?:your )?personal (?:and )?non ?commercial use only"),
    ("proprietary", 84, 0.8, "for evaluation", r"(?:licensed|provided) for evaluation (?:purposes|use) only"),
    ("proprietary", 85, 0.85, "end user", r"(?:subject to|governed by|under) (?:the |this |an )?end user licen[cs]e agreement"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keywords: tuple[tuple[bytes, ...], ...]  # one of each
    pattern: re.Pattern


def build_rules() -> list[Rule]:
    """All rules, the highest priority first."""
    found = [Rule(label, priority, confidence, _keywords(keyword), _compiled(rx)) for label, priority, confidence, keyword, rx in TERMS]
    for label, keyword, name, bare in NAMES:
        for priority, confidence, gate, frame in FRAMES:
            if gate or bare:
                found.append(Rule(label, priority, confidence, _keywords(keyword, gate), _compiled(frame.format(name))))
    return sorted(found, key=lambda r: -r.priority)


def _keywords(*any_of: str) -> tuple[tuple[bytes, ...], ...]:
    return tuple(tuple(x.encode() for x in k.split("|")) for k in any_of if k)


def _compiled(words: str) -> re.Pattern:
    return re.compile(rf"(?<= )(?:{words})(?= )".encode())


RULES = build_rules()
KEYWORDS = {k for r in RULES for k in r.keywords}
#: A text without any of these holds no match of any rule: a literal of each frame and name, and a keyword of each term.
GATES = (b"licen", b"reserved", b"proprietary", b"permission", b"redistribution", b"endorse", b"unencumbered", b" as is ", b"public domain", b"apache", b"bsd", b"gpl", b"gnu ", b" mpl ", b"mozilla", b"epl ", b"eclipse", b"eupl", b"european union", b"cddl", b"common ", b"wtfpl", b"cc0", b" cc ", b"creative commons", b"odbl", b"odc ", b"open d", b"mit no attribution", b"spdx", b" under ", b"x11", b" mit ", b" isc ", b" zlib ", b"libpng", b"openssl", b"postgresql", b" ms pl ", b" ms rl ", b"ncsa", b" ofl ", b" psf ")
GATES += tuple(sorted({k.encode() for _, _, _, k, _ in TERMS if not any(g in k.encode() for g in GATES)}))


def detect(text: bytes) -> list[tuple[int, int, Rule]]:
    """Kept detections as byte intervals of a normalised text (words between single spaces, a space at each end)."""
    if not any(g in text for g in GATES):
        return []
    found = []
    here = {k: any(x in text for x in k) for k in KEYWORDS}
    for rule in RULES:
        if all(here[k] for k in rule.keywords):
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text)]
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
    starts: list[int] = []  # of kept intervals that lie in no other kept one, in order; their ends are in order as well
    ends: list[int] = []
    kept = []
    for s, e, rule in found:
        i = bisect_right(starts, s)
        if i and ends[i - 1] >= e:
            continue
        kept.append((s, e, rule))
        low, high = bisect_left(starts, s), bisect_right(ends, e)  # those between lie in this one
        starts[low:high] = [s]
        ends[low:high] = [e]
    return sorted(kept, key=lambda x: x[:2])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,confidence:double>>"


def license_scan(docs: DataFrame, phrases: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the number of words; places, first and last start of the base phrases (null if none) and their labels; all labels;
    score, the confidence of the best kept detection (1 for a base phrase, 0 for none); detections in words, end exclusive.

    Null and empty texts have no words and no labels (empty strings). Repeated rows stay. Other columns aren't looked at. No shuffle.
    """
    base = [(b" " + b" ".join(p.encode().translate(TO_WORDS).split()) + b" ", label) for p, label in phrases.items()]

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            rows = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                words = raw[a:b].translate(TO_WORDS).split()
                text = b" " + b" ".join(words) + b" "
                places, labels = [], set()
                for phrase, label in base:
                    k = text.find(phrase)
                    while k >= 0:
                        places.append(k)
                        labels.add(label)
                        k = text.find(phrase, k + 1)
                kept = detect(text)
                starts, spans = [], []
                if places or kept:
                    space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)  # word i begins after space i
                    starts = np.searchsorted(space, places).tolist()
                    first, last = (np.searchsorted(space, x).tolist() for x in ([s - 1 for s, *_ in kept], [e for _, e, _ in kept]))
                    spans = [{"start": i, "end": j, "label": r.label, "confidence": r.confidence} for i, j, (*_, r) in zip(first, last, kept, strict=True)]
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {r.label for *_, r in kept})), 1.0 if labels else max((r.confidence for *_, r in kept), default=0.0), spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, SCHEMA)
