"""License scans by sentence rules.

A text is cut into sentences (at line ends, and at ., !, ?, : or ; before white space, but not
in "v. 2"; also with single line ends taken as spaces, for notices wrapped over lines, once whole
and once cut at the ends of comments and copyright lines). Comment marks at line starts and ends
count as blanks. A sentence is normalised: lower case, runs of anything but letters, digits, '.',
'+', '/' and '-' become one space, outer marks go. A fixed table maps normalised sentences to sentence identifiers. Ordered licence
rules, each a sequence of identifiers, are matched against the document's identifier
sequence; identifiers of one match are consecutive, apart from up to ``MAX_GAP`` unknown
sentences. Earlier rules win, each sentence serves one match. A known sentence left over is reported as rule
``partial`` with the licence that its rules agree on, else ``UNKNOWN`` (a copyright line is not); "all
rights reserved" after a copyright line, where a licence's notice follows, is part of that notice. A sentence that mentions a licence
but is not in the table is reported as licence ``UNKNOWN``. SPDX tags give a row (rule ``spdx``)
per licence of their expression, as the tag names it.

Scope: notices, headers and tags of Apache-2.0, MIT, ISC, 0BSD, BSD, GPL, LGPL, AGPL, MPL-2.0, EPL,
Unlicense, CC BY 4.0 and its kin, CC0 in the wording of the table, and SPDX tags of any licence;
"or later" is a licence of its own, an unspecified BSD licence is ``BSD-unspecified``, a bare dedication
``LicenseRef-Public-Domain``; other licences are ``UNKNOWN`` where a sentence says that something stands under a licence. Full
licence texts (such as the whole GPL) are not recognised as such.

Only texts holding one of a few stems are cut; each table sentence holds one, so no match is
lost. Defined results: null, empty and licence-free texts give no row; spans are code points
in the text as stored; repeated documents give repeated rows; only id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm._text import text_column

MAX_GAP = 1
NEAR = 1000

# How a sentence names the licence that something stands under; what stands under it may come first.
UNDER = r"((\S+ ){0,6}(is|are) )?((dual )?(released|licensed|distributed|published|provided|(made )?available) )?under ((the|a|an) )?(terms of (the )?)?"
# Sentences of well-known licence notices, normalised, as patterns by identifier.
SENTENCES: dict[str, str] = {
    "apache2-short": r"(the asf licenses this file to you under the |" + UNDER + r")apache( software)? license,? (version |v)?2(\.0)?( the license)?",
    "apache2-compliance": r"you may not use this file except in compliance with the license",
    "apache2-obtain-asis": r"you may obtain a copy of the license at https? \S+ unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-obtain": r"you may obtain a copy of the license at( http.*)?",
    "apache2-asis": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": r"see the license for the specific language governing permissions and limitations under the license",
    "mit-short": UNDER + r"(mit|expat) license",
    "mit-title": r"(the )?mit license( mit)?",
    "mit-grant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .*",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis-software": r"the software is provided as is without warranty of any kind express or implied .*",
    "no-liability": r"in no event shall the authors or copyright holders be liable for any claim damages or other liability .*",
    "gpl3-short": UNDER + r"gnu general public license,? (version |v)3(\.0)?",
    "gpl2-short": UNDER + r"gnu general public license,? (version |v)2(\.0)?",
    "gpl-free": r"this \S+ is free software",
    "gpl-terms2": r"you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-terms2-one": r"this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-terms-either3": r"(this program is free software )?you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or( at your option)? any later version",
    "gpl-terms-either2": r"(this program is free software )?you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or( at your option)? any later version",
    "gpl-either3": r"either version 3 of the license or( at your option)? any later version",
    "gpl-either2": r"either version 2 of the license or( at your option)? any later version",
    "gpl-hope": r"this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redist": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": r"(\d\.? )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": r"(\d\.? )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": r"(\d\.? )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "lgpl2-short": UNDER + r"gnu (lesser|library) general public license,? (version |v)2(\.0)?",
    "lgpl21-short": UNDER + r"gnu lesser general public license,? (version |v)2\.1",
    "lgpl3-short": UNDER + r"gnu lesser general public license,? (version |v)3(\.0)?",
    "agpl3-short": UNDER + r"gnu affero general public license,? (version |v)3(\.0)?",
    "isc-grant": r"permission to use copy modify and(/or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": r"permission to use copy modify and(/or)? distribute this software for any purpose with or without fee is hereby granted",
    "isc-asis": r"the software is provided as is and .* disclaims? all warranties with regard to this software .*",
    "isc-short": UNDER + r"isc license",
    "epl1": r"(all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license (version |v\.? ?)?1\.0.*",
    "epl2": r"(all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license (version |v\.? ?)?2\.0.*",
    "epl1-short": UNDER + r"eclipse public license (version |v\.? ?)?1\.0",
    "epl2-short": UNDER + r"eclipse public license (version |v\.? ?)?2\.0",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "unlicense-short": UNDER + r"unlicense( license)?",
    "bsd-short": UNDER + r"(3-clause bsd|bsd 3-clause|bsd-3-clause|(new|modified|revised) bsd)( new or revised)? license",
    "bsd2-short": UNDER + r"(2-clause bsd|bsd 2-clause|bsd-2-clause|(simplified|freebsd) bsd)( simplified)? license",
    "bsd-any": UNDER + r"bsd license",
    "mpl2": r"this source code form is subject to the terms of the mozilla public license v\. 2\.0",
    "cc-by": UNDER + r"(cc[ -]by|creative commons attribution)[ -]4\.0( international)?( (public )?license)?",
    "cc-by-nc": UNDER + r"(cc[ -]by-nc|creative commons attribution-noncommercial)[ -]4\.0( international)?( (public )?license)?",
    "cc-by-sa": UNDER + r"(cc[ -]by-sa|creative commons attribution-sharealike)[ -]4\.0( international)?( (public )?license)?",
    "cc0": r"((\S+ ){0,6}(is|are) )?(hereby )?(dedicated to|released into|released to|placed in) the public domain under( the)? (cc0|creative commons (cc0|zero)).*",
    "public-domain": r"((\S+ ){0,6}(is|are) )?(hereby )?(dedicated to|released into|released to|placed in|in) the public domain",
    "reserved": r"all rights reserved",
    "copyright": r"copyright( c)? \d{4}.*",
}
# GNU licences "or later" are licences of their own.
for _short in ("gpl3", "gpl2", "lgpl3", "lgpl21", "lgpl2", "agpl3"):
    SENTENCES[f"{_short}-later"] = SENTENCES[f"{_short}-short"] + r"( of the license)?( or( at your option)?( any)? later( version)?| or newer|\+)"
    SENTENCES[f"{_short}-short"] += r"( of the license)?( only)?"
# Headers of the other GNU licences: (rule, licence, name, version); the terms and the version are
# one sentence or two, after "this library is free software" or with it.
_GNU = [("lgpl21", "LGPL-2.1-or-later", "lesser", "2.1"), ("lgpl2", "LGPL-2.0-or-later", "(lesser|library)", "2"),
        ("lgpl3", "LGPL-3.0-or-later", "lesser", "3"), ("agpl3", "AGPL-3.0-or-later", "affero", "3")]
for _rule, _, _name, _version in _GNU:
    _terms = rf"(this \S+ is free software )?you can redistribute it and/or modify it under the terms of the gnu {_name} general public license as published by the free software foundation"
    _either = rf"either version {re.escape(_version)} of the license or( at your option)? any later version"
    SENTENCES[f"{_rule}-terms-either"] = f"{_terms} {_either}"
    SENTENCES.setdefault(f"{_rule[:4]}-terms", _terms if _name == "affero" else _terms.replace(_name, "(lesser|library)"))
    SENTENCES.setdefault(f"gpl-either{_version.replace('.', '')}", _either)
# Ordered rules (name, licence, identifiers); longer rules stand before shorter.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("apache2-header", "Apache-2.0", ("apache2-short", "apache2-compliance", "apache2-obtain", "apache2-asis", "apache2-see")),
    ("apache2-header-one", "Apache-2.0", ("apache2-short", "apache2-compliance", "apache2-obtain-asis", "apache2-see")),
    ("mit-full", "MIT", ("mit-grant", "mit-notice", "asis-software", "no-liability")),
    ("bsd3", "BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd2", "BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("gpl3-header", "GPL-3.0-or-later", ("gpl-free", "gpl-terms2", "gpl-either3")),
    ("gpl3-header-one", "GPL-3.0-or-later", ("gpl-terms2-one", "gpl-either3")),
    ("gpl2-header", "GPL-2.0-or-later", ("gpl-free", "gpl-terms2", "gpl-either2")),
    ("gpl2-header-one", "GPL-2.0-or-later", ("gpl-terms2-one", "gpl-either2")),
    ("gpl3-sentence", "GPL-3.0-or-later", ("gpl-free", "gpl-terms-either3")),
    ("gpl3-sentence-one", "GPL-3.0-or-later", ("gpl-terms-either3",)),
    ("gpl2-sentence", "GPL-2.0-or-later", ("gpl-free", "gpl-terms-either2")),
    ("gpl2-sentence-one", "GPL-2.0-or-later", ("gpl-terms-either2",)),
    *((f"{r}-header", lic, ("gpl-free", f"{r[:4]}-terms", f"gpl-either{v.replace('.', '')}")) for r, lic, _, v in _GNU),
    *((f"{r}-header-one", lic, (f"{r[:4]}-terms", f"gpl-either{v.replace('.', '')}")) for r, lic, _, v in _GNU),
    *((f"{r}-sentence", lic, ("gpl-free", f"{r}-terms-either")) for r, lic, _, _ in _GNU),
    *((f"{r}-sentence-one", lic, (f"{r}-terms-either",)) for r, lic, _, _ in _GNU),
    ("isc-full", "ISC", ("isc-grant", "isc-asis")),
    ("0bsd-full", "0BSD", ("0bsd-grant", "isc-asis")),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("0bsd-grant", "0BSD", ("0bsd-grant",)),
    ("epl1", "EPL-1.0", ("epl1",)),
    ("epl2", "EPL-2.0", ("epl2",)),
    ("unlicense", "Unlicense", ("unlicense",)),
    ("lgpl21-notice", "LGPL-2.1", ("lgpl21-short",)),
    ("lgpl2-notice", "LGPL-2.0", ("lgpl2-short",)),
    ("lgpl3-notice", "LGPL-3.0", ("lgpl3-short",)),
    ("agpl3-notice", "AGPL-3.0", ("agpl3-short",)),
    ("isc-notice", "ISC", ("isc-short",)),
    ("epl1-notice", "EPL-1.0", ("epl1-short",)),
    ("epl2-notice", "EPL-2.0", ("epl2-short",)),
    ("unlicense-notice", "Unlicense", ("unlicense-short",)),
    ("mit-grant-notice", "MIT", ("mit-grant", "mit-notice")),
    ("apache2-notice", "Apache-2.0", ("apache2-short",)),
    ("mit-notice", "MIT", ("mit-short",)),
    ("gpl3-notice", "GPL-3.0", ("gpl3-short",)),
    ("gpl2-notice", "GPL-2.0", ("gpl2-short",)),
    ("bsd-notice", "BSD-3-Clause", ("bsd-short",)),
    ("bsd2-notice", "BSD-2-Clause", ("bsd2-short",)),
    ("bsd-unspecified", "BSD-unspecified", ("bsd-any",)),
    ("gpl3-later", "GPL-3.0-or-later", ("gpl3-later",)),
    ("gpl2-later", "GPL-2.0-or-later", ("gpl2-later",)),
    ("lgpl3-later", "LGPL-3.0-or-later", ("lgpl3-later",)),
    ("lgpl21-later", "LGPL-2.1-or-later", ("lgpl21-later",)),
    ("lgpl2-later", "LGPL-2.0-or-later", ("lgpl2-later",)),
    ("agpl3-later", "AGPL-3.0-or-later", ("agpl3-later",)),
    ("mpl2-notice", "MPL-2.0", ("mpl2",)),
    ("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc",)),
    ("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa",)),
    ("cc-by", "CC-BY-4.0", ("cc-by",)),
    ("cc0", "CC0-1.0", ("cc0",)),
    ("public-domain", "LicenseRef-Public-Domain", ("public-domain",)),
    ("all-rights", "Proprietary", ("reserved",)),
]
# Stems, one of which stands in every table sentence; and licence mentions.
STEMS = ("licen", "copyright", "rights reserved", "permission", "redistribut", "warrant", "free software", "public domain", "liab", "gpl")
MENTION = re.compile(r"\blicen[sc]ed? (to \S+ )?under\b|\bunder (the|an?) (\S+ ){1,4}licen[sc]es?\b|\bspdx-license-identifier\b"
                     r"|\b(under|subject to) the (same )?(terms|conditions|terms and conditions) of (\S+ ){0,10}licen[sc]es?\b"
                     r"|\b(governed|covered) by (the|an?) (\S+ ){1,6}licen[sc]es?\b|\bunder the (\S+ ){0,5}[al]?gpl([v\d]\S*)?(?= |$)")
# SPDX tags: an expression of licence identifiers on the tag's line; operators in small letters count
# before what is plainly an identifier
_SPDX_ID = r"[A-Za-z0-9](?:[\w.:-]*[A-Za-z0-9])?\+?"
_SPDX = re.compile(rf"(?i:SPDX-License-Identifier):[^\S\n]*(?P<ids>(?:\([^\S\n]*)*{_SPDX_ID}(?:[^\S\n]*\))*(?:(?:[^\S\n]+(?:AND|OR|WITH|(?:and|or|with)"
                   rf"(?=[^\S\n]+\(*(?:\S*[-\d]|(?i:mit|isc|zlib|unlicense)\b)))[^\S\n]+|/)(?:\([^\S\n]*)*{_SPDX_ID}(?:[^\S\n]*\))*)*)")
_SPDX_NAMES = {lic.lower(): lic for _, lic, _ in RULES if lic not in ("Proprietary", "BSD-unspecified", "LicenseRef-Public-Domain")}
#: Licence that a sentence of a rule points to, where all rules that hold it agree.
_HINT = {k: next(iter(names)) for k in SENTENCES for names in [{lic for _, lic, want in RULES if k in want}] if len(names) == 1}
_HINT["mit-title"] = "MIT"

#: Order in which matches that share text are kept.
_RANK = {r: k for k, r in enumerate([*(r[0] for r in RULES), "partial", "mention"])}
_KNOWN = [(k, re.compile(v)) for k, v in SENTENCES.items()]
_BORDER = "\x1e"  # stands for the line end where a comment or a copyright line ends, and for SPDX tags
_STOP = r"[.!?;:](?=\s|$)(?!(?<=\b[vV]\.)\s+\d)"
_END = re.compile(_STOP + r"|\n|" + _BORDER)
_WRAPPED_END = re.compile(_STOP + r"|\n[^\S\n]*\n|" + _BORDER)
# comment marks at the start and the end of a line, and where a comment of several lines opens and closes
_MARK = re.compile(r"(?:[^\S\n]*(?://+!?|/\*+!?|\*+/|\*+|--+|#+!?|;+|<!--+|\(\*+|\{-+|(?:dnl|@?rem)(?=\s|$)))+", re.I)
_MARK_END = re.compile(r"(?:(?<!\*)\*+[/)]|(?<!-)--+>?|(?<!-)-+\})\s*$")
_OPEN = re.compile(r"(?:^|(?<=\s))(?:/\*|<!--|\(\*|\{-)")
_CLOSE = re.compile(r"\*/|-->|\*\)|-\}")
_COPYRIGHT = re.compile(r"\s*copyright\b.*(?:\(c\)|©|\d{4})", re.I)
_OTHER = re.compile(r"[^\w.+/-]+|_+")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip(" .-/")


def identify(sentence: str) -> str | None:
    """Identifier of a normalised sentence."""
    if not any(s in sentence for s in STEMS):
        return None
    return next((k for k, p in _KNOWN if p.fullmatch(sentence)), None)


def sentences(text: str, end: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised) of the sentences of a text that are not empty."""
    at = 0
    for m in [*end.finditer(text), None]:
        stop = m.start() if m else len(text)
        if n := normalise(text[at:stop]):
            yield at, stop, n
        at = m.end() if m else stop


def uncomment(text: str) -> tuple[str, str]:
    """The text with comment marks at line starts and ends blanked, and the same with the ends of
    comments and of copyright lines as ``_BORDER``; both as long as the text, so spans hold."""
    plain, bordered = [], []
    inside = marked = False
    for line in text.split("\n"):
        m, z = _MARK.match(line), _MARK_END.search(line)
        bare = " " * m.end() + line[m.end():] if m else line
        if z and z.start() >= (m.end() if m else 0):
            bare = bare[:z.start()] + " " * (len(line) - z.start())
        was, marked = marked, inside or bool(m)
        opened, closed = [x.end() for x in _OPEN.finditer(line)], [x.end() for x in _CLOSE.finditer(line)]
        if opened or closed:
            inside = max(opened, default=-1) > max(closed, default=-1)
        if plain:
            bordered.append("\n" if was == marked and not _COPYRIGHT.match(plain[-1]) else _BORDER)
        plain.append(bare)
        bordered.append(bare)
    return "\n".join(plain), "".join(bordered)


def spdx_tags(text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end): licences of SPDX tags, each once per tag, an exception with its licence."""
    out = []
    for m in _SPDX.finditer(text):
        for one in dict.fromkeys(re.split(r"\s+(?:and|or)\s+|/", re.sub(r"[()]", " ", m["ids"]).strip(), flags=re.I)):
            name, *exception = re.split(r"\s+with\s+", one.strip(), flags=re.I)
            if re.match(r"[AL]?GPL-.*\+$", name, re.I):
                name = name[:-1] + "-or-later"
            name = "UNKNOWN" if name in ("NONE", "NOASSERTION") else _SPDX_NAMES.get(name.lower(), name)
            out.append((" WITH ".join([name, *exception]), m.start(), m.end()))
    return out


def _heads_notice(text: str, start: int, end: int, notices: list[int]) -> bool:
    """What stands at start..end follows a copyright line, and one of ``notices`` follows it, with at
    most ``MAX_GAP`` sentences and ``NEAR`` characters between."""
    before = text[max(0, start - NEAR):start].rstrip().rsplit("\n", 1)[-1]
    k = bisect_left(notices, end)
    near = k < len(notices) and notices[k] - end <= NEAR
    return near and bool(_COPYRIGHT.match(before)) and sum(1 for _ in sentences(text[end:notices[k]], _WRAPPED_END)) <= MAX_GAP


def match_rules(found: list[tuple[int, int, str, str | None]]) -> list[tuple[str, str, list[int]]]:
    """(rule, licence, sentences): rules matched in order of RULES over (start, end, text, id)."""
    ids = [x[3] for x in found]
    known = [i for i, k in enumerate(ids) if k]
    used: set[int] = set()
    out = []
    for rule, licence, want in RULES:
        for a, i in enumerate(known):
            if ids[i] != want[0] or i in used:
                continue
            path, b = [i], a + 1
            for k in want[1:]:
                if b >= len(known) or known[b] in used or ids[known[b]] != k or known[b] - path[-1] - 1 > MAX_GAP:
                    break
                path.append(known[b])
                b += 1
            if len(path) == len(want):
                used.update(path)
                out.append((rule, licence, path))
    for i, (_, _, n, k) in enumerate(found):
        if k and i not in used and k != "copyright":
            out.append(("partial", _HINT.get(k, "UNKNOWN"), [i]))
        elif not k and MENTION.search(n):
            out.append(("mention", "UNKNOWN", [i]))
    return sorted(out, key=lambda r: (r[2][0], r[0]))


def scan_text(text: str) -> list[tuple[str, str, int, int]]:
    """(rule, licence, start, end) of one text, by lines and, for wrapped notices, by paragraphs,
    whole and within comments. Of matches that share text, the one of the earlier rule stays, and
    of equal ones the line's."""
    low = text.lower()
    if not any(s in low for s in STEMS):
        return []
    tags = spdx_tags(text) if "spdx" in low else []
    if tags:
        text = _SPDX.sub(lambda m: _BORDER * (m.end() - m.start()), text)
    found = []
    plain, bordered = uncomment(text)
    passes = [(plain, _END), (bordered, _WRAPPED_END), (plain, _WRAPPED_END)]
    for turn, (x, end) in enumerate(passes if _BORDER in bordered else passes[:2]):
        cut = [(s, e, n, identify(n)) for s, e, n in sentences(x, end)]
        for rule, licence, path in match_rules(cut):
            spans = [cut[i][:2] for i in path]
            found.append((_RANK[rule], turn, spans[0][0], spans[-1][1], rule, licence, spans))
    out = [("spdx", licence, start, stop) for licence, start, stop in tags]
    taken: list[tuple[int, int]] = []  # sorted, disjoint
    for _, _, start, stop, rule, licence, spans in sorted(found):
        if all((k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b)
               for a, b in spans for k in [bisect_left(taken, (a, b))]):
            for span in spans:
                insort(taken, span)
            out.append((rule, licence, start, stop))
    notices = sorted(x[2] for x in out if x[0] not in ("partial", "mention", "all-rights"))
    out = [x for x in out if x[0] != "all-rights" or not _heads_notice(plain, x[2], x[3], notices)]
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rule, license, start, end): one row per match in every document."""

    def run(batches):
        for b in batches:
            rows = [(k, *m) for k, t in enumerate(text_column(b).cast(pa.string()).to_pylist()) for m in scan_text(t)]
            if rows:
                at, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *map(pa.array, rest)], names=["doc_id", "rule", "license", "start", "end"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("rule", T.StringType()),
                           T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, matches): licences per document with at least one match."""
    return scan(docs, id_col, text).groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("matches"))
