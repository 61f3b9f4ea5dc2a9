"""Licence scans on the standard notice texts, wrapped and unwrapped."""

import re
import textwrap

import pytest

from cohortlens.llm import license_scan


def strong(text):
    return [(r, lic) for r, lic, _, _ in license_scan.scan_text(text) if r not in ("partial", "mention")]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
STANDARD = {
    "apache2-header": (APACHE, "Apache-2.0"),
    "apache2-header-one": (APACHE.replace("\n\n    http", "\nhttp").replace("2.0\n\n", "2.0\n"), "Apache-2.0"),
    "mit-full": (MIT, "MIT"),
    "mit-grant-notice": (MIT[:MIT.index("THE SOFTWARE IS")], "MIT"),
    "bsd3": (BSD3, "BSD-3-Clause"),
    "bsd2": (BSD2, "BSD-2-Clause"),
    "gpl3-sentence": (GPL.format(":", ",", 3), "GPL-3.0-or-later"),
    "gpl3-sentence-one": (GPL.format(",", ",", 3), "GPL-3.0-or-later"),
    "gpl3-header": (GPL.format(";", ";", 3), "GPL-3.0-or-later"),
    "gpl3-header-one": (GPL.format(",", ";", 3), "GPL-3.0-or-later"),
    "gpl2-sentence": (GPL.format(":", ",", 2), "GPL-2.0-or-later"),
    "gpl2-sentence-one": (GPL.format(",", ",", 2), "GPL-2.0-or-later"),
    "gpl2-header": (GPL.format(";", ";", 2), "GPL-2.0-or-later"),
    "gpl2-header-one": (GPL.format(",", ";", 2), "GPL-2.0-or-later"),
    "mpl2-notice": (MPL, "MPL-2.0"),
    "apache2-notice": ("Licensed under the Apache License, Version 2.0.\n", "Apache-2.0"),
    "mit-notice": ("Released under the terms of the MIT License.\n", "MIT"),
    "gpl3-notice": ("Licensed under the GNU General Public License version 3.\n", "GPL-3.0"),
    "gpl3-later": ("Licensed under the GNU General Public License version 3 or later.\n", "GPL-3.0-or-later"),
    "gpl2-later": ("This tool is licensed under the GNU General Public License, version 2 or any later version.\n", "GPL-2.0-or-later"),
    "lgpl3-later": ("Released under the GNU Lesser General Public License v3 or later.\n", "LGPL-3.0-or-later"),
    "lgpl21-later": ("Distributed under the terms of the GNU Lesser General Public License version 2.1 or newer.\n", "LGPL-2.1-or-later"),
    "lgpl2-later": ("Licensed under the GNU Library General Public License version 2 or later.\n", "LGPL-2.0-or-later"),
    "agpl3-later": ("Licensed under the GNU Affero General Public License version 3 or (at your option) any later version.\n", "AGPL-3.0-or-later"),
    "bsd2-notice": ("This library is licensed under the BSD 2-Clause License.\n", "BSD-2-Clause"),
    "bsd-unspecified": ("Distributed under the BSD license.\n", "BSD-unspecified"),
    "public-domain": ("The data are released into the public domain.\n", "LicenseRef-Public-Domain"),
    "gpl2-notice": ("Licensed under the GNU General Public License version 2.\n", "GPL-2.0"),
    "bsd-notice": ("Licensed under the 3-Clause BSD License.\n", "BSD-3-Clause"),
    "cc-by": ("This work is licensed under the Creative Commons Attribution 4.0 International License.\n", "CC-BY-4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.\n", "CC-BY-NC-4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.\n", "CC-BY-SA-4.0"),
    "cc0": ("This work is dedicated to the public domain under CC0 1.0.\n", "CC0-1.0"),
    "all-rights": ("All rights reserved.\n", "Proprietary"),
}

for rule, licence, name, version in (("lgpl21", "LGPL-2.1-or-later", "Lesser", "2.1"), ("lgpl2", "LGPL-2.0-or-later", "Library", "2"),
                                     ("lgpl3", "LGPL-3.0-or-later", "Lesser", "3"), ("agpl3", "AGPL-3.0-or-later", "Affero", "3")):
    gnu = GPL.replace("GNU General", f"GNU {name} General")
    for form, first, second in (("sentence", ":", ","), ("sentence-one", ",", ","), ("header", ";", ";"), ("header-one", ",", ";")):
        STANDARD[f"{rule}-{form}"] = (gnu.format(first, second, version), licence)
    STANDARD[f"{rule}-notice"] = (f"Licensed under the GNU {name} General Public License, version {version}.\n", licence.removesuffix("-or-later"))
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ASIS = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER.
"""
ZERO = ISC[:ISC.index(", provided")] + ".\n"
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License {} which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
STANDARD |= {
    "isc-full": (ISC + ASIS, "ISC"),
    "isc-grant": (ISC, "ISC"),
    "0bsd-full": (ZERO + ASIS, "0BSD"),
    "0bsd-grant": (ZERO, "0BSD"),
    "epl1": (EPL.format("v1.0"), "EPL-1.0"),
    "epl2": (EPL.format("v. 2.0"), "EPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish this software.\n", "Unlicense"),
    "isc-notice": ("Released under the ISC License.\n", "ISC"),
    "epl1-notice": ("Licensed under the Eclipse Public License v1.0.\n", "EPL-1.0"),
    "epl2-notice": ("Licensed under the Eclipse Public License 2.0.\n", "EPL-2.0"),
    "unlicense-notice": ("Released under the Unlicense.\n", "Unlicense"),
}


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False, break_long_words=False) for p in re.split(r"\n[^\S\n]*\n", text.strip())) + "\n"


def test_every_rule_has_a_standard_notice():
    assert set(STANDARD) == {r[0] for r in license_scan.RULES}


@pytest.mark.parametrize("rule", STANDARD)
def test_standard_notice(rule):
    text, licence = STANDARD[rule]
    for form in (text, *(wrapped(text, w) for w in (30, 72, 10_000))):
        assert strong(form) == [(rule, licence)], form
        assert strong("Some words before.\n\n" + form + "\nSome words after.") == [(rule, licence)]


COMMENTS = {"//": ("", "// ", ""), "#": ("", "# ", ""), "--": ("", "-- ", ""), ";;": ("", ";; ", ""), "dnl": ("", "dnl ", ""), "rem": ("", "REM ", ""),
            "/* * */": ("/*\n", " * ", " */\n"), "/* */": ("/*\n", "", "*/\n"), "<!-- -->": ("<!--\n", "  ", "-->\n")}


def commented(text, style):
    first, mark, last = COMMENTS[style]
    return first + "".join((mark + line).rstrip() + "\n" for line in text.splitlines()) + last


@pytest.mark.parametrize("style", COMMENTS)
def test_standard_notices_in_comments(style):
    for rule, (text, licence) in STANDARD.items():
        for width in (30, 72):
            form = commented(wrapped(text, width), style)
            assert strong(form) == [(rule, licence)], form
            assert strong(f"int before = 1\n{form}int after = 2\n") == [(rule, licence)], form
            # no full stop at its end, and text right after it
            bare = commented(wrapped(text, width).rstrip(".\n") + "\n", style)
            assert strong(f"{bare}int after\n") == [(rule, licence)], bare


def test_boxed_and_closed_on_each_line():
    assert strong("/* you may use it.      */\n/* Licensed under the   */\n/* MIT License.         */\nint x") == [("mit-notice", "MIT")]
    assert strong("/***\n * Licensed under the *\n * MIT License        *\n ***/\nint x") == [("mit-notice", "MIT")]
    assert strong("/* Licensed under the\n   MIT License */\nint x") == [("mit-notice", "MIT")]


def test_copyright_line_before_a_notice():
    for style in COMMENTS:
        form = commented("Copyright 2020 Foo\nLicensed under the Apache\nLicense, Version 2.0", style)
        assert strong(form) == [("apache2-notice", "Apache-2.0")]


def test_wrapped_bullet_is_one_sentence():
    form = BSD3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    assert strong(form) == [("bsd3", "BSD-3-Clause")]


def test_weak_matches_of_paragraphs_stay():
    assert license_scan.scan_text("It is licensed\nunder Foo terms.") == [("mention", "UNKNOWN", 0, 30)]
    text = "// you may not use this file except\n// in compliance with the License.\n"
    assert [m[:2] for m in license_scan.scan_text(text)] == [("partial", "Apache-2.0")]
    # of a line's and a paragraph's equal matches one stays, and none beside a rule
    assert [m[:2] for m in license_scan.scan_text("Licensed under Foo terms\nand more.")] == [("mention", "UNKNOWN")]
    assert license_scan.scan_text("Licensed under the\nMIT License.") == [("mit-notice", "MIT", 0, 30)]


def test_spans_are_of_the_stored_text():
    text = "int x\n// Released under the\n// MIT License.\n"
    [(rule, _, a, b)] = license_scan.scan_text(text)
    assert rule == "mit-notice" and text[a:b].split() == "// Released under the // MIT License".split()


@pytest.mark.parametrize("text, want", [
    ("// SPDX-License-Identifier: MIT", ["MIT"]),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", ["GPL-2.0-only WITH Linux-syscall-note"]),
    ("# spdx-license-identifier: apache-2.0 OR MIT", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: (LGPL-2.1+ AND BSD-3-Clause) OR LicenseRef-x", ["BSD-3-Clause", "LGPL-2.1-or-later", "LicenseRef-x"]),
    ("<!-- SPDX-License-Identifier: CC0-1.0-->", ["CC0-1.0"]),
    ("SPDX-License-Identifier: Apache-2.0/MIT", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: MIT.", ["MIT"]),
    ("SPDX-License-Identifier: MIT or Apache-2.0", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: MIT and this is text", ["MIT"]),
    ("SPDX-License-Identifier: NOASSERTION", ["UNKNOWN"]),
])
def test_spdx_tags(text, want):
    for x in (text, f"{text}\nint x;\n", f"int x;\n{text}\n// Some words\n"):
        found = license_scan.scan_text(x)
        assert sorted(m[1] for m in found) == want and {m[0] for m in found} == {"spdx"}
        assert all(x[a:b].lower().startswith("spdx-license-identifier:") for _, _, a, b in found)


def test_spdx_tag_beside_a_notice():
    text = "// SPDX-License-Identifier: MIT\n// Licensed under the MIT\n// License.\n"
    assert strong(text) == [("spdx", "MIT"), ("mit-notice", "MIT")]


@pytest.mark.parametrize("text", [
    "You may use it under the terms of version 2 of the GNU General\nPublic License as published by the Free Software Foundation.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.",
    "It may be used under the terms and conditions of the Foo Bar Licence.",
    "Released under the GPL.",
    "Released under the LGPLv3 or later.",
    "SPDX-License-Identifier: <id>",
])
def test_what_the_table_lacks_is_unknown(text):
    assert [m[:2] for m in license_scan.scan_text(text)] == [("mention", "UNKNOWN")]


def test_many_matches_in_one_text():
    text = "Licensed under the MIT License.\n" * 20_000
    assert len(license_scan.scan_text(text)) == 20_000


@pytest.mark.parametrize("text, licences", [
    ("The code is under the MIT license.", ["MIT"]),
    ("This software is licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("This article is licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Licensed under the GNU General Public License version 3 or later.", ["GPL-3.0-or-later"]),
    ("Licensed under the GNU General Public License version 2 only.", ["GPL-2.0"]),
    ("Released into the public domain.", ["LicenseRef-Public-Domain"]),
    ("Dedicated to the public domain under CC0 1.0.", ["CC0-1.0"]),
    ("All code here is available under the BSD license.", ["BSD-unspecified"]),
    ("MIT License", ["MIT"]),
    ("Copyright (c) 2011, Foo\nAll rights reserved.\n\n" + BSD3, ["BSD-3-Clause"]),
    ("Copyright 2011 Foo. All rights reserved.", ["Proprietary"]),
    ("It is not licensed under the MIT License.", ["UNKNOWN"]),
    ("Copyright 2011 Foo.", []),
])
def test_common_wordings(text, licences):
    assert [m[1] for m in license_scan.scan_text(text)] == licences


def test_licence_column_names_licences():
    """Whatever single table sentence a text holds, the licence column is a licence or UNKNOWN."""
    names = {lic for _, lic, _ in license_scan.RULES} | {"UNKNOWN"}
    for k in license_scan.SENTENCES:
        assert {lic for _, lic, _ in license_scan.match_rules([(0, 1, "", k)])} <= names
