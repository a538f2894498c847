"""Licence scan: whole texts, notices and names in many forms, and a brute-force matcher."""

import random
import re
from importlib.resources import files

import pytest

from fitlake.llm import license_scan

SF = "/root/testdata/sf0.01"
TEXTS = {x.name.removesuffix(".txt"): x.read_text() for x in files("fitlake.llm").joinpath("license_texts").iterdir()}


def scan(text):
    return license_scan.match_rules(license_scan.identify(text))


def names(text):
    return [x.name for x in license_scan.identify(text)]


@pytest.mark.parametrize("label, name", [(label, name) for label, name, *_ in license_scan.TEXT_RULES])
def test_whole_texts(label, name):
    text = TEXTS[name].replace("{{the copyright holder}}", "Acme").replace("{{the organization}}", "Acme")
    for around in ("%s", "prose without a stop\n%s\nand more of it", "Copyright (c) 2021 Jane Doe\n\n%s", "Some prose; and\n%s"):
        for form in (text, "".join(f" * {line}\n" for line in text.splitlines()), text.replace("\n", "\r\n"), " ".join(text.split())):
            licences, left = scan(around % form)
            assert licences == [label] and set(left) <= license_scan.PASSED_OVER


def test_texts_with_changes():
    """Sentences may be missing or changed in part; a licence within another's span is part of it."""
    mit = TEXTS["MIT"]
    assert scan(mit.split("THE SOFTWARE IS")[0])[0] == ["MIT"]
    assert scan(mit.replace("subject to the following conditions", "subject to these conditions"))[0] == ["MIT"]
    assert scan(mit.replace("The above copyright", "(The following)\n\nThe above copyright"))[0] == ["MIT"]
    assert scan("MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + mit)[0] == ["MIT"]
    assert scan("The MIT License (MIT)\n\n" + mit + "\n\nReleased under the MIT License.")[0] == ["MIT", "MIT"]
    assert scan(mit + TEXTS["Apache-2.0.notice"] + TEXTS["BSD-2-Clause"])[0] == ["MIT", "Apache-2.0", "BSD-2-Clause"]
    assert scan("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.") == ([], ["MIT/1"])
    assert scan(" ".join([mit] * 3))[0] == ["MIT"] * 3


#: How a licence is named, and its SPDX name.
NAMED = [
    ("This project is licensed under the MIT license - see the file.", "MIT"), ("MIT License", "MIT"), ("License: MIT", "MIT"),
    ("Apache License Version 2.0, January 2004", "Apache-2.0"), ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"),
    ("This file is licensed under the MIT License, see LICENSE.", "MIT"), ("Released under the MIT License.", "MIT"),
    ("prose without a stop\nLicensed under CC BY-NC 4.0.\nMore.", "CC-BY-NC-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("A.\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Available under the Apache-2.0 licence.", "Apache-2.0"),
    ("Licensed under the GNU Affero General Public License v3 or later.", "AGPL-3.0-or-later"), ("Licensed under GPLv2+", "GPL-2.0-or-later"),
    ("This library is distributed under the terms of the GNU Lesser General Public License, version 2.1.", "LGPL-2.1-only"),
    ("Licensed under the 3-clause BSD license.", "BSD-3-Clause"), ("Released under CC0 1.0.", "CC0-1.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "GPL-3.0-only"),
    ("# SPDX-License-Identifier: Apache-2.0\nimport x", "Apache-2.0"), ("// SPDX-License-Identifier: (mit OR gpl-2.0+)", "MIT OR GPL-2.0-or-later"),
    ("You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General\nPublic License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.", "GPL-2.0-only"),
]


@pytest.mark.parametrize("text, label", NAMED)
@pytest.mark.parametrize("line", ["", "Copyright (c) 2021 Jane Doe\n", "Copyright 2019-2021 Acme\n\n", "prose above\n * COPYRIGHT (C)\n * 2020 Acme, Inc\r\n", "© 1999 x\nCopyright © 2020 A\nCopyright © 2021 B\n"])
def test_names_below_a_copyright_line(text, label, line):
    licences, left = scan(line + text)
    assert licences == [label] and left == ["copyright"] * line.lower().count("copyright")


def test_notices():
    gpl = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
    """
    assert scan(gpl) == (["GPL-2.0-or-later"], [])
    assert scan(gpl.replace("General", "Lesser General").replace("version 2", "version 2.1")) == (["LGPL-2.1-or-later"], [])
    assert scan(TEXTS["Apache-2.0.notice"]) == (["Apache-2.0"], []) and scan(TEXTS["MPL-2.0.notice"]) == (["MPL-2.0"], [])
    assert scan(gpl + gpl)[0] == ["GPL-2.0-or-later"] * 2


def test_ties_and_prose():
    assert names("It is free; licensed under the MIT license; released under CC0 1.0.") == ["named", "named"]
    assert scan("Dual-licensed under the MIT license or the Apache License, Version 2.0.") == (["MIT", "Apache-2.0"], [])
    assert names("Copyright (c) 2021 Jane Doe. All rights reserved.\nReleased under the MIT License.") == ["copyright", "all_rights", "named"]
    assert scan("The license to drive was lost.") == ([], []) and scan("") == ([], []) and scan("MIT") == ([], [])
    assert scan("The mit of the license, version 2.") == ([], [])


def test_identification_is_brute_force():
    """Every known sentence in generated documents, against a search of each at each word."""
    rng = random.Random(11)
    known = license_scan.knowledge()
    sentences = {words: name for group in known.starts.values() for _, words, name in group}
    listed = sorted(sentences)
    prose = "the of license software warranty notice copies a in permission and to provided any this".split()
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 25)):
            words = list(rng.choice(listed))
            if rng.random() < 0.3:  # cut off or changed
                words[rng.randrange(len(words))] = rng.choice(prose)
            if rng.random() < 0.6:
                parts.append(" ".join(rng.choices(prose, k=rng.randint(0, 8))))
            parts.append(" ".join(words).capitalize() + rng.choice([".", ";", "", ":\n", "\n\n"]))
        text = " license ".join(parts)
        words = [w for w, _ in license_scan.words_of(text)]
        found, k = [], 0
        while k < len(words):
            fits = [s for s in listed if tuple(words[k : k + len(s)]) == s]
            if fits:
                found.append((k, sentences[max(fits, key=len)]))
                k += len(max(fits, key=len))
            else:
                k += 1
        mine = [(x.first, x.name) for x in license_scan.identify(text) if "/" in x.name]
        assert mine == found


def test_long_texts_and_many_licenses():
    """Whole texts are read, in time that grows with them: sentences of any length, licences in any number."""
    long = "word " * 200_000 + "Permission " + "is " * 50_000 + ". " + TEXTS["MIT"]
    assert scan(long) == (["MIT"], [])
    assert scan("Released under the MIT License.\n" * 20_000)[0] == ["MIT"] * 20_000
    assert scan(TEXTS["Apache-2.0.notice"] * 500)[0] == ["Apache-2.0"] * 500


SCHEMA = "doc_id long, text string, licenses string, sentence_ids string, unmatched int"


def test_edges(spark):
    texts = [None, "", " \n", "Released under the MIT License.", "Released under the MIT License.", "ﬁ İ K License: MIT"]
    rows = [(i if i != 4 else None, x, "MIT", "x", 1) for i, x in enumerate(texts)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted(((r.id, r.licenses, r.sentence_ids, r.unmatched) for r in license_scan.scan_licenses(df).collect()), key=str)
    one = ["MIT"], ["named"], []
    assert out == sorted([(0, [], [], []), (1, [], [], []), (2, [], [], []), (3, *one), (3, *one), (None, *one), (5, [], [], [])], key=str)
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_licenses_of_the_corpus(spark):
    """Every planted licence line is found, and nothing else."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    named = [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3.")]
    for r in license_scan.op3_license_scan(spark, SF).collect():
        text = docs[r.doc_id] or ""
        assert sorted(filter(None, r.licenses.split(","))) == sorted(n for n, line in named for _ in re.finditer(re.escape(line), text))
