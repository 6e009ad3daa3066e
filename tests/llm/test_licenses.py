import re
from pathlib import Path

import duckdb
import pytest

from kotonoha.llm import licenses as lic


def brute(text):
    ids = []
    for s in re.split(lic.BREAK.replace(r"\z", r"\Z").replace("(", "(?:"), text or ""):
        s = re.sub("[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in s)).strip(" ")
        if s:
            x = lic.SENTENCES.get(s, "-")
            if x != "-" or not ids or ids[-1] != "-":
                ids.append(x)
    sequence = ids[:]
    found = []
    for name, rule in lic.RULES:
        at, out, hit = 0, [], False
        while at < len(ids):
            if tuple(ids[at : at + len(rule)]) == rule:
                at, hit = at + len(rule), True
            else:
                out.append(ids[at])
                at += 1
        ids = out
        if hit and name not in found:
            found.append(name)
    return sequence, [x for x in found if x != lic.RESERVED or len(found) == 1]


APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n"
CASES = [None, "", " \n", "All rights reserved.", "x. ALL RIGHTS RESERVED!\nReleased under the MIT License. y", APACHE, APACHE * 3 + "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "we are not licensed under the MIT License today.", "a. " * 20000 + "Released under the MIT License"]


def test_rules(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, "Released under the MIT license", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, licenses string")
    got = {r.doc_id: r for r in lic.find_licenses(df).collect()}
    for i, t, _ in rows:
        sequence, found = brute(t)
        assert got[i].sequence == "|" + "|".join(sequence) + "|"
        assert got[i].licenses == found
    assert got[5].licenses == ["Apache-2.0"] and got[8].licenses == []
    assert lic.find_licenses(df.limit(0)).count() == 0


MIT = """MIT License
Copyright (c) 2020 Some One
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
WRAPPED = [
    (MIT, ["MIT"]),
    (BSD, ["BSD-2-Clause"]),
    (BSD.replace("1. ", "(a) ").replace("2. ", "(b) "), ["BSD-2-Clause"]),
    (GPL, ["GPL-3.0-or-later"]),
    ("/*\n * " + GPL.replace("\n", "\n * ") + "\n */\nint x;", ["GPL-3.0-or-later"]),
    (";; " + GPL.replace("\n", "\n;; "), ["GPL-3.0-or-later"]),
    ("# This file is licensed under the MIT\n# License", ["MIT"]),
    ("Released under the MIT License\nimport x\nAll rights reserved", ["MIT"]),
    ("This file is not licensed under the MIT\nLicense", []),
    ("\n" * 100_000 + "This file is licensed\nunder the MIT License", ["MIT"]),
]


def test_wrapped(spark):
    """Notices as they are published, wrapped and in comments."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRAPPED)], "doc_id bigint, text string")
    got = {r.doc_id: r.licenses for r in lic.find_licenses(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(WRAPPED)}


def test_rest(spark):
    """What no rule uses up, with repeated notices, and the SQL by lists over the same rows."""
    perm, notice = (next(s for s, i in lic.SENTENCES.items() if i == x) for x in ("MITperm", "MITnotice"))
    texts = [
        "Released under the MIT license\nReleased under the MIT license",
        "Released under the MIT license\nunknown\nReleased under the MIT license\nAll rights reserved",
        f"{perm}.\n{notice}.\n{perm}.\n{notice}.\n{notice}.",
        f"{notice}.\nReleased under the MIT license\n{perm}.",
        f"{perm}.\nLicensed under CC0 1.0\n{notice}.",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (",".join(r.licenses), r.rest) for r in lic.find_licenses(df).collect()}
    assert got == {0: ("MIT", "|"), 1: ("MIT", "|"), 2: ("MIT", "|MITnotice|"), 3: ("MIT", "|MITnotice|MITperm|"), 4: ("CC0-1.0", "|MITperm|MITnotice|"), 5: ("", "|"), 6: ("", "|")}
    con = duckdb.connect()
    con.register("rows", df.toPandas())
    con.sql("create view documents as select doc_id, text from rows")
    assert {i: (names, rest) for i, _, names, rest in con.sql(lic.ORACLE).fetchall()} == got


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    got = lic.op3_licenses(spark, d).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.sql(lic.ORACLE).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert got.equals(want.astype(got.dtypes.to_dict())) and (got.licenses != "").sum() > 20


def test_three_clauses_with_any_holder(spark):
    """A notice that names its own holder, reserves all rights and is wrapped and numbered."""
    text = """Copyright (c) The Regents of some University. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University of Some-Place nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
    df = spark.createDataFrame([(1, text), (2, "All rights reserved."), (3, "All rights reserved. All rights reserved.")], "doc_id int, text string")
    assert {r.doc_id: r.licenses for r in lic.find_licenses(df).collect()} == {1: ["BSD-3-Clause"], 2: ["Proprietary"], 3: ["Proprietary"]}


SYSTEM = Path("/usr/share/common-licenses")
WHOLE = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not SYSTEM.is_dir(), reason="the system has no licence texts")
def test_whole_texts_of_the_system(spark):
    """Each text is its own licence only: neither its model notice nor reserved rights are another."""
    rows = [(name, (SYSTEM / name).read_text(errors="replace")) for name in WHOLE if (SYSTEM / name).is_file()]
    got = {r.doc_id: r.licenses for r in lic.find_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {name: [WHOLE[name]] for name, _ in rows}


GNU = """    This {thing} is free software; you can redistribute it and/or
    modify it under the terms of the GNU {kind} Public
    License as published by the Free Software Foundation; either
    version {version} of the License, or (at your option) any later version.

    This {thing} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
    {kind} Public License for more details.

    You should have received a copy of the GNU {kind} Public License
    along with this {thing}; if not, write to the Free Software Foundation.
"""


def test_notices_cut_by_semicolons(spark):
    texts = [
        (GNU.format(thing="program", kind="General", version="2"), ["GPL-2.0-or-later"]),
        (GNU.format(thing="program", kind="General", version="3"), ["GPL-3.0-or-later"]),
        (GNU.format(thing="library", kind="Lesser General", version="2.1"), ["LGPL-2.1-or-later"]),
        (GNU.format(thing="library", kind="Library General", version="2"), ["LGPL-2.0-or-later"]),
        (GNU.format(thing="program", kind="Affero General", version="3"), ["AGPL-3.0-or-later"]),
        (GNU.format(thing="program", kind="General", version="2").replace("Foundation; either", "Foundation, either"), ["GPL-2.0-or-later"]),
        (GNU.format(thing="program", kind="General", version="2").replace(" as published", " version 2 as published").split("; either")[0] + ".", ["GPL-2.0"]),
        ("We like the GNU General Public License version 2 of June 1991.", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: (r.licenses, r.rest) for r in lic.find_licenses(df).collect()}
    assert got == {i: (want, "|") for i, (_, want) in enumerate(texts)}


def test_sql_of_whole_texts(spark):
    """Titles, gaps of any length and model notices, one sentence a line, held against the SQL by lists."""
    of = {i: s for s, i in lic.SENTENCES.items()}
    lines = lambda *ids: "\n".join(of.get(i, i) for i in ids)
    notice = ("GPLterms", "V2orLater", "GPLhope", "GPLimplied", "GPLsee", "GPLcopy")
    texts = [
        (lines("GPL2title", "one", "two", "FSFverbatim", "three", "four", "five", *notice, "six"), "GPL-2.0"),
        (lines("GPL2title", "one", "FSFverbatim", "three"), "GPL-2.0"),
        (lines(*notice), "GPL-2.0-or-later"),
        (lines(*notice, "one", "GPL2title", "two", "FSFverbatim", "three", *notice), "GPL-2.0,GPL-2.0-or-later"),
        (lines("MPL2title", "one", "AllRights"), "MPL-2.0"),
        (lines("CCBYSA4title", "CCBYSA4title"), "CC-BY-SA-4.0"),
        (lines("FSFverbatim", "one"), ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: (",".join(r.licenses), r.rest) for r in lic.find_licenses(df).collect()}
    assert {i: names for i, (names, _) in got.items()} == {i: want for i, (_, want) in enumerate(texts)}
    con = duckdb.connect()
    con.register("rows", df.toPandas())
    con.sql("create view documents as select doc_id, text from rows")
    assert {i: (names, rest) for i, _, names, rest in con.sql(lic.ORACLE).fetchall()} == got
