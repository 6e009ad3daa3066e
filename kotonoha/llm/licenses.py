"""Operator 3: licences by sentence rules, with SQL functions only.

A text is cut into sentences (at a line end, or at a mark of punctuation before white space or the
end), sentences are normalised (ASCII lower case, every run of other characters than letters a-z and
digits one blank), and looked up among the known licence sentences. What remains of a document is the
sequence of identifiers, with a hyphen for each run of unknown sentences. The rules are tried in
their order: where a rule's identifiers stand one after the other in the sequence, its licence is
found and they are used up, so that a long notice is not found again as a shorter one.

A sentence may be wrapped: lines that follow one another without a blank line or a mark of
punctuation between them are looked up one by one and in every run that makes up a known sentence,
comment marks left out. A list number in front of a sentence is stepped over. Whole licence texts are
known by their titles and by the sentences that stand in them, a rule's hyphen being what lies between
two of them; the model notice at the end of such a text is the text's own and no notice. Beyond the sentences
that the SQL in ORACLE knows, those of published notices (PUBLISHED) and references to a licence by
name (NAMED) are known; the SQL finds neither these nor wrapped sentences.

Known sentences and rules are a fixed table, a literal in the plan: nothing is joined or shuffled.

Defined results: a null or blank text has an empty sequence and no licence; a licence is named once
however often its notice is repeated; identifiers that no rule uses up are listed as rest; a null id
keeps its row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm.common import documents, text_rows

RESERVED = "Proprietary"
#: Normalised sentences of public licence notices and their identifiers.
SENTENCES = {
    "released under the mit license": "MITref",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITliability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDwarranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSDliability",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCwarranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ISCliability",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2basis",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2see",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPLhope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GPLimplied",
    "see the gnu general public license for more details": "GPLsee",
    "you should have received a copy of the gnu general public license along with this program": "GPLcopy",
    "this software is provided as is without any express or implied warranty": "ZlibWarranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibPerm",
    "the origin of this software must not be misrepresented": "ZlibOrigin",
    "you must not claim that you wrote the original software": "ZlibClaim",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "ZlibAltered",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    "distributed under the boost software license version 1 0": "BSLref",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2at",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2at",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseFree",
    "licensed under the mit license": "MITref",
    "this software is released under the mit license": "MITref",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "licensed under the gnu general public license version 3": "GPL3ref",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "licensed under the gnu general public license version 2": "GPL2ref",
    "licensed under the gnu lesser general public license version 3": "LGPL3ref",
    "licensed under the gnu affero general public license version 3": "AGPL3ref",
    "licensed under the apache license version 2 0": "Apache2ref",
    "licensed under the apache license version 2 0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "Apache2not",
    "you may obtain a copy of the license at": "Apache2at",
    "http www apache org licenses license 2 0": "Apache2url",
    "licensed under cc by nc 4 0": "CCBYNC4ref",
    "licensed under cc by 4 0": "CCBY4ref",
    "licensed under cc by sa 4 0": "CCBYSA4ref",
    "licensed under cc0 1 0": "CC0ref",
    "this work is in the public domain": "PDref",
    "this work is dedicated to the public domain": "PDref",
    "all rights reserved": "AllRights",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDpre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDname",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3orLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2orLater",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLterms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPLterms",
    "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation": "LibraryTerms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AGPLterms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL2only",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "GPL3only",
    "either version 1 or at your option any later version": "V1orLater",
    "either version 2 of the license or at your option any later version": "V2orLater",
    "either version 2 or at your option any later version": "V2orLater",
    "either version 2 1 of the license or at your option any later version": "V21orLater",
    "either version 3 of the license or at your option any later version": "V3orLater",
    "either version 3 or at your option any later version": "V3orLater",
    "this library is distributed in the hope that it will be useful but without any warranty": "GPLhope",
    "see the gnu lesser general public license for more details": "LGPLsee",
    "see the gnu library general public license for more details": "LibrarySee",
    "see the gnu affero general public license for more details": "AGPLsee",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPLcopy",
    "you should have received a copy of the gnu lesser general public license along with this program": "LGPLcopy",
    "you should have received a copy of the gnu library general public license along with this library": "LibraryCopy",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLcopy",
    "gnu general public license version 1 february 1989": "GPL1title",
    "gnu general public license version 2 june 1991": "GPL2title",
    "gnu general public license version 3 29 june 2007": "GPL3title",
    "gnu library general public license version 2 june 1991": "Library2title",
    "gnu lesser general public license version 2 1 february 1999": "LGPL21title",
    "gnu lesser general public license version 3 29 june 2007": "LGPL3title",
    "gnu affero general public license version 3 19 november 2007": "AGPL3title",
    "gnu free documentation license version 1 2 november 2002": "GFDL12title",
    "gnu free documentation license version 1 3 3 november 2008": "GFDL13title",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "FSFverbatim",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2 or any later version published by the free software foundation": "GFDL12orLater",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation": "GFDL13orLater",
    "apache license version 2 0 january 2004": "Apache2title",
    "mozilla public license version 1 1": "MPL11title",
    "mozilla public license version 2 0": "MPL2title",
    "the contents of this file are subject to the mozilla public license version 1 1 the license": "MPL11ref",
    "cc0 1 0 universal": "CC0title",
    "creative commons attribution 4 0 international public license": "CCBY4title",
    "creative commons attribution sharealike 4 0 international public license": "CCBYSA4title",
    "creative commons attribution noncommercial 4 0 international public license": "CCBYNC4title",
    "creative commons attribution noderivatives 4 0 international public license": "CCBYND4title",
    "creative commons attribution noncommercial sharealike 4 0 international public license": "CCBYNCSA4title",
    "creative commons attribution noncommercial noderivatives 4 0 international public license": "CCBYNCND4title",
    "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications": "ArtisticIntent",
    "aggregation of this package with a commercial distribution is always permitted provided that the use of this package is embedded": "ArtisticEmbedded",
    "boost software license version 1 0 august 17th 2003": "BSL1title",
}
#: What stands in a GNU notice after the terms.
_GPL, _LGPL, _AGPL = ("GPLhope", "GPLimplied", "GPLsee", "GPLcopy"), ("GPLhope", "GPLimplied", "LGPLsee", "LGPLcopy"), ("GPLhope", "GPLimplied", "AGPLsee", "AGPLcopy")
_LIBRARY = ("GPLhope", "GPLimplied", "LibrarySee", "LibraryCopy")
_TEXT = ("-", "FSFverbatim", "-")
#: Licences by their whole texts, a hyphen for what stands between known sentences; notices that such a text holds as a model for others are its own.
FULL_RULES = (
    ("GPL-1.0", ("GPL1title", *_TEXT, "GPLterms", "V1orLater", *_GPL)),
    ("GPL-1.0", ("GPL1title",)),
    ("GPL-2.0", ("GPL2title", *_TEXT, "GPLterms", "V2orLater", *_GPL)),
    ("GPL-2.0", ("GPL2title",)),
    ("GPL-3.0", ("GPL3title", *_TEXT, "GPL3orLater", *_GPL)),
    ("GPL-3.0", ("GPL3title",)),
    ("LGPL-2.0", ("Library2title", *_TEXT, "LibraryTerms", "V2orLater", *_LIBRARY)),
    ("LGPL-2.0", ("Library2title",)),
    ("LGPL-2.1", ("LGPL21title", *_TEXT, "LGPLterms", "V21orLater", *_LGPL)),
    ("LGPL-2.1", ("LGPL21title",)),
    ("LGPL-3.0", ("LGPL3title", "-", "FSFverbatim")),
    ("LGPL-3.0", ("LGPL3title",)),
    ("AGPL-3.0", ("AGPL3title", *_TEXT, "AGPL3orLater", *_AGPL)),
    ("AGPL-3.0", ("AGPL3title",)),
    ("GFDL-1.2", ("GFDL12title", *_TEXT, "GFDL12orLater")),
    ("GFDL-1.2", ("GFDL12title",)),
    ("GFDL-1.3", ("GFDL13title", *_TEXT, "GFDL13orLater")),
    ("GFDL-1.3", ("GFDL13title",)),
    ("Apache-2.0", ("Apache2title",)),
    ("MPL-1.1", ("MPL11title", "-", "MPL11ref", "Apache2not", "Apache2at")),
    ("MPL-1.1", ("MPL11title",)),
    ("MPL-1.1", ("MPL11ref", "Apache2not", "Apache2at")),
    ("MPL-1.1", ("MPL11ref",)),
    ("MPL-2.0", ("MPL2title",)),
    ("CC0-1.0", ("CC0title",)),
    ("CC-BY-4.0", ("CCBY4title",)),
    ("CC-BY-SA-4.0", ("CCBYSA4title",)),
    ("CC-BY-NC-4.0", ("CCBYNC4title",)),
    ("CC-BY-ND-4.0", ("CCBYND4title",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSA4title",)),
    ("CC-BY-NC-ND-4.0", ("CCBYNCND4title",)),
    ("Artistic-1.0-Perl", ("ArtisticIntent", "-", "ArtisticEmbedded")),
    ("Artistic-1.0", ("ArtisticIntent",)),
    ("BSL-1.0", ("BSL1title",)),
    ("LGPL-2.1-or-later", ("LGPLterms", "V21orLater", *_LGPL)),
    ("LGPL-2.1-or-later", ("LGPLterms", "V21orLater")),
    ("LGPL-3.0-or-later", ("LGPLterms", "V3orLater", *_LGPL)),
    ("LGPL-3.0-or-later", ("LGPLterms", "V3orLater")),
    ("LGPL-2.0-or-later", ("LibraryTerms", "V2orLater", *_LIBRARY)),
    ("LGPL-2.0-or-later", ("LibraryTerms", "V2orLater")),
    ("AGPL-3.0-or-later", ("AGPLterms", "V3orLater", *_AGPL)),
    ("AGPL-3.0-or-later", ("AGPLterms", "V3orLater")),
    ("GPL-3.0-or-later", ("GPLterms", "V3orLater", *_GPL)),
    ("GPL-3.0-or-later", ("GPLterms", "V3orLater")),
    ("GPL-2.0-or-later", ("GPLterms", "V2orLater", *_GPL)),
    ("GPL-2.0-or-later", ("GPLterms", "V2orLater")),
    ("GPL-1.0-or-later", ("GPLterms", "V1orLater", *_GPL)),
    ("GPL-1.0-or-later", ("GPLterms", "V1orLater")),
    ("GPL-2.0", ("GPL2only", *_GPL)),
    ("GPL-2.0", ("GPL2only",)),
    ("GPL-3.0", ("GPL3only", *_GPL)),
    ("GPL-3.0", ("GPL3only",)),
    ("GFDL-1.2-or-later", ("GFDL12orLater",)),
    ("GFDL-1.3-or-later", ("GFDL13orLater",)),
)
#: Licences and the identifiers that make them up, in the order in which they are tried.
RULES = (
    *FULL_RULES,
    ("Apache-2.0", ("Apache2ref", "Apache2not", "Apache2at", "Apache2url", "Apache2basis", "Apache2see")),
    ("Apache-2.0", ("Apache2ref", "Apache2not", "Apache2at", "Apache2url")),
    ("Apache-2.0", ("Apache2ref", "Apache2not")),
    ("BSD-3-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDname", "BSDwarranty", "BSDliability")),
    ("BSD-3-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDname")),
    ("BSD-2-Clause", ("BSDpre", "BSDsource", "BSDbinary", "BSDwarranty", "BSDliability")),
    ("BSD-2-Clause", ("BSDpre", "BSDsource", "BSDbinary")),
    ("Zlib", ("ZlibWarranty", "ZlibLiability", "ZlibPerm", "ZlibOrigin", "ZlibClaim")),
    ("MIT", ("MITperm", "MITnotice", "MITwarranty", "MITliability")),
    ("MIT", ("MITperm", "MITnotice")),
    ("MIT", ("MITref",)),
    ("ISC", ("ISCperm", "ISCwarranty", "ISCliability")),
    ("ISC", ("ISCperm",)),
    ("Apache-2.0", ("Apache2ref",)),
    ("GPL-3.0-or-later", ("GPL3orLater", "GPLhope", "GPLimplied", "GPLsee", "GPLcopy")),
    ("GPL-2.0-or-later", ("GPL2orLater", "GPLhope", "GPLimplied", "GPLsee", "GPLcopy")),
    ("GPL-3.0-or-later", ("GPL3orLater",)),
    ("GPL-2.0-or-later", ("GPL2orLater",)),
    ("BSL-1.0", ("BSLref",)),
    ("AGPL-3.0", ("AGPL3ref",)),
    ("LGPL-3.0", ("LGPL3ref",)),
    ("GPL-3.0", ("GPL3ref",)),
    ("GPL-2.0", ("GPL2ref",)),
    ("CC-BY-NC-4.0", ("CCBYNC4ref",)),
    ("CC-BY-SA-4.0", ("CCBYSA4ref",)),
    ("CC-BY-4.0", ("CCBY4ref",)),
    ("CC0-1.0", ("CC0ref",)),
    ("Public-Domain", ("PDref",)),
    (RESERVED, ("AllRights",)),
)
#: Sentences of published notices that the marks of punctuation within them cut as here.
PUBLISHED = {
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3orLater",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2orLater",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3orLater",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21orLater",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3orLater",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2ref",
    "this is free and unencumbered software released into the public domain": "Unlicense",
}
#: Names of licences in references such as "This file is licensed under the MIT License", as patterns.
NAMED = {
    "mit license": "MITref",
    "apache license (?:version )?2 0": "Apache2ref",
    "(?:bsd 3 clause|3 clause bsd) license": "BSD3ref",
    "(?:bsd 2 clause|2 clause bsd) license": "BSD2ref",
    "isc license": "ISCref",
    "gnu general public license (?:version |v)3(?: 0)?": "GPL3ref",
    "gnu general public license (?:version |v)2(?: 0)?": "GPL2ref",
    "gnu lesser general public license (?:version |v)3(?: 0)?": "LGPL3ref",
    "gnu affero general public license (?:version |v)3(?: 0)?": "AGPL3ref",
    "mozilla public license (?:version )?2 0": "MPL2ref",
    "(?:cc by nc 4 0|creative commons attribution noncommercial 4 0 international)(?: license)?": "CCBYNC4ref",
    "(?:cc by sa 4 0|creative commons attribution sharealike 4 0 international)(?: license)?": "CCBYSA4ref",
    "(?:cc by 4 0|creative commons attribution 4 0 international)(?: license)?": "CCBY4ref",
}
#: Sentences that name a holder, as patterns.
HOLDERS = {"neither the name of [a-z0-9 ]{1,200}? nor the names of (?:its|their|any|other) contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDname"}
_REFERENCE = "(?:(?:this|the) (?:file|work|code|source code|software|program|project|package|library|module|document|repository) is )?(?:licensed|released|distributed|available|made available) under (?:the terms of )?(?:the |an |a )?"
#: Rules for what only the tables above know, tried after the others.
PUBLISHED_RULES = (
    ("BSD-3-Clause", ("BSD3ref",)),
    ("BSD-2-Clause", ("BSD2ref",)),
    ("ISC", ("ISCref",)),
    ("LGPL-3.0-or-later", ("LGPL3orLater", *_LGPL)),
    ("AGPL-3.0-or-later", ("AGPL3orLater", *_AGPL)),
    ("LGPL-3.0-or-later", ("LGPL3orLater",)),
    ("LGPL-2.1-or-later", ("LGPL21orLater",)),
    ("AGPL-3.0-or-later", ("AGPL3orLater",)),
    ("MPL-2.0", ("MPL2ref", "-", "MPL2at")),
    ("MPL-2.0", ("MPL2ref", "MPL2at")),
    ("MPL-2.0", ("MPL2ref",)),
    ("Unlicense", ("Unlicense", "UnlicenseFree")),
    ("Unlicense", ("Unlicense",)),
)
BREAK = r"[.;:!?]+([ \t\r\n]+|\z)|\n+"
#: What ends a sentence for good: punctuation behind a word, or a line without letters and digits.
PARAGRAPH = r"(?<=[^\s.;:!?])[.;:!?]+([ \t\r\n]+|\z)|\n[^A-Za-z0-9]*\n"
_MARK = r"^[0-9]{1,2}$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def _patterns() -> dict[str, str]:
    """Patterns of the sentences of each identifier, blanks as blanks or line ends, the longest first, so that no sentence is taken for a part of it."""
    known: dict[str, list[str]] = {}
    for sentence, name in {**SENTENCES, **PUBLISHED, **HOLDERS, **{_REFERENCE + name: i for name, i in NAMED.items()}}.items():
        known.setdefault(name, []).append(sentence)
    names = sorted(known, key=lambda name: max(map(len, known[name])), reverse=True)
    return {name: "(?:" + "|".join(sorted(known[name], key=len, reverse=True)).replace(" ", "[ \\n]") + ")" for name in names}


def _sequence(text: Column) -> Column:
    """|id|id|-|id|: known identifiers in order, each run of unknown sentences a hyphen."""
    pieces = lambda s: F.filter(F.transform(F.split(s, BREAK, -1), normalised), lambda p: (p != "") & ~p.rlike(_MARK))
    # one line for each piece, and a bar where a sentence cannot go on
    lines = F.array_join(F.filter(F.transform(F.split(text, PARAGRAPH, -1), lambda s: F.array_join(pieces(s), "\n")), lambda s: s != ""), "|")
    whole = lambda x: r"(?<![^|\n])(?:(?:[0-9]{1,2}|[a-z])[ \n])?" + x + r"(?![^|\n])"
    named = lines
    for name, x in _patterns().items():
        named = F.regexp_replace(named, whole(x), "=" + name)
    known = F.when(lines.rlike(whole("(?:" + "|".join(_patterns().values()) + ")")), named).otherwise(F.when(lines != "", F.lit("-")).otherwise(F.lit("")))
    ids = F.regexp_replace(F.regexp_replace(F.translate(known, "\n", "|"), r"(?<![^|])[^=|-][^|]*", "-"), "=", "")
    return F.concat(F.lit("|"), F.regexp_replace(ids, r"-(\|-)+", "-"), F.lit("|"))


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sequence, licenses, rest): the identifiers, the licences in the order of the rules, what no rule used."""
    rows = text_rows(df, id_col, text_col).select("doc_id", _sequence(F.col("text")).alias("sequence"))
    # every identifier has brackets of its own, and what is used up leaves a mark, so that neighbours are told apart and stay where they are
    whole = lambda ids: "".join(f"<{i}>" for i in ids)
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(whole(ids)).alias("ids")) for name, ids in (*RULES, *PUBLISHED_RULES)))
    listed = F.array_join(F.transform(F.filter(F.split("sequence", r"\|"), lambda x: x != ""), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    rows = rows.withColumn("listed", listed)
    zero = F.struct(F.col("listed").alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["ids"])
        return F.when(hit, F.struct(F.replace(state["rest"], rule["ids"], F.lit("<.>")).alias("rest"), F.array_append(state["found"], rule["name"]).alias("found"))).otherwise(state)

    rows = rows.withColumn("state", F.when(F.col("sequence").rlike("[A-Z]"), F.aggregate(rules, zero, step)).otherwise(zero))
    rest = F.array_join(F.regexp_extract_all(F.col("state.rest"), F.lit("<([A-Za-z][^>]*)>"), F.lit(1)), "|")
    found = F.array_distinct("state.found")
    # reserved rights stand in the notice of most licences, and make a text proprietary only where there is no other
    found = F.when(F.size(found) > 1, F.array_remove(found, RESERVED)).otherwise(found)
    return rows.select("doc_id", "sequence", found.alias("licenses"), F.when(rest == "", "|").otherwise(F.concat(F.lit("|"), rest, F.lit("|"))).alias("rest"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(documents(spark, sf_dir))
    known = F.size(F.filter(F.split("sequence", r"\|"), lambda s: ~s.isin("", "-"))).alias("n_known")
    return found.select("doc_id", known, F.array_join("licenses", ",").alias("licenses"), "rest")


def _oracle() -> str:
    """The same by a join and by lists of identifiers, rule after rule."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, found, last = [], [], "seq"
    for k, (name, ids) in enumerate(RULES):
        rule, n = ", ".join(f"'{i}'" for i in ids), len(ids)
        steps.append(f"p{k} AS (SELECT *, list_filter(range(1, len(s{k}) + 1), lambda i: s{k}[i:i + {n - 1}] = [{rule}]) AS at{k} FROM {last})")
        steps.append(
            f"r{k} AS (SELECT * EXCLUDE (s{k}, at{k}), CASE WHEN len(at{k}) > 0 THEN '{name}' END AS f{k}, "
            f"list_transform(s{k}, lambda x, i: CASE WHEN len(list_filter(at{k}, lambda q: q <= i AND i < q + {n})) > 0 THEN '.' ELSE x END) AS s{k + 1} FROM p{k})"
        )
        found.append(f"f{k}")
        last = f"r{k}"
    listed = ", ".join(found)  # a licence stands where the first of its rules that hit stands
    return rf"""WITH known(sentence, id) AS (VALUES {values}),
parts AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{BREAK}'),
  lambda x: trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents),
one AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM parts),
ids AS (SELECT doc_id, list(coalesce(id, '-') ORDER BY pos) AS ids, count(id) AS n FROM one LEFT JOIN known USING (sentence) GROUP BY doc_id),
seq AS (SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN list_filter(ids, lambda x, i: x <> '-' OR i = 1 OR ids[i - 1] <> '-') ELSE [] END AS s0 FROM documents LEFT JOIN ids USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, CAST(n AS INTEGER) AS n_known,
  array_to_string(list_filter([{listed}], lambda x, i: x IS NOT NULL AND list_position([{listed}], x) = i AND (x <> '{RESERVED}' OR len(list_filter([{listed}], lambda y: y <> '{RESERVED}')) = 0)), ',') AS licenses,
  '|' || array_to_string(list_transform(list_filter(s{len(RULES)}, lambda x: x NOT IN ('-', '.')), lambda x: x || '|'), '') AS rest
FROM {last}"""


ORACLE = _oracle()
