"""Licence scans by sentence rules, with SQL functions only.

A text is parted into sentences (line ends; full stops, exclamation and question marks
before white space).  Known sentences of licence texts and notices are also found over
line ends, behind comment marks and within longer sentences; titles and tags, which are
mentioned in passing too, must be a whole line or sentence.  Normalised sentences (lower case, runs of other characters than
a-z and 0-9 as one space) are mapped to identifiers of known licence sentences, and the
sequence of a document's identifiers is matched against ordered licence rules: a
rule is a run of identifiers; the first rule in the list that an identifier takes part in
names its licence.

A document whose text has none of the words that every known sentence has one of is
passed by without parting.  No shuffle, no join: one row out for each row in.
Null and empty texts have no sentences; repeated rows give repeated results; other
columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licence texts and notices.
SENTENCES: dict[str, str] = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-title": "apache license version 2 0 january 2004",
    "apache-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-2": "licensed under the gnu general public license version 3",
    "gpl2-notice": "licensed under the gnu general public license version 2",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-nd-notice": "licensed under cc by nd 4 0",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-obtain-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-title": "mozilla public license version 2 0",
    "mpl11-notice": "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-title": "isc license",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd3-title": "bsd 3 clause license",
    "bsd2-title": "bsd 2 clause license",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-waiver": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-title": "cc0 1 0 universal",
    "gpl2-only-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl21-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-redistribute-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "gpl-lgpl3-notice": "licensed under the gnu lesser general public license version 3",
    "gpl-lgpl21-notice": "licensed under the gnu lesser general public license version 2 1",
    "agpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-see": "see the gnu affero general public license for more details",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "gpl-agpl3-notice": "licensed under the gnu affero general public license version 3",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl1-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl-title": "boost software license version 1 0 august 17th 2003",
    "bsl-notice": "distributed under the boost software license version 1 0",
    "artistic-title": "the artistic license 2 0",
    "cc-by-sa-text": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-text": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-text": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-text": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-text": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "cc-by-3-text": "this work is licensed under a creative commons attribution 3 0 unported license",
    "reserved": "all rights reserved copyright",
}
#: Licences that a tag may name.
TAGS = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC 0BSD MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 Artistic-2.0"
).split()
SENTENCES |= {f"spdx-{t.lower()}": "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", t.lower())) for t in TAGS}
#: In order: licence, the identifiers that follow one another.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-grant", "apache-warranty")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope", "gpl-see")),
    ("GPL-2.0-only", ("gpl2-only-redistribute", "gpl-hope", "gpl-see")),
    ("AGPL-3.0-or-later", ("agpl3-redistribute", "gpl-hope", "agpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute-2", "gpl-hope", "lgpl-see")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-title", "isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Zlib", ("zlib-warranty", "zlib-liable", "zlib-grant")),
    ("BSL-1.0", ("bsl-title", "bsl-grant")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("MPL-2.0", ("mpl-notice", "mpl-obtain")),
    ("MPL-2.0", ("mpl-notice", "mpl-obtain-2")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-2",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-title",)),
    ("Apache-2.0", ("apache-grant",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-notice-2",)),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-text",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("MPL-2.0", ("mpl-title",)),
    ("MPL-1.1", ("mpl11-notice",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-title",)),
    ("0BSD", ("0bsd-grant",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC0-1.0", ("cc0-title",)),
    ("GPL-2.0-only", ("gpl2-only-redistribute",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute-2",)),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("LGPL-2.1-only", ("lgpl21-title",)),
    ("LGPL-3.0-only", ("gpl-lgpl3-notice",)),
    ("LGPL-2.1-only", ("gpl-lgpl21-notice",)),
    ("AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("AGPL-3.0-only", ("gpl-agpl3-notice",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-1.0", ("epl1-notice",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-title",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("Artistic-2.0", ("artistic-title",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-text",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-text",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-text",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-text",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-text",)),
    ("CC-BY-3.0", ("cc-by-3-text",)),
    *((t, (f"spdx-{t.lower()}",)) for t in TAGS),
)
#: Every known sentence has one of these words.
HINTS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "anyone is free to copy", "advertising materials", "held liable", "cc0", "mpl was not")


#: Sentences that stand for a licence only where they are a whole line or sentence.
WHOLE = frozenset(k for k in SENTENCES if k.startswith(("mit-title", "isc-title", "bsd3-title", "bsd2-title", "mpl-title", "artistic-title", "cc0-title", "spdx-", "reserved")))


def _pattern() -> str:
    """Known sentences in a text of ``normalised``, the longest first."""
    gap, runs = "[ L]+", []
    for k, v in sorted(SENTENCES.items(), key=lambda x: -len(x[1])):
        runs.append(f"(?<=[SL] ?){v}(?= ?[SL])")
        if k not in WHOLE:
            # "Or later" makes another licence of a version, and "not" none.
            later = f"(?!{gap}(?:or|and){gap}(?:any{gap})?(?:later|newer|above|higher|greater))(?!{gap}or{gap}at{gap}your{gap}option)" if k.startswith("gpl") and "notice" in k else ""
            runs.append(f"(?<=[ SL])(?<!not[ L]){gap.join(v.split())}(?=[ SL]){later}")
    return "|".join(runs)


def normalised(text: Column) -> Column:
    """Words of a text in lower case; S stands at the end of a sentence and L at that of a line, with comment words after it left out."""
    x = F.regexp_replace(F.regexp_replace(F.lower(text), r"[.!?]+\s+", "S"), r"[\n\r]+(?:[ \t]*(?:rem|dnl)(?=[ \t]))?", "L")
    return F.concat(F.lit("S"), F.regexp_replace(x, "[^a-z0-9SL]+", " "), F.lit("S"))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, k)])
    low = F.lower(text)
    hinted = low.contains(HINTS[0])
    for h in HINTS[1:]:
        hinted = hinted | low.contains(h)
    found = F.regexp_extract_all(normalised(text), F.lit(_pattern()), F.lit(0))
    ids = F.filter(F.transform(found, lambda s: F.try_element_at(known, F.regexp_replace(s, "[ L]+", " "))), lambda i: i.isNotNull())
    return F.when(hinted, ids).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_sentences (known ones), sentence_ids, n_rules (matched runs), licenses (distinct, in the order of the rules).

    ``sentence_ids`` are joined by commas.  Matching takes the rules in order; each takes all its
    runs out of the sequence, so that no identifier counts twice.
    """
    rows = docs.select(docs[key].cast("long").alias(key), identifiers(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("_ids"))
    left = F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(","))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(ids) + ",").alias("run")) for name, ids in RULES])
    empty = F.struct(left.alias("left"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"))

    def apply(acc, rule):
        rest = F.replace(acc["left"], rule["run"], F.lit("|"))
        hits = F.length(F.regexp_replace(rest, r"[^|]", "")) - F.length(F.regexp_replace(acc["left"], r"[^|]", ""))
        return F.struct(rest.alias("left"), (acc["n"] + hits).alias("n"), F.when(hits > 0, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    found = F.when(F.size("_ids") > 0, F.aggregate(rules, empty, apply))
    return rows.withColumn("_f", found).select(
        key,
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.coalesce(F.col("_f.n"), F.lit(0)).cast("long").alias("n_rules"),
        F.coalesce(F.array_join(F.array_distinct("_f.names"), ","), F.lit("")).alias("licenses"),
    )
