"""Licence scan by sentence rules (operator 3). DataFrame functions only.

A text is cut after . ! ? : or ; before white space and at line ends. A known sentence is found where, normalised (A-Z lower-cased, runs of
other characters than a-z and 0-9 made one space), it fills one line or several that follow each other, up to cuts on both sides: a heading or copyright
line before it doesn't hide it, nor does wrapping. ``INNER`` lists where known sentences have such marks inside. The known sentences' identifiers, in
order, are matched against ordered rules: a rule fires where its identifiers follow each other among the known ones and aren't part of a longer rule's match. Texts without any
trigger word are passed over: every known sentence has one.

Defined results: null, empty and unmatched texts have no sentence and an empty licence list; rows come back as they
are, null and repeated ids included; a licence is named once, in rule order; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised, and the rules over them.
SENTENCES: dict[str, str] = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "mit-spdx": "spdx license identifier mit",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-spdx": "spdx license identifier apache 2 0",
    "gpl3-free": "this program is free software",
    "gpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-implied": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl3-spdx": "spdx license identifier gpl 3 0 or later",
    "bsd-permitted": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3-spdx": "spdx license identifier bsd 3 clause",
    "bsd2-spdx": "spdx license identifier bsd 2 clause",
    "ccby-licensed": "licensed under cc by 4 0",
    "ccbysa-licensed": "licensed under cc by sa 4 0",
    "ccbync-licensed": "licensed under cc by nc 4 0",
    "ccby-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-spdx": "spdx license identifier cc0 1 0",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-spdx": "spdx license identifier mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-library": "this library is free software",
    "lgpl21-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-redistribute": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2-spdx": "spdx license identifier epl 2 0",
    "isc-spdx": "spdx license identifier isc",
    "lgpl21-spdx": "spdx license identifier lgpl 2 1 or later",
    "lgpl3-spdx": "spdx license identifier lgpl 3 0 or later",
    "agpl3-spdx": "spdx license identifier agpl 3 0 or later",
    "agpl3-only-spdx": "spdx license identifier agpl 3 0 only",
    "gpl2-only-spdx": "spdx license identifier gpl 2 0 only",
    "gpl2-spdx": "spdx license identifier gpl 2 0 or later",
    "gpl3-only-spdx": "spdx license identifier gpl 3 0 only",
    "unlicense-spdx": "spdx license identifier unlicense",
    "bsl-spdx": "spdx license identifier bsl 1 0",
    "ccby-spdx": "spdx license identifier cc by 4 0",
    "bsd-names-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-author": "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-authors": "neither the name of the author nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-organization": "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-company": "neither the name of the company nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-project": "neither the name of the project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-holders": "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-foundation": "neither the name of the foundation nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name-author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "lgpl3-body": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "cc0-offers": "affirmer offers the work as is and makes no representations or warranties of any kind concerning the work express implied statutory or otherwise including without limitation warranties of title merchantability fitness for a particular purpose non infringement or the absence of latent or other defects accuracy or the present or absence of errors whether or not discoverable all to the greatest extent permissible under applicable law",
    "zlib-provided": "this software is provided as is without any express or implied warranty",
    "zlib-granted": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-spdx": "spdx license identifier zlib",
    "mit-or-apache-spdx": "spdx license identifier mit or apache 2 0",
    "apache-or-mit-spdx": "spdx license identifier apache 2 0 or mit",
}
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-spdx",)),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-header", "apache-comply")),
    ("Apache-2.0", ("apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-spdx",)),
    ("GPL-3.0", ("gpl3-free", "gpl3-redistribute")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-spdx",)),
    ("GPL-2.0", ("gpl3-free", "gpl2-redistribute")),
    ("GPL-2.0", ("gpl2-work",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd3-spdx",)),
    ("BSD-2-Clause", ("bsd-permitted", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd2-spdx",)),
    ("CC-BY-4.0", ("ccby-licensed",)),
    ("CC-BY-4.0", ("ccby-work",)),
    ("CC-BY-SA-4.0", ("ccbysa-licensed",)),
    ("CC-BY-SA-4.0", ("ccbysa-work",)),
    ("CC-BY-NC-4.0", ("ccbync-licensed",)),
    ("CC-BY-NC-4.0", ("ccbync-work",)),
    ("CC0-1.0", ("cc0-spdx",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("MPL-2.0", ("mpl2-spdx",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-spdx",)),
    ("LGPL-2.1", ("lgpl-library", "lgpl21-redistribute")),
    ("LGPL-2.1", ("lgpl21-spdx",)),
    ("LGPL-3.0", ("lgpl-library", "lgpl3-redistribute")),
    ("LGPL-3.0", ("lgpl3-spdx",)),
    ("AGPL-3.0", ("gpl3-free", "agpl3-redistribute")),
    ("AGPL-3.0", ("agpl3-spdx",)),
    ("AGPL-3.0", ("agpl3-only-spdx",)),
    ("GPL-2.0", ("gpl2-only-spdx",)),
    ("GPL-2.0", ("gpl2-spdx",)),
    ("GPL-3.0", ("gpl3-only-spdx",)),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("Unlicense", ("unlicense-spdx",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-spdx",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-2.0", ("epl2-spdx",)),
    ("CC-BY-4.0", ("ccby-spdx",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names-university",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names-author",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names-authors",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names-organization",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names-company",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names-project",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names-holders",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-names-foundation",)),
    ("BSD-3-Clause", ("bsd-permitted", "bsd-source", "bsd-binary", "bsd-name-author",)),
    ("Apache-2.0", ("apache-grant",)),
    ("LGPL-3.0", ("lgpl3-body",)),
    ("CC0-1.0", ("cc0-offers",)),
    ("Zlib", ("zlib-provided", "zlib-granted",)),
    ("Zlib", ("zlib-spdx",)),
    ("MIT", ("mit-or-apache-spdx",)),
    ("Apache-2.0", ("mit-or-apache-spdx",)),
    ("MIT", ("apache-or-mit-spdx",)),
    ("Apache-2.0", ("apache-or-mit-spdx",)),
)
TRIGGERS = ("license", "copyright", "warranty", "permission", "free software", "conditions are met", "written permission", "copies of the software", "free and unencumbered", "anyone is free", "affirmer offers")
# End of the fixed values.

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]"
_LINE, _END = "\x01", "\x02"
#: Words of known sentences between which the public texts have a mark that ends sentences elsewhere.
INNER = ("foundation either", "license v 2 0")
#: The tag whose colon ends no sentence.
TAG = "spdx license identifier"


def _pattern() -> str:
    """Any known sentence between two cuts, the longest first; between its words a line may end."""
    made = []
    for s in sorted(SENTENCES.values(), key=len, reverse=True):
        own = s
        for words in INNER:
            own = own.replace(words, words.replace(" ", "\0"))
        own = own.replace(TAG + " ", TAG + "\0")
        made.append(own.replace(" ", f"[ {_LINE}]").replace("\0", f"[ {_LINE}{_END}]"))
    return f"(?<=[{_LINE}{_END}])(?:{'|'.join(made)})(?=[{_LINE}{_END}])"


def _marked(text: Column) -> Column:
    """The normalised text with a mark for each line end and each sentence end; every expression is linear in the text."""
    lower = F.translate(text, UPPER + _LINE + _END, LOWER + "  ")
    lines = F.translate(F.regexp_replace(lower, "[.!?:;]" + _SPACE + "+", _END), "\n\x0b\x0c\r", _LINE * 4)
    spaced = F.concat(F.lit(_END), F.regexp_replace(lines, f"[^a-z0-9{_LINE}{_END}]+", " "), F.lit(_END))
    return F.regexp_replace(F.regexp_replace(spaced, f"[ {_LINE}]{{2,}}", _LINE), f"[ {_LINE}{_END}]{{2,}}", _END)


def _longer(ids: tuple[str, ...]) -> list[str]:
    """The earlier rules that hold this one's identifiers and more: where such a rule matches, it takes them."""
    held = "," + ",".join(ids) + ","
    return [own for own in ("," + ",".join(other) + "," for _, other in RULES) if held in own and own != held]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known (known sentences), sentences (their identifiers in order) and licences (names), comma-separated, of every row."""
    known = F.array(*[F.lit(s) for s in SENTENCES.values()])
    names = F.array(*[F.lit(n) for n in SENTENCES])
    trigger = "(" + "|".join(t.replace(" ", "[^a-z0-9]+") for t in TRIGGERS) + ")"
    candidate = F.translate(text_col, UPPER, LOWER).rlike(trigger)
    matched = F.regexp_extract_all(_marked(F.col(text_col)), F.lit(_pattern()), F.lit(0))
    found = F.transform(matched, lambda s: F.element_at(names, F.array_position(known, F.translate(s, _LINE + _END, "  ")).cast("int")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(candidate, found).otherwise(F.array().cast("array<string>")).alias("ids"))
    joined = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))

    def left(ids: tuple[str, ...]) -> Column:
        out = F.col("joined")
        for taken in _longer(ids):
            out = F.replace(out, F.lit(taken), F.lit(",,"))
        return out

    fired = F.array(*[F.when(F.instr(left(ids), "," + ",".join(ids) + ",") > 0, F.lit(name)) for name, ids in RULES])
    rows = rows.withColumn("joined", joined)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentences"), F.array_join(F.array_distinct(F.array_compact(fired)), ",").alias("licences"))


def oracle() -> str:
    """The same result in DuckDB's SQL, without the trigger words, on texts whose known sentences fill a whole sentence or line."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    normal = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"

    def left(ids: tuple[str, ...]) -> str:
        out = "joined"
        for taken in _longer(ids):
            out = f"replace({out}, '{taken}', ',,')"
        return out

    rules = ", ".join(f"CASE WHEN contains({left(ids)}, ',{','.join(ids)},') THEN {k} END" for k, (_, ids) in enumerate(RULES))
    licence = quoted(name for name, _ in RULES)
    order = {name: k for k, (name, _) in reversed(list(enumerate(RULES)))}
    first = "[" + ", ".join(str(order[name]) for name, _ in RULES) + "]"
    return f"""
WITH known AS (SELECT {quoted(SENTENCES.values())} AS k, {quoted(SENTENCES)} AS n),
cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(spdx-license-identifier):[\\x20\\x09-\\x0D]+', '\\1 ', 'gi'), '([.!?:;])[\\x20\\x09-\\x0D]+', '\\1' || chr(1), 'g'), chr(1)) AS segs FROM documents),
made AS (SELECT doc_id, k, n, flatten(list_transform(segs, lambda s: CASE WHEN list_contains(k, {normal('s')}) THEN [{normal('s')}] ELSE list_transform(string_split_regex(s, '[\\n\\x0B\\x0C\\r]'), lambda l: {normal('l')}) END)) AS normal FROM cut, known),
ids AS (SELECT doc_id, list_transform(list_filter(normal, lambda s: list_contains(k, s)), lambda s: n[list_position(k, s)]) AS ids FROM made),
joined AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS joined FROM ids),
fired AS (SELECT doc_id, ids, list_sort(list_distinct(list_transform(list_filter([{rules}], lambda r: r IS NOT NULL), lambda r: ({first})[r + 1]))) AS fired FROM joined)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentences,
       coalesce(array_to_string(list_transform(fired, lambda r: ({licence})[r + 1]), ','), '') AS licences FROM fired"""
