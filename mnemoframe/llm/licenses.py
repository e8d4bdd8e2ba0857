"""Licence scan by sentence rules.

A text is normalised, with marks where its sentences, lines and paragraphs end. Known licence sentences that stand between
two marks, on one line or wrapped over several, give their identifiers, and the sequence of identifiers is matched against
ordered licence rules. DataFrame functions only, no shuffle: the knowledge is small fixed tables, which become a pattern, a
map literal and a list of conditions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of licence texts and notices, by identifier.
SENTENCES: dict[str, str] = {
    "apache2.notice": "licensed under the apache license version 2 0",
    "apache2.work": "this work is licensed under the apache license version 2 0",
    "apache2.released": "released under the apache license version 2 0",
    "apache2.use": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit.notice": "licensed under the mit license",
    "mit.work": "this work is licensed under the mit license",
    "mit.released": "released under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied",
    "gpl3.notice": "licensed under the gnu general public license version 3",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.released": "released under the gnu general public license version 3",
    "gpl.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl2.notice": "licensed under the gnu general public license version 2",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd3.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3.notice": "licensed under the bsd 3 clause license",
    "mpl2.notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ccby4.notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4.notice": "licensed under cc by nc 4 0",
    "ccby4.short": "licensed under cc by 4 0",
    "rights.reserved": "all rights reserved",
    "apache2.basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2.see": "see the license for the specific language governing permissions and limitations under the license",
    "mit.include": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "gpl.copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl.hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl.see": "see the gnu lesser general public license for more details",
    "agpl.see": "see the gnu affero general public license for more details",
    "lgpl21.notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3.notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl2.copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc.warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense.domain": "this is free and unencumbered software released into the public domain",
    "unlicense.free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0.notice": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl1.notice": "distributed under the boost software license version 1 0",
    "apache2.title": "apache license version 2 0 january 2004",
    "gpl3.title": "gnu general public license version 3 29 june 2007",
    "gpl2.title": "gnu general public license version 2 june 1991",
    "lgpl3.title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21.title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3.title": "gnu affero general public license version 3 19 november 2007",
    "mpl2.title": "mozilla public license version 2 0",
    "epl2.title": "eclipse public license v 2 0",
}
#: Fixed values: (licence, sequence of identifiers) in the order in which they are tried. The first that fits names the licence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2.notice", "apache2.use", "apache2.copy")),
    ("MIT", ("mit.grant", "mit.include", "mit.warranty")),
    ("MIT", ("mit.grant", "mit.warranty")),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd3.endorse")),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd3.endorse")),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.warranty")),
    ("BSD-2-Clause", ("bsd.redistribution",)),
    ("Unlicense", ("unlicense.domain", "unlicense.free")),
    ("MPL-2.0", ("mpl2.notice", "mpl2.copy")),
    ("ISC", ("isc.grant", "isc.warranty")),
    ("AGPL-3.0", ("agpl3.notice",)),
    ("LGPL-3.0", ("lgpl3.notice",)),
    ("LGPL-2.1", ("lgpl21.notice",)),
    ("Apache-2.0", ("apache2.work",)),
    ("Apache-2.0", ("apache2.released",)),
    ("Apache-2.0", ("apache2.notice",)),
    ("MIT", ("mit.work",)),
    ("MIT", ("mit.released",)),
    ("MIT", ("mit.notice",)),
    ("MIT", ("mit.grant",)),
    ("GPL-3.0", ("gpl3.work",)),
    ("GPL-3.0", ("gpl3.released",)),
    ("GPL-3.0", ("gpl3.notice",)),
    ("GPL-2.0", ("gpl2.notice",)),
    ("GPL", ("gpl.redistribute",)),
    ("BSD-3-Clause", ("bsd3.notice",)),
    ("MPL-2.0", ("mpl2.notice",)),
    ("ISC", ("isc.grant",)),
    ("CC-BY-4.0", ("ccby4.notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4.notice",)),
    ("CC-BY-NC-4.0", ("ccbync4.notice",)),
    ("CC-BY-4.0", ("ccby4.short",)),
    ("Unlicense", ("unlicense.domain",)),
    ("CC0-1.0", ("cc0.notice",)),
    ("Zlib", ("zlib.grant",)),
    ("BSL-1.0", ("bsl1.notice",)),
    ("Apache-2.0", ("apache2.title",)),
    ("GPL-3.0", ("gpl3.title",)),
    ("GPL-2.0", ("gpl2.title",)),
    ("LGPL-3.0", ("lgpl3.title",)),
    ("LGPL-2.1", ("lgpl21.title",)),
    ("AGPL-3.0", ("agpl3.title",)),
    ("MPL-2.0", ("mpl2.title",)),
    ("EPL-2.0", ("epl2.title",)),
    ("proprietary", ("rights.reserved",)),
)
#: A text with one of these grants rights, whatever its copyright line reserves.
GRANTS = ("bsd.redistribution", "mit.grant", "isc.grant", "apache2.use", "gpl.redistribute", "mpl2.notice", "zlib.grant", "unlicense.free")
#: Licences that a file may name in one line; sentences and rules for them follow from the names.
NAMED = (
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Zlib", "BSL-1.0", "EPL-2.0", "0BSD", "MIT-0", "PostgreSQL", "Python-2.0", "EUPL-1.2",
)
SENTENCES |= {f"spdx.{n}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", n.lower()) for n in NAMED}
RULES += tuple((n, (f"spdx.{n}",)) for n in NAMED)
_MIT = SENTENCES["mit.grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_GPL = SENTENCES["gpl.redistribute"] + " as published by the free software foundation"
_USE = "version 2 0 the license you may not use this file except in compliance with the license"
#: Sentences as the licences and their file headers have them in full, with the identifiers they stand for.
WHOLE: dict[str, str] = {
    "licensed under the apache license " + _USE: "apache2.notice,apache2.use",
    "the asf licenses this file to you under the apache license " + _USE: "apache2.notice,apache2.use",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2.copy",
    SENTENCES["mpl2.copy"].replace("https", "http"): "mpl2.copy",
    _MIT: "mit.grant",
    SENTENCES["mit.warranty"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.warranty",
    **{f"{_GPL} {either}version {n} of the license{later}": f"gpl.redistribute,gpl{n}.notice" for n in (2, 3) for either in ("", "either ") for later in ("", " or at your option any later version")},
    _GPL: "gpl.redistribute",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
}
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_IN = "(?:this [a-z]+ is |the [a-z]+ is |it is |distributed and |released and )?licensed under (?:the |a )?"
_SEE = "(?: see (?:the )?[a-z]+(?: [a-z]+)?(?: file)?(?: for (?:more |the full )?(?:details|information|text))?)?"
#: Sentences that name somebody, a work or a file, as patterns, and the known sentence that each stands for. ``*`` is one to twelve words.
HOLES: tuple[tuple[str, str], ...] = (
    (f"neither the names? of * nor the names? of (?:its|their|any|other|the|[a-z ]{{1,30}}) ?contributors {_ENDORSE}", SENTENCES["bsd3.endorse"]),
    (f"neither the names? of * {_ENDORSE}", SENTENCES["bsd3.endorse"]),
    ("the names? of * may not be used to endorse or promote products derived from this software without specific prior written permission", SENTENCES["bsd3.endorse"]),
    ("this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", SENTENCES["bsd.warranty"]),
    (f"{_IN}creative commons attribution 4 0 international(?: license)?(?: cc by 4 0)?{_SEE}", SENTENCES["ccby4.notice"]),
    (f"{_IN}creative commons attribution sharealike 4 0 international(?: license)?(?: cc by sa 4 0)?{_SEE}", SENTENCES["ccbysa4.notice"]),
    (f"(?:* is |{_IN[: -len('(?:the |a )?')].replace('licensed under ', '')})licensed under (?:the |a )?(?:terms of the )?mit license{_SEE}", SENTENCES["mit.work"]),
    (f"(?:* is )licensed under (?:the |a )?(?:terms of the )?apache license (?:version |v )?2 0{_SEE}", SENTENCES["apache2.work"]),
    (f"(?:* is )?licensed under (?:the |a )?(?:terms of the )?bsd 3 clause license{_SEE}", SENTENCES["bsd3.notice"]),
    (f"(?:* is )licensed under (?:the |a )?(?:terms of the )?gnu general public license (?:version |v )?3(?: 0)?{_SEE}", SENTENCES["gpl3.work"]),
)
#: Every known sentence has one of these, so that other texts needn't be cut up.
ANCHORS = "licen|permission|warrant|distribut|endorse|reserved|liab|public domain"


def marked(text: Column) -> Column:
    """Lower case; S, L and P where a sentence, a line and a paragraph end; runs of anything but a-z and 0-9 become one space.

    A version number behind "v." goes on with its sentence, and so does a URL in a paragraph of its own. Lines without a
    letter or digit, such as those of comment marks alone, part paragraphs.
    """
    t = F.regexp_replace(F.lower(text), r"\bv\.\s+(?=[0-9])", "v ")
    t = F.regexp_replace(t, r"(?<![.!?])[.!?]++\s++", "S")
    t = F.regexp_replace(t, r"\n[^\p{L}\p{N}]*\n", "P")
    t = F.regexp_replace(t, r"P(?=[^\p{L}\p{N}]*+https?://)", "L")
    t = F.regexp_replace(F.regexp_replace(t, r"\n", "L"), "[^a-z0-9SLP]+", " ")
    return F.trim(F.regexp_replace(t, " ?([SLP]) ?", "$1"))


def _filled(t: Column) -> Column:
    """Marked text in which sentences with holes are the known ones that they stand for; a line may end behind each word, and a full stop stand in a hole ("Inc.")."""
    for hole, sentence in HOLES:
        t = F.regexp_replace(t, "(?<![^SLP])" + hole.replace("* ", "(?:[a-z0-9]+_){1,12}").replace(" ", "[ L]").replace("_", "[ LS]") + "(?![^SLP])", sentence)
    return t


def _pattern(sentences: Iterable[str]) -> str:
    """Any of ``sentences`` between two marks, the longest first; a line may end behind each word."""
    longest = sorted(sentences, key=lambda s: (-len(s), s))
    return f"(?<![^SLP])(?:{'|'.join(s.replace(' ', '[ L]') for s in longest)})(?![^SLP])"


def scan_licenses(
    docs: DataFrame, text: str = "text", sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, whole: Mapping[str, str] = WHOLE
) -> DataFrame:
    """``docs`` with license_sentences (identifiers in text order, comma-joined), licenses (licences of all rules that fit,
    in rule order, each once, comma-joined), license (that of the first rule; null if none) and n_license_sentences.

    A rule fits if its identifiers follow one another among the text's known sentences; reserved rights are no licence beside a sentence that grants some. A null
    or empty text has none, a very long one is scanned whole, an empty table gives no rows.
    Sentences of ``whole`` stand for one or more identifiers of ``sentences``; a longer known sentence goes before those it
    holds. Input columns named like a new one are replaced; every row gives one row.
    """
    ids_of = {v: k for k, v in sentences.items()} | {v: k for v, k in whole.items() if all(i in sentences for i in k.split(","))}
    if missing := [v for v in ids_of if not any(a in v for a in ANCHORS.split("|"))]:
        raise ValueError(f"known sentences without an anchor: {missing}")
    cols = [c for c in docs.columns if c not in ("license_sentences", "licenses", "license", "n_license_sentences")]
    known = F.create_map(*[F.lit(x) for pair in ids_of.items() for x in pair])
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.lit(0).alias("none")).alias("r"), F.col(f"`{text}`").alias("t"))
    found = F.regexp_extract_all(_filled(marked(F.col("t"))), F.lit(_pattern(ids_of)), F.lit(0))
    ids = F.flatten(F.transform(found, lambda s: F.split(F.element_at(known, F.translate(s, "L", " ")), ",")))
    rows = rows.select("r", F.when(F.lower("t").rlike(ANCHORS), ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    rows = rows.withColumn("seq", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))
    fits = [F.when(F.contains(F.col("seq"), F.lit("," + ",".join(seq) + ",")), F.lit(name)) for name, seq in rules]
    rows = rows.withColumn("found", F.when(F.size("ids") > 0, F.array_distinct(F.array_compact(F.array(*fits)))).otherwise(F.array().cast("array<string>")))
    granted = F.arrays_overlap("ids", F.array(*[F.lit(g) for g in GRANTS]))
    rows = rows.withColumn("found", F.when(granted, F.array_remove("found", "proprietary")).otherwise(F.col("found")))
    return rows.select(
        *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(cols)],
        F.array_join("ids", ",").alias("license_sentences"),
        F.array_join("found", ",").alias("licenses"),
        F.try_element_at("found", F.lit(1)).alias("license"),
        F.size("ids").cast("bigint").alias("n_license_sentences"),
    )
