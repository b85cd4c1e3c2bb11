"""Licence scan by sentence rules.

Line ends and stops followed by a blank are boundaries of a text. A known sentence is found where its normalised
words (A-Z lower-cased, every other sign a blank) stand from one boundary to another; boundaries inside it are
passed over, so it may be wrapped or hold a colon. From left to right, the longest known sentence goes first. The
identifiers of a text, in order, are matched against ordered rules, the most specific first. A rule takes its
identifiers out of the sequence, so that a shorter rule does not report the same sentences again.

Everything happens inside the row, so nothing is shuffled and doc_id need not be unique. A null or empty
text, or one without known sentences, gives no identifiers and an empty list of licences; an empty table
gives an empty frame. Texts of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences in normalised form, each with its identifier.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2",
    "this file is licensed under the apache license version 2 0": "apache2",
    "you may not use this file except in compliance with the license": "apache_use",
    "you may obtain a copy of the license at": "apache_copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind": "as_is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc_grant",
    "licensed under the isc license": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd_grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd_binary",
    "licensed under the bsd 2 clause license": "bsd2",
    "licensed under the bsd 3 clause license": "bsd3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 2": "gpl2",
    "licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu lesser general public license version 3": "lgpl3",
    "licensed under the gnu affero general public license version 3": "agpl3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl_terms",
    "either version 2 of the license or at your option any later version": "or_later_2",
    "either version 3 of the license or at your option any later version": "or_later_3",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl_hope",
    "licensed under the mozilla public license version 2 0": "mpl2",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2",
    "licensed under cc by 4 0": "cc_by_4",
    "licensed under cc by sa 4 0": "cc_by_sa_4",
    "licensed under cc by nc 4 0": "cc_by_nc_4",
    "licensed under cc by nd 4 0": "cc_by_nd_4",
    "licensed under cc by nc sa 4 0": "cc_by_nc_sa_4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc_by_4",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache2",
    "spdx license identifier gpl 3 0 or later": "gpl3_later",
}

# Licences with the identifiers that stand for them, in the order in which they are tried.
RULES = [
    ("GPL-2.0-or-later", ["gpl_terms", "or_later_2", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl_terms", "or_later_2"]),
    ("GPL-3.0-or-later", ["gpl_terms", "or_later_3", "gpl_hope"]),
    ("GPL-3.0-or-later", ["gpl_terms", "or_later_3"]),
    ("GPL-3.0-or-later", ["gpl3_later"]),
    ("Apache-2.0", ["apache2", "apache_use", "apache_copy", "apache_see"]),
    ("Apache-2.0", ["apache2", "apache_use", "apache_copy"]),
    ("Apache-2.0", ["apache2"]),
    ("MIT", ["mit", "mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit"]),
    ("ISC", ["isc_grant", "as_is"]),
    ("ISC", ["isc"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD-2-Clause", ["bsd2"]),
    ("BSD-3-Clause", ["bsd3"]),
    ("GPL-2.0", ["gpl2"]),
    ("GPL-3.0", ["gpl3"]),
    ("LGPL-3.0", ["lgpl3"]),
    ("AGPL-3.0", ["agpl3"]),
    ("GPL", ["gpl_terms"]),
    ("MPL-2.0", ["mpl2"]),
    ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa_4"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-ND-4.0", ["cc_by_nd_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("Unlicense", ["unlicense"]),
    ("Proprietary", ["reserved"]),
]

# The sentences of the standard texts as they are issued, in full. ``*`` stands for one to eight words.
_FSF = "as published by the free software foundation"
_LATER = "or at your option any later version"
STANDARD_SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant_full",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant_full",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_as_is",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd_advert",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu general public license {_FSF} either version 2 of the license {_LATER}": "gpl2_later",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu general public license {_FSF} either version 3 of the license {_LATER}": "gpl3_later",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu general public license {_FSF} version 2 of the license": "gpl2",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 {_FSF}": "gpl2",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu general public license {_FSF} version 3 of the license": "gpl3",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu general public license {_FSF}": "gpl_terms",
    "* is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl_terms",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license {_FSF} either version 2 1 of the license {_LATER}": "lgpl21_later",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license {_FSF} either version 3 of the license {_LATER}": "lgpl3_later",
    f"* is free software you can redistribute it and or modify it under the terms of the gnu affero general public license {_FSF} either version 3 of the license {_LATER}": "agpl3_later",
} | {
    "spdx license identifier " + name: found
    for names, found in (
        ("mit", "mit"), ("apache 2 0", "apache2"), ("isc", "isc"), ("0bsd", "0bsd"), ("bsd 2 clause", "bsd2"), ("bsd 3 clause", "bsd3"),
        ("bsd 4 clause", "bsd4"), ("gpl 2 0|gpl 2 0 only", "gpl2"), ("gpl 3 0|gpl 3 0 only", "gpl3"), ("gpl 2 0 or later", "gpl2_later"),
        ("gpl 3 0 or later", "gpl3_later"), ("lgpl 2 1|lgpl 2 1 only", "lgpl21"), ("lgpl 2 1 or later", "lgpl21_later"),
        ("lgpl 3 0|lgpl 3 0 only", "lgpl3"), ("lgpl 3 0 or later", "lgpl3_later"), ("agpl 3 0|agpl 3 0 only", "agpl3"),
        ("agpl 3 0 or later", "agpl3_later"), ("mpl 2 0", "mpl2"), ("unlicense", "unlicense"), ("cc by 4 0", "cc_by_4"),
        ("cc by sa 4 0", "cc_by_sa_4"), ("cc by nc 4 0", "cc_by_nc_4"), ("cc by nd 4 0", "cc_by_nd_4"), ("cc by nc sa 4 0", "cc_by_nc_sa_4"),
    )
    for name in names.split("|")
}

# Rules of the standard texts, tried before RULES. "All rights reserved" is part of the BSD texts.
_BSD = ["bsd_grant", "bsd_source", "bsd_binary"]
STANDARD_RULES = [
    (name, front + _BSD + rest)
    for name, rest in (("BSD-4-Clause", ["bsd_advert", "bsd_endorse"]), ("BSD-3-Clause", ["bsd_endorse"]), ("BSD-2-Clause", []))
    for front in (["reserved"], [])
] + [
    ("GPL-2.0-or-later", ["gpl2_later", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_later"]),
    ("ISC", ["isc_grant_full", "isc_as_is"]),
    ("0BSD", ["isc_grant", "isc_as_is"]),
    ("0BSD", ["0bsd"]),
    ("BSD-4-Clause", ["bsd4"]),
    ("LGPL-2.1-or-later", ["lgpl21_later"]),
    ("LGPL-3.0-or-later", ["lgpl3_later"]),
    ("AGPL-3.0-or-later", ["agpl3_later"]),
    ("LGPL-2.1", ["lgpl21"]),
]

#: Every known sentence holds one of these, so texts without them need no cutting.
HINTS = ["licen", "permi", "copyright", "redistribut", "warrant", "reserved", "domain", "advertis"]
BOUNDARY = r"[.!?;:]+[ \t\r\n]+|[.!?;:]+$|[\r\n]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentence_pattern() -> str:
    """Regular expression of the known sentences, the longest first, over words with an X at each boundary."""
    between = " (?:X )*+"
    some = f"[a-z0-9]+(?:{between}[a-z0-9]+){{0,7}}?"
    known = sorted(SENTENCES | STANDARD_SENTENCES, key=lambda s: (-len(s.split()), s))
    words = [between.join(some if w == "*" else w for w in s.split()) for s in known]
    return f"X ({'|'.join(words)})(?= X)"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in (SENTENCES | STANDARD_SENTENCES).items() for x in pair])
    low = F.translate(text, UPPER, LOWER)
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | F.contains(low, F.lit(hint))
    later = F.regexp_replace(low, r"(gpl-[0-9.]+)\+", "$1-or-later")
    marked = F.concat(F.lit("X "), F.regexp_replace(later, BOUNDARY, " X "), F.lit(" X"))
    line = F.regexp_replace(marked, "[^a-z0-9X]+", " ")
    found = F.regexp_extract_all(line, F.lit(sentence_pattern()), F.lit(1))

    def identifier(sentence):
        sentence = F.regexp_replace(sentence, "X ", "")
        for wild in ("^.+ is free software", "^neither the name of .+ nor the names"):
            sentence = F.regexp_replace(sentence, wild, wild[1:].replace(".+", "*"))
        return F.element_at(known, sentence)

    ids = F.transform(found, lambda s: F.coalesce(F.element_at(known, F.regexp_replace(s, "X ", "")), identifier(s)))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(hinted, F.filter(ids, lambda x: x.isNotNull())), empty)


def matched_licences(ids: Column, rules=None) -> Column:
    """Licences whose identifiers stand next to each other in ``ids``, by ordered rules, without repeats."""
    table = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in parts)).alias("parts"))
            for name, parts in (rules or STANDARD_RULES + RULES)
        ]
    )
    sequence = F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc, rule):
        hit = F.contains(acc["rest"], rule["parts"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["parts"], F.lit("#"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        )

    return F.array_distinct(F.aggregate(table, start, step, lambda acc: acc["found"]))


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licences (comma-joined) of every row."""
    ids = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    none = F.array().cast("array<string>")
    licences = F.when(F.size("ids") > 0, matched_licences(F.col("ids"))).otherwise(none)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.concat_ws(",", "ids").alias("sentence_ids"),
        F.concat_ws(",", licences).alias("licences"),
    )


def scan_sql() -> str:
    """The scan of table ``documents`` as SQL, for texts whose known sentences are those of SENTENCES and stand unbroken
    between two boundaries, as in the given tables: one step per rule of RULES."""
    quoted = lambda x: "'" + x + "'"
    cases = " ".join(f"WHEN {quoted(s)} THEN {quoted(i)}" for s, i in SENTENCES.items())
    names = list(dict.fromkeys(name for name, _ in RULES))
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    parts = f"string_split_regex({low}, '{BOUNDARY}')".replace(r"\t", "\t").replace(r"\r", "\r").replace(r"\n", "\n")
    clean = "trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))"
    sql = (
        f"WITH s AS (SELECT doc_id, list_filter(list_transform({parts}, lambda s: CASE {clean} {cases} END), lambda x: x IS NOT NULL) AS ids FROM documents),\n"
        " r0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS rest, '' AS found FROM s)"
    )
    for k, (name, ids) in enumerate(RULES):
        part = quoted("".join(f"<{i}>" for i in ids))
        sql += (
            f",\n r{k + 1} AS (SELECT doc_id, ids, replace(rest, {part}, '#') AS rest,"
            f" found || CASE WHEN contains(rest, {part}) THEN {quoted(str(names.index(name)).zfill(2) + ',')} ELSE '' END AS found FROM r{k})"
        )
    last = f"r{len(RULES)}"
    pick = " || ".join(
        f"CASE WHEN contains(found, '{str(k).zfill(2)},') THEN {quoted(',' + n)} ELSE '' END" for k, n in enumerate(names)
    )
    return (
        f"{sql}\nSELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,"
        f" substr({pick}, 2) AS licences FROM {last}"
    )
