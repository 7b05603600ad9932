"""Licence scans by sentence rules.

A text is split into sentences, each is normalised (lower case, everything but
ASCII letters and digits as one space) and looked up among known licence
sentences.  The identifiers found, in text order, are matched against ordered
rules: a rule is a sequence of identifiers; where it occurs it names a licence
and takes its sentences away from later rules.  Sentences that no rule takes
are reported.

Texts are split twice, once with line ends as spaces and, inside the sentences
that are not known so, once more with every line end as a break, so both a
wrapped licence text and a one-line notice are seen, in one text too.
All of it is expressions within the row: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and common notices, normalised.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this software is released under the mit license": "MITref",
    "licensed under the apache license version 2 0": "Apache2ref",
    "released under the apache license version 2 0": "Apache2ref",
    "licensed under the apache license version 2 0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "Apache2use",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2warranty",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2see",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "licensed under the gnu general public license version 3": "GPL3ref",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "licensed under the gnu general public license version 2": "GPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "licensed under cc by 4 0": "CCBY4ref",
    "licensed under cc by sa 4 0": "CCBYSA4ref",
    "licensed under cc by nc 4 0": "CCBYNC4ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDname",
    "this is free and unencumbered software released into the public domain": "Unlicense",
}

# The rules, in order.  The longer one of two that begin alike comes first.
RULES = (
    ("Apache-2.0", ("Apache2ref", "Apache2use", "Apache2warranty", "Apache2see")),
    ("Apache-2.0", ("Apache2ref",)),
    ("MIT", ("MITgrant", "MITnotice", "MITwarranty")),
    ("MIT", ("MITgrant", "MITnotice")),
    ("MIT", ("MITref",)),
    ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDname")),
    ("BSD-2-Clause", ("BSDgrant", "BSDsource", "BSDbinary")),
    ("ISC", ("ISCgrant",)),
    ("GPL-3.0-or-later", ("GPL3plus",)),
    ("GPL-3.0-only", ("GPL3ref",)),
    ("GPL-2.0-or-later", ("GPL2plus",)),
    ("GPL-2.0-only", ("GPL2ref",)),
    ("CC-BY-4.0", ("CCBY4ref",)),
    ("CC-BY-SA-4.0", ("CCBYSA4ref",)),
    ("CC-BY-NC-4.0", ("CCBYNC4ref",)),
    ("Unlicense", ("Unlicense",)),
)

#: every known sentence has one of these words, so a text with none of them needs no splitting;
#: single words only, as a text may have anything where the sentence has a space
MARKS = ("licens", "permission", "redistribut", "warrant", "unencumbered")

BY_LINE = r"[.!?:]+[ \t]+|[.!?:]*[\r\n]+"
BY_SENTENCE = r"[.!?:]+\s+|\n[ \t\r]*\n"
#: a line that goes on after the end of a sentence
ACROSS = r"(?s)[A-Za-z0-9].*[.!?:][\x0B\f].*[A-Za-z0-9]"


def sequence_of(ids) -> str:
    """Identifiers as they are matched: each between semicolons."""
    return "".join(f";{x};" for x in ids)


def _identifiers(text: Column) -> Column:
    """Known sentences of both splits in text order; what both find counts once.

    A break between sentences is one between lines too, so lines lie within
    sentences.  Only punctuation right before a form feed or vertical tab ends
    no line: the known lines across such a place come last.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])

    def look(s: Column) -> Column:
        return F.try_element_at(known, F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))

    def both(s: Column) -> Column:
        return F.when(look(s).isNotNull(), F.array(look(s))).otherwise(F.transform(F.split(s, BY_LINE), look))

    found = F.flatten(F.transform(F.split(text, BY_SENTENCE), both))
    across = F.filter(F.split(text, BY_LINE), lambda s: F.rlike(s, F.lit(ACROSS)))
    across = F.when(F.rlike(text, F.lit(r"[.!?:][\x0B\f]")), F.transform(across, look)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(found, across), lambda x: x.isNotNull())


def _matched(ids: Column) -> Column:
    """struct(licences, left): the rules in their order over one identifier sequence."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(sequence_of(s)).alias("ids")) for n, s in RULES])
    start = F.struct(
        F.array().cast("array<string>").alias("licences"),
        F.concat(F.lit(""), F.array_join(F.transform(ids, lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "")).alias("left"),
    )

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.array_union(state["licences"], F.array(rule["name"]))).otherwise(state["licences"]).alias("licences"),
            F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"),
        )

    return F.aggregate(rules, start, apply)


def scan_licenses(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licence_ids`` (known sentences in text order), ``licences`` (sorted) and ``unmatched``.

    ``licence_ids`` are those of the split by sentences and those of the split
    by lines, each occurrence once.  ``unmatched`` are identifiers that no rule
    took.  Null and empty texts have none.  Existing columns of these names are
    replaced; rows are handled one by one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lower = F.lower(text)
    marked = F.contains(lower, F.lit(MARKS[0]))
    for mark in MARKS[1:]:
        marked = marked | F.contains(lower, F.lit(mark))
    none = F.array().cast("array<string>")
    columns = [c for c in docs.columns if c not in ("licence_ids", "licences", "unmatched")]
    found = docs.select(*columns, F.when(marked, _identifiers(text)).otherwise(none).alias("licence_ids"))
    found = found.withColumn("__m", F.when(F.size("licence_ids") > 0, _matched(F.col("licence_ids"))))
    left = F.filter(F.split(F.col("__m.left"), "[;|]+"), lambda x: x != "")
    return found.select(
        *columns,
        "licence_ids",
        F.coalesce(F.array_sort("__m.licences"), none).alias("licences"),
        F.coalesce(left, none).alias("unmatched"),
    )


def licence_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_sentences, sentence_ids, licences and n_unmatched, lists joined by commas."""
    found = scan_licenses(docs.select(id_col, text_col), text_col=text_col)
    return found.select(
        id_col,
        F.size("licence_ids").cast("bigint").alias("n_sentences"),
        F.array_join("licence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
        F.size("unmatched").cast("bigint").alias("n_unmatched"),
    )
