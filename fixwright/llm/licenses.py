"""Finding licences by the sentences that state them.

A text is cut into sentences, each is normalised (letters A-Z lowered, punctuation to
single spaces), and the ones with a licence word are looked up among known licence
sentences, each with an identifier. What is left of a text is the sequence of these
identifiers, and ordered rules name the licence: a rule matches a run of identifiers,
longer and more specific rules stand first, and a rule uses up what it has matched.
Sentences with a licence word that nobody knows stay visible as ``Unknown``.

All of it is column expressions over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, shadowed

#: Words of which a sentence must have one to be looked at.
WORDS = "licen[cs]|copyright|spdx|permission|warrant|redistribut|public domain|all rights reserved|merchantab"

GRANT = "(?:this (?:work|file|software|program|project|code|document|page|text|content|material) is )?(?:licensed|released|distributed|made available|available|provided|published) under (?:the )?(?:terms of (?:the )?)?"

#: Known sentences, tried in this order: identifier, pattern of the whole normalised sentence.
SENTENCES = [
    ("GplV3", GRANT + "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: v| version )?3(?:\\.0)?(?: only)?"),
    ("GplV3Later", GRANT + "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: v| version )?3(?:\\.0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("GplV2", GRANT + "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: v| version )?2(?:\\.0)?(?: only)?"),
    ("GplV2Later", GRANT + "(?:gnu general public licen[cs]e|gnu gpl|gpl)(?: v| version )?2(?:\\.0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("GplAny", GRANT + "(?:gnu general public licen[cs]e|gnu gpl|gpl)"),
    ("LgplV3", GRANT + "(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl)(?: v| version )?3(?:\\.0)?"),
    ("LgplV21", GRANT + "(?:gnu lesser general public licen[cs]e|gnu lgpl|lgpl)(?: v| version )?2\\.1"),
    ("AgplV3", GRANT + "(?:gnu affero general public licen[cs]e|gnu agpl|agpl)(?: v| version )?3(?:\\.0)?"),
    ("ApacheV2", GRANT + "apache (?:software )?licen[cs]e(?: v| version )?2(?:\\.0)?"),
    ("ApacheTitle", "apache licen[cs]e"),
    ("VersionTwoDate", "version 2\\.0 january 2004(?: http www\\.apache\\.org licen[cs]es)?"),
    ("ApacheCompliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("ApacheObtain", "you may obtain a copy of the licen[cs]e at(?: http.*)?"),
    ("Mit", GRANT + "(?:an |a )?mit(?: style)? licen[cs]e"),
    ("MitTitle", "(?:the )?mit licen[cs]e(?: mit)?"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy.*"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included.*"),
    ("AsIs", "(?:the|this) software is provided (?:by .* )?as is.*"),
    ("Bsd2", GRANT + "(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: .*)?licen[cs]e"),
    ("Bsd3", GRANT + "(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: .*)?licen[cs]e"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BsdSource", "(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", "(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdNoEndorse", "(?:3 )?neither the name of .* may be used to endorse or promote products.*permission"),
    ("MplV2", GRANT + "mozilla public licen[cs]e(?: v| version )?2(?:\\.0)?"),
    ("Isc", GRANT + "isc licen[cs]e"),
    ("CcBy", GRANT + "(?:cc by|creative commons attribution)(?: international| licen[cs]e)?(?: [1-4]\\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("CcBySa", GRANT + "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4]\\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("CcByNc", GRANT + "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4]\\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("CcByNcSa", GRANT + "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4]\\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("CcByNd", GRANT + "(?:cc by nd|creative commons attribution no ?derivatives)(?: [1-4]\\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("CcByNcNd", GRANT + "(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives)(?: [1-4]\\.[0-9])?(?: international)?(?: licen[cs]e)?"),
    ("Cc0", GRANT + "(?:cc0|creative commons zero)(?: [1-4]\\.[0-9])?(?: universal)?(?: licen[cs]e)?"),
    ("PublicDomain", "this (?:work|file|software|text|document) is (?:in|dedicated to|placed in|released into) the public domain"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("Spdx", "spdx license identifier .*"),
    ("AllRights", "(?:copyright .*)?all rights reserved"),
    ("Copyright", "(?:portions )?copyright (?:c )?(?:19|20)[0-9]{2}.*"),
]

#: Licences by the run of identifiers that states them, tried in this order.
RULES = [
    ("Apache-2.0", ["ApacheTitle", "VersionTwoDate"]),
    ("Apache-2.0", ["ApacheV2", "ApacheCompliance", "ApacheObtain"]),
    ("Apache-2.0", ["ApacheV2"]),
    ("MIT", ["MitTitle", "Copyright", "MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["Copyright", "MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs"]),
    ("MIT", ["MitTitle", "MitGrant"]),
    ("MIT", ["Mit"]),
    ("MIT", ["MitTitle"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["Bsd3"]),
    ("BSD-2-Clause", ["Bsd2"]),
    ("GPL-3.0-or-later", ["GplV3Later"]),
    ("GPL-3.0-only", ["GplV3"]),
    ("GPL-2.0-or-later", ["GplV2Later"]),
    ("GPL-2.0-only", ["GplV2"]),
    ("GPL", ["GplAny"]),
    ("LGPL-3.0-only", ["LgplV3"]),
    ("LGPL-2.1-only", ["LgplV21"]),
    ("AGPL-3.0-only", ["AgplV3"]),
    ("MPL-2.0", ["MplV2"]),
    ("ISC", ["Isc"]),
    ("CC-BY-NC-ND", ["CcByNcNd"]),
    ("CC-BY-NC-SA", ["CcByNcSa"]),
    ("CC-BY-NC", ["CcByNc"]),
    ("CC-BY-ND", ["CcByNd"]),
    ("CC-BY-SA", ["CcBySa"]),
    ("CC-BY", ["CcBy"]),
    ("CC0-1.0", ["Cc0"]),
    ("Unlicense", ["Unlicense"]),
    ("Public-Domain", ["PublicDomain"]),
    ("All-Rights-Reserved", ["Copyright", "AllRights"]),
    ("All-Rights-Reserved", ["AllRights"]),
]

#: A text without any of these has no sentence to look at.
HINTS = "licen[cs]|copyright|spdx|permission|warrant|redistribut|public|rights|merchantab"
#: Ends a sentence within a line.
ENDS = "[.!?;:]+(?:[ \\t\\r]+|\\z)"
ADDED = ("n_sentences", "sentence_ids", "licences", "verdict")


def sentences(text: Column) -> Column:
    """The normalised sentences of a text that have a licence word, in order."""
    cut = F.flatten(F.transform(F.split(lower_ascii(text), "\n"), lambda line: F.split(line, ENDS)))
    return F.filter(F.transform(cut, _normal), lambda s: s.rlike(WORDS))


def _normal(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9.]+", " "), "^[ .]+|[ .]+$", "")


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, Unknown if no known sentence is like it."""
    (first, pattern), *rest = SENTENCES
    found = F.when(sentence.rlike(f"^(?:{pattern})$"), first)
    for name, pattern in rest:
        found = found.when(sentence.rlike(f"^(?:{pattern})$"), name)
    return found.otherwise("Unknown")


def _tags(names: list[str]) -> str:
    return "".join(f"<{n}>" for n in names)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``n_sentences``, ``sentence_ids``, ``licences`` and ``verdict``.

    ``sentence_ids`` are the identifiers in text order and ``licences`` the distinct names
    in alphabetical order, both joined by commas. The verdict is none (no sentence with a
    licence word), known (all identifiers used up by rules), partly (some) or unknown (no
    rule matched). A null text counts as empty: none. Input columns with these names are
    replaced; rows are neither merged nor dropped.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ids = F.when(lower_ascii(whole).rlike(HINTS), F.transform(sentences(whole), identifier)).otherwise(
        F.array().cast("array<string>")
    )
    rules = F.array(*[F.struct(F.lit(_tags(r)).alias("run"), F.lit(name).alias("name")) for name, r in RULES])
    start = F.struct(
        F.concat_ws("", F.transform("__ids", lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("left"),
        F.array().cast("array<string>").alias("names"),
    )
    read = F.aggregate(
        rules,
        start,
        lambda at, rule: F.when(
            F.contains(at["left"], rule["run"]),
            F.struct(
                F.replace(at["left"], rule["run"], F.lit("|")).alias("left"),
                F.array_append(at["names"], rule["name"]).alias("names"),
            ),
        ).otherwise(at),
    )
    rows = docs.withColumn("__ids", ids).withColumn("__read", F.when(F.size("__ids") > 0, read))
    names = F.coalesce(F.array_join(F.array_sort(F.array_distinct("__read.names")), ","), F.lit(""))
    verdict = (
        F.when(F.size("__ids") == 0, "none").when(names == "", "unknown")
        .when(F.contains("__read.left", F.lit("<")), "partly").otherwise("known")
    )
    return rows.select(
        *[F.col(f"`{c}`") for c in shadowed(docs, *ADDED).columns],
        F.size("__ids").cast("bigint").alias("n_sentences"),
        F.array_join("__ids", ",").alias("sentence_ids"), names.alias("licences"), verdict.alias("verdict"),
    )


def sql() -> str:
    """The scan of ``documents``, with the same sentences and rules."""
    cases = " ".join(f"WHEN regexp_matches(s, '^(?:{p})$') THEN '{n}'" for n, p in SENTENCES)
    rules = ", ".join(f"'{_tags(r)}={name}'" for name, r in RULES)
    ends = ENDS.replace("\\t", "\t").replace("\\r", "\r")
    return f"""
    WITH cut AS (
        SELECT doc_id, list_transform(flatten(list_transform(
            string_split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), chr(10)), lambda x: regexp_split_to_array(x, '{ends}'))),
            lambda x: regexp_replace(regexp_replace(x, '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS parts
        FROM documents
    ),
    ids AS (
        SELECT doc_id, list_transform(list_filter(parts, lambda s: regexp_matches(s, '{WORDS}')), lambda s: CASE {cases} ELSE 'Unknown' END) AS ids
        FROM cut
    ),
    read AS (
        SELECT doc_id, ids, list_reduce(
            list_concat([array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '') || '#'], [{rules}]),
            lambda acc, r: CASE WHEN contains(split_part(acc, '#', 1), split_part(r, '=', 1))
                THEN replace(split_part(acc, '#', 1), split_part(r, '=', 1), '|') || '#' || split_part(acc, '#', 2) || split_part(r, '=', 2) || ','
                ELSE acc END) AS state
        FROM ids
    )
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
        array_to_string(list_sort(list_distinct(list_filter(string_split(split_part(state, '#', 2), ','), lambda x: x <> ''))), ',') AS licences,
        CASE WHEN len(ids) = 0 THEN 'none' WHEN split_part(state, '#', 2) = '' THEN 'unknown'
            WHEN contains(split_part(state, '#', 1), '<') THEN 'partly' ELSE 'known' END AS verdict
    FROM read
    """
