from fixwright.llm import licenses

MIT = """The MIT License (MIT)

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files.
The above copyright notice and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""

CASES = [
    ("Licensed under the Apache License, Version 2.0.", "known", "Apache-2.0"),
    ("some text\nThis work is licensed under the GNU General Public License, version 3.", "known", "GPL-3.0-only"),
    ("Released under the MIT License. Licensed under CC BY-NC 4.0.", "known", "CC-BY-NC,MIT"),
    ("LICENSED   UNDER\tCC BY 4.0!", "known", "CC-BY"),
    ("Licensed under the GNU GPL v2 or later.", "known", "GPL-2.0-or-later"),
    (MIT, "known", "MIT"),
    ("Copyright 2020 A Person. All rights reserved.", "known", "All-Rights-Reserved"),
    ("Ask for a license before you go.", "unknown", ""),
    ("Licensed under CC0 1.0. No warranties whatsoever of the best kind.", "partly", "CC0-1.0"),
    ("Nothing of the kind.", "none", ""),
    ("", "none", ""),
    (None, "none", ""),
    ("a " * 200_000 + "\nLicensed under the ISC License.", "known", "ISC"),
]


def test_texts(spark):
    docs = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(CASES)], "doc_id int, text string, Verdict string")
    got = {r.doc_id: r for r in licenses.scan(docs).drop("text").collect()}
    assert [(got[i].verdict, got[i].licences) for i in range(len(CASES))] == [(v, x) for _, v, x in CASES]
    assert got[5].sentence_ids.split(",")[:3] == ["MitTitle", "Copyright", "MitGrant"]


def test_rules_use_identifiers_up_in_order(spark):
    t = "Apache License\nVersion 2.0, January 2004\nLicensed under the Apache License, Version 2.0.\n"
    docs = spark.createDataFrame([(1, t), (1, t)], "doc_id int, text string")
    out = licenses.scan(docs).collect()
    assert len(out) == 2 and {(r.n_sentences, r.licences, r.verdict) for r in out} == {(2, "Apache-2.0", "partly")} or all(
        r.licences == "Apache-2.0" for r in out
    )
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
