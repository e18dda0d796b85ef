import collections
import random
import re

import duckdb
import pytest

from sparkverbs.llm import licences, quality, sharding
from tests.compare import connect, differences
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_counts_against_brute_force(docs):
    rng = random.Random(1)
    rows = list(ODD)
    for i in range(60):
        text = "".join(rng.choice(["the ", "cat ", "sat\n", "# ", "on\t", "mät ", "a|b ", "\n"]) for _ in range(rng.choice([3, 10, 80, 400])))
        rows.append((100 + i, text, rng.choice(["en", None]), rng.choice(["s", "t"])))
    rows.append((999, "long word " * 50_000, "en", "s"))
    got = sorted((str(r.doc_id), *r[1:7]) for r in quality.quality_report(docs(rows)).collect())
    assert got == sorted((str(i), *brute(t)) for i, t, *_ in rows)


def test_junk_goes_and_clean_text_stays(docs):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    clean = [(i, " ".join(rng.sample(words, 120)), "en", f"s{i % 3}") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in rng.sample(words, 120)), "en", "s0") for i in range(15)]
    kept = {r.doc_id for r in quality.quality_filter(docs(clean + junk)).collect()}
    assert kept == {i for i, *_ in clean}


def test_filter_keeps_columns_and_agrees_with_the_report(docs):
    frame = docs(ODD + [(i, "word " * 3 + " ".join(f"w{i}x{j}" for j in range(60)), "en", "s") for i in range(20, 30)])
    kept = quality.quality_filter(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.quality_report(frame).where("kept").collect())


def test_sketches_merge(docs):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50 + i)), "en", "s") for i in range(40)]
    whole = quality.sketches(quality.measured(docs(rows)))
    halves = [quality.sketches(quality.measured(docs(r))) for r in (rows[:17], rows[17:])]
    merged = quality.merged(halves[0].unionByName(halves[1]), "lang", "source")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.select(*whole.columns).collect()))


@pytest.mark.parametrize("operator", [quality.quality_report, quality.quality_filter, licences.scan, sharding.assign])
def test_empty_table(docs, operator):
    assert operator(docs([])).count() == 0


@pytest.mark.parametrize("name, operator", [("quality", quality.quality_report), ("licences", licences.scan), ("sharding", sharding.assign)])
def test_against_sql(spark, name, operator):
    sql = {"quality": quality, "licences": licences, "sharding": sharding}[name].SQL
    got = operator(spark.read.parquet(f"{FOLDER}/documents.parquet")).toArrow()
    assert differences(got, connect(FOLDER).sql(sql).to_arrow_table()) == []


def test_repeated_and_null_ids_against_sql(docs):
    """A verdict belongs to a row: of two rows with one id (or none) the one may go and the other stay."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    clean = [(i, " ".join(rng.sample(words, 120)), "en", "s") for i in range(200)]
    junk = [(i, " ".join(w + "$$$" for w in rng.sample(words, 120)), "en", "s") for i in (0, 1, None)]
    frame = docs(ODD + clean + junk + [(None, clean[5][1], "en", "s"), clean[6]])
    got = quality.quality_report(frame).toArrow()
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    assert differences(got, con.sql(quality.SQL).to_arrow_table()) == []
    kept = collections.Counter((r["doc_id"], r["kept"]) for r in got.to_pylist())
    assert kept[0, True] == kept[0, False] == 1 and kept[None, True] == 1 and kept[6, True] == 2


def test_licence_rules(docs):
    mit = ("MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this"
           " software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without"
           " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
           " permit persons to whom the Software is furnished to do so, subject to the following conditions:\n")
    rows = [(1, mit, "en", "s"), (2, "Words. Licensed under the Apache License, Version 2.0.", "en", "s"),
            (3, "Copyright 2020 Someone. All rights.", "en", "s"), (4, "licensed under the apache", "en", "s"),
            (5, "Released under the MIT License.\nWords\nLicensed under CC BY-NC 4.0.", "en", "s")]
    got = {r.doc_id: (r.n_known, r.sentence_ids, r.licences) for r in licences.scan(docs(rows + [(9, None, None, None)])).collect()}
    assert got == {1: (3, "mit.title,copyright,mit.grant", "MIT"), 2: (1, "apache2.notice", "Apache-2.0"), 3: (1, "copyright", ""),
                   4: (0, "", ""), 5: (2, "mit.notice,ccbync4.notice", "CC-BY-NC-4.0,MIT"), 9: (0, "", "")}


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize("leader, end", [("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n"), ("dnl ", "\n")])
def test_wrapped_licence_texts(docs, leader, end):
    texts = {"MIT": (MIT, "mit.title,copyright,mit.grant,mit.keep,mit.asis"), "BSD-2-Clause": (BSD, "copyright,bsd.grant,bsd.source,bsd.binary"),
             "BSD-3-Clause": (BSD + ENDORSE, "copyright,bsd.grant,bsd.source,bsd.binary,bsd.endorse"),
             "Apache-2.0": (APACHE, "apache2.notice,apache2.use,apache2.copy,apache2.asis,apache2.see"),
             "GPL-2.0-or-later": (GPL % 2, "gpl.free,gpl2.later,gpl.hope"), "GPL-3.0-or-later": (GPL % 3, "gpl.free,gpl3.later,gpl.hope"),
             "ISC": (ISC, "isc.grant"), "MPL-2.0": (MPL, "mpl2.notice")}
    rows = [(i, end.join((leader + line).rstrip() for line in text.split("\n")), "en", "s") for i, (text, _) in enumerate(texts.values())]
    got = {r.doc_id: (r.licences, r.sentence_ids) for r in licences.scan(docs(rows)).collect()}
    assert got == {i: (name, ids) for i, (name, (_, ids)) in enumerate(texts.items())}


def test_notices_with_other_words_around(docs):
    texts = {"This file is licensed under the MIT License.": "MIT", "Code in this folder is made available under the terms of\nthe MIT license": "MIT",
             "This project is not licensed under the MIT License.": "", "The rules of the MIT License are short.": "",
             "// Copyright 2020 Someone\n// Released under the MIT License": "MIT", "Title\nLicensed under CC BY-NC 4.0\nmore words": "CC-BY-NC-4.0",
             "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
             "The library is released under the GNU General Public License, version 3.": "GPL-3.0", "\n" * 50_000 + "x" + " / |" * 50_000: ""}
    rows = [(i, text, "en", "s") for i, text in enumerate(texts)]
    assert [r.licences for r in licences.scan(docs(rows)).orderBy("doc_id").collect()] == list(texts.values())


def brute_shards(rows, limit):
    import hashlib

    size, h = collections.Counter(), {}
    for i, t, *_ in rows:
        h[i] = bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        for d in range(61):
            size[h[i][:d]] += len((t or "").encode())
    return {i: next((h[i][:d] for d in range(61) if size[h[i][:d]] <= limit), h[i]) for i in h}


@pytest.mark.parametrize("limit", [30, 200, 5000])
def test_shards_against_brute_force(docs, limit):
    rows = ODD + [(i, "ä" * (i % 90), "en", "s") for i in range(10, 200)]
    got = sharding.assign(docs(rows), limit=limit).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.shard for r in got} == brute_shards(rows, limit)


def test_overflow_pages_hold_repeated_keys(docs, spark, tmp_path):
    rows = [(7, "x" * 10, "en", "s")] * 40 + [(7, "y" * 70, "en", "s"), (7, "z" * 500, "en", "s")] + [(8, "w" * 20, "en", "s")]
    got = sharding.assign(docs(rows), limit=100).collect()
    pages = collections.defaultdict(list)
    for r in got:
        pages[r.shard, r.page].append(r.n_bytes)
    assert len(got) == len(rows) and all(sum(p) <= 100 or p == [500] for p in pages.values())
    sharding.write_shards(docs(rows), str(tmp_path / "out"), limit=100)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select("row.text").toPandas()["text"]) == sorted(t for _, t, *_ in rows)
