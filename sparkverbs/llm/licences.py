"""Licence scan by sentence rules: sentences are normalised, known ones get an identifier, and ordered rules over the
identifiers of a text name its licences.

A sentence ends at [.;:!?] before white space, at a line without letters and digits, and it may end at any other line break:
licence texts are wrapped, often behind comment leaders, so a known sentence is found whole on one line and over several, but
titles and notices on lines of their own are found too. Normalising lower-cases A-Z, turns every run of characters other than
a-z and 0-9 into one space, which takes comment leaders out, and drops copyright holders: any line or sentence that begins with
``copyright`` becomes the identifier ``copyright``, unless a known sentence runs over it. Unknown sentences between two known
ones don't matter; the order of the known ones does. Everything happens inside a row, so no text is shuffled and no group
exists that could be large.

The SQL text knows sentences on one line, word for word; it agrees wherever texts hold no others.

Null or empty text has no sentences and no licences; repeated rows give repeated results; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence sentences in normal form, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2.notice",
    "licensed under the apache license version 2 0 the license": "apache2.notice",
    "you may not use this file except in compliance with the license": "apache2.use",
    "you may obtain a copy of the license at": "apache2.copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an"
    " as is basis without warranties or conditions of any kind either express or implied": "apache2.asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2.see",
    "released under the mit license": "mit.notice",
    "licensed under the mit license": "mit.notice",
    "mit license": "mit.title",
    "the mit license": "mit.title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
    " files the software to deal in the software without restriction including without limitation the rights to use copy"
    " modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software"
    " is furnished to do so subject to the following conditions": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " software": "mit.keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "mit.asis",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
    " conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission": "bsd.endorse",
    "this work is licensed under the gnu general public license version 2": "gpl2.notice",
    "this work is licensed under the gnu general public license version 3": "gpl3.notice",
    "this program is free software": "gpl.free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free"
    " software foundation either version 3 of the license or at your option any later version": "gpl3.later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free"
    " software foundation either version 2 of the license or at your option any later version": "gpl2.later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl.hope",
    "licensed under cc by 4 0": "ccby4.notice",
    "licensed under cc by sa 4 0": "ccbysa4.notice",
    "licensed under cc by nc 4 0": "ccbync4.notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4.notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    " provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "this is free and unencumbered software released into the public domain": "unlicense.notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2.notice",
    "copyright": "copyright",
}
#: Licence -> sequences of identifiers that name it, in order; others may stand between them.
RULES = {
    "Apache-2.0": [["apache2.notice"], ["apache2.use", "apache2.copy", "apache2.asis"]],
    "MIT": [["mit.notice"], ["mit.title", "mit.grant"], ["mit.grant", "mit.keep", "mit.asis"]],
    "BSD-2-Clause": [["bsd.grant", "bsd.source", "bsd.binary"]],
    "BSD-3-Clause": [["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]],
    "GPL-2.0": [["gpl2.notice"]],
    "GPL-2.0-or-later": [["gpl.free", "gpl2.later"]],
    "GPL-3.0": [["gpl3.notice"]],
    "GPL-3.0-or-later": [["gpl.free", "gpl3.later"]],
    "CC-BY-4.0": [["ccby4.notice"]],
    "CC-BY-SA-4.0": [["ccbysa4.notice"]],
    "CC-BY-NC-4.0": [["ccbync4.notice"]],
    "ISC": [["isc.grant"]],
    "Unlicense": [["unlicense.notice"]],
    "MPL-2.0": [["mpl2.notice"]],
}
#: A licence that a longer rule of another one contains.
WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}

#: Who or what a notice speaks of, how it names the licence, and what may follow. A space is any gap between two words.
LEAD = ("(?:(?!copyright )(?:(?!not |never |cannot )[a-z0-9]+ ){0,8}?(?:is|are|was|be|been) (?:(?!not |never )[a-z]+ ){0,2}?)?"
        "(?:licensed|released|distributed|available|provided|published|offered) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?"
        "(?:the |a )?")
TAIL = ("(?: the license)?(?: see (?:the )?(?:license|licence|copying)(?: file)?(?: txt| md)?(?: for (?:more |further )?(?:details|information))?)?")
CC = "(?:creative commons attribution{0} 4 0(?: international)?(?: license)?(?: cc by{1} 4 0)?|cc by{1} 4 0(?: license)?)"
#: Other wordings of the sentences above, as patterns over the normal form.
VARIANTS = [
    (LEAD + "(?:mit|expat) licen[sc]e(?: mit)?" + TAIL, "mit.notice"),
    (LEAD + "apache (?:software )?licen[sc]e (?:version |v )?v?2(?: 0)?" + TAIL, "apache2.notice"),
    (LEAD + "gnu general public license(?: gpl)? (?:version |v )?v?2(?: 0)?(?: only)?" + TAIL, "gpl2.notice"),
    (LEAD + "gnu general public license(?: gpl)? (?:version |v )?v?3(?: 0)?(?: only)?" + TAIL, "gpl3.notice"),
    (LEAD + CC.format("", "") + TAIL, "ccby4.notice"),
    (LEAD + CC.format(" share ?alike", " sa") + TAIL, "ccbysa4.notice"),
    (LEAD + CC.format(" non ?commercial", " nc") + TAIL, "ccbync4.notice"),
    ("this source code form is subject to the terms of the mozilla public license v(?: [|])? 2 0", "mpl2.notice"),
    ("the mit license mit", "mit.title"),
    ("you may obtain a copy of the license at https? www apache org licenses license 2 0(?: html| txt)?", "apache2.copy"),
    ("(?:[0-9]{1,2}|[a-d]) redistributions of source code must retain the above copyright notice this list of conditions and the following"
     " disclaimer", "bsd.source"),
    ("(?:[0-9]{1,2}|[a-d]) redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
     " following disclaimer in the documentation and or other materials provided with the distribution", "bsd.binary"),
    ("(?:(?:[0-9]{1,2}|[a-d]) )?neither the names? of (?:[a-z0-9]+ ){1,30}?nor the names of (?:its|the|any|other) contributors may be used to"
     " endorse or promote products derived from this software without specific prior written permission", "bsd.endorse"),
    ("(?:(?:this|the) (?:[a-z0-9]+ ){1,4}?|[a-z0-9]+ )is free software", "gpl.free"),
    ("permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that"
     " the above copyright notice and this permission notice appear in all copies", "isc.grant"),
]

ENDS = r"[.;:!?]+[\x20\x09-\x0D]+|[\n\r]+"
#: Marks of the normal form: ``|`` where a sentence ends, ``/`` where it may end.
GAP = "(?: /)? "
STEPS = [(r"\r\n?", "\n"), ("[|/]", " "), (r"(?m)^[^a-z0-9\n]*(?:dnl|rem|c)(?=[\x20\x09])", " "), (r"\n[^a-z0-9\n]*(?=\n)", "|"),
         (r"[.;:!?]+[\x20\x09-\x0D]+", "|"), (r"\n", "/"), ("[^a-z0-9|/]+", " "), ("[ /]*[|][ /|]*", " | "), (" ?/[ /]*", " / ")]


def _pattern(rule: list[str]) -> str:
    return "(^|,)" + "(,.*)?,".join(x.replace(".", "[.]") for x in rule) + "(,|$)"


def _known() -> str:
    """Pattern of all known sentences, each between two marks; the longest wording comes first."""
    plain = sorted((x for x in SENTENCES if x != "copyright"), key=len, reverse=True)
    every = "|".join(x.replace(" ", GAP) for x in [*plain, *(x for x, _ in VARIANTS)])
    return f"(?<=[|/] )(?:(?:{every})(?= [|/])|copyright(?= ))"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    marked = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in STEPS:
        marked = F.regexp_replace(marked, pattern, to)
    found = F.regexp_extract_all(F.concat(F.lit("| "), F.trim(marked), F.lit(" |")), F.lit(_known()), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    return F.transform(F.transform(found, lambda s: F.replace(s, F.lit(" / "), F.lit(" "))), lambda s: F.coalesce(
        table[s], *[F.when(s.rlike(f"^(?:{pattern})$"), F.lit(name)) for pattern, name in VARIANTS]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_known, sentence_ids, licences): known sentences in order and licences in alphabetical order, each joined by
    commas; empty strings if there are none."""
    ids = docs.select(docs[key].alias(key), sentence_ids(docs[text]).alias("__ids"))
    ids = ids.select(key, F.size("__ids").cast("long").alias("n_known"), F.array_join("__ids", ",").alias("sentence_ids"))

    def found(name: str) -> Column:
        hit = F.lit(False)
        for rule in RULES[name]:
            hit = hit | F.col("sentence_ids").rlike(_pattern(rule))
        return hit

    named = [F.when(found(n) & ~found(WITHIN[n]) if n in WITHIN else found(n), F.lit(n)) for n in sorted(RULES)]
    return ids.select(key, "n_known", "sentence_ids", F.when(F.col("n_known") == 0, "").otherwise(
        F.concat_ws(",", *named)).alias("licences"))


def _sql() -> str:
    def found(name):
        return "(" + " or ".join(f"regexp_matches(ids, '{_pattern(r)}')" for r in RULES[name]) + ")"

    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    named = ", ".join(f"case when {found(n)}{f' and not {found(WITHIN[n])}' if n in WITHIN else ''} then '{n}' end"
                      for n in sorted(RULES))
    return rf"""
with s as (select row_number() over () as r, doc_id,
        regexp_split_to_array(coalesce(text, ''), '{ENDS}') as s from documents),
x as (select r, unnest(s) as s, unnest(range(0, len(s))) as i from s),
p as (select r, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as s from x),
k as (select r, i, id from p join (values {known}) v(s, id)
        on v.s = case when starts_with(p.s, 'copyright ') then 'copyright' else p.s end),
g as (select r, count(*) as n, string_agg(id, ',' order by i) as ids from k group by r)
select doc_id, coalesce(n, 0)::bigint as n_known, coalesce(ids, '') as sentence_ids,
        coalesce(concat_ws(',', {named}), '') as licences
from s left join g using (r)
"""


SQL = _sql()
