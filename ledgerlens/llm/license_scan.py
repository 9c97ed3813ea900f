"""Licence scan over a positional rare-token index, in DataFrame operations only.

Templates (notices and texts of licences) are posted by word and position. The documents' own counts tell which words of a
template are rare; a file looks up only its highest-IDF licence words, the postings are intersected by relative position
(word place less template place), and a place counts only if the template's mandatory key phrases stand there whole,
compared word by word with the text itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pick, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: phrase and label: fixed values of the query's contract; every word is mandatory.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: label, mandatory key phrases, text: the notices and texts of usual licences, as their owners publish them (fixed
#: values). A phrase is looked for where it stands in the text.
TEMPLATES = (
    ("apache-2.0", ("apache license version 2 0",), """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", ("permission is hereby granted free of charge", "the above copyright notice and this permission notice"), """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software."""),
    ("isc", ("permission to use copy modify and or distribute this software",), """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"), """Redistribution and use in source and binary forms,
with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("bsd-3-clause", ("neither the name of the copyright holder nor the names of its contributors",), """Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission."""),
    ("gpl-2.0-or-later", ("gnu general public license as published by the free software foundation either version 2",), """This program is free software; you can redistribute it and/or modify it under the terms
of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version."""),
    ("gpl-3.0-or-later", ("gnu general public license as published by the free software foundation either version 3",), """This program is free software: you can redistribute it and/or modify it under the terms
of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""),
    ("lgpl-2.1-or-later", ("gnu lesser general public license",), """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("agpl-3.0-or-later", ("gnu affero general public license",), """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""),
    ("mpl-2.0", ("mozilla public license v 2 0",), """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", ("released into the public domain",), """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("zlib", ("this software is provided as is without any express or implied warranty",), """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely."""),
    ("bsl-1.0", ("boost software license version 1 0",), "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("cc-by-4.0", ("creative commons attribution 4 0 international license",), "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", ("creative commons attribution sharealike 4 0 international license",), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", ("cc by nc 4 0",), "Licensed under CC BY-NC 4.0"),
    ("apache-2.0", ("apache license version 2 0",), "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", ("gnu general public license version 3",), "This work is licensed under the GNU General Public License, version 3."),
)


def template_words(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Template(NamedTuple):
    """words: of the whole text. required: places of the mandatory phrases' words, each one of them. base: a base phrase."""

    label: str
    base: bool
    words: list[str]
    required: list[int]


def read_templates(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, tuple[str, ...], str]]) -> list[Template]:
    out = [Template(label, True, words, list(range(len(words)))) for phrase, label in phrases for words in [phrase.split()]]
    for label, keys, text in templates:
        words, required = template_words(text), set()
        for key in map(str.split, keys):
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            required |= set(range(at, at + len(key)))
        out.append(Template(label, False, words, sorted(required)))
    return out


def rarest_words(template: Template, idf: dict[str, float], most: int) -> list[str]:
    """The words by which a template is looked up; one is enough for a base phrase, which is compared whole at each."""
    return sorted(set(template.words), key=lambda w: (-idf[w], w))[: 1 if template.base else most]


def _low(word: Column) -> Column:
    """A-Z lower-cased in words of ASCII; others are in no template."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word))


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = BASE_PHRASES, templates: Sequence[tuple[str, tuple[str, ...], str]] = TEMPLATES, rare_words: int = 4, min_share: float = 0.6) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the base phrases; first_word and last_word are their smallest and largest start (null
    without any). A template is looked up by its `rare_words` rarest words, by the document frequencies of this input; its label
    is given where two of these (one of a template of one) stand at one relative position, every word of its mandatory phrases
    stands at its place, and what else agrees there makes up at least `min_share` of the template's IDF weight. score is
    the best such share of any place that was looked at, verified or not.
    Null and empty texts have no words, empty labels and score 0. Rows are judged one by one, so ids may repeat or be
    null; an empty table gives an empty result; other columns of the input are ignored.

    Document frequencies are counted for the templates' words alone, so they are few whatever the input. All else is done
    inside each row: texts are read twice and nothing of them is shuffled or written.
    """
    known = read_templates(phrases, templates)
    vocabulary = sorted({w for t in known for w in t.words})
    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", words.alias("words"))

    in_template = F.array_distinct(F.filter(F.transform("words", _low), lambda w: w.isin(*vocabulary)))
    held = rows.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), in_template)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    frequency = {r["word"]: r["df"] for r in held.collect()}  # of the templates' words; the null stands once in every row
    n_rows = frequency.get(None, 0)
    idf = {w: math.log((n_rows + 1.0) / (frequency.get(w, 0) + 1.0)) + 1e-6 for w in vocabulary}

    postings: dict[str, list[tuple[int, int]]] = {}
    for k, template in enumerate(known):
        rare = set(rarest_words(template, idf, rare_words))
        for place, word in enumerate(template.words):
            if word in rare:
                postings.setdefault(word, []).append((k, place))
    rare_of = [len(rarest_words(t, idf, rare_words)) for t in known]
    index = F.create_map(*[x for word, places in postings.items() for x in (F.lit(word), F.array(*[F.struct(F.lit(k).alias("template"), F.lit(place).alias("place")) for k, place in places]))])
    whole = F.array(
        *[
            F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _texts(t.words).alias("words"), F.array(*[F.lit(idf[w]) for w in t.words]).alias("idf"), F.array(*[F.lit(i) for i in t.required]).alias("required"), F.lit(sum(idf[w] for w in t.words)).alias("weight"), F.lit(t.base or n < 2).alias("alone"))
            for t, n in zip(known, rare_of, strict=True)
        ]
    )

    # each rare word at its place opens a place of each template that has it
    placed = F.filter(F.transform("words", lambda w, i: F.struct(_low(w).alias("word"), i.alias("at"))), lambda x: x["word"].isin(*postings))
    start = lambda hit: F.transform(F.element_at(index, hit["word"]), lambda p: F.struct(p["template"].alias("template"), (hit["at"] - p["place"]).alias("start"), hit["word"].alias("word")))
    pairs = F.array_sort(F.array_distinct(F.flatten(F.transform(placed, start))))
    rows = rows.select("doc_id", "words", pairs.alias("pairs"))
    # sorted, two words that open one place are neighbours
    same = lambda i: F.coalesce((F.get("pairs", i)["template"] == F.get("pairs", i + 1)["template"]) & (F.get("pairs", i)["start"] == F.get("pairs", i + 1)["start"]), F.lit(False))
    agreed = F.filter("pairs", lambda x, i: F.get(whole, x["template"])["alone"] | same(i))
    opened = F.array_distinct(F.transform(agreed, lambda x: F.struct(x["template"].alias("template"), x["start"].alias("start"))))
    rows = rows.select("doc_id", "words", opened.alias("opened"))

    def judged(place: Column) -> Column:
        template = F.get(whole, place["template"])
        equal = lambda i: F.coalesce(_low(F.get("words", place["start"] + i)) == F.get(template["words"], i), F.lit(False))
        mass = F.aggregate(F.sequence(F.lit(0), F.size(template["words"]) - 1), F.lit(0.0), lambda acc, i: acc + F.when(equal(i), F.get(template["idf"], i)).otherwise(0.0))
        share = F.least(mass / template["weight"], F.lit(1.0))
        return F.struct(place["start"].alias("start"), template["label"].alias("label"), template["base"].alias("base"), share.alias("share"), F.forall(template["required"], equal).alias("phrases"))

    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform("opened", judged).alias("places"))
    found = F.filter("places", lambda x: x["phrases"] & (x["base"] | (x["share"] >= min_share)))
    rows = rows.select("doc_id", "n_words", found.alias("found"), F.array_max(F.transform("places", lambda x: x["share"])).alias("best"))
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))
