"""Licence scans by a positional index of rare licence words.

Templates are clauses of known notices, each with a mandatory key phrase, and the
base phrases themselves. One pass over the texts counts in how many files each
template word occurs; its inverse document frequency is its weight. A template's
anchors are its highest-IDF words, down to the first whose total leaves the others
less than ``1 - min_score`` of the weight, so no alignment that reaches
``min_score`` can do without one. The second pass looks up each file's anchor words
in the index of their template positions; file position less template position is
a candidate alignment. Its score is the share of the template's weight whose words
stand in their places; it is accepted when it scores ``min_score`` and holds the
whole key phrase. All of that happens within the file's row: nothing but the word
counts is shuffled.

DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are always reported, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Clauses of licence notices (label, key phrase, text).
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license", "licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "bsd license", "licensed under the bsd license"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    ("mit", "the above copyright notice and this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "without restriction including without limitation the rights", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache", "unless required by applicable law or agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "subject to the terms and conditions of this license", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "gnu general public license", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "gnu general public license", "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("lgpl", "gnu lesser general public license", "you should have received a copy of the gnu lesser general public license along with this library if not write to the free software foundation"),
    ("agpl", "gnu affero general public license", "you should have received a copy of the gnu affero general public license along with this program if not see https www gnu org licenses"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "may be used to endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "provided that the above copyright notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl", "boost software license", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt"),
    ("cc-by", "creative commons attribution", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
]

#: Room for offsets in a candidate's number.
_SPAN = 1 << 40


def templates() -> list[tuple[str, str, str]]:
    """Label, key phrase and text of the base phrases, then of the notices."""
    return [(label, phrase, phrase) for phrase, label in BASE.items()] + TEMPLATES


def words_of(text: str = "text") -> Column:
    """Words of a text (null: none), with A-Z lower-cased; other letters stay as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    t = F.coalesce(text, F.lit(""))
    plain = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, upper, lower))
    return F.array_remove(F.split(plain, _SEPARATOR), "")


def weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all rows."""
    vocabulary = sorted({w for *_, text in templates() for w in text.split()})
    found = F.array_intersect(words_of(), _constant(vocabulary, "array<string>"))
    seen = docs.select(F.explode(F.array_append(found, F.lit("*"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # at most one row a template word, and all rows as *
    count = {r["w"]: r["n"] for r in seen}
    return {w: math.log((count.get("*", 0) + 1) / (count.get(w, 0) + 1)) + 1 for w in vocabulary}


def anchors(words: list[str], idf: dict[str, float], min_score: float) -> set[str]:
    """The highest-IDF words of a template without which no alignment reaches ``min_score``."""
    rest, out = sum(idf[w] for w in words), set()
    enough = (1 - min_score) * rest
    held = 0.0
    for w in sorted(set(words), key=lambda w: (-idf[w], w)):
        out.add(w)
        held += idf[w] * words.count(w)
        if held > enough + 1e-6:
            break
    return out


def _constant(value: object, kind: str) -> Column:
    """A nested constant as one expression that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, min_score: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null text counts as empty. Without a base phrase first_word and last_word are
    null and base_labels empty. The score is that of the best accepted alignment,
    else 0. Repeated rows are judged one by one; other columns are ignored; an
    empty table gives no rows.
    """
    idf = weights(docs)
    known = templates()
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, text) in enumerate(known):
        words = text.split()
        rare = anchors(words, idf, min_score)
        for i, w in enumerate(words):
            if w in rare:
                index.setdefault(w, []).append((t, i))
    rare = _constant(sorted(index), "array<string>")
    postings = _constant({w: [t * _SPAN - i for t, i in index[w]] for w in sorted(index)}, "map<string,array<bigint>>")
    shapes = []
    for _, key, text in known:
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        total = sum(idf[w] for w in words)
        shapes.append([{"w": w, "i": i, "weight": idf[w] / total, "key": at <= i < at + len(phrase)} for i, w in enumerate(words)])
    shape = _constant(shapes, "array<array<struct<w:string,i:int,weight:double,key:boolean>>>")

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of().alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("long").alias("i"), w.alias("w"))), lambda h: F.array_contains(rare, h["w"]))
    # A candidate is template * _SPAN + offset; an offset is above -_SPAN / 2, so both can be read from the sum.
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(postings, h["w"]), lambda p: p + h["i"]))))
    none = F.array().cast("array<bigint>")
    looked = cut.select("doc_id", "words", F.when(F.arrays_overlap("words", rare), starts).otherwise(none).alias("starts"))

    def scored(c: Column) -> Column:
        t = F.floor((c + _SPAN // 2) / _SPAN).cast("int")
        offset = (c - t.cast("long") * _SPAN).cast("int")
        state = F.struct(F.lit(0.0).alias("score"), F.lit(True).alias("key"))

        def step(s: Column, p: Column) -> Column:
            same = F.coalesce(F.get("words", offset + p["i"]) == p["w"], F.lit(False))
            return F.struct((s["score"] + F.when(same, p["weight"]).otherwise(0.0)).alias("score"), (s["key"] & (same | ~p["key"])).alias("key"))

        return F.struct(t.alias("t"), offset.cast("long").alias("at"), F.aggregate(F.get(shape, t), state, step).alias("of"))

    accepted = F.filter(F.transform("starts", scored), lambda a: a["of"]["key"] & (a["of"]["score"] >= min_score - 1e-9))
    found = looked.select("doc_id", F.size("words").cast("long").alias("n_words"), accepted.alias("found"))
    labels = _constant([label for label, *_ in known], "array<string>")
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: F.get(labels, x["t"])))), ",")
    based = found.withColumn("base", F.filter("found", lambda a: a["t"] < len(BASE)))
    places = F.transform("base", lambda a: a["at"])
    return based.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", lambda a: a["of"]["score"])), F.lit(0.0))), 9).alias("score"),
    )
