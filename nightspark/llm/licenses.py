"""Licence scan by a positional index of rare licence words.

Only DataFrame functions.  A template can stand in a document only if the
document holds its key phrases' words and enough of the others.  Of such
templates the document's words with the highest IDF are looked up in the
postings (template, place); lookups that agree, but for a few words put in or
left out, on where the template would start are counted; starts with three or
more are compared word by word, and the template's key phrases must stand there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import PLAIN_GAP, PLAIN_WORD, ascii_lower, table
from nightspark.llm.quality import let


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Each must stand in the document whole, where the template has it but for up to ``GAP`` words put in before.
    phrases: tuple[str, ...]


# fixed values: notices of public licences
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
             "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
             "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
             "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
             "permissions and limitations under the License.", ("apache license version 2 0", "without warranties or conditions of any kind")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation", ("free software", "gnu general public license")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
             "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
             "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
             "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
             "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
             "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
             ("for any purpose with or without fee is hereby granted",)),
    Template("mit-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
             "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
             "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
             "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
             "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
             "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
             "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
             "DEALINGS IN THE SOFTWARE.", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files", ("permission is hereby granted free of charge",)),
    Template("mit-release", "Released under the MIT License", ("mit license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license v 2 0",)),
)
#: Phrases of the base scan, all ending in "license", and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# end of fixed values

#: Least share of a template's words that stand in place.
LEAST_SHARE = 0.6
#: Words that stand up to so many words late count as in place: so many may be put in or left out, on balance.
GAP = 8
#: Lookups that must agree.  A template of n words may lack (1 - LEAST_SHARE) n of them: looking up so many
#: and VOTES more of its words finds every start.
VOTES = 3
SHIFT, ROOM = 1 << 40, 1 << 20


def template_words(text: str) -> list[str]:
    return re.findall(PLAIN_WORD, text.lower())


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def document_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PLAIN_GAP), "")


def word_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each licence word stands; a row per word of the templates reaches the driver."""
    found = docs.select(F.explode(F.array_intersect(document_words(F.col(text)), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r.word: r.n for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def base_places(words: Column) -> Column:
    """(place, label) wherever a base phrase stands, in order."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w == "license", i).otherwise(F.lit(-1))), lambda i: i >= 0)

    def match(i: Column) -> Column:
        out = F.lit(None).cast("struct<at:long,label:string>")
        for phrase, label in BASE:
            before = phrase.split()[:-1]
            hit = F.lit(True)
            for k, w in enumerate(reversed(before), 1):
                hit = hit & F.coalesce(F.get(words, i - k) == w, F.lit(False))
            out = F.when(hit, F.struct((i - len(before)).cast("long").alias("at"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(at, match), lambda x: x.isNotNull())


def aligned(words: Column, found: Column, frequencies: dict[str, int], templates: tuple[Template, ...]) -> Column:
    """(label, share) of the templates that stand in the document, for each place where votes agree."""
    texts = [template_words(t.text) for t in templates]
    keys = []
    for t, ws in zip(templates, texts, strict=True):
        phrases = [template_words(p) for p in t.phrases]
        keys.append([(next(i for i in range(len(ws)) if ws[i : i + len(p)] == p), p) for p in phrases])
    postings: dict[str, list[int]] = {}
    for t, ws in enumerate(texts):
        for i, w in enumerate(ws):
            postings.setdefault(w, []).append(t * SHIFT + ROOM - i)
    index = F.create_map(*[x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*map(_long, p)))])
    frequency = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), _long(frequencies.get(w, 0)))])
    labels = F.array(*[F.lit(t.label) for t in templates])
    bodies = F.array(*[F.array(*map(F.lit, ws)) for ws in texts])
    # (place, words) of the key phrases
    fixed = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, p)).alias("words")) for at, p in k]) for k in keys])
    musts = F.array(*[F.array(*[F.lit(w) for w in sorted({w for _, p in k for w in p})]) for k in keys])
    lookups = F.array(*[F.lit(int((1 - LEAST_SHARE) * len(ws) + 1e-9) + VOTES) for ws in texts])

    possible = F.filter(F.sequence(F.lit(0), F.lit(len(texts) - 1)), lambda t: F.forall(
        F.get(musts, t), lambda w: F.array_contains(found, w)) & (F.size(F.filter(
            F.get(bodies, t), lambda w: F.array_contains(found, w))) >= LEAST_SHARE * F.size(F.get(bodies, t))))
    ranked = F.sort_array(F.transform(found, lambda w: F.struct(F.element_at(frequency, w).alias("n"), w.alias("w"))))

    def starts(live: Column) -> Column:
        """template * SHIFT + ROOM + start, one for each lookup, sorted."""
        # of each template, so that one licence in a document does not hide another
        rare = F.array_distinct(F.flatten(F.transform(live, lambda t: F.slice(F.transform(F.filter(
            ranked, lambda x: F.array_contains(F.get(bodies, t), x["w"])), lambda x: x["w"]), F.lit(1), F.get(lookups, t)))))

        def hits(rare: Column) -> Column:
            places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(rare, w), F.struct(
                w.alias("w"), i.cast("long").alias("i")))), lambda x: x.isNotNull())
            return F.flatten(F.transform(places, lambda x: F.transform(F.filter(
                F.element_at(index, x["w"]), lambda p: F.array_contains(live, F.floor(p / SHIFT).cast("int"))), lambda p: p + x["i"])))

        return F.sort_array(let(rare, hits))

    def agreed(s: Column) -> Column:
        """Starts from which on ``VOTES`` lookups or more stand in ``GAP`` words, once each."""
        return F.filter(F.transform(s, lambda x, j: F.when(
            (F.get(s, j + VOTES - 1) <= x + GAP) & F.coalesce(x != F.get(s, j - 1), F.lit(True)), x)), lambda x: x.isNotNull())

    def verified(key: Column) -> Column:
        t = F.floor(key / SHIFT).cast("int")
        start = (key - t.cast("long") * SHIFT - ROOM).cast("int")

        def near(j: Column) -> Column:
            """The words from place ``j`` of the template on, ``GAP`` more than one."""
            lo = F.greatest(start + j, F.lit(0))
            return F.slice(words, lo + 1, F.greatest(start + j + GAP + 1 - lo, F.lit(0)))

        phrase = lambda p: F.exists(F.sequence(F.lit(0), F.lit(GAP)), lambda d: (start + p["at"] + d >= 0) & F.forall(
            F.transform(p["words"], lambda w, k: F.coalesce(F.get(words, start + p["at"] + d + k) == w, F.lit(False))), lambda same: same))
        body = F.get(bodies, t)
        share = F.size(F.filter(body, lambda w, j: F.array_contains(near(j), w))) / F.size(body)
        return F.when(F.forall(F.get(fixed, t), phrase), let(share, lambda x: F.when(
            x >= LEAST_SHARE, F.struct(F.get(labels, t).alias("label"), x.alias("share")))))

    none = F.array().cast("array<struct<label:string,share:double>>")
    votes = lambda live: let(starts(live), agreed)
    return let(possible, lambda live: F.when(F.size(live) > 0, F.filter(F.transform(
        votes(live), verified), lambda x: x.isNotNull())).otherwise(none))


def license_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template's words that stand in place,
    or up to ``GAP`` words late (0 without one).  Null and empty texts: no words, empty labels, score 0,
    null places.  Repeated rows are judged one by one and count as often in the
    word frequencies; ties in frequency go by the word.  Other columns are
    ignored; no rows give no rows.  All documents give the word frequencies, of
    which the driver holds one number per template word; nothing else is
    shuffled.
    """
    vocabulary = sorted({w for t in templates for w in template_words(t.text)} | {"license"})
    frequencies = word_frequencies(docs, text, vocabulary)
    known = F.array(*map(F.lit, vocabulary))

    def scan(words: Column) -> Column:
        def with_found(found: Column) -> Column:
            base = F.when(F.array_contains(found, "license"), base_places(words)).otherwise(
                F.array().cast("array<struct<at:long,label:string>>"))
            own = F.array_except(found, F.array(F.lit("license"))) if "license" not in {
                w for t in templates for w in template_words(t.text)} else found
            method = F.when(F.size(own) > 1, aligned(words, own, frequencies, templates)).otherwise(
                F.array().cast("array<struct<label:string,share:double>>"))
            return F.struct(F.size(words).cast("long").alias("n_words"), base.alias("base"), method.alias("method"))

        return let(F.array_intersect(words, known), with_found)

    out = docs.select(F.col(doc_id).alias("_id"), let(document_words(F.col(text)), scan).alias("_s"))
    places = F.transform("_s.base", lambda x: x["at"])
    base, method = F.transform("_s.base", lambda x: x["label"]), F.transform("_s.method", lambda x: x["label"])
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return out.select(
        F.col("_id").alias(doc_id), F.col("_s.n_words").alias("n_words"), F.size("_s.base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, method)).alias("labels"),
        F.coalesce(F.array_max(F.transform("_s.method", lambda x: x["share"])), F.lit(0.0)).alias("score"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
