"""Licence mentions: phrases, and ordered signature rules over normalized words.

A rule is a regular expression over a text's words (lower case, joined by
blanks), with a label, a priority, a weight and a keyword. An expression is
tried only around the places where words begin with its keyword. Detections are taken in order of priority,
then length; one whose interval lies within one already taken is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import ALNUM, pieces, words_of

# The words of a text (bytes, after lower-casing), and the base phrases with their labels.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Licence families as (label, names, versions). Rules are made from them by the forms below.
FAMILIES = (
    ("mit", ("mit", "expat"), ()),
    ("apache", ("apache", "apache software"), ("1 0", "1 1", "2 0", "2")),
    ("gpl", ("gnu general public", "gnu gpl", "gpl"), ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "lgpl"), ("2", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public", "affero general public", "agpl"), ("1", "3", "3 0")),
    ("bsd", ("bsd", "berkeley software distribution"), ("0 clause", "2 clause", "3 clause", "4 clause")),
    ("mpl", ("mozilla public", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution", "cddl"), ("1 0", "1 1")),
    ("eupl", ("european union public", "eupl"), ("1 1", "1 2")),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("zlib", ("zlib", "zlib libpng"), ()),
    ("boost", ("boost software",), ("1 0",)),
    ("business-source", ("business source", "busl"), ("1 0", "1 1")),
    ("artistic", ("artistic",), ("1 0", "2 0")),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("wtfpl",), ("2",)),
    ("ofl", ("sil open font", "ofl"), ("1 0", "1 1")),
    ("psf", ("python software foundation", "psf"), ("2",)),
    ("odbl", ("open database", "odbl"), ("1 0",)),
    ("gfdl", ("gnu free documentation", "gfdl"), ("1 1", "1 2", "1 3")),
    ("ms-pl", ("microsoft public", "ms pl"), ()),
    ("ncsa", ("university of illinois ncsa", "ncsa"), ()),
)
# Forms with weight, priority and what every match contains; {n} is a name, {v} a version.
FORMS = (
    ("{n} licen[sc]e(?: version)? {v}", 1.0, 10, "licen"),
    ("{n} v ?{v}", 0.8, 20, ""),
    ("spdx license identifier {n}(?: {v})?", 1.0, 5, "spdx"),
    ("(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{n}(?: licen[sc]e|{follow})", 0.95, 15, "under"),
    ("under the {n} licen[sc]e", 0.9, 18, "licen"),
    ("(?:the )?{n} licen[sc]e", 0.7, 30, "licen"),
)
# What may follow a name that stands without "license": the end, a version, or a word that goes on with the sentence.
FOLLOW = "(?=$| v ?[0-9]| version| [0-9]| (?:and|or|with|see|which|that|as|copyright|by|in|for|to|at|on|from|if|is|are|this|it|we|you|all|please|terms|unless)(?: |$))"
# Spellings of a version: after "v", "version" or nothing, glued or not, before or after "license".
SPELLED = "(?:the )?(?:licen[sc]e )?{n}(?: licen[sc]e)?(?: ?v ?| version ){v}(?: licen[sc]e)?{later}"
BARE = "(?:the )?(?:licen[sc]e )?{n} {v}(?! [0-9])(?: licen[sc]e)?{later}"
LATER = "(?: only| or (?:any )?later(?: version)?)?"
NAMED = "licen[sc]e {n}(?! ?v ?[0-9]| version| [0-9])"
ADJECTIVE = "{n} licen[sc]ed"
# Names that mean a licence wherever they stand alone.
ALONE = ("gpl", "gnu gpl", "lgpl", "agpl", "mpl", "cddl", "eupl", "wtfpl", "gfdl")
# A single number right after the name is a version only for these.
SHORT = ("gpl", "gnu gpl", "lgpl", "agpl")
# Sentences of licence texts and names in another order, as (label, expression, keyword).
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "any person obtaining"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "person or organization"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use"),
    ("bsd-3.clause", "neither the name of [^.]{1,120}? may be used to endorse or promote products", "neither the name"),
    ("bsd-3.clause", "(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd three clause)(?: licen[sc]e)?", "bsd"),
    ("bsd-2.clause", "(?:(?:simplified|2 clause|two clause) bsd|bsd two clause)(?: licen[sc]e)?", "bsd"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "you want to public"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v ?2 0", "source code form"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license", "either version 2"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license", "either version 3"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "either version 2 1"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation either version 3 of the license", "either version 3"),
)
# Further sentences that licence texts and file headers have, in the same form.
HEADERS = (
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance with"),
    ("apache-2.0", "http www apache org licenses license 2 0", "apache org"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "is provided as is"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd", "this software is provided by the (?:copyright holders|regents|author) and contributors as is", "contributors as is"),
    ("bsd-4.clause", "all advertising materials mentioning features or use of this software must display", "all advertising materials"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "you should have received"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "in the hope"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", "you should have received"),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "library is free software"),
    ("agpl", "you should have received a copy of the gnu affero general public license", "you should have received"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "contents of this file"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent of this document"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions"),
    ("zlib", "the origin of this software must not be misrepresented", "origin of this software"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "font software"),
    ("ofl", "the fonts and derivatives however cannot be released under any other type of license", "fonts and derivatives"),
    ("cc0", "to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "extent possible"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "verbatim or modified"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "retain this notice"),
    ("json", "the software shall be used for good not evil", "used for good"),
    ("openssl", "this product includes software developed by the openssl project", "openssl"),
    ("ncsa", "neither the names of .{1,120}? may be used to endorse or promote products derived from this software without specific prior written permission", "neither the names"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "author disclaims"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "software and its documentation"),
    ("odbl", "this .{1,80}? is made available under the open database license", "open database"),
    ("boost-1.0", "bsl 1 0", "bsl"),
    ("business-source-1.1", "bsl 1 1", "bsl"),
    ("business-source", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensor hereby grants"),
    ("elastic-2.0", "elastic licen[sc]e 2 0", "elastic"),
    ("sspl-1.0", "server side public licen[sc]e(?: version| v)? ?1", "server side"),
    ("sspl-1.0", "sspl(?: version| v)? ?1", "sspl"),
    ("eula", "end user licen[sc]e agreement", "end user"),
)
# Creative Commons elements, and notices without a family.
COMMONS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
NOTICES = (
    ("public-domain", "(?:dedicated to|released into|in) the public domain", "public domain", 0.8),
    ("cc0", "cc0(?: 1 0)?", "cc0", 0.9),
    ("cc0", "creative commons zero(?: 1 0)?", "creative commons zero", 0.9),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 0.6),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary", 0.8),
    ("permission-notice", "permission is hereby granted free of charge", "permission is hereby", 0.8),
    ("redistribution-notice", "redistribution and use in source and binary forms", "redistribution and use", 0.8),
    ("warranty-notice", "provided as is without warranty", "without warranty", 0.5),
)


# Bytes before and after a keyword that a rule with it may reach.
BEFORE, AFTER = 200, 320


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    sign: str  # letters that a text with a match contains


def signatures() -> list[Signature]:
    """All rules, most important first."""
    rules = []
    for label, names, versions in FAMILIES:
        for name in names:
            longest = max(name.split(" "), key=len)
            for form, weight, priority, sign in FORMS:
                sign = max(sign, longest, key=len)
                if "{v}" in form and ")?" not in form.split("{v}")[-1]:
                    rules += [Signature(f"{label}-{v.replace(' ', '.')}", name, form.format(n=name, v=v, follow=FOLLOW), priority, weight, sign)
                              for v in versions]
                else:
                    any_version = "|".join(sorted(versions, key=len, reverse=True)) or "(?!)"
                    rules.append(Signature(label, name, form.format(n=name, v=f"(?:{any_version})", follow=FOLLOW), priority, weight, sign))
            for v in versions:
                for form in (SPELLED, BARE) if " " in v or name in SHORT else (SPELLED,):
                    pattern = form.format(n=name, v=v, later=LATER)
                    rules.append(Signature(f"{label}-{v.replace(' ', '.')}", name, pattern, 4, 0.9, longest))
            rules.append(Signature(label, name, NAMED.format(n=name), 25, 0.7, longest))
            rules.append(Signature(label, name, ADJECTIVE.format(n=name), 25, 0.8, longest))
            if name in ALONE:
                rules.append(Signature(label, name, name + "(?! ?v ?[0-9]| version| [0-9]| licen[sc]e)", 45, 0.5, longest))
    rules += [Signature(label, keyword, pattern, 3, 1.0, max(keyword.split(" "), key=len)) for label, pattern, keyword in SENTENCES]
    rules += [Signature(label, keyword, pattern, 6, 0.9, max(keyword.split(" "), key=len)) for label, pattern, keyword in HEADERS]
    for parts in COMMONS:
        words = {"by": "attribution", "sa": "share ?alike", "nd": "no ?derivatives", "nc": "non ?commercial"}
        long = " ".join(words[x] for x in parts.split(" "))
        label = f"cc-{parts.replace(' ', '-')}"
        rules.append(Signature(label, f"cc {parts}", f"cc {parts}(?: [1-4] 0)?", 12 - len(parts), 0.9, "cc"))
        rules.append(Signature(label, "creative commons", f"creative commons {long}(?: [1-4] 0)?", 12 - len(parts), 0.95, "creative"))
    rules += [Signature(label, keyword, pattern, 40, weight, max(keyword.split(" "), key=len)) for label, pattern, keyword, weight in NOTICES]
    return sorted(rules, key=lambda r: (r.priority, r.label, r.pattern))


class Detector:
    """Phrases and rules, compiled; texts come as UTF-8 bytes."""

    def __init__(self):
        # rules by keyword, each with its rank
        self.rules: dict[bytes, list[tuple[int, Signature, re.Pattern]]] = {}
        rules = signatures()
        for rank, r in enumerate(rules):
            pattern = re.compile(rb"(?<![^ ])" + r.pattern.encode() + rb"(?![^ ])")
            self.rules.setdefault(b" " + r.keyword.encode(), []).append((rank, r, pattern))
        # the words that keywords begin with, and the keywords of each
        self.starts: dict[bytes, list[bytes]] = {}
        for keyword in self.rules:
            self.starts.setdefault(keyword.split(b" ")[1], []).append(keyword)
        self.phrases = [(p.encode(), re.compile(rb"(?<![^ ])(?=" + p.encode() + rb"(?![^ ]))"), label) for p, label in PHRASES]
        # a text with none of these signs has neither a phrase nor a match of a rule
        signs = {r.sign for r in rules} | {"licen", "cc"}
        self.signs = [x.encode() for x in sorted(signs) if not any(y != x and y in x for y in signs)]

    def detect(self, text: bytes) -> tuple[list[tuple[int, str]], list[tuple[int, int, Signature]]]:
        """Base places as (word, label), and the rules' detections as (first byte, last byte, rule) of the joined words."""
        lower = text.lower()
        if not any(sign in lower for sign in self.signs):
            return [], []
        line = b" ".join(WORD.findall(lower))
        base = []
        for phrase, pattern, label in self.phrases:
            if phrase in line:
                at = word = 0
                for m in pattern.finditer(line):
                    word += line.count(b" ", at, m.start())
                    at = m.start()
                    base.append((word, label))
        hits = set()
        padded = b" " + line
        for start, keywords in self.starts.items():
            if b" " + start not in padded:
                continue
            for keyword in keywords:
                for low, high in windows(padded, keyword):
                    for rank, rule, pattern in self.rules[keyword]:
                        for m in pattern.finditer(line, low, high):
                            hits.add((rule.priority, m.start() - m.end(), rank, m.start(), m.end(), rule))
        return sorted(base), uncovered(sorted(hits, key=lambda h: h[:4]))


def windows(padded: bytes, keyword: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of the line (``padded`` without its first blank) around the places of a keyword, at word ends, far ones apart."""
    at = padded.find(keyword)
    while at >= 0:
        low, high = max(0, at - BEFORE), at + AFTER
        at = padded.find(keyword, at + 1)
        while 0 <= at <= high:
            high = at + AFTER
            at = padded.find(keyword, at + 1)
        low = padded.rfind(b" ", 0, low + 1)  # a blank of the padded line is where a word of the line begins
        end = padded.find(b" ", high)
        yield max(low, 0), len(padded) - 1 if end < 0 else end - 1


def uncovered(hits: list[tuple], cell: int = 256) -> list[tuple[int, int, Signature]]:
    """Detections in order, without those inside one that came before.

    An interval is entered at every cell of bytes that it touches, so only its
    neighbours are looked at.
    """
    taken: list[tuple[int, int, Signature]] = []
    near: dict[int, list[tuple[int, int]]] = {}
    for *_, start, end, rule in hits:
        if not any(s <= start and end <= e for s, e in near.get(start // cell, ())):
            taken.append((start, end, rule))
            for k in range(start // cell, end // cell + 1):
                near.setdefault(k, []).append((start, end))
    return taken


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    A null text counts as an empty one: no words, null places, empty labels, a
    score of 0. The score is the largest weight of a detection, 1 for a base
    phrase. Repeated rows give equal results, an empty table an empty one;
    other columns are not read. A very long text is read whole; expressions see
    its stretches around keywords.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector()
        for batch in batches:
            rows = []
            for begin, stop, data, edges in pieces(batch.column(1)):
                counts = words_of(data, edges, ALNUM).counts
                whole = data.tobytes()
                for i in range(stop - begin):
                    base, hits = detector.detect(whole[edges[i]:edges[i + 1]])
                    own = {label for _, label in base}
                    rows.append((
                        int(counts[i]), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                        ",".join(sorted(own)), ",".join(sorted(own | {r.label for *_, r in hits})),
                        1.0 if base else max([r.weight for *_, r in hits], default=0.0)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)
