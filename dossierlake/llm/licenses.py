"""Licence scans by a positional rare-token index.

The templates' words are indexed with their positions. A file's words of high inverse template
frequency are looked up; postings of one template whose relative positions lie in a narrow band vote for
one placing. Where enough of the template's rare words have voted, its words are aligned with the file's,
with room for words put in or left out, and the placing counts when the mandatory key phrases stand there.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from dossierlake.llm.common import map_batches, text_or_empty, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
ROOM = 6  # one word in so many may be put in or left out within a band,
RIGID = 12  # but in templates shorter than this none

#: Fixed phrases and their labels; every place where one stands counts.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licences that a file may name by a short identifier, as words.
SPDX = {
    "mit": "mit", "apache-2": "apache 2 0", "gpl-2": "gpl 2 0", "gpl-3": "gpl 3 0", "lgpl": "lgpl 2 1", "agpl-3": "agpl 3 0", "bsd": "bsd 3 clause", "bsd-2": "bsd 2 clause", "mpl-2": "mpl 2 0", "isc": "isc",
    "unlicense": "unlicense", "cc0": "cc0 1 0", "zlib": "zlib",
}
_NO_WARRANTY = "is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution"
)

#: Templates: label, text, key phrases that must stand in the file at their place.
TEMPLATES = (
    *((label, f"spdx license identifier {words}", (f"identifier {words}",)) for label, words in SPDX.items()),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software " + _NO_WARRANTY, ("permission is hereby granted free of charge", "copies or substantial portions of the software")),
    ("bsd", _BSD_TERMS + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "endorse or promote products derived from this software")),
    ("bsd-2", _BSD_TERMS + " this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed", ("redistribution and use in source and binary forms", "following disclaimer in the documentation")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software", ("distribute this software for any purpose", "appear in all copies")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ("apache license version 2", "except in compliance with the license")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "licensed under the mit license", ("the mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("as is basis without warranties or conditions",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("in source and binary forms", "provided that the following conditions are met")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
)


class RareTokenIndex:
    """Postings (template, position) of the words whose inverse template frequency is high."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, least_idf: float = 1.2, least_match: float = 0.6):
        self.templates = [(label, t.split(), [k.split() for k in keys]) for label, t, keys in templates]
        self.phrases = [(p.split(), label) for p, label in phrases]
        self.least_match = least_match
        found = defaultdict(set)
        for i, (_, words, _) in enumerate(self.templates):
            for w in words:
                found[w].add(i)
        self.idf = {w: math.log(len(self.templates) / len(x)) for w, x in found.items()}
        self.postings = defaultdict(list)
        for i, (_, words, _) in enumerate(self.templates):
            rare = [w for w in words if self.idf[w] >= least_idf]
            for q, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((i, q))
        self.quorum = [max(1, sum(self.idf[w] >= least_idf for w in words) // 2) for _, words, _ in self.templates]
        self.anchors = defaultdict(list)  # of the base phrases: the word that the fewest templates share
        for n, (words, _) in enumerate(self.phrases):
            q = max(range(len(words)), key=lambda k: (self.idf.get(words[k], math.inf), len(words[k]), -k))
            self.anchors[words[q]].append((n, q))
        self.wanted = frozenset(self.postings) | frozenset(self.anchors)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], dict[str, float], list[tuple[int, int, str, float]]]:
        """Number of words, base places (start, label), labels with scores, and placings (start, end, label, score)."""
        words = WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
        hits = [p for p, w in enumerate(words) if w in self.wanted]
        base, labels, placings = [], {}, []
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by template: relative position, and place in the template
        for p in hits:
            for n, q in self.anchors.get(words[p], ()):
                phrase, label = self.phrases[n]
                if p >= q and words[p - q : p - q + len(phrase)] == phrase:
                    base.append((p - q, label))
                    labels[label] = 1.0
            for i, q in self.postings.get(words[p], ()):
                votes[i].append((p - q, q))
        for i, found in votes.items():
            label, template, keys = self.templates[i]
            room = len(template) // ROOM if len(template) >= RIGID else 0
            found.sort()
            at = 0
            while at < len(found):
                end, first = at, found[at][0]
                while end < len(found) and found[end][0] <= first + room:
                    end += 1
                if len({q for _, q in found[at:end]}) >= self.quorum[i]:
                    there = words[max(first, 0) : found[end - 1][0] + len(template)]
                    hit = self._match(template, there, first, room)
                    if hit >= self.least_match and all(self._stands(there, k) for k in keys):
                        placings.append((max(first, 0), max(first, 0) + len(there), label, round(hit, 4)))
                        labels[label] = max(labels.get(label, 0.0), round(hit, 4))
                at = end
        return len(words), sorted(base), labels, sorted(placings)

    @staticmethod
    def _match(template: list[str], there: list[str], first: int, room: int) -> float:
        """The share of the template's words that stand there in order; without room, each at its place."""
        if not room:
            return sum(a == b for a, b in zip(there, template[max(-first, 0) :], strict=False)) / len(template)
        return sum(x.size for x in SequenceMatcher(None, template, there, autojunk=False).get_matching_blocks()) / len(template)

    @staticmethod
    def _stands(words: list[str], phrase: list[str]) -> bool:
        return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def scan_licenses(docs: DataFrame, index: RareTokenIndex | None = None) -> DataFrame:
    """One row per document: base places, labels by phrase and by template, and the placings found.

    Null and empty texts have no words, no labels and score 0. Rows are independent; repeated rows
    repeat, an empty table gives none, further columns are not read.
    """
    index = index or RareTokenIndex()

    def work(part: pa.RecordBatch) -> dict:
        found = [index.scan(t) for t in texts_of(part)]
        return {
            "doc_id": part.column("doc_id"),
            "n_words": [n for n, *_ in found],
            "n_base": [len(b) for _, b, *_ in found],
            "first_word": [b[0][0] if b else None for _, b, *_ in found],
            "last_word": [b[-1][0] if b else None for _, b, *_ in found],
            "base_labels": [",".join(sorted({x for _, x in b})) for _, b, *_ in found],
            "labels": [",".join(sorted(x)) for _, _, x, _ in found],
            "score": [float(max(x.values(), default=0.0)) for _, _, x, _ in found],
            "placings": [[{"first": a, "end": b, "label": x, "score": s} for a, b, x, s in p] for *_, p in found],
        }

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, placings array<struct<first:long,end:long,label:string,score:double>>"
    return map_batches(docs.select("doc_id", text_or_empty().alias("text")), work, schema)
