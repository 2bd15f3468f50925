"""License scans with a positional rare-token index.

Licence texts are indexed by the positions of their words.  Document frequencies
over the whole corpus rank the template words that occur in it; each template is
looked up by its highest-IDF words only.  In a file, every occurrence of such a word
votes, through its postings, for the place where the template would begin.  A place
on which at least half of the template's rare words agree (two at least, if it has
as many) is a candidate, and counts once all mandatory key phrases of the template
stand in full at their relative positions, give or take a few words.

Each key phrase is a short template of its own as well, so that a notice of one
phrase is found too, through that phrase's postings.  Nothing is found but through
postings.  Base phrases are found at every place.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import WORD_BYTES, table, text_slices

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence texts and notices (public texts, lower case, without signs)
#: and their mandatory key phrases.  What follows a colon in a name tells two
#: templates of one label apart.
TEMPLATES = {
    "agpl": ("under the terms of the gnu affero general public license as published by the free software foundation",
             ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license you may obtain a copy of the license at",
                   ["apache license version 2 0"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met 1 redistributions of source code must retain the above copyright "
            "notice this list of conditions and the following disclaimer 2 redistributions in binary form must "
            "reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution this software is provided by the "
            "copyright holders and contributors as is and any express or implied warranties including but not limited "
            "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
            "event shall the copyright holder or contributors be liable for any direct indirect incidental special "
            "exemplary or consequential damages including but not limited to procurement of substitute goods or "
            "services loss of use data or profits or business interruption however caused and on any theory of "
            "liability whether in contract strict liability or tort including negligence or otherwise arising in any "
            "way out of the use of this software even if advised of the possibility of such damage",
            ["redistribution and use in source and binary forms",
             "redistributions of source code must retain the above copyright notice"]),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license",
                  ["creative commons attribution 4 0"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights "
            "to this work", ["waived all copyright and related or neighboring rights"]),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", ["gnu general public license"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "gpl-3": ("this work is licensed under the gnu general public license version 3",
              ["gnu general public license version 3"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies "
            "the software is provided as is and the author disclaims all warranties with regard to this software "
            "including all implied warranties of merchantability and fitness in no event shall the author be liable "
            "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
            "of use data or profits whether in an action of contract negligence or other tortious action arising out "
            "of or in connection with the use or performance of this software", ["distribute this software for any purpose with or without fee"]),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
            "of the software and to permit persons to whom the software is furnished to do so subject to the "
            "following conditions the above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the software the software is provided as is without warranty of any "
            "kind express or implied including but not limited to the warranties of merchantability fitness for a "
            "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for "
            "any claim damages or other liability whether in an action of contract tort or otherwise arising from "
            "out of or in connection with the software or the use or other dealings in the software",
            ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    "mit:notice": ("released under the mit license", ["mit license"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                ["mozilla public license v 2 0"]),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  ["free and unencumbered software released into the public domain"]),
}

_RARE_WORDS = 6                   # highest-IDF words by which a template is looked up
_SLACK = 4                        # words by which a key phrase may be off its place


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


@dataclass
class Index:
    """Postings ``word -> (template, place in it)`` of the rare words; per template
    its label, words, key phrases with their places, and number of rare words."""
    names: list[str]
    words: list[list[bytes]]
    keys: list[list[tuple[int, list[bytes]]]]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    n_rare: list[int] = field(default_factory=list)


def with_notices(templates: dict) -> dict[str, tuple[str, list[str]]]:
    """The templates and, for each of their key phrases, one of that phrase alone."""
    notices = {f"{n.partition(':')[0]}:{phrase}": (phrase, [phrase]) for n, (_, keys) in templates.items() for phrase in keys}
    return {**notices, **templates}


def build_index(frequency: dict[bytes, int], templates: dict | None = None, rare: int = _RARE_WORDS) -> Index:
    """The index of ``templates`` and their notices; words seen in fewer documents
    (ties: smaller words first) are rarer.  Words seen in none cannot vote and are
    left out; a template without any cannot stand in a document."""
    templates = with_notices(TEMPLATES if templates is None else templates)
    index = Index([], [], [])
    for t, name in enumerate(sorted(templates)):
        text, phrases = templates[name]
        ws = text.encode().split()
        index.names.append(name.partition(":")[0])
        index.words.append(ws)
        cut = [p.encode().split() for p in phrases]
        index.keys.append([(next(i for i in range(len(ws)) if ws[i:i + len(p)] == p), p) for p in cut])
        chosen = sorted({w for w in ws if frequency.get(w, 0)}, key=lambda w: (frequency[w], w))[:rare]
        index.n_rare.append(len(chosen))
        for w in chosen:
            index.postings.setdefault(w, []).extend((t, i) for i, x in enumerate(ws) if x == w)
    return index


def _phrase_places(words: list[bytes], starts: dict[bytes, list[tuple[list[bytes], str]]],
                   places: list[int]) -> list[tuple[int, str]]:
    return [(i, label) for i in places for phrase, label in starts.get(words[i], ())
            if words[i:i + len(phrase)] == phrase]


def _stands(words: list[bytes], place: int, phrase: list[bytes]) -> bool:
    return any(words[p:p + len(phrase)] == phrase for p in range(max(0, place - _SLACK), place + _SLACK + 1))


def scan(words: list[bytes], index: Index, starts: dict) -> tuple[list[tuple[int, str]], dict[str, float]]:
    """The base places ``(word, label)`` of a file and, for each template found,
    the share of its words that stand in place."""
    known = index.postings
    places = [i for i, w in enumerate(words) if w in known or w in starts]
    base = _phrase_places(words, starts, places)
    votes: dict[tuple[int, int], set[bytes]] = {}
    for i in places:
        for t, at in known.get(words[i], ()):
            votes.setdefault((t, i - at), set()).add(words[i])
    found: dict[str, float] = {}
    for (t, begin), agreeing in votes.items():
        if 2 * len(agreeing) >= max(index.n_rare[t], min(4, 2 * index.n_rare[t])) \
                and all(_stands(words, begin + at, phrase) for at, phrase in index.keys[t]):
            template = index.words[t]
            same = sum(1 for k, w in enumerate(template) if 0 <= begin + k < len(words) and words[begin + k] == w)
            found[index.names[t]] = max(found.get(index.names[t], 0.0), same / len(template))
    return base, found


def template_frequencies(docs: DataFrame, templates: dict | None = None) -> dict[bytes, int]:
    """In how many rows of ``docs`` each template word occurs.  The result is as
    long as the templates' vocabulary, whatever the corpus."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = frozenset(w for text, _ in templates.values() for w in text.encode().split())

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                for text in texts:
                    seen.update(vocabulary.intersection(words_of(text)))
        yield pa.record_batch([pa.array([w.decode() for w in seen], pa.string()),
                               pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


def scan_licenses(docs: DataFrame, templates: dict | None = None, base: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word,
    last_word`` (smallest and largest start of a base phrase, words from 0; else
    null), ``base_labels, labels`` (distinct, sorted, comma-joined; the second
    with the templates' too) and ``score``: the largest share of a found
    template's words that stand in place, at least 0.5 with a base phrase, 0
    without any label.  A null or empty text has no words.  Other columns are
    not looked at."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(build_index(template_frequencies(docs, templates), templates))
    starts: dict[bytes, list] = {}
    for phrase, label in (BASE if base is None else base).items():
        p = phrase.encode().split()
        starts.setdefault(p[0], []).append((p, label))

    def run(batches):
        index = held.value
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                cols: list[list] = [[] for _ in range(7)]
                for text in texts:
                    words = words_of(text)
                    places, found = scan(words, index, starts)
                    labels = {x for _, x in places}
                    values = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                              ",".join(sorted(labels)), ",".join(sorted(labels | set(found))),
                              max([*found.values(), 0.5 if places else 0.0]))
                    for c, v in zip(cols, values):
                        c.append(v)
                yield pa.record_batch(
                    [batch.column(0).slice(first, len(texts)),
                     *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                         "base_labels string, labels string, score double")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
