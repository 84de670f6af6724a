"""License scan: exact phrases, and an exact set-similarity join of lines with templates.

Every line of a text is a block, its distinct words are its set. So is every stretch of words
that runs over line ends and is at most ``1 / CONTAINMENT`` times as long as the template, so a
sentence is met however it is wrapped. A block meets a template when it holds at least
``CONTAINMENT`` of the template's words. Template words are ordered by how
many blocks of the whole corpus hold them, rarest first. A template of n words that must share
m of them has to share one of its n - m + 1 rarest (prefix filter); a block of fewer than m
words cannot (length filter); and from the first shared word on, enough words must be left on
both sides (positional filter). What passes is counted exactly, so no pair is lost.

Templates are a short fixed list and travel with the function; texts never move. The corpus
statistics are sums of counts per task.

Defined results: null text is empty (0 words, no places, score 0); upper-case A-Z count as
lower case; a repeated row is scanned again; a null id stays null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, deque

from pyspark.sql import DataFrame, functions as F

from abstracta.llm.common import FOLD, map_rows, text_or_empty

CONTAINMENT = 0.8
#: Phrases with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Sentences from public license texts, with their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial license", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
)


def folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many blocks of the corpus each template word stands; a row per template word."""
    vocabulary = frozenset(word.encode() for text, _ in templates for word in text.split())

    def task(batch):
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            for line in folded(text).split(b"\n"):
                counts.update(vocabulary.intersection(line.split()))
        yield from ((word.decode(), n) for word, n in counts.items())

    counted = map_rows(docs.select(text_or_empty().alias("text")), task, "word string, n long")
    found = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {row["word"].encode(): row["n"] for row in found}


class Template:
    def __init__(self, text: str, label: str, frequency: dict[bytes, int], containment: float) -> None:
        self.words = sorted({w.encode() for w in text.split()}, key=lambda w: (frequency[w], w))
        self.label = label
        #: Words of a stretch over line ends: the sentence with some foreign words between.
        self.span = math.ceil(len(text.split()) / containment - 1e-9)
        self.least = math.ceil(containment * len(self.words) - 1e-9)
        self.prefix = self.words[: len(self.words) - self.least + 1]
        self.place = {word: i for i, word in enumerate(self.words)}

    def containment(self, block: set[bytes]) -> float:
        """Share of the words in ``block``, 0 when a filter shows that it is below the least."""
        if len(block) < self.least:
            return 0.0
        shared = sorted(self.place[w] for w in block.intersection(self.place))
        if not shared or len(self.words) - shared[0] < self.least or len(shared) < self.least:
            return 0.0
        return len(shared) / len(self.words)

    def wrapped(self, words: list[bytes]) -> float:
        """Best containment in any stretch of at most ``span`` of the ``words``, 0 below the least."""
        best, held, inside = 0, Counter(), deque()
        for at, word in enumerate(words):
            if word in self.place:
                inside.append((at, word))
                held[word] += 1
                while inside[0][0] <= at - self.span:
                    _, old = inside.popleft()
                    held[old] -= 1
                    if not held[old]:
                        del held[old]
                best = max(best, len(held))
        return best / len(self.words) if best >= self.least else 0.0


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row.

    ``score`` is the best containment of any template in any block that meets the threshold,
    1 where a base phrase stands, else 0.
    """
    frequency = word_frequencies(docs, templates)
    wanted = [Template(text, label, frequency, containment) for text, label in templates]
    index: dict[bytes, list[int]] = {}
    for number, template in enumerate(wanted):
        for word in template.prefix:
            index.setdefault(word, []).append(number)
    prefix_words = frozenset(index)
    spaced = [(f" {phrase} ".encode(), label) for phrase, label in phrases]

    def rows(batch):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = [line.split() for line in folded(text).split(b"\n")]
            words = [word for line in lines for word in line]
            joined = b" " + b" ".join(words) + b" "
            places, base = [], set()
            for phrase, label in spaced:
                at, seen, upto = joined.find(phrase), 0, 0
                while at >= 0:
                    seen, upto = seen + joined.count(b" ", upto, at), at
                    places.append(seen)
                    base.add(label)
                    at = joined.find(phrase, at + 1)
            labels, score = set(base), 1.0 if base else 0.0
            for line in lines:
                hits = prefix_words.intersection(line)
                if hits:
                    block = set(line)
                    for number in {n for word in hits for n in index[word]}:
                        share = wanted[number].containment(block)
                        if share:
                            labels.add(wanted[number].label)
                            score = max(score, share)
            if len(lines) > 1:
                whole = set(words)
                for number in {n for word in prefix_words.intersection(whole) for n in index[word]}:
                    # No stretch holds more than the whole text.
                    if wanted[number].containment(whole):
                        share = wanted[number].wrapped(words)
                        if share:
                            labels.add(wanted[number].label)
                            score = max(score, share)
            first, last = (min(places), max(places)) if places else (None, None)
            yield doc_id, len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), rows, ddl)
