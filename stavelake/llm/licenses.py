"""License scans by template markup.

A template is wording with marks: ``[words]`` may be left out, ``{a-b}`` stands for a to b words of
any kind. All templates are compiled into one automaton over words. From every word of a text that
can begin a template the automaton runs on; where it accepts, the mandatory wording stands there
exactly. States are made when a text first needs them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words: digits, a to z (A to Z lower-cased), and all beyond ASCII; anything else separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# The phrases that the contract names, and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Public wording of licences and notices, in markup.
WORDING = (
    ("agpl-3", "under the gnu affero general public license [v3] [as published by the free software foundation] [either] version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at {1-8} apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "under [the terms of] the [2 clause] [3 clause] [new] [simplified] [revised] bsd license"),
    ("cc-by", "under [a] [the] creative commons attribution {1-3} international license"),
    ("cc-by-nc", "under [a] [the] creative commons attribution non commercial {0-4} license"),
    ("cc-by-nc", "licensed under cc by nc {1-1} 0"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "under [a] [the] creative commons attribution share alike {0-4} license"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl-2", "under [the terms of] the gnu general public license [as published by the free software foundation] [either] version 2"),
    ("gpl-3", "under [the terms of] the gnu general public license [as published by the free software foundation] [either] version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under [the terms of] the gnu lesser general public license [as published by the free software foundation] [either] version {1-2}"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software [and associated documentation files the software] to deal in the software without restriction"),
    ("mit", "[released] [licensed] [available] [distributed] under the [terms of the] mit license"),
    ("mpl-2", "subject to the terms of the mozilla public license {0-2} 2 0"),
    ("all-rights-reserved", "copyright [c] {1-8} all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


def parse(template: str) -> list:
    """Nodes of a template: a word, (low, high) for any words, or a list of nodes that may be left out."""
    stack: list[list] = [[]]
    for token in re.findall(r"[\[\]]|\{\d+-\d+\}|[^\s\[\]{}]+|[{}]", template):
        if token == "[":
            stack.append([])
        elif token == "]":
            if len(stack) == 1:
                raise ValueError(f"nothing to close in {template!r}")
            inner = stack.pop()
            stack[-1].append(inner)
        elif token[0] == "{" and len(token) > 1:
            low, high = map(int, token[1:-1].split("-"))
            if low > high:
                raise ValueError(f"{token} in {template!r}")
            stack[-1].append((low, high))
        elif token in "{}":
            raise ValueError(f"replaceable part without bounds in {template!r}")
        else:
            stack[-1].append(token.lower())
    if len(stack) > 1:
        raise ValueError(f"not closed: {template!r}")
    return stack[0]


def mandatory(template: str) -> int:
    """Words that must stand there."""
    return sum(isinstance(x, str) for x in parse(template))


class Automaton:
    """All templates as one automaton over words; ``find`` gives (template, first word, last word)."""

    MOST_STATES = 50_000

    def __init__(self, templates: list[str]):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.accepts: dict[int, int] = {}
        for k, t in enumerate(templates):
            if not mandatory(t):
                raise ValueError(f"no mandatory word in {t!r}")
            self.accepts[self._add(parse(t), 0)] = k
        self.vocabulary = {w for es in self.edges for w, _ in es if w is not None}
        self._reset()
        start = self.sets[0]
        if any(w is None for s in start for w, _ in self.edges[s]):
            raise ValueError("a template cannot begin with a replaceable part")
        self.firsts = {w for s in start for w, _ in self.edges[s]}

    def _new(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _add(self, nodes: list, at: int) -> int:
        for x in nodes:
            if isinstance(x, list):
                end = self._add(x, at)
                after = self._new()
                self.free[at].append(after)
                self.free[end].append(after)
                at = after
            elif isinstance(x, tuple):
                skips = []
                for j in range(x[1]):
                    if j >= x[0]:
                        skips.append(at)
                    nxt = self._new()
                    self.edges[at].append((None, nxt))
                    at = nxt
                for s in skips:
                    self.free[s].append(at)
            else:
                nxt = self._new()
                self.edges[at].append((x.encode(), nxt))
                at = nxt
        return at

    def _reset(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}
        self.steps: list[dict[bytes | None, int]] = []
        self.ends: list[list[int]] = []
        self._state({0})

    def _state(self, some: set[int]) -> int:
        """The number of the set with all that it reaches without a word; -1 for nothing."""
        reached, todo = set(some), list(some)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in reached:
                    reached.add(s)
                    todo.append(s)
        key = frozenset(reached)
        if not key:
            return -1
        if (known := self.number.get(key)) is None:
            known = self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.ends.append(sorted(self.accepts[s] for s in key if s in self.accepts))
        return known

    def _step(self, state: int, word: bytes | None) -> int:
        nxt = self._state({to for s in self.sets[state] for w, to in self.edges[s] if w is None or w == word})
        self.steps[state][word] = nxt
        return nxt

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        out, firsts, vocabulary, n = [], self.firsts, self.vocabulary, len(words)
        for i in [i for i, w in enumerate(words) if w in firsts]:
            if len(self.sets) > self.MOST_STATES:
                self._reset()
            state, longest = 0, {}
            for j in range(i, n):
                word = words[j] if words[j] in vocabulary else None
                nxt = self.steps[state].get(word)
                state = self._step(state, word) if nxt is None else nxt
                if state < 0:
                    break
                for k in self.ends[state]:
                    longest[k] = j
            out += [(k, i, j) for k, j in sorted(longest.items())]
        return out


def find_templates(docs: DataFrame, templates: list[str]) -> DataFrame:
    """(doc_id, n_words, places) of every row: each place where a template stands, the longest from its first word.

    ``places`` are structs (template, first, last): the template's number and its first and
    last word, words from 0. A null or empty text has no words and no places. Rows are kept
    apart, repeated or not; an empty table gives an empty result, other columns are ignored.
    """
    templates = list(templates)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(templates)
        for b in batches:
            n, found = [], []
            for text in b["text"]:
                words = words_of(text) if isinstance(text, str) else []
                n.append(len(words))
                found.append(automaton.find(words))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": n, "t": [[x[0] for x in f] for f in found],
                                "a": [[x[1] for x in f] for f in found], "z": [[x[2] for x in f] for f in found]})

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        scan, "doc_id long, n_words long, t array<int>, a array<long>, z array<long>")
    return raw.select("doc_id", "n_words", F.arrays_zip(F.col("t").alias("template"), F.col("a").alias("first"), F.col("z").alias("last")).alias("places"))


def license_labels(docs: DataFrame, base=BASE, wording=WORDING) -> DataFrame:
    """Labels of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base`` are plain phrases, all of whose places count; ``wording`` adds labels by markup.
    ``score`` is m / (m + 2), where m is the number of mandatory words of the longest template
    that stands in the text, 0 without any. See ``find_templates`` for nulls and repeated rows.
    """
    every = [*base, *wording]
    found = find_templates(docs, [t for _, t in every])
    label = F.array(*[F.lit(x) for x, _ in every])
    words = F.array(*[F.lit(mandatory(t)) for _, t in every])
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(label, p["template"])))), ",")
    own = F.filter("places", lambda p: p["template"] < len(base))
    m = F.coalesce(F.array_max(F.transform("places", lambda p: F.get(words, p["template"]))), F.lit(0))
    return found.withColumn("_own", own).select(
        "doc_id", "n_words", F.size("_own").cast("long").alias("n_base"),
        F.array_min(F.transform("_own", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("_own", lambda p: p["first"])).alias("last_word"),
        named(F.col("_own")).alias("base_labels"), named(F.col("places")).alias("labels"), (m / (m + 2)).alias("score"))


def pattern(template: str) -> str:
    """The template as a regular expression over words that each have a space before and behind."""

    def of(nodes: list) -> str:
        return "".join(f"(?:{of(x)})?" if isinstance(x, list) else f"(?: [^ ]+ ){{{x[0]},{x[1]}}}" if isinstance(x, tuple) else f" {x} " for x in nodes)

    return of(parse(template))


def _oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = " OR ".join(f"w[i + 1 : i + {mandatory(t)}] = {t.split()}" for _, t in BASE)
    has = lambda rows: ", ".join(f"CASE WHEN regexp_matches(s, '{pattern(t)}') THEN '{x}' END" for x, t in rows)
    labels = lambda rows: f"array_to_string(list_sort(list_distinct(list_filter([{has(rows)}], lambda x: x IS NOT NULL))), ',')"
    most = ", ".join(f"CASE WHEN regexp_matches(s, '{pattern(t)}') THEN {mandatory(t)} ELSE 0 END" for _, t in [*BASE, *WORDING])
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, len(w) AS n_words, list_filter(range(len(w)), lambda i: {at}) AS b,
              array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS s FROM d),
 m AS (SELECT *, greatest({most}) AS m FROM p)
SELECT doc_id, n_words, len(b) AS n_base, list_min(b) AS first_word, list_max(b) AS last_word,
       {labels(BASE)} AS base_labels, {labels([*BASE, *WORDING])} AS labels, (m / (m + 2))::DOUBLE AS score FROM m
"""


ORACLE = _oracle()
