"""License scan by templates with optional and replaceable regions.

Markup: plain words are mandatory; ``[...]`` is a region that may be missing, and may hold others;
``{name:least-most}`` stands for so many words of any kind. Templates are compiled into one automaton
over words. It is run from each place where a template can begin; a text is accepted there when all
mandatory wording stands in order, word for word, with nothing between but what a region allows.

Words are runs of digits, letters a-z (after A-Z are lower-cased) and all characters beyond ASCII.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, nonnull_text

WORD = rb"[0-9a-z\x80-\xff]+"
# Sets of states kept in a task; beyond it the table starts anew.
KEPT_STATES = 20_000


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


# Phrases that name a license.
BASE = (Template("gpl", "GNU General Public License", True), Template("apache", "Apache License", True),
        Template("cc-by", "CC BY", True), Template("mit", "MIT License", True))

# Wording of public licenses and their usual notices.
NOTICES = (
    Template("mit-notice", "released under the MIT License"),
    Template("mit-notice", "licensed under the MIT License"),
    Template("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice [(including the next paragraph)]
        shall be included in all copies or substantial portions of the Software."""),
    Template("isc-text", """Permission to use, copy, modify, [and/or] [and] distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    Template("bsd-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: [1.] Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. [2.] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution."""),
    Template("bsd-no-endorsement", """Neither the name of {holder:1-20} nor the names of [its] [{others:1-4}] contributors may be used to endorse or promote
        products derived from this software without specific prior written permission."""),
    Template("apache-notice", """Licensed under the Apache License, Version {version:1-2} [(the "License"); you may not use this file except in compliance with
        the License. [You may obtain a copy of the License at {address:1-12}]]"""),
    Template("gpl-notice", "licensed under the [terms of the] GNU General Public License[,] [version {version:1-2}]"),
    Template("gpl-notice", """This {work:1-3} is free software[:] you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation[,] either version {version:1-2} of the License, or (at your option) any later version."""),
    Template("lgpl-notice", """This {work:1-3} is free software[:] you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation[,] either version {version:1-2} of the License, or (at your option) any later version."""),
    Template("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. {version:1-2}"),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
    Template("cc0", "To the extent possible under law, {author:1-20} has waived all copyright and related or neighboring rights to {work:1-20}"),
    Template("cc-by-nc", "CC BY NC"), Template("cc-by-sa", "CC BY [NC] SA"), Template("cc-by-nd", "CC BY [NC] ND"),
    Template("cc-notice", "licensed under [a] [Creative Commons] CC BY [NC] [SA] [ND] {version:1-2}"),
)
TEMPLATES = BASE + NOTICES


def words_of(text: bytes) -> list[bytes]:
    return re.findall(WORD, text.lower())


def parse(markup: str) -> list:
    """Items in order: a word (bytes), ``("opt", items)`` or ``("any", least, most)``. Raises ValueError on open or unknown markup."""
    stack: list[list] = [[]]
    for token in re.findall(r"\[|\]|\{[^}]*\}|[^\[\]{}]+|[{}]", markup):
        if token == "[":
            stack.append([])
        elif token == "]":
            if len(stack) < 2:
                raise ValueError(f"no region is open: {markup}")
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif token.startswith("{"):
            found = re.fullmatch(r"\{\w+:(\d+)-(\d+)\}", token)
            if not found or int(found[1]) > int(found[2]):
                raise ValueError(f"unknown region {token}")
            stack[-1].append(("any", int(found[1]), int(found[2])))
        elif token == "}":
            raise ValueError(f"no region is open: {markup}")
        else:
            stack[-1].extend(words_of(token.encode()))
    if len(stack) > 1:
        raise ValueError(f"a region stays open: {markup}")
    if not stack[0] or not isinstance(stack[0][0], bytes):
        raise ValueError(f"a template begins with a word: {markup}")
    return stack[0]


def mandatory(items: list) -> int:
    return sum(isinstance(x, bytes) for x in items)


class Automaton:
    """All templates in one automaton over words; sets of states are made when they are first met."""

    def __init__(self, templates: tuple[Template, ...]):
        self.by_word: list[dict[bytes, list[int]]] = [{}]
        self.by_any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        self.ends: dict[int, int] = {}
        for number, template in enumerate(templates):
            self.ends[self._add(parse(template.markup), 0)] = number
        self.first = frozenset(self.by_word[0])
        self.vocabulary = {w for d in self.by_word for w in d}
        self._forget()

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def _add(self, items: list, at: int) -> int:
        """States for the items from ``at`` on; the state behind the last."""
        for item in items:
            after = self._state()
            if isinstance(item, bytes):
                self.by_word[at].setdefault(item, []).append(after)
            elif item[0] == "opt":
                inner = self._state()
                self.free[at] += [inner, after]
                self.free[self._add(item[1], inner)].append(after)
            else:
                for k in range(item[2]):
                    if k >= item[1]:
                        self.free[at].append(after)
                    step = self._state()
                    self.by_any[at].append(step)
                    at = step
                self.free[at].append(after)
            at = after
        return at

    def _closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _forget(self) -> None:
        self.sets: list[frozenset[int]] = [self._closed([0])]
        self.number = {self.sets[0]: 0}
        self.steps: list[dict] = [{}]
        self.accepted: list[tuple[int, ...]] = [()]

    def _step(self, at: int, word: bytes | None) -> int:
        reached = [t for s in self.sets[at] for t in (*self.by_word[s].get(word, ()), *self.by_any[s])]
        if not reached:
            self.steps[at][word] = -1
            return -1
        to = self._closed(reached)
        if to not in self.number:
            self.number[to] = len(self.sets)
            self.sets.append(to)
            self.steps.append({})
            self.accepted.append(tuple(sorted({self.ends[s] for s in to if s in self.ends})))
        self.steps[at][word] = self.number[to]
        return self.number[to]

    def run(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, template, end) in words: for each start and template the longest accepted text."""
        out = []
        if len(self.sets) > KEPT_STATES:
            self._forget()
        for start in [i for i, w in enumerate(words) if w in self.first]:
            at, i, found = 0, start, {}
            while i < len(words):
                word = words[i] if words[i] in self.vocabulary else None
                to = self.steps[at].get(word)
                at = self._step(at, word) if to is None else to
                if at < 0:
                    break
                i += 1
                for t in self.accepted[at]:
                    found[t] = i
            out += [(start, t, found[t]) for t in sorted(found)]
        return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, matches (label, base, weight, start, end) of each document; start and end count words from 0, the end is not included.

    Matches are in the order of start, then of the templates. Weight is the number of mandatory words. Null text is
    empty; a document without matches has an empty list; repeated rows and null ids stay. Extra columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights = [mandatory(parse(t.markup)) for t in templates]

    def run(batches):
        import pyarrow as pa

        machine = Automaton(templates)
        match = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("weight", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            counts, found = [], []
            for text in b.column("text").cast(pa.binary()):
                words = words_of(text.as_py())
                counts.append(len(words))
                found.append([{"label": templates[t].label, "base": templates[t].base, "weight": weights[t], "start": s, "end": e}
                              for s, t, e in machine.run(words)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, match)], ["doc_id", "n_words", "matches"])

    return docs.select("doc_id", nonnull_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, matches array<struct<label:string,base:boolean,weight:int,start:bigint,end:bigint>>")


def _names(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of scanned documents.

    The score grows with the longest wording found: 1 - 1 / (1 + its mandatory words); 0 without any.
    """
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    most = F.coalesce(F.array_max(F.transform("matches", lambda m: m["weight"])), F.lit(0))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                          F.array_max(starts).alias("last_word"), _names(base).alias("base_labels"), _names(F.col("matches")).alias("labels"),
                          (F.lit(1.0) - F.lit(1.0) / (1 + most)).alias("score"))


def as_regex(markup: str) -> str:
    """The template as a regular expression over words that each stand between two spaces of their own."""
    def of(items: list) -> str:
        return "".join(f" {x.decode()} " if isinstance(x, bytes) else f"(?:{of(x[1])})?" if x[0] == "opt" else f"(?: [^ ]+ ){{{x[1]},{x[2]}}}" for x in items)
    return of(parse(markup))


def twin_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The summary as SQL, templates as regular expressions."""
    rows = ", ".join(f"('{t.label}', {str(t.base).lower()}, {mandatory(parse(t.markup))}, {len(parse(t.markup))}, '{as_regex(t.markup)}')" for t in templates)
    return f"""
        WITH t(label, base, weight, n, re) AS (VALUES {rows}),
             w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS l FROM documents),
             s AS (SELECT k, doc_id, l, array_to_string(list_transform(l, lambda x: ' ' || x || ' '), '') AS s FROM w),
             hits AS (SELECT k, label, base, weight, CASE WHEN base THEN list_filter(range(len(l)),
                        lambda i: array_to_string(list_transform(l[i + 1:i + n], lambda x: ' ' || x || ' '), '') = re) ELSE [] END AS places
                      FROM s, t WHERE regexp_matches(s, re)),
             per AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                       max(weight) AS weight, flatten(list(places)) AS places FROM hits GROUP BY k)
        SELECT doc_id, len(l) AS n_words, coalesce(len(places), 0) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
          coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, 1.0::DOUBLE - 1.0::DOUBLE / (1 + coalesce(weight, 0)) AS score
        FROM s LEFT JOIN per USING (k)"""
