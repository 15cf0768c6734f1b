"""License scans: templates with optional and replaceable regions, compiled into one automaton over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of, worker

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The wording of public licences and of notices that name them. <<beginOptional>> and <<endOptional>> enclose what may be left
#: out, <<var;name=...;max=n>> stands for up to n words of any kind.
TEMPLATES = {
    "apache-2.0-notice": """<<beginOptional>><<beginOptional>>This <<var;name=work;max=3>> is<<endOptional>> licensed under<<endOptional>> the Apache License, Version 2.0
        <<beginOptional>>(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0<<endOptional>>""",
    "gpl-2.0-notice": "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<beginOptional>>; either<<endOptional>> version 2<<beginOptional>> of the License, or (at your option) any later version<<endOptional>>",
    "gpl-3.0-notice": "GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<beginOptional>>; either<<endOptional>> version 3<<beginOptional>> of the License, or (at your option) any later version<<endOptional>>",
    "cc-by-4.0-notice": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY 4.0",
    "cc-by-sa-4.0-notice": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY-SA 4.0",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY-NC 4.0",
    "cc-by-long-notice": "Creative Commons Attribution <<var;name=kind;max=4>> <<beginOptional>>International <<endOptional>>License",
    "mit-notice": "<<beginOptional>><<var;name=work;max=3>> is <<endOptional>><<beginOptional>>released <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;name=holder;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;max=12>>
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution""",
}

#: Bytes that stand in a word, in lower case; all others become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Mandatory words at which the score is a half.
HALF = 8
MARKUP = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def parse(markup: str) -> list:
    """A template as a list of words (bytes), numbers (up to so many words of any kind) and lists (optional regions). Marks that don't pair up are a ValueError."""
    open_: list[list] = [[]]
    for i, part in enumerate(MARKUP.split(markup)):
        kind = part.strip().split(";")[0]
        if i % 2 == 0:
            open_[-1].extend(words_of(part.encode()))
        elif kind == "beginOptional":
            open_.append([])
        elif kind == "endOptional" and len(open_) > 1:
            region = open_.pop()
            open_[-1].append(region)
        elif kind == "var":
            open_[-1].append(int(dict(x.split("=", 1) for x in part.split(";")[1:])["max"]))
        else:
            raise ValueError(f"no such mark here: {part}")
    if len(open_) > 1:
        raise ValueError("an optional region has no end")
    return open_[0]


def mandatory(nodes: list) -> int:
    return sum(isinstance(n, bytes) for n in nodes)


@dataclass
class Automaton:
    """All templates as one automaton. A state stands before one word; sets of states are the bits of an integer.

    on: the states that a word leads on from; any: those that every word does; after: the states that follow one (those behind optional
    regions and replaceable words too); first: by template the states it may begin with; ends: by state, the templates that a word read there may end.
    """

    labels: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    on: dict[bytes, int] = field(default_factory=dict)
    any: int = 0
    after: list[int] = field(default_factory=list)
    first: int = 0
    ends: dict[int, int] = field(default_factory=dict)
    longest: int = 0

    def _state(self, before: int, word: bytes | None) -> int:
        """A new state; before: the states it follows."""
        bit = 1 << len(self.after)
        for s in range(len(self.after)):
            if before >> s & 1:
                self.after[s] |= bit
        self.after.append(0)
        if word is None:
            self.any |= bit
        else:
            self.on[word] = self.on.get(word, 0) | bit
        return bit

    def _build(self, nodes: list, before: int, begins: bool) -> tuple[int, bool, int]:
        """Adds nodes after the states before (and the beginning, if begins); what the next follows, and the most words."""
        most = 0
        for n in nodes:
            if isinstance(n, list):
                inner, through, m = self._build(n, before, begins)
                before, begins, most = before | inner, begins or through, most + m
                continue
            for _ in range(1 if isinstance(n, bytes) else n):
                bit = self._state(before, n if isinstance(n, bytes) else None)
                if begins:
                    self.first |= bit
                before, begins = (bit, False) if isinstance(n, bytes) else (before | bit, begins)
                most += 1
        return before, begins, most

    def add(self, label: str, markup: str) -> None:
        nodes = parse(markup)
        if not mandatory(nodes):
            raise ValueError(f"{label}: no word is mandatory")
        last, _, most = self._build(nodes, 0, True)
        for s in range(len(self.after)):
            if last >> s & 1:
                self.ends[s] = len(self.labels)
        self.labels.append(label)
        self.sizes.append(mandatory(nodes))
        self.longest = max(self.longest, most)

    @classmethod
    def of(cls, templates: dict[str, str]) -> Automaton:
        made = cls()
        for label, markup in templates.items():
            made.add(label, markup)
        return made

    def starters(self) -> frozenset[bytes] | None:
        """The words that a match can begin with; None if any can."""
        return None if self.first & self.any else frozenset(w for w, s in self.on.items() if s & self.first)

    def accepted(self, words: list[bytes], at: int) -> dict[int, int]:
        """template, words of its longest match: those accepted from place at on."""
        found: dict[int, int] = {}
        active = self.first
        for i in range(at, len(words)):
            hit = active & (self.on.get(words[i], 0) | self.any)
            if not hit:
                break
            active = 0
            while hit:
                low = hit & -hit
                s = low.bit_length() - 1
                active |= self.after[s]
                if s in self.ends:
                    found[self.ends[s]] = i + 1 - at
                hit ^= low
        return found


def anchored(markup: str) -> str:
    """markup without the regions at its very beginning that may be left out: they never decide whether it matches somewhere."""
    depth, at = 0, 0
    for m in MARKUP.finditer(markup):
        if not depth and words_of(markup[at : m.start()].encode()):
            break
        depth += {"beginOptional": 1, "endOptional": -1}.get(m.group(1).strip(), 0)
        at = m.end() if not depth else at
    return markup[at:]


def matches(automaton: Automaton, text: bytes, piece: int = PIECE) -> Iterator[tuple[int, int, int] | int]:
    """(template, first word, words) for each accepted place of a text; the number of its words at last. Holds one piece of the text as words."""
    starters, held, base, at = automaton.starters(), [], 0, 0
    while True:
        end = at + piece
        while end < len(text) and WORD_BYTES[text[end]] != 32:
            end += 1
        held += words_of(text[at:end])
        at, final = end, end >= len(text)
        ready = len(held) if final else max(0, len(held) - automaton.longest)
        for i in range(ready) if starters is None else [i for i, w in enumerate(held) if w in starters and i < ready]:
            for t, n in automaton.accepted(held, i).items():
                yield t, base + i, n
        held, base = held[ready:], base + ready
        if final:
            yield base
            return


#: What a scan gives for each text: words, base places, their first and last start, base labels, all labels, score, and the accepted places.
SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,first:long,words:long>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """id_col and SCAN for each row of docs; one map pass, no shuffle.

    Words are runs of digits, letters a-z (A-Z in lower case) and all characters beyond ASCII. A base place is one where a phrase's words
    follow each other; labels has those of phrases and of templates whose mandatory words stand there exactly, with any of the optional
    regions and up to the stated number of words where replaceable ones are. places: the templates' places (the longest match from each start, from
    the first word that isn't optional on). score: m / (m + 8), m being the mandatory words of the largest phrase or template found; 0 if none is.

    Null and empty texts have no words, no places and empty labels; rows that repeat and null ids give a result each; an empty
    table gives an empty result. Other columns are left out, so their names can't clash. Long texts are cut into pieces of 1 MB.
    """
    automaton = Automaton.of({f"phrase {p}": p for p in phrases} | {name: anchored(t) for name, t in templates.items()})
    label_of, n_phrases = [*phrases.values(), *templates], len(phrases)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), out_type)

    def one(text: bytes) -> tuple:
        base, places, found, n = [], [], set(), 0
        for m in matches(automaton, text):
            if isinstance(m, int):
                n = m
                continue
            found.add(m[0])
            if m[0] < n_phrases:
                base.append(m[1])
            else:
                places.append({"label": label_of[m[0]], "first": m[1], "words": m[2]})
        size = max((automaton.sizes[t] for t in found), default=0)
        base_labels = ",".join(sorted({label_of[t] for t in found if t < n_phrases}))
        return n, len(base), min(base, default=None), max(base, default=None), base_labels, ",".join(sorted({label_of[t] for t in found})), size / (size + HALF), places

    @worker("licenses")
    def scan(batches):
        for b in batches:
            if b.num_rows:
                got = [one(t.as_buffer().to_pybytes()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True))], ["id", *(x.split()[0] for x in SCAN.split(", "))])

    names = [x.split()[0] for x in SCAN.split(", ")]
    return rows.mapInArrow(scan, f"id {kind}, {SCAN}").select(F.col("id").alias(id_col), *names)


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def _pattern(nodes: list) -> str:
    """A parsed template as a regular expression over words between bars."""
    return "".join(rf"\|{n.decode()}\|" if isinstance(n, bytes) else f"(?:{_pattern(n)})?" if isinstance(n, list) else rf"(?:\|[^|]*\|){{0,{n}}}" for n in nodes)


def _sql() -> str:
    """Phrases by their words' places, templates as regular expressions over the words."""
    found = ", ".join(f"case when regexp_matches(s, '{_pattern(parse(t))}') then {{'label': '{n}', 'size': {mandatory(parse(t))}, 'base': false}} end" for n, t in TEMPLATES.items())
    starts = ", ".join(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()!r}), lambda i: {{'label': '{label}', 'size': {len(p.split())}, 'base': true, 'at': i - 1}})" for p, label in PHRASES.items())
    return rf"""
with a as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select doc_id, w, '|' || array_to_string(w, '||') || '|' as s from a),
c as (select doc_id, len(w) as n_words, list_concat({starts.replace("}), list", "}), list")}) as p, list_filter([{found}], lambda x: x is not null) as t from b)
select doc_id, n_words, len(p)::bigint as n_base, list_min(list_transform(p, lambda x: x.at))::bigint as first_word, list_max(list_transform(p, lambda x: x.at))::bigint as last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), list_transform(t, lambda x: x.label)))), ',') as labels,
  coalesce(list_max(list_concat(list_transform(p, lambda x: x.size), list_transform(t, lambda x: x.size))), 0)::double / (coalesce(list_max(list_concat(list_transform(p, lambda x: x.size), list_transform(t, lambda x: x.size))), 0) + {HALF}) as score
from c"""


OP12_SQL = _sql()
