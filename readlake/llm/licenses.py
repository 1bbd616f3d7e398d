"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of every template in one graph. Streaming a text through
it gives the matching statistics: at each word the longest run ending there that occurs in a
template, and which template places it can be. Long matches are chained in template order into
spans, and a template is reported where its chained spans cover enough of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, whole_text

#: Phrases whose every occurrence counts, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices, openings and short whole texts of public licences, as (label, text); fixed values.
#: ``templates_from`` reads long ones from files.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("mit-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-3-full", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc-full", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: Least tokens of a match that is chained, and least part of a template that its spans cover.
LEAST_RUN, LEAST_COVER = 3, 0.8
#: Most words between two chained matches.
GAP = 8
#: ASCII other than 0-9 and a-z parts words.
_PARTS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_PARTS).split()


@dataclass(frozen=True)
class Span:
    """Words [start, end) of a text that match [at, at + end - start) of a template."""

    template: int
    at: int
    start: int
    end: int


class TemplateAutomaton:
    """Suffix automaton over the tokens of several sequences, with the places of each state."""

    def __init__(self, sequences: Sequence[Sequence[bytes]]):
        self.sequences = [list(s) for s in sequences]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(self.sequences):
            last = 0
            for n, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((k, n + 1))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] += self.ends[v]
        self.ends[0] = []
        #: Sequences that are whole suffixes of a state's runs: (length, sequence), shortest first.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, sequence in enumerate(self.sequences):
            v = 0
            for token in sequence:
                v = self.next[v][token]
            if v:
                self.whole[v].append((len(sequence), k))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.whole[v] = self.whole[self.link[v]] + sorted(self.whole[v])

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _clone(self, p: int, token: bytes, q: int) -> int:
        """The runs of q that are no longer than those of p and the token get a state of their own."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, token: bytes) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
        return new

    def statistics(self, text: Sequence[bytes]) -> Iterator[tuple[int, int, int]]:
        """(word, state, length) of the longest match that ends at each word, where there is one."""
        state = length = 0
        edges, link, size, root = self.next, self.link, self.length, self.next[0]
        for n, token in enumerate(text):
            if token not in root:  # in no template
                state = length = 0
                continue
            while (to := edges[state].get(token)) is None:
                state = link[state]
                length = size[state]
            state, length = to, length + 1
            yield n, state, length

    def scan(self, text: Sequence[bytes], least: int) -> tuple[list[tuple[int, int, int]], list[Span]]:
        """(start, length, sequence) of each whole sequence that occurs, and the maximal matches of
        ``least`` words or more, once for each template place they can stand for."""
        found, spans, held = [], [], None
        for n, state, length in self.statistics(text):
            for size, k in self.whole[state]:
                if size <= length:
                    found.append((n + 1 - size, size, k))
            if held and (n != held[0] + 1 or length != held[2] + 1):  # the held match can't grow to the right
                spans += self._places(*held, least)
            held = (n, state, length)
        if held:
            spans += self._places(*held, least)
        return found, spans

    def _places(self, n: int, state: int, length: int, least: int) -> list[Span]:
        return [Span(k, end - length, n + 1 - length, n + 1) for k, end in self.ends[state]] if length >= least else []


def chain(spans: Sequence[Span], gap: int) -> list[tuple[int, int, int]]:
    """The heaviest chains of one template's spans in order of text and template: (start, end, words).

    A span may follow any that ends at most ``gap`` words before it; only those are looked at, and
    there are no more of them than the words within the gap have places in the template. Of equal
    chains the one with the latest predecessors holds.
    """
    spans = sorted(set(spans), key=lambda s: (s.start, s.at, s.end))
    best: list[tuple[int, int]] = []
    near: list[int] = []
    for i, s in enumerate(spans):
        near = [j for j in near if spans[j].end >= s.start - gap]
        score, before = s.end - s.start, -1
        for j in reversed(near):
            t = spans[j]
            over = max(0, t.end - s.start, t.at + (t.end - t.start) - s.at)
            if t.start < s.start and t.at < s.at and over < s.end - s.start and best[j][0] + s.end - s.start - over > score:
                score, before = best[j][0] + s.end - s.start - over, j
        best.append((score, before))
        near.append(i)
    out, used = [], set()
    for i in sorted(range(len(spans)), key=lambda i: (-best[i][0], spans[i].start)):
        path, k = [], i
        while k >= 0 and k not in used:
            path.append(k)
            k = best[k][1]
        if k < 0 and path:
            used.update(path)
            out.append((spans[path[-1]].start, spans[i].end, best[i][0]))
    return out


class LicenseScanner:
    def __init__(self, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, least_run: int = LEAST_RUN, least_cover: float = LEAST_COVER, gap: int = GAP):
        self.base = list(phrases.values())
        self.labels = [*self.base, *(label for label, _ in templates)]
        self.automaton = TemplateAutomaton([words(p) for p in phrases] + [words(t) for _, t in templates])
        self.least_run, self.least_cover, self.gap = least_run, least_cover, gap

    def scan(self, text: str):
        """Number of words, base occurrences (start, length, label), and template spans (start, end, label, covered part)."""
        own = words(text)
        found, matches = self.automaton.scan(own, self.least_run)
        n = len(self.base)
        base = [(start, size, self.base[k]) for start, size, k in found if k < n]
        by: dict[int, list[Span]] = {}
        for s in matches:
            if s.template >= n:
                by.setdefault(s.template, []).append(s)
        spans = []
        for k, group in by.items():
            whole = len(self.automaton.sequences[k])
            spans += [(start, end, self.labels[k], min(1.0, covered / whole)) for start, end, covered in chain(group, self.gap) if covered >= self.least_cover * whole]
        return len(own), base, sorted(spans)


def templates_from(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(label, text) of each file of a folder of licence texts, the label its name in lower case."""
    rows = spark.read.text(path, wholetext=True).select("value", F.lower(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)).alias("label"))
    return sorted((r["label"], r["value"]) for r in rows.collect())


def license_spans(docs: DataFrame, scanner: LicenseScanner | None = None) -> DataFrame:
    """One row per document: n_words, base occurrences and template spans (start, end, label, covered).

    A null text counts as empty: no words and no spans. Rows are scanned each for itself, so
    repeated rows and null ids give repeated results and an empty table none. A very long text is
    streamed whole, in time that grows with its length; only doc_id and text are read, so further
    columns cannot clash. Templates of one label each give spans of their own.
    """
    scanner = scanner or LicenseScanner()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.float64())]))
    base = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("label", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bases, spans = [], [], []
            for text in batch["text"]:
                own, found, covered = scanner.scan(text.as_py())
                n.append(own)
                bases.append([{"start": a, "length": b, "label": c} for a, b, c in found])
                spans.append([{"start": a, "end": b, "label": c, "covered": d} for a, b, c, d in covered])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(bases, base), pa.array(spans, span)], ["doc_id", "n_words", "base", "spans"])

    rows = spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text")))
    return rows.mapInArrow(scan, "doc_id long, n_words long, base array<struct<start:long,length:long,label:string>>, spans array<struct<start:long,end:long,label:string,covered:double>>")


def license_report(docs: DataFrame, scanner: LicenseScanner | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans: the base
    occurrences of each document and all labels found; score is the greatest covered part of a
    template, or 1 where only a base phrase stands, or 0."""
    spans = license_spans(docs, scanner)
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("spans", lambda s: s["label"])))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.when(F.size("base") > 0, 1.0), F.lit(0.0))
    return spans.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.alias("score"), F.size("spans").cast("long").alias("n_spans"))


def op1_license_automaton(spark, sf_dir: str) -> DataFrame:
    """``license_report`` of all ``documents`` with the built-in phrases and templates."""
    return license_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
