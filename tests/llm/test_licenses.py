import random
import re

from readlake.llm import licenses as L

from .data import awkward, empty, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def base(text):
    w = WORD.findall((text or "").translate(LOWER))
    hits = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), hits


def test_base_columns_match_a_plain_scan(spark):
    texts = awkward() + ["the MIT-license, apache license General Public License", "mit license mit license", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."]
    rows = {r.doc_id: r for r in L.license_report(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, hits = base(t)
        r = rows[i]
        assert (r.n_words, r.n_base) == (n, len(hits))
        assert (r.first_word, r.last_word) == ((min(h[0] for h in hits), max(h[0] for h in hits)) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert rows[len(texts) - 2].labels == "apache,apache-2.0" and rows[len(texts) - 2].score == 1
    assert rows[len(texts) - 1].labels == "cc-by-nc" and rows[len(texts) - 1].n_base == 0


def test_matching_statistics_by_brute_force():
    r = random.Random(0)
    for _ in range(100):
        sequences = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(1, 8))] for _ in range(4)]
        text = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        a = L.TemplateAutomaton(sequences)
        got = {n: (size, sorted(set(a.ends[s]))) for n, s, size in a.statistics(text)}
        for n in range(len(text)):
            longest = None
            for size in range(1, n + 2):
                run = text[n + 1 - size : n + 1]
                if at := sorted({(k, i + size) for k, q in enumerate(sequences) for i in range(len(q) - size + 1) if q[i : i + size] == run}):
                    longest = (size, at)
            assert got.get(n) == longest


def plain_chain(spans, gap):
    """Every span against every earlier one."""
    spans = sorted(set(spans), key=lambda s: (s.start, s.at, s.end))
    score = []
    for i, s in enumerate(spans):
        own = s.end - s.start
        more = [0]
        for j, t in enumerate(spans[:i]):
            over = max(0, t.end - s.start, t.at + t.end - t.start - s.at)
            if t.start < s.start and t.at < s.at and s.start - t.end <= gap and over < own:
                more.append(score[j] - over)
        score.append(own + max(more))
    return max(score, default=0)


def test_chains_by_brute_force():
    r = random.Random(4)
    for _ in range(300):
        spans = [L.Span(0, at, start, start + n) for _ in range(r.randrange(0, 120)) for at, start, n in [(r.randrange(40), r.randrange(60), r.randrange(1, 9))]]
        assert max((c[2] for c in L.chain(spans, 5)), default=0) == plain_chain(spans, 5)


def test_chains_look_back_as_far_as_the_gap():
    """A hundred places of a short run between two parts of a template must not hide the first part."""
    first, last = L.Span(0, 0, 0, 30), L.Span(0, 30, 33, 60)
    noise = [L.Span(0, 200 + k, 31, 33) for k in range(100)]
    assert L.chain([first, last, *noise], 8)[0] == (0, 60, 57)


def test_full_texts_are_found_when_edited(spark):
    texts = dict(L.TEMPLATES)
    r = random.Random(5)
    edited = []
    for label in ("mit-full", "bsd-3-full", "isc-full"):
        w = texts[label].split()
        for k in sorted(r.sample(range(len(w)), 6)):
            w[k] = "changed"
        edited.append("some words before " + " ".join(w) + " and after")
        edited.append(" ".join(texts[label].split()[: len(w) // 2]))
    rows = {x.doc_id: x for x in L.license_report(table(spark, edited)).collect()}
    for k, label in enumerate(("mit-full", "bsd-3-full", "isc-full")):
        assert label in rows[2 * k].labels.split(",") and 0.8 <= rows[2 * k].score <= 1
        assert label not in rows[2 * k + 1].labels.split(",")  # half of it is too little


def test_templates_from_files(spark, tmp_path):
    r = random.Random(6)
    text = " ".join(r.choices([f"term{i}" for i in range(900)] + ["of", "the", "covered", "work"], k=5000))
    (tmp_path / "Long-1.0").write_text(text)
    templates = L.templates_from(spark, str(tmp_path))
    assert templates == [("long-1.0", text)]
    w = text.split()
    for k in range(0, len(w), 50):
        w[k] = "edited"
    (row,) = L.license_report(table(spark, [" ".join(w)]), L.LicenseScanner(templates=templates)).collect()
    assert row.labels == "long-1.0" and row.score > 0.9


def test_edited_template_is_chained():
    s = L.LicenseScanner()
    text = "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and its associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software"
    assert [x[2] for x in s.scan(text)[2]] == ["mit-text"]
    assert s.scan("permission to use the rights of any person")[2] == []


def test_empty_table(spark):
    assert L.license_report(empty(spark)).count() == 0
