"""Licence notices against a plain search over words and an edit distance over all windows."""

import random
import re

import pytest

from lociform.llm import licenses

SCHEMA = "doc_id long, text string, places string, n_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    own = WORD.findall(fold(text))
    out = []
    for n in licenses.BASE:
        phrase = n.words.split()
        out += [(w, n.label) for w in range(len(own)) if own[w : w + len(phrase)] == phrase]
    return len(own), sorted(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts():
    r = random.Random(11)
    bits = ["MIT", "mit", "License", "licence", "Licens", "GNU", "General", "generl", "Public", "apache", "APACHE", "apach3", "cc", "BY", "by-nc", "gnu general public license", "mit license", "é", "ſ", "K", "中文", "_", "\x00", "\n", "Affero", "lesser", "x", "under the terms of the", "permission is hereby granted, free of charge, to any person obtaining a copy"]
    out = ["", None, " ", "mit licensemit license", "MIT\nLicense", "mit_license", "mit  --  LICENSE", "mitlicense", "bcc by", "cc by cc by", "cc byé", "İ mit license", "mit l " * 3000, "mit license " * 500, "a" * 50000, "éa " * 20000 + "MIT License"]
    out += ["".join(r.choice(bits) + r.choice([" ", " ", "-", ", ", ""]) for _ in range(r.randint(1, 20))) for _ in range(500)]
    return out


def test_base_places_and_labels(spark):
    data = [(k, t, "clash", "clash") for k, t in enumerate(texts())] + [(0, "mit license", None, None), (None, "CC BY", None, None)]
    got = licenses.report(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    shown = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    want = []
    for d, t, _, _ in data:
        n, places = base(t)
        starts = [w for w, _ in places]
        want.append((d if d is not None else -1, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))))
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(shown, key=key) == sorted(want, key=key)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.score == 1 or not r.n_base


@pytest.mark.parametrize("seed", range(4))
def test_every_occurrence_within_the_bound_is_found(seed):
    """Each notice with up to its edits, between foreign words, is found where it was planted; with more it isn't labelled."""
    r = random.Random(seed)
    search = licenses.search_for(licenses.NOTICES)
    for n in licenses.NOTICES:
        for edits in range(n.edits + 1):
            text = list(n.words)
            for _ in range(edits):
                k = r.randrange(1, len(text) - 1)
                what = r.randrange(3)
                if what == 0:
                    text[k] = "q"
                elif what == 1:
                    text.insert(k, "q")
                else:
                    del text[k]
            planted = "".join(text)
            total, places = search.places(f"zz {planted} zz")
            assert any(p.notice == n.words and p.edits <= edits for p in places), planted
            for p in places:
                assert p.edits <= len(p.notice) // licenses.SHARE
                own = " ".join(WORD.findall(fold(f"zz {planted} zz"[p.start : p.end])))
                assert distance(own, p.notice) == p.edits


def test_spans_are_of_the_text():
    search = licenses.search_for(licenses.NOTICES)
    text = "É – the MIT  Licence; GNU\n General Publik License!"
    total, places = search.places(text)
    assert total == 9 and [(p.label, text[p.start : p.end], p.edits, p.word, p.base) for p in places] == [("mit", "MIT  Licence", 1, 3, False), ("gpl", "GNU\n General Publik License", 1, 5, False)]
    assert search.places("mit lizenz und die apache pfeife") == (6, [])


def test_notices_are_checked_and_empty_table(spark):
    with pytest.raises(ValueError):
        licenses.Search([licenses.Notice("x", "Two  Words")])
    own = licenses.scan(spark.createDataFrame([(1, "the acme shared sorce licence here")], "doc_id long, text string"), [licenses.Notice("acme", "acme shared source licence")]).first()
    assert [(p.label, p.edits, p.word) for p in own.places] == [("acme", 1, 1)]
    assert licenses.report(spark.createDataFrame([], SCHEMA)).count() == 0
