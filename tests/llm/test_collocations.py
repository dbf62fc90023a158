"""Phrases against brute force."""

import random
import re
from collections import Counter

import pytest

from armscope.llm import collocations as co
from armscope.llm import shared

SCHEMA = "doc_id long, lang string, text string, phrase string, f long, h long, rank int, source string"


def texts():
    rng = random.Random(3)
    names = ["alpha", "Beta", "g'amma", "d-elta", "é", "ÀB", "z#", "of", "the", "a"]
    out = []
    for i in range(60):
        lang = ["en", "de", None, "und", ""][i % 5]
        body = []
        for _ in range(rng.randint(5, 120)):
            body.append(rng.choice(names[: 4 + i % 7]) + rng.choice([" ", " ", "  ", "\t", " \t", ", ", "\n", ". ", "\x0b"]))
            if rng.random() < 0.1:
                body.append("one fixed phrase of words ")
            if rng.random() < 0.1:
                body.append("New  York City! ")
            if rng.random() < 0.05:
                body.append("ha ha ha ha ha ha ")
        out.append((lang, "".join(body)))
    out += [("en", None), (None, None), ("en", ""), ("de", " \t\n"), ("fr", "alone"), ("en", "word " * 3000), *out[:3]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(1, lang, t, "x", 2, 3, 4, "s") for lang, t in rows], SCHEMA)


def brute(rows, spec):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang or ("und" if lang is None else lang)] += len(w)
            for k in range(1, spec.longest + 1):
                f.update((lang if lang is not None else "und", w[i : i + k]) for i in range(len(w) - k + 1))
    frequent = {(lang, q): a for (lang, q), a in f.items() if len(q) > 1 and a >= spec.least}
    inside = Counter()
    for (lang, q), a in frequent.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                part = (lang, q[i : i + k])
                inside[part] = max(inside[part], a)
    out = {}
    for (lang, q), a in frequent.items():
        if inside[lang, q] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, q[:k]] * f[lang, q[k:]]), k) for k in range(1, len(q))]
            score, k = min(cuts)
            row = (-score, -a, " ".join(q).encode(), f[lang, q[:k]], f[lang, q[k:]])
            out.setdefault(lang, []).append(row)
    return sorted(
        (lang, i + 1, q.decode(), -a, left, right, n[lang], -score)
        for lang, rows in out.items()
        for i, (score, a, q, left, right) in enumerate(sorted(rows)[: spec.first])
    )


def mined(docs, spec):
    return sorted(tuple(r) for r in co.collocations(docs, spec).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(
    "spec,bits,pending",
    [
        (co.Collocations(least=4, first=12), 1 << 28, 1 << 21),
        (co.Collocations(least=3, first=7, first_share=0.05, growth=3), 1 << 16, 500),
        (co.Collocations(longest=3, least=5, first=3, first_share=0.02, growth=2), 1 << 28, 1),
    ],
)
def test_phrases_equal_brute_force(spark, monkeypatch, spec, bits, pending):
    monkeypatch.setattr(shared, "SIEVE_BITS", bits)
    monkeypatch.setattr(co, "PENDING", pending)
    want = brute(texts(), spec)
    assert {r[0] for r in want} == {"en", "de", "und", ""} and max(r[1] for r in want) == spec.first
    assert mined(table(spark, texts()), spec) == want


def test_settled_languages_are_not_expanded(spark, monkeypatch):
    rng = random.Random(1)
    rare = [" ".join(f"r{i}{x}" for x in "abc") for i in range(30)]
    rows = [("en", " ".join([rng.choice(rare), "the", rng.choice(["of", "to"])] * 1)) for _ in range(600)]
    asked, real = [], co.grown
    monkeypatch.setattr(co, "grown", lambda docs, frontier, *more: asked.append(frontier.count()) or real(docs, frontier, *more))
    spec = co.Collocations(least=5, first=10, first_share=0.3, growth=8)
    assert mined(table(spark, rows), spec) == brute(rows, spec)
    assert sum(asked) < 93  # "the", "of" and "to" stay out


def test_no_texts(spark):
    assert mined(table(spark, texts()).limit(0), co.Collocations()) == []
    assert mined(table(spark, [("en", None), (None, "a b a b")]), co.Collocations()) == []


def test_scores_beyond_64_bits(spark):
    a, left, right, n = 7 * 10**12 + 1, 8 * 10**12 + 3, 10**13 + 7, 9 * 10**15 + 11
    phrases = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, f long")
    known = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert co.scored(phrases, known, totals).first().score == 1000 * a * n // (left * right)
    one = spark.createDataFrame([("en", "x", 3), ("en", "y", 7)], "lang string, phrase string, f long")
    few = spark.createDataFrame([("en", "x y", 3)], "lang string, phrase string, f long")
    for total in (6, 7, 13, 14, 10**15 + 1):
        totals = spark.createDataFrame([("en", total)], "lang string, n long")
        assert co.scored(few, one, totals).first().score == 1000 * 3 * total // 21
