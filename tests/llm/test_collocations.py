"""Operator 12 against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import collocations as C


def plain(docs, threshold=10, longest=3, covered=50, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        rows = []
        for p, a in found.items():
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            rows += [] if inside else [(-score, -a, " ".join(p).encode(), l, r)]
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(spark, docs, schema="text string, lang string", **options):
    return sorted(tuple(r) for r in C.collocations(spark.createDataFrame(docs, schema), **options).collect())


def made(rng, n):
    vocabulary = ["alpha", "Beta", "the", "of", "new", "YORK", "city", "Ünder", "naïve", "x y", "a\x1cb", "ÀÉ"]
    weights = np.array([3, 3, 9, 9, 2, 2, 2, 1, 1, 1, 1, 1]) / 35
    join = lambda ws: "".join(w + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", ": "], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])) for w in ws)
    return [(join(rng.choice(vocabulary, int(rng.integers(1, 60)), p=weights)) + ("New York City. " * int(rng.integers(0, 3))), [None, "en", "de", "und"][int(rng.integers(0, 4))]) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"top": 7}, {"longest": 4, "threshold": 12, "covered": 80}, {"slice_bytes": 60, "held": 50, "bits": 17}])
def test_against_plain_counts(spark, options):
    docs = made(np.random.default_rng(1), 150) + [(None, "en"), ("", None), (" \t\n", "zz"), ("fish and chips " * 300, "en"), ("one two. " * 400, "de"), ("a" * 3000 + " " + "b" * 5000, "en")]
    assert got(spark, docs, **options) == plain(docs, **{k: v for k, v in options.items() if k in ("top", "longest", "threshold", "covered")})


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == []
    docs = [("a b " * 20, "en", 1, "x")]
    rows = [tuple(r) for r in C.collocations(spark.createDataFrame(docs, "text string, lang string, n long, phrase string")).collect()]
    assert sorted(rows) == plain([d[:2] for d in docs])


def test_a_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(2)
    for threshold in (5, 20):
        true = np.concatenate([rng.integers(1, threshold, 4000), rng.integers(threshold, 3 * threshold, 50)])
        h = rng.permutation(len(true)).astype("u8")
        mass = int(true.sum())
        summary = C.Summary(mass // threshold + 1)
        capacity = summary.capacity
        for _ in range(3):
            # Counts come in pieces, in any order.
            order = rng.permutation(len(h))
            for part in np.array_split(order, 7):
                summary.add(h[part], np.maximum(true[part] // 3, 0))
                summary.settle()
        rest = true - 3 * (true // 3)
        summary.add(h[rest > 0], rest[rest > 0])
        summary.settle()
        assert len(summary.h) <= capacity and summary.lost * (capacity + 1) <= mass and summary.lost < threshold
        assert set(h[true >= threshold].tolist()) <= set(summary.possible(threshold).tolist()) <= set(summary.h.tolist())
        least = dict(zip(summary.h.tolist(), summary.c.tolist()))
        assert all(t - summary.lost <= least.get(x, 0) <= t for x, t in zip(h.tolist(), true.tolist()) if x in least)


def test_many_distinct_words_are_renumbered():
    n = 3_000_000
    ids = np.concatenate([np.arange(1, n), [5, 6, 7]])
    (_, one, c1), (_, two, c2), (size, own, count) = C.counted_phrases(ids, n, 3)
    assert size == 3 and own.shape[1] == 3 and len(one) == n - 1 and c1.max() == c2.max() == count.max() == 2
    assert own[count == 2].tolist() == [[5, 6, 7]] and len(own) == n - 1
