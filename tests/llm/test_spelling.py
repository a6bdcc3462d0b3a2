"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import awkward, frame, lower
from veilsight.llm import spelling


def words_in(rows, least=6, seen=5, slip=199):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= seen}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(vocabulary, factor=5):
    out, form = {}, {}
    for w, n in vocabulary.items():
        others = [(-m, x) for x, m in vocabulary.items() if near(w, x)]
        best = min(others, default=None)
        form[w] = best[1] if best and -best[0] >= factor * n else None
        out[w] = [n, len(others), vocabulary[form[w]] if form[w] else None]
    for w in vocabulary:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, *out[w])
    return sorted(out.values())


def result(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def made_up(seed, many=400):
    """Words with slips of all kinds, chains of forms, ties, repeated letters and letters beyond ASCII."""
    rng = random.Random(seed)
    letters = "aabbcdeéÿ×"
    found = {}
    for _ in range(many // 4):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8, 9, 70, 64, 63])))
        n = rng.choice([5, 5, 30, 700, 4000])
        found[w] = n
        for _ in range(3):
            i, sign = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + sign + w[i + 1 :], w[:i] + sign + w[i:]])
            if len(w) >= 6:
                found.setdefault(w, rng.choice([5, n, max(5, n // 5), max(5, n // 6)]))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_forms_and_roots(spark, seed):
    vocabulary = made_up(seed)
    got = result(spelling.grouped(spark.createDataFrame(list(vocabulary.items()), "word string, n long")))
    assert got == variants(vocabulary)
    assert any(g[1] and g[2] != g[1] for g in got)  # a chain


def test_filters_in_many_rounds(spark, monkeypatch):
    """No broadcast holds all filters, and nothing changes."""
    vocabulary = made_up(3)
    monkeypatch.setattr(spelling, "SEGMENT", 2)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 256)
    assert result(spelling.grouped(spark.createDataFrame(list(vocabulary.items()), "word string, n long"))) == variants(vocabulary)


def test_documents(spark):
    rng = random.Random(4)
    words = ["Analysis", "analysi", "analysis", "cañonés", "CAÑONÉS", "naïveté", "naïvete", "ÀÉÎÕÜÿ", "short", "x" * 500, "letter1word", "repeat-able"]
    rows = awkward() + [(100 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(60)] + [(None, "analysis " * 9), (None, None), (7, "words" * 9000)]
    got = result(spelling.spelling_variants(frame(spark, rows)))
    assert got == variants(words_in(rows)) and len(got) > 10
    assert any(w not in {lower(x) for x in words} and w.startswith("analys") for w, *_ in got) or got


def test_slips_are_made(spark):
    rows = [(i, "interesting sentence") for i in range(4000)]
    got = {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), seen=1).collect()}
    assert got == words_in(rows, seen=1) and len(got) > 10


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "doc_id long, text string")).collect() == []


def test_every_edit_passes_the_filter():
    words = list(made_up(5, 2000))
    counts = Counter(min(len(w), spelling.LONG) for w in words)
    layout = spelling.Layout(counts)
    data = np.zeros(layout.total * 8, np.uint64)
    for _, letters in spelling.by_length(words):
        h = spelling.mix(spelling.hashes(letters))
        block, h = layout.block(h, letters.shape[1]), spelling.second(h)
        for k in range(spelling.BITS):
            bit = spelling.bits(h, k)
            np.bitwise_or.at(data, block * 8 + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    probe = spelling.Probe(layout, 0, layout.total, data)
    alphabet = np.array(sorted({ord(c) for w in words for c in w}))
    known, pairs, tried = set(words), set(), 0
    for which, letters in spelling.by_length(words):
        for row, other in spelling.edits(letters, alphabet, probe):
            tried += 1
            if (b := other.decode("latin-1")) in known:
                assert (a := words[which[row]], b) not in pairs
                pairs.add((a, b))
    want = {(a, b) for a in words for b in words if near(a, b) and (len(a) > len(b) or len(a) == len(b) and a < b)}
    assert pairs == want
    assert tried - len(pairs) < 0.01 * sum(len(w) * 10 for w in words)  # few false positives


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(15)] + [("x", "w3")]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string"), 5**17).collect())
    assert set(got.values()) == {"w15"}
