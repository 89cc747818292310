"""Operator 12 against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_texts import docs, rows  # noqa: F401  (fixtures)

from conftest import SMALL
from supplyplan.llm import queries, spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def words_of(texts, mistype=None, shortest=6, least=5):
    seen = Counter()
    for k, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if mistype and h % mistype == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= shortest and n >= least}


def edits(word, letters):
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def brute(words):
    letters, forms, out = set("".join(words)), {}, {}
    for w, n in words.items():
        near = sorted((-words[x], x) for x in edits(w, letters) if x in words)
        forms[w] = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = [len(near), words.get(forms[w])]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, words[w], *out[w])
    return out


def collected(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def vocabulary(seed, size):
    r = random.Random(seed)
    words = {}
    while len(words) < size:
        w = "".join(r.choice("abcdéÉ") for _ in range(r.randrange(6, 10)))
        words[w] = r.choice([5, 5, 6, 30, 200, 5000, 100_000])
        if r.random() < 0.5:
            words[r.choice(sorted(edits(w, "abcdé")))] = r.choice([5, 7, 25, 1000])
    return {w: n for w, n in words.items() if len(w) >= 6}


@pytest.mark.parametrize("classes, tile", [(4, 2048), (4, 7), (1, 50), (3, 1)])
def test_groups(spark, classes, tile):
    words = vocabulary(classes, 250 if tile < 50 else 900) | {"x" * 3000: 5, "x" * 2999 + "y": 50, "x" * 2999: 9}
    words |= {"marbling": 5, "marblin": 30, "marbli": 200, "harbli": 200, "marblo": 100_000}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = brute(words)
    assert sum(v[0] is not None and v[1] != v[0] for v in expected.values()) > 1  # chains of forms
    assert collected(spelling.spelling_groups(df, classes=classes, tile=tile)) == expected


def test_one_edit():
    r, pairs = random.Random(1), []
    for _ in range(4000):
        a = "".join(r.choice("abc") for _ in range(r.randrange(3, 8)))
        b = r.choice(sorted(edits(a, "abc"))) if r.random() < 0.7 else "".join(r.choice("abc") for _ in range(r.randrange(3, 8)))
        if r.random() < 0.3:
            b = r.choice(sorted(edits(b, "abc"))) or "a"
        pairs.append((a, b))
    got = spelling.one_edit(*spelling._codes([a for a, _ in pairs]), *spelling._codes([b for _, b in pairs]))
    assert got.tolist() == [b in edits(a, "abc") for a, b in pairs]
    assert 500 < got.sum() < 3500


def test_distances_are_those_of_the_counts():
    words = list(vocabulary(9, 300))
    i, j = spelling.near_pairs(words, words, True)
    assert {frozenset((words[a], words[b])) for a, b in zip(i, j)} == {
        frozenset((a, b)) for a in words for b in edits(a, set("".join(words))) if b in set(words)}


def test_word_counts(spark, docs, rows):
    texts = [*rows, rows[8], (None, "no id here")]
    for shortest, least, mistype in ((6, 5, None), (3, 1, 3), (6, 2, 199)):
        got = {r.word: r.n for r in spelling.word_counts(docs, shortest, least, mistype).collect()}
        assert got == words_of(texts, mistype, shortest, least)
    assert spelling.spelling_groups(spelling.word_counts(docs.limit(0))).count() == 0


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    expected = brute(words_of(texts, 199))
    got = collected(queries.op12_spelling_variants(spark, SMALL))
    assert got == expected and len(got) > 100
