"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from kindred.llm import spelling_variants as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for a in counts:
        best = min(near[a], key=lambda b: (-counts[b], b), default=None)
        if best is not None and counts[best] >= 2 * counts[a]:
            form[a] = best

    def root(a):
        return root(form[a]) if a in form else a

    return {a: (form.get(a), root(a), n, len(near[a]), counts.get(form.get(a))) for a, n in counts.items()}


def grouped(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in S.group_variants(words, **options).collect()}


def made_up(seed, alphabet, lengths, size):
    random.seed(seed)
    words = {"".join(random.choices(alphabet, k=random.choice(lengths))) for _ in range(size)}
    for word in sorted(words)[: size // 2]:  # and their near words
        k = random.randrange(len(word))
        words |= {word[:k] + random.choice(alphabet) + word[k:], word[:k] + word[k + 1 :], word[:k] + random.choice(alphabet) + word[k + 1 :]}
    return {w: random.choice([3, 5, 9, 40, 200, 5000]) for w in words if len(w) >= 2}


@pytest.mark.parametrize(("seed", "alphabet", "lengths", "cells"), [(1, "abcé", [5, 6, 7], 1 << 18), (2, "ab", [5, 6, 9, 12], 64), (3, "xyz", [2, 3, 4, 5], 16), (4, "abÿ", [8, 30], 200)])
def test_groups_as_brute_force(spark, seed, alphabet, lengths, cells):
    """Small limits cut the lists again and again."""
    counts = made_up(seed, alphabet, lengths, 150)
    assert grouped(spark, counts, cells=cells) == brute(counts)


def test_one_beginning_for_all_and_very_long_words(spark):
    random.seed(5)
    long = "q" * 3000
    counts = {f"{long}{''.join(random.choices('ab', k=4))}{long}": 3 + k for k in range(40)} | {"a" * k: 3 * 4**k for k in range(5, 12)} | {long[:-1]: 8, long: 20}
    assert grouped(spark, counts, cells=20_000) == brute(counts)


def test_ways_of_many_steps_end_at_the_root(spark):
    """Each word is a form of the one before: steps double, and every word arrives."""
    counts = {"a" * 5 + "b" * k: 3 * 2**k for k in range(40)}
    got = grouped(spark, counts)
    assert all(got[w][1] == "a" * 5 + "b" * 39 for w in counts)


def test_vocabulary_as_brute_force(spark, odd, documents):
    def brute_words(rows):
        counts = Counter()
        for doc_id, text in rows:
            run = ""
            for c in (text or "") + " ":
                if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                    run += c.lower() if c.isascii() else c
                    continue
                if run:
                    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                    counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
        return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    texts = [(k, "Hello ÀÉÎ×÷ÿ hello,WORLD worldĀwords don't élanélan straße" * 3 + " variant" * (k % 7)) for k in range(300)]
    for docs in (odd, documents(texts), documents([])):
        want = brute_words([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
        assert {r["word"]: r["n"] for r in S.vocabulary(docs).collect()} == want
    assert "variant" in want or not want
    assert S.group_variants(S.vocabulary(documents([]))).count() == 0
