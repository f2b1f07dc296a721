"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from kindred.llm import exact_dedup as E
from kindred.llm import super_minhash as M
from kindred.llm.components import components

SPACE = r"[\x20\x09-\x0D]"


def test_classes_of_odd_rows(odd):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, "", t)].append((-len(t), i is None, i or 0, i))
    expected = sorted((str(i), str(min(g)[3]), len(g), hashlib.sha256(b.encode()).hexdigest()) for b, g in groups.items() for *_, i in g)
    got = E.deduplicate(odd).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    kept = E.unique_documents(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_texts_that_differ_late_or_end_early(documents):
    base = "x" * 5000
    texts = [base, base + "a", base + "b", base[:64], base[:65], base[:63], base, base + "a", "x" * 512, "x" * 513, "x " * 512]
    got = {r["doc_id"]: r for r in E.deduplicate(documents(list(enumerate(texts)))).collect()}
    bare = [t.replace(" ", "") for t in texts]
    assert all(got[k]["group_size"] == bare.count(bare[k]) for k in range(len(texts)))
    assert got[8]["keep_id"] == 10 and got[6]["keep_id"] == 0


def test_empty_tables(documents):
    assert E.deduplicate(documents([])).count() == 0
    assert M.near_duplicates(documents([])).count() == 0


def sets_of(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute_components(rows, width):
    sets = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    return [(i, len(sets[k]), min((x for x in ids[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("width", [2, 5])
def test_groups_of_near_copies(documents, width):
    """Large groups of mixed distance, whose buckets are too large to compare all pairs, and small ones."""
    rng = random.Random(width)
    rows = []
    for group, (copies, shares) in enumerate([(60, (0.01, 0.03, 0.05, 0.07)), (50, (0.02, 0.1)), (4, (0.02,)), (3, (0.05,))]):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(90)]
        rows += [(None, " ".join(edited(rng, base, shares[k % len(shares)]))) for k in range(copies)]
    rows += [(None, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60)))) for _ in range(40)]
    rows = [(k * 3 + 1, t) for k, (_, t) in enumerate(rows)] + [(500, rows[0][1].upper()), (501, None), (502, " "), (503, "one"), (504, "ONE")]
    got = M.near_duplicates(documents(rows), width).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, width))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows_of_near_duplicates(odd):
    got = M.near_duplicates(odd, 2).collect()
    assert len(got) == 12 and {r["doc_id"]: r["n_shingles"] for r in got}[1] == 0
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r["component_id"])
    assert by_id[1] == [1] and by_id[2] == [2] and by_id[7] == [5] and by_id[None] == [None, None]
    kept = M.unlike_documents(odd, 2)
    # One of the two alike, one of the long ones, one without id; texts without words stay.
    assert kept.columns == odd.columns and kept.count() == 9


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 100, 100))
    m = 250
    found = [np.mean(M.signature(np.concatenate([shared, a]) + np.uint64(k), m) == M.signature(np.concatenate([shared, b]) + np.uint64(k), m)) for k in range(20)]
    assert abs(np.mean(found) - 400 / 600) < 0.02
    few = M.signature(np.array([7, 9], dtype=np.uint64), m)
    assert (few >> np.uint64(32)).max() >= m // 4 and len(set(few.tolist())) == m


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 140)}, 300: 300, 301: 300}
