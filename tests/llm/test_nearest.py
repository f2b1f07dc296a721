"""Learned partitions against brute force."""

import numpy as np
import pytest

from kindred.llm import learned_partitions as L

SCHEMA = "vec_id long, embedding array<double>, id int, vector string, part int, score string"


def table(spark, vectors, ids=None):
    rows = [(int(k), None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2, "y") for k, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return L.usable(spark.createDataFrame(rows, SCHEMA))


def searched(spark, vectors, k=20, **options):
    rows = table(spark, vectors)
    found = {}
    for r in L.nearest(rows, rows.where("id % 20 = 0"), k, **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(own) for q, own in found.items()}


def brute(vectors, k=20):
    out = {}
    for q in range(0, len(vectors), 20):
        scores = [(-float((vectors[q] * v).sum()), i) for i, v in enumerate(vectors) if i != q]
        out[q] = [(rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def recall(got, want):
    hits = sum(len({x[1] for x in got.get(q, [])} & {x[1] for x in own}) for q, own in want.items())
    return hits / sum(map(len, want.values()))


def test_small_tables_are_searched_whole(spark):
    vectors = np.random.default_rng(1).standard_normal((90, 8))
    vectors[40:60] = vectors[40]  # ties
    assert searched(spark, vectors) == brute(vectors)
    assert searched(spark, vectors[:5]) == brute(vectors[:5])
    assert searched(spark, vectors[:1]) == {}


@pytest.mark.parametrize("spread", [0.3, 2.0])
def test_recall_and_parts_searched(spark, spread):
    """Few parts where vectors lie in clusters; as many as recall needs where they do not."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    vectors = centres[rng.integers(0, 40, 6000)] + spread * rng.standard_normal((6000, 16))
    vectors *= rng.uniform(0.8, 1.2, (6000, 1))
    want = brute(vectors)
    got = searched(spark, vectors)
    assert recall(got, want) >= 0.9 and all(len(own) == 20 for own in got.values())
    for q, own in got.items():
        assert [x[0] for x in own] == list(range(1, 21)) and all(np.isclose(x[2], vectors[q] @ vectors[x[1]], rtol=1e-12) for x in own)
        assert [(-x[2], x[1]) for x in own] == sorted((-x[2], x[1]) for x in own)
    router = L.fit(vectors, 6000 // L.PART_ROWS, 20)
    sizes = np.bincount(router.most_probable(vectors, 1)[:, 0], minlength=router.parts)
    assert router.parts == 32 and sizes.max() < 3 * sizes.mean()
    assert router.probes <= router.parts // 4 or spread > 1


def test_registered_recall(spark):
    from kindred.llm.texts import table as read

    for sf in ("sf0.01", "sf0.1"):
        rows = sorted(read(spark, f"/root/testdata/{sf}", "embeddings").select("vec_id", "embedding").collect())
        vectors = np.array([r["embedding"] for r in rows])
        got = {}
        for r in L.op13_learned_partitions(spark, f"/root/testdata/{sf}").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert set(got) == set(range(0, len(rows), 20)) and recall(got, brute(vectors)) >= 0.9


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [1.0, inf], [1.0, 2.0, 3.0], [1.0, 2.0], [2.0, 1.0], [-1e200, 1e-200], [3.0, 3.0]]
    rows = table(spark, vectors)
    assert sorted(r["id"] for r in rows.collect()) == [7, 8, 9, 10]
    assert [tuple(r) for r in L.nearest(rows, rows.where("id = 8"), 2).collect()] == [(8, 1, 10, 9.0), (8, 2, 7, 4.0)]
    twice = table(spark, [[1.0, 2.0], [1.0, 2.0], [0.0, 5.0], [4.0, 4.0]], [20, 20, 20, 3])
    assert sorted((r["id"], r["vector"]) for r in twice.collect()) == [(3, [4.0, 4.0]), (20, [0.0, 5.0])]
    none = table(spark, [])
    assert L.nearest(none, none).count() == 0


def test_a_third_of_all_vectors_alike(spark):
    """Equal scores tie by id across blocks, whatever part and block the copies lie in."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1500, 8))
    vectors[::3] = vectors[0] / np.linalg.norm(vectors[0]) * 9
    got, want = searched(spark, vectors), brute(vectors)
    hot = [q for q in want if q % 3 == 0]
    assert all([x[1] for x in got[q]] == [x[1] for x in want[q]] for q in hot) and recall(got, want) >= 0.9
