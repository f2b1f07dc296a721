"""The pipeline stage by stage against brute force on a small folder of tables."""

import random
import re
from collections import Counter

import pytest
from test_dedup import brute_components
from test_filters import brute_statistics

import corpus_pipeline as C


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    text = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    rows = [(k, text(rng.randrange(50, 300)), "en", f"s{k % 4}", 0) for k in range(150)]
    rows += [(200 + k, rows[k][1] + " ", "en", "s1", 0) for k in range(20)]  # exact copies
    rows += [(300 + k, rows[k][1] + " new", "en", "s2", 0) for k in range(20)]  # near copies
    rows += [(400 + k, text(20), "en", "s0", 0) for k in range(10)] + [(500, "same " * 100, "en", None, 0), (501, None, None, None, None), (None, text(80), "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def stage(spark, folder, name, docs):
    return dict(C.STAGES)[name](spark, docs, folder).collect()


def test_stages_in_order(spark, folder):
    docs = C.table(spark, folder, "documents")
    rows = docs.collect()
    frame = lambda found: spark.createDataFrame(found, docs.schema)
    as_set = lambda found: Counter(map(tuple, found))

    good = [r for r in rows if brute_statistics(r["text"])[0] >= 50 and brute_statistics(r["text"])[4] * 100 <= 50 * brute_statistics(r["text"])[0]]
    assert as_set(stage(spark, folder, "quality rules", docs)) == as_set(good)

    by_text = {}
    for r in sorted(good, key=lambda r: (-len(r["text"]), r["doc_id"] is None, r["doc_id"] or 0)):
        by_text.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), r)
    unique = list(by_text.values())
    assert as_set(stage(spark, folder, "exact dedup", frame(good))) == as_set(unique)

    component = {i: root for i, _, root in brute_components([(r["doc_id"], r["text"]) for r in unique], 5)}
    unlike = [r for r in unique if component[r["doc_id"]] == r["doc_id"]]
    assert as_set(stage(spark, folder, "MinHash near-dedup", frame(unique))) == as_set(unlike)

    mixed = stage(spark, folder, "mixing", frame(unlike))
    size = lambda found: sum(len(r["text"].split()) for r in found)
    times = as_set(mixed)
    assert set(times) <= as_set(unlike).keys() and max(times.values()) <= 2
    assert size(mixed) == pytest.approx(1.5 * size(unlike), rel=0.01)

    packed = stage(spark, folder, "best-fit packing", frame(mixed))
    assert sum(r["length"] for r in packed) == sum(n for n in [len(ids) + 1 for ids in C.packing.byte_bpe()([r["text"] for r in mixed])])
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)


def test_run_applies_all_stages(spark, folder):
    packed = C.run(spark, folder)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = packed.collect()
    ids = {r["doc_id"] for r in rows}
    assert ids and not ids & {*range(400, 410), 500, 501} and max(r["offset"] + r["length"] for r in rows) <= 1024
