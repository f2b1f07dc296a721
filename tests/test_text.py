from collections import Counter, defaultdict
from math import log2, sqrt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import words_of
from kindred.functions.words import is_number
from kindred.operators import content as C
from kindred.operators import text as X
from kindred.operators.features import WordWeights
from kindred.operators.keyword_index import KeywordIndex

TEXTS = [
    "Don't stop: élan vital, 5 of ½ x ÀÉ",
    "naïve\tcafé\t \t tab\n\nnew line \xa0 nbsp\xa0 in\xa0side\u3000 end\u2003\r\nlast\r",
    "a b c 12 345 6x x_y __ Ünïcödé 東京 tower 2024!",
    "",
    "   ",
]


def docs(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, text string")


def test_tokens_match_python(spark):
    frame = docs(spark, [(1, k, t) for k, t in enumerate(TEXTS)])
    got = defaultdict(list)
    for r in X.tokenize(frame).collect():
        got[r["item_id"]].append(r["word"])
    for k, text in enumerate(TEXTS):
        assert Counter(got[k]) == Counter(words_of(text))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("aB1é½_-'.,! \t\n\r\xa0\u3000\x1c\x85東"), max_size=40), min_size=1, max_size=20))
def test_tokens_match_python_for_any_text(spark, texts):
    got = Counter((r["item_id"], r["word"]) for r in X.tokenize(docs(spark, [(1, k, t) for k, t in enumerate(texts)])).collect())
    assert got == Counter((k, w) for k, t in enumerate(texts) for w in words_of(t))


def test_stopwords_and_digits(spark):
    frame = docs(spark, [(1, 1, "The cat7 and the dog")])
    stop = X.stopword_table(spark, ["the", "and"])
    assert sorted(r["word"] for r in X.tokenize(frame, stop).collect()) == ["cat7", "dog"]
    assert sorted(r["word"] for r in X.tokenize(frame, stop, remove_digits=True).collect()) == ["cat", "dog"]


def test_profiles_equal_brute_force(spark):
    rows = [
        (1, 1, "spice noodle broth noodle"), (2, 1, "broth salt"), (1, 2, "pizza oven salt crust"),
        (3, 3, "the 5 !"), (2, 2, "oven oven"), (4, 4, "noodle salt oven tea"),
    ]
    stop = {"the"}
    words = defaultdict(Counter)
    for _, item, text in rows:
        words[item].update(words_of(text, stop))
    df = Counter(w for c in words.values() for w in set(c))
    expected = {}
    for item, counts in words.items():
        total = sum(counts.values())
        scored = sorted((-round(n / total * log2(4 / df[w]), 9), w) for w, n in counts.items())[:3]
        expected[item] = [w for _, w in scored]
    profiles = X.item_profiles(docs(spark, rows), X.stopword_table(spark, stop), words=3)
    got = defaultdict(list)
    for r in sorted(profiles.collect(), key=lambda r: r["rank"]):
        got[r["item_id"]].append(r["word"])
    assert got == {k: v for k, v in expected.items() if v}
    assert 3 not in got  # nothing but stopwords, numbers and punctuation

    users = X.user_profiles(docs(spark, rows), profiles)
    mine = defaultdict(set)
    for u, item, _ in rows:
        mine[u] |= set(got.get(item, []))
    assert {(r["user_id"], r["word"]) for r in users.collect()} == {(u, w) for u in mine for w in mine[u]}

    pairs = spark.createDataFrame([(u, i) for u in range(1, 6) for i in range(1, 6)], "user_id bigint, item_id bigint")
    scores = {(r["user_id"], r["item_id"]): r["sim"] for r in C.content_scores(pairs, profiles, users).collect()}
    wanted = {
        (u, i): len(mine[u] & set(w)) / sqrt(len(mine[u]) * len(w))
        for u in mine for i, w in got.items() if mine[u] & set(w)
    }
    assert scores == pytest.approx({k: v for k, v in wanted.items() if v >= 0.01}, abs=1e-6)
    assert C.with_both_profiles(pairs, profiles, users).count() == len(got) * len([u for u in mine if mine[u]])


def test_rare_words(spark):
    counts = spark.createDataFrame([(1, "a", 96), (1, "b", 3), (2, "c", 1)], "item_id bigint, word string, n bigint")
    assert {r["word"] for r in X.rare_words(counts, 0.02).collect()} == {"c"}
    assert {r["word"] for r in X.without_rare(counts, 0.035).collect()} == {"a"}


def test_keyword_search_ranks_by_match(spark):
    profiles = spark.createDataFrame(
        [(1, "noodle"), (1, "broth"), (2, "noodle"), (3, "tea"), (3, "salt")], "item_id bigint, word string"
    )
    got = C.keyword_search("Noodle, BROTH!", profiles).collect()
    assert [(r["item_id"], r["n_matched"], r["score"]) for r in got] == [(1, 2, 1.0), (2, 1, 0.707107)]


@pytest.mark.parametrize("file_rows", [5_000_000, 4])
def test_a_keyword_index_finds_what_the_profiles_have(spark, tmp_path, file_rows):
    words = [(i, f"word{w}") for i in range(60) for w in range(40) if (i * w + i) % 5 == 0 or w == 3]
    profiles = spark.createDataFrame(words, "item_id bigint, word string")
    index = KeywordIndex.build(profiles, str(tmp_path / "index"), buckets=16, file_rows=file_rows)
    for query in ("word3, WORD7!", "word1 word2 word39 unknown", "nothing here", ""):
        expected = C.keyword_search(query, profiles, 12).collect()
        assert index.search(query, 12).collect() == expected
    assert index.postings.count() == len(words)


def test_a_search_reads_the_files_of_its_words(spark, tmp_path):
    profiles = spark.createDataFrame([(i, f"word{w}") for i in range(30) for w in range(200)], "item_id bigint, word string")
    index = KeywordIndex.build(profiles, str(tmp_path / "index"), buckets=64)
    files = index.postings.inputFiles()
    found = index.postings_of(["word5", "word77"])
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    scan = [x for x in [plan] if x][0].collectLeaves().apply(0)
    assert len(files) >= 60 and scan.metrics().apply("numFiles").value() <= 2 and found.count() == 60


def test_what_is_a_number(spark):
    rows = [("12", True), ("a1", False), ("z", False), ("1a", False), ("{", False), ("é1", False), ("٣", True), ("Ⅷ", True), ("", False), ("A", False)]
    df = spark.createDataFrame(rows, "word string, expected boolean")
    assert df.where(is_number(F.col("word")) != F.col("expected")).count() == 0


def test_rare_words_are_left_out_in_one_join(spark, monkeypatch):
    """Profiles without rare words equal those counted without them, and no table is joined with the rare words by item."""
    rows = [(1, 1, "aa aa bb cc"), (1, 2, "aa bb dd dd"), (2, 3, "cc ee bb")]
    reviews = spark.createDataFrame(rows, "user_id bigint, item_id bigint, text string")
    joined = []
    monkeypatch.setattr(X, "without_rare", lambda *a: joined.append(1))
    got = {(r["item_id"], r["word"]): r["tfidf"] for r in X.item_profiles(reviews, rare_share=0.15).collect()}
    log = log2
    expected = {(1, "aa"): 2 / 4 * log(3 / 2), (1, "bb"): 0.0, (1, "cc"): log(3 / 2) / 4, (2, "aa"): log(3 / 2) / 4, (2, "bb"): 0.0, (2, "dd"): 2 / 4 * log(3), (3, "cc"): log(3 / 2) / 2, (3, "bb"): 0.0}
    assert got == pytest.approx(expected, abs=1e-9) and not joined


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def repeated_reviews(spark):
    return spark.createDataFrame([(k % 3, k % 4, f"alpha beta word{k % 5} the 12") for k in range(24)], "user_id long, item_id long, text string")


def test_profiles_look_the_idf_up_in_a_hash_table(spark):
    items = X.item_profiles(repeated_reviews(spark), X.stopword_table(spark, ["the"]))
    assert "ShuffledHashJoin [word" in plan_of(items)
    assert {r["word"] for r in items.collect()} == {"alpha", "beta", *(f"word{k}" for k in range(5))}


def test_scores_look_the_users_words_up_in_a_hash_table(spark):
    reviews = repeated_reviews(spark)
    items = X.item_profiles(reviews)
    scores = C.content_scores(reviews.select("user_id", "item_id"), items, X.user_profiles(reviews, items))
    assert "ShuffledHashJoin [user_id" in plan_of(scores)


def test_tfidf_of_written_counts_equals_that_of_words(spark):
    words = spark.createDataFrame([(k % 3, ["alpha", f"w{k % 4}", "alpha"]) for k in range(12)], "item_id long, words array<string>")
    fitted = WordWeights.fit(words)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(fitted.tfidf(counts=fitted.known)) == rows(fitted.tfidf(words)) != []
