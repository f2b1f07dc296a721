"""For each SQL-expressible query: SQL text over the given tables that must give the same rows."""

from __future__ import annotations

from kindred import defaults as D
from kindred.functions.hashing import MIX_RANGE, PRIME, coefficients, mix_sql
from kindred.functions.words import PUNCTUATION
from kindred.plans.catalog import LSH_PLAN, LSH_ROWS, RARE_SHARE, SEARCH_TEXT, STOPWORDS
from kindred.plans.tables import DOCUMENTS_PER_ITEM, DOCUMENTS_PER_USER, LEAST_ITEMS, LEAST_USERS

MIX = mix_sql("user_id", "item_id")
TEST_BOUND = int(D.TEST_SHARE * MIX_RANGE)
SEED_BOUND = int(D.SEED_SHARE * MIX_RANGE)


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


PURCHASES = """purchases AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS = PURCHASES + """,
ratings AS (SELECT user_id, item_id, avg(stars) AS rating FROM purchases GROUP BY user_id, item_id)"""
SPLIT = RATINGS + f""",
train AS (SELECT * FROM ratings WHERE {MIX} >= {TEST_BOUND}),
test AS (SELECT * FROM ratings WHERE {MIX} < {TEST_BOUND})"""
USERS = f"(SELECT {LEAST_USERS} + count(*) // {DOCUMENTS_PER_USER} FROM documents)"
ITEMS = f"(SELECT {LEAST_ITEMS} + count(*) // {DOCUMENTS_PER_ITEM} FROM documents)"
REVIEWS = f"""reviews AS (
  SELECT doc_id % {USERS} AS user_id, (doc_id * 7919) % {ITEMS} AS item_id,
         CAST(1 + (doc_id * 31) % 5 AS DOUBLE) AS stars, text
  FROM documents)"""
REVIEW_PAIRS = f"""review_pairs AS (
  SELECT DISTINCT doc_id % ({USERS} + 4) AS user_id, (doc_id * 104729) % ({ITEMS} + 3) AS item_id FROM documents)"""


def moments(source: str, key: str, member: str, name: str, min_support: int = D.MIN_CO_RATED) -> str:
    return f"""{name} AS (
  SELECT x.{member} AS a, y.{member} AS b, count(*) AS n, sum(x.rating) AS sx, sum(y.rating) AS sy,
         sum(x.rating * x.rating) AS sxx, sum(y.rating * y.rating) AS syy, sum(x.rating * y.rating) AS sxy
  FROM {source} x JOIN {source} y ON x.{key} = y.{key} AND x.{member} < y.{member}
  GROUP BY x.{member}, y.{member} HAVING count(*) >= {min_support})"""


def pearson(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT a, b, n, sim FROM (
    SELECT a, b, n, round(greatest(-1.0, least(1.0,
             (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)))), 6) AS sim
    FROM {source} WHERE n * sxx - sx * sx > 1e-9 * n * sxx AND n * syy - sy * sy > 1e-9 * n * syy)
  WHERE sim > 0)"""


def sizes(source: str, entity: str, name: str) -> str:
    return f"{name} AS (SELECT {entity} AS e, count(*) AS size FROM {source} GROUP BY {entity})"


def signatures(source: str, entity: str, member: str, name: str) -> str:
    values = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(coefficients()))
    return f"""hashes(k, ha, hb) AS (VALUES {values}),
{name} AS (
  SELECT {entity} AS e, CAST(k AS BIGINT) AS k,
         min((({member} % {PRIME}) * CAST(ha AS BIGINT) + hb) % {PRIME}) AS minhash
  FROM {source} CROSS JOIN hashes GROUP BY {entity}, k)"""


def banded(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT DISTINCT x.e AS a, y.e AS b FROM {source} x JOIN {source} y
  ON x.k = y.k AND x.minhash = y.minhash AND x.e < y.e)"""


def banded_pairs_of(source: str, name: str, rows: int) -> str:
    """Pairs that agree in all ``rows`` rows of a band."""
    return f"""{name}_bands AS (
  SELECT e, k // {rows} AS band, list(minhash ORDER BY k) AS bucket FROM {source} GROUP BY e, k // {rows}),
{name} AS (
  SELECT DISTINCT x.e AS a, y.e AS b FROM {name}_bands x JOIN {name}_bands y
  ON x.band = y.band AND x.bucket = y.bucket AND x.e < y.e)"""


def user_model(source: str, lsh: bool) -> str:
    """CTEs ending in ``user_model(a, b, sim)``."""
    parts = [
        moments(source, "item_id", "user_id", "user_moments"),
        pearson("user_moments", "user_sims"),
        sizes(source, "user_id", "user_sizes"),
    ]
    band = ""
    if lsh:
        parts += [signatures(source, "user_id", "item_id", "user_sigs"), banded("user_sigs", "user_candidates")]
        band = "JOIN user_candidates c ON c.a = s.a AND c.b = s.b"
    parts.append(f"""user_model AS (
  SELECT s.a, s.b, s.sim FROM user_sims s
  JOIN user_sizes p ON p.e = s.a JOIN user_sizes q ON q.e = s.b {band}
  WHERE s.n / (p.size + q.size - s.n) >= {D.MIN_JACCARD_USERS})""")
    return ",\n".join(parts)


def item_model(source: str) -> str:
    return moments(source, "user_id", "item_id", "item_moments") + ",\n" + pearson("item_moments", "item_model")


def jaccard(entity: str, member: str) -> str:
    """CTEs ending in ``exact(a, b, jaccard)``."""
    return ",\n".join([
        sizes("ratings", entity, "all_sizes"),
        f"""common AS (
  SELECT x.{entity} AS a, y.{entity} AS b, count(*) AS overlap
  FROM ratings x JOIN ratings y ON x.{member} = y.{member} AND x.{entity} < y.{entity} GROUP BY 1, 2)""",
        f"""exact AS (
  SELECT a, b, overlap / (p.size + q.size - overlap) AS jaccard
  FROM common JOIN all_sizes p ON p.e = a JOIN all_sizes q ON q.e = b
  WHERE overlap / (p.size + q.size - overlap) > {D.MIN_JACCARD_ITEMS})""",
    ])


JACCARD = jaccard("item_id", "user_id")


COST = """count(c.a) AS n_found, count(*) AS n_exact, round(count(c.a) / count(*), 6) AS recall,
  (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM candidates_bands GROUP BY band, bucket)) AS n_bucket_pairs,
  (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM ratings GROUP BY {member})) AS n_join_pairs"""
SAMPLED = "count(*) AS n_exact, round(count(c.a) / count(*), 6) AS true_recall, true AS inside"


def lsh_recall(entity: str, member: str, columns: str = COST) -> str:
    """Of the pairs above the threshold those that the planned bands find, with ``columns`` over both."""
    bands = f"planned AS (SELECT * FROM sigs WHERE k < {LSH_PLAN.rows * LSH_PLAN.bands})"
    return query(
        RATINGS, jaccard(entity, member), signatures("ratings", entity, member, "sigs"), bands, banded_pairs_of("planned", "candidates", LSH_PLAN.rows),
        select=f"SELECT {columns.format(member=member)} FROM exact e LEFT JOIN candidates c ON c.a = e.a AND c.b = e.b",
    )


ITEM_LSH = signatures("ratings", "item_id", "user_id", "item_sigs") + ",\n" + banded("item_sigs", "item_candidates")


def item_predictions(ratings: str, pairs: str) -> str:
    """CTEs ending in ``item_predictions(user_id, item_id, stars)``; needs ``item_model``."""
    return f"""both_ways AS (
  SELECT a AS item_id, b AS other, sim FROM item_model UNION ALL SELECT b, a, sim FROM item_model),
votes AS (
  SELECT p.user_id, p.item_id, m.other, m.sim, r.rating,
         row_number() OVER (PARTITION BY p.user_id, p.item_id ORDER BY m.sim DESC, m.other) AS rn
  FROM (SELECT DISTINCT user_id, item_id FROM {pairs}) p JOIN both_ways m ON m.item_id = p.item_id
  JOIN {ratings} r ON r.user_id = p.user_id AND r.item_id = m.other),
item_predictions AS (
  SELECT user_id, item_id, round(sum(sim * rating) / sum(sim), 6) AS stars
  FROM votes WHERE rn <= {D.ITEM_NEIGHBOURS} GROUP BY user_id, item_id)"""


USER_PREDICTIONS = f"""means AS (SELECT user_id, avg(rating) AS mean FROM train GROUP BY user_id),
neighbours AS (
  SELECT * FROM (
    SELECT user_id, other, sim, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) AS rn
    FROM (SELECT a AS user_id, b AS other, sim FROM user_model UNION ALL SELECT b, a, sim FROM user_model))
  WHERE rn <= {D.USER_NEIGHBOURS}),
user_predictions AS (
  SELECT t.user_id, t.item_id,
         round(any_value(mu.mean) + sum(n.sim * (r.rating - mo.mean)) / sum(n.sim), 6) AS stars
  FROM test t JOIN neighbours n ON n.user_id = t.user_id
  JOIN train r ON r.user_id = n.other AND r.item_id = t.item_id
  JOIN means mo ON mo.user_id = n.other JOIN means mu ON mu.user_id = t.user_id
  GROUP BY t.user_id, t.item_id)"""


def rmse(predictions: str) -> str:
    return f"""SELECT round(sqrt(avg((p.stars - t.rating) * (p.stars - t.rating))), 6) AS rmse, count(*) AS n_pairs
FROM {predictions} p JOIN test t ON t.user_id = p.user_id AND t.item_id = p.item_id"""


def text_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Every character that Unicode calls whitespace.
WHITESPACE = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
SPACES = " || ".join(f"chr({c})" for c in WHITESPACE)
STOP_LIST = ", ".join(text_literal(w) for w in STOPWORDS)


def token_rows(source: str, keep: str, name: str, stop: bool = True, text: str = "text") -> str:
    pattern = PUNCTUATION.replace("'", "''")
    dropped = f"AND word NOT IN ({STOP_LIST})" if stop else ""
    columns = f"{keep}, " if keep else ""
    return f"""{name} AS (
  SELECT {columns}word FROM (
    SELECT {columns}lower(trim(raw, {SPACES})) AS word FROM (
      SELECT {columns}unnest(string_split(replace(regexp_replace({text}, '{pattern}', '', 'g'), chr(10), ' '), ' ')) AS raw
      FROM {source}))
  WHERE length(word) >= 2 AND NOT regexp_matches(word, '^\\p{{N}}+$') {dropped})"""


TOKENS = REVIEWS + ",\n" + token_rows("reviews", "user_id, item_id", "tokens")
COUNTS = TOKENS + """,
counts AS (SELECT item_id, word, count(*) AS n FROM tokens GROUP BY item_id, word)"""
RARE = f"""rare AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY word
  HAVING sum(n) < CAST({RARE_SHARE} AS DOUBLE) * (SELECT sum(n) FROM counts)),
frequent AS (SELECT * FROM counts WHERE word NOT IN (SELECT word FROM rare))"""


def profiles(counts: str) -> str:
    return f"""idf AS (
  SELECT word, count(*) AS df, log2((SELECT count(DISTINCT item_id) FROM reviews) / count(*)) AS idf
  FROM {counts} GROUP BY word),
totals AS (SELECT item_id, sum(n) AS total FROM {counts} GROUP BY item_id),
profile AS (
  SELECT * FROM (
    SELECT item_id, word, tfidf, row_number() OVER (PARTITION BY item_id ORDER BY tfidf DESC, word) AS rank
    FROM (SELECT c.item_id, c.word, round(c.n / t.total * i.idf, 9) AS tfidf
          FROM {counts} c JOIN totals t ON t.item_id = c.item_id JOIN idf i ON i.word = c.word))
  WHERE rank <= {D.PROFILE_WORDS})"""


PROFILES = COUNTS + ",\n" + profiles("counts")
USER_WORDS = """user_words AS (
  SELECT DISTINCT r.user_id, p.word FROM reviews r JOIN profile p ON p.item_id = r.item_id)"""

TEXT_COUNTS = f"""{REVIEWS},
words AS (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM reviews),
counts AS (
  SELECT item_id, word, count(*) AS n FROM words WHERE word NOT IN ({STOP_LIST}) GROUP BY item_id, word)"""

CONTENT = f"""liked AS (SELECT DISTINCT user_id, item_id FROM reviews WHERE stars >= {D.LIKED_FROM}),
seeds AS (
  SELECT user_id, item_id FROM (
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {MIX}, item_id) AS rn
    FROM liked WHERE {MIX} < {SEED_BOUND}) WHERE rn <= {D.MAX_SEEDS}),
vectors AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (
  SELECT * FROM (
    SELECT seed_id, item_id, score, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, item_id) AS rank
    FROM (SELECT x.item_id AS seed_id, y.item_id, round(list_cosine_similarity(x.v, y.v), 6) AS score
          FROM vectors x JOIN vectors y ON x.item_id <> y.item_id))
  WHERE rank <= {D.SIMILAR_PER_SEED}),
content AS (
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT s.user_id, n.item_id, max(n.score) AS score
        FROM seeds s JOIN near n ON n.seed_id = s.item_id
        WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.user_id = s.user_id AND r.item_id = n.item_id)
        GROUP BY s.user_id, n.item_id))"""


def average(key: str) -> str:
    return query(
        RATINGS,
        select=f"SELECT {key}, round(avg(rating), 6) AS average_stars, count(*) AS n_ratings FROM ratings GROUP BY {key}",
    )


def basket(key: str, member: str) -> str:
    return query(
        RATINGS,
        "sizes AS (SELECT %s AS k, count(*) AS n_members FROM ratings GROUP BY 1)" % key,
        select=f"""SELECT r.{key}, n_members, {mix_sql(f"r.{member}", "0")} % CAST(ceil(n_members / 1000) AS BIGINT) AS chunk,
       array_to_string(list_sort(list(r.{member})), ',') AS members
FROM ratings r JOIN sizes ON k = r.{key} GROUP BY 1, 2, 3""",
    )


def oracle_sql() -> dict[str, str]:
    item_predict = query(
        SPLIT, item_model("train"), item_predictions("train", "test"),
        select="SELECT * FROM item_predictions",
    )
    user_ctes = (SPLIT, user_model("train", lsh=True), USER_PREDICTIONS)
    item_pearson = query(RATINGS, item_model("ratings"), select="SELECT a AS b1, b AS b2, sim FROM item_model")
    liked = query(PURCHASES, select=f"SELECT DISTINCT user_id, item_id FROM purchases WHERE stars >= {D.LIKED_FROM}")
    reviewed = (REVIEWS, CONTENT)
    keyword_search = query(
        PROFILES,
        f"asked_text AS (SELECT {text_literal(SEARCH_TEXT)} AS text)",
        token_rows("asked_text", "", "asked_words", stop=False),
        "asked AS (SELECT DISTINCT word FROM asked_words)",
        "ni AS (SELECT item_id, count(*) AS n FROM profile GROUP BY item_id)",
        select="""SELECT p.item_id, count(*) AS n_matched,
           round(count(*) / sqrt(CAST(any_value(ni.n) * (SELECT count(*) FROM asked) AS DOUBLE)), 6) AS score
FROM profile p JOIN asked a ON a.word = p.word JOIN ni ON ni.item_id = p.item_id
GROUP BY p.item_id ORDER BY score DESC, p.item_id LIMIT 10""",
    )
    return {
        "ratings_utility": query(RATINGS, select="SELECT user_id, item_id, round(rating, 6) AS rating FROM ratings"),
        "user_avg": average("user_id"),
        "item_avg": average("item_id"),
        "global_avg": query(RATINGS, select="SELECT round(avg(rating), 6) AS average_stars FROM ratings"),
        "rating_counts": query(
            RATINGS,
            select="""SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users,
       count(DISTINCT item_id) AS n_items FROM ratings""",
        ),
        "baskets_user": basket("user_id", "item_id"),
        "baskets_item": basket("item_id", "user_id"),
        "users_with_average": query(
            RATINGS,
            select="""SELECT user_id, c_name AS name, round(avg(rating), 6) AS average_stars, count(*) AS n_ratings
FROM ratings JOIN customer ON c_custkey = user_id GROUP BY user_id, c_name""",
        ),
        "liked_items": liked,
        "liked_items_sql": liked,
        "seed_sample": query(
            PURCHASES,
            f"liked AS (SELECT DISTINCT user_id, item_id FROM purchases WHERE stars >= {D.LIKED_FROM})",
            select=f"""SELECT user_id, item_id FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {MIX}, item_id) AS rn
  FROM liked WHERE {MIX} < {SEED_BOUND}) WHERE rn <= {D.MAX_SEEDS}""",
        ),
        "holdout_split": query(
            SPLIT,
            select="""SELECT user_id, item_id, 'train' AS part FROM train
UNION ALL SELECT user_id, item_id, 'test' FROM test""",
        ),
        "dense_ids": query(
            RATINGS,
            "u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_index FROM (SELECT DISTINCT user_id FROM ratings))",
            "i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_index FROM (SELECT DISTINCT item_id FROM ratings))",
            select="""SELECT r.user_id, r.item_id, user_index, item_index
FROM ratings r JOIN u ON u.user_id = r.user_id JOIN i ON i.item_id = r.item_id""",
        ),
        "co_rating_pairs": query(
            RATINGS, moments("ratings", "user_id", "item_id", "m"), select="SELECT a, b, n FROM m"
        ),
        "item_pearson": item_pearson,
        "user_pearson": query(
            RATINGS, user_model("ratings", lsh=False), select="SELECT a AS u1, b AS u2, sim FROM user_model"
        ),
        "minhash_signatures": query(
            RATINGS, signatures("ratings", "user_id", "item_id", "sigs"),
            select="SELECT e AS user_id, k, minhash FROM sigs",
        ),
        "lsh_buckets": query(
            RATINGS, signatures("ratings", "user_id", "item_id", "sigs"),
            select="SELECT k AS band, minhash AS bucket, count(*) AS n FROM sigs GROUP BY 1, 2 HAVING count(*) > 1",
        ),
        "lsh_candidates": query(
            RATINGS, signatures("ratings", "user_id", "item_id", "sigs"), banded_pairs_of("sigs", "candidates", LSH_ROWS),
            select="SELECT a, b FROM candidates",
        ),
        "lsh_user_pearson_search": query(
            RATINGS, user_model("ratings", lsh=False), select="SELECT a AS u1, b AS u2, sim FROM user_model"
        ),
        "lsh_recall": lsh_recall("item_id", "user_id"),
        "lsh_user_recall": lsh_recall("user_id", "item_id"),
        "lsh_sampled_recall": lsh_recall("item_id", "user_id", SAMPLED),
        "lsh_co_raters": query(
            RATINGS, signatures("ratings", "user_id", "item_id", "sigs"), banded("sigs", "candidates"),
            moments("ratings", "item_id", "user_id", "m"),
            select="SELECT c.a, c.b FROM candidates c JOIN m ON m.a = c.a AND m.b = c.b",
        ),
        "lsh_verified_jaccard": query(
            RATINGS, JACCARD, ITEM_LSH,
            select="""SELECT e.a AS b1, e.b AS b2, round(e.jaccard, 6) AS sim
FROM exact e JOIN item_candidates c ON c.a = e.a AND c.b = e.b""",
        ),
        "lsh_user_pearson": query(
            RATINGS, user_model("ratings", lsh=True), select="SELECT a AS u1, b AS u2, sim FROM user_model"
        ),
        "lsh_confirmed_recall": query(
            RATINGS, JACCARD, ITEM_LSH,
            select="""SELECT count(c.a) AS n_found, count(*) AS n_exact, round(count(c.a) / count(*), 6) AS recall
FROM exact e LEFT JOIN item_candidates c ON c.a = e.a AND c.b = e.b""",
        ),
        "item_predict": item_predict,
        "item_predict_from_file": item_predict,
        "als_reload_agrees": query(
            SPLIT,
            select="""SELECT count(*) AS n_pairs, count(*) AS n_agree FROM test
WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""",
        ),
        "als_recommend_agrees": query(
            RATINGS,
            f"asked AS (SELECT count(DISTINCT user_id) AS users, least({D.TOP}, count(DISTINCT item_id)) AS k FROM ratings)",
            select="SELECT users AS n_users, CAST(users * k AS BIGINT) AS n_rows, users AS n_agree FROM asked",
        ),
        "als_details_agree": query(
            RATINGS,
            f"asked AS (SELECT min(user_id) AS user_id, least({D.TOP}, count(DISTINCT item_id)) AS k FROM ratings)",
            select="SELECT user_id, k AS n_rows, k AS n_items, true AS best_first, k AS n_named FROM asked",
        ),
        "als_cv_agrees": query(
            SPLIT,
            select="""SELECT 4 AS n_points, 4 AS n_different, 1 AS n_best, true AS best_is_kept, count(*) AS n_predicted FROM test
WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""",
        ),
        "text_vectors_agree": query(
            TEXT_COUNTS,
            select="SELECT count(DISTINCT item_id) AS n_items, count(DISTINCT item_id) AS n_agree, count(DISTINCT word) + 20 AS n_features FROM counts",
        ),
        "hybrid_als_agrees": query(
            *reviewed,
            "per_user AS (SELECT user_id, count(*) AS n FROM content GROUP BY user_id)",
            "known AS (SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM reviews)",
            select=f"""SELECT 'content' AS source, count(*) AS n_users, CAST(sum(least(n, {D.CONTENT_MAX})) AS BIGINT) AS n_rows, count(*) AS n_ordered FROM per_user
UNION ALL SELECT 'collaborative', users, CAST(users * least(items, {D.COLLABORATIVE_MAX}) AS BIGINT), users FROM known""",
        ),
        "vector_index_recall": f"SELECT CAST(sum(least({D.SIMILAR_PER_SEED}, n - 1)) AS BIGINT) AS n_exact, true AS reached FROM (SELECT count(*) OVER () AS n FROM embeddings)",
        "text_tfidf": query(
            TEXT_COUNTS,
            "found AS (SELECT word, count(*) AS df FROM counts GROUP BY word)",
            select="""SELECT c.item_id, c.word,
       round(n * ln((1.0 + (SELECT count(DISTINCT item_id) FROM counts)) / (1.0 + df)), 6) AS tfidf
FROM counts c JOIN found f ON f.word = c.word""",
        ),
        "user_predict": query(*user_ctes, select="SELECT * FROM user_predictions"),
        "item_predict_rmse": query(
            SPLIT, item_model("train"), item_predictions("train", "test"), select=rmse("item_predictions")
        ),
        "user_predict_rmse": query(*user_ctes, select=rmse("user_predictions")),
        "friends_avg": query(
            SPLIT,
            """friends AS (
  SELECT DISTINCT c_custkey AS user_id, f AS friend_id
  FROM (SELECT c_custkey, unnest([c_custkey + 1, c_custkey + 7, c_custkey // 2]) AS f FROM customer)
  WHERE f <> c_custkey AND f IN (SELECT c_custkey FROM customer))""",
            select="""SELECT t.user_id, t.item_id, round(avg(r.rating), 6) AS stars, count(*) AS n_friends
FROM test t JOIN friends f ON f.user_id = t.user_id
JOIN train r ON r.user_id = f.friend_id AND r.item_id = t.item_id GROUP BY t.user_id, t.item_id""",
        ),
        "term_counts_without_digits": query(
            REVIEWS,
            token_rows("reviews", "item_id", "tokens", text=r"regexp_replace(text, '\p{Nd}', '', 'g')"),
            select="SELECT item_id, word, count(*) AS n FROM tokens GROUP BY item_id, word",
        ),
        "tokens": query(TOKENS, select="SELECT user_id, item_id, word FROM tokens"),
        "term_freq": query(
            COUNTS,
            "totals AS (SELECT item_id, sum(n) AS total FROM counts GROUP BY item_id)",
            select="""SELECT c.item_id, word, n, round(n / total, 9) AS tf
FROM counts c JOIN totals t ON t.item_id = c.item_id""",
        ),
        "doc_freq_idf": query(PROFILES, select="SELECT word, df, round(idf, 9) AS idf FROM idf"),
        "rare_words": query(COUNTS, RARE, select="SELECT word, n FROM rare"),
        "item_profile_top200": query(PROFILES, select="SELECT item_id, word, tfidf, rank FROM profile"),
        "item_profile_frequent": query(
            COUNTS, RARE, profiles("frequent"), select="SELECT item_id, word, tfidf, rank FROM profile"
        ),
        "user_profile": query(PROFILES, USER_WORDS, select="SELECT user_id, word FROM user_words"),
        "vocab_index": query(
            PROFILES,
            select="""SELECT word, row_number() OVER (ORDER BY word) - 1 AS index
FROM (SELECT DISTINCT word FROM profile)""",
        ),
        "content_scores": query(
            PROFILES, USER_WORDS, REVIEW_PAIRS,
            "ni AS (SELECT item_id, count(*) AS n FROM profile GROUP BY item_id)",
            "nu AS (SELECT user_id, count(*) AS n FROM user_words GROUP BY user_id)",
            """scored AS (
  SELECT q.user_id, q.item_id, count(*) / sqrt(CAST(any_value(ni.n) * any_value(nu.n) AS DOUBLE)) AS sim
  FROM review_pairs q JOIN profile p ON p.item_id = q.item_id
  JOIN user_words w ON w.user_id = q.user_id AND w.word = p.word
  JOIN ni ON ni.item_id = q.item_id JOIN nu ON nu.user_id = q.user_id GROUP BY q.user_id, q.item_id)""",
            select=f"SELECT user_id, item_id, round(sim, 6) AS sim FROM scored WHERE sim >= {D.MIN_COSINE}",
        ),
        "keyword_search": keyword_search,
        "keyword_index_search": keyword_search,
        "vector_cosine_topn": query(*reviewed, select="SELECT seed_id, item_id, score, rank FROM near"),
        "content_recommend": query(*reviewed, select="SELECT user_id, item_id, score, rank FROM content"),
        "item_details": query(
            *reviewed,
            select="""SELECT user_id, item_id, score, rank, p_name AS name, p_brand AS brand, p_type AS category,
       p_retailprice AS price FROM content JOIN part ON p_partkey = item_id""",
        ),
        "hybrid_union": query(
            *reviewed, REVIEW_PAIRS,
            "ratings AS (SELECT user_id, item_id, avg(stars) AS rating FROM reviews GROUP BY user_id, item_id)",
            """unseen AS (
  SELECT * FROM review_pairs p WHERE NOT EXISTS (
    SELECT 1 FROM ratings r WHERE r.user_id = p.user_id AND r.item_id = p.item_id))""",
            item_model("ratings"), item_predictions("ratings", "unseen"),
            select=f"""SELECT user_id, item_id, score, rank, 'content' AS source FROM content
WHERE rank <= {D.CONTENT_MAX}
UNION ALL
SELECT user_id, item_id, stars, rank, 'collaborative' FROM (
  SELECT user_id, item_id, stars, row_number() OVER (PARTITION BY user_id ORDER BY stars DESC, item_id) AS rank
  FROM item_predictions) WHERE rank <= {D.COLLABORATIVE_MAX}""",
        ),
        "reviews_json": query(
            REVIEWS,
            select="""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, stars, text
FROM reviews""",
        ),
        "average_map_file": query(
            RATINGS,
            select="""SELECT CAST(item_id AS VARCHAR) AS item_id, round(avg(rating), 6) AS average_stars
FROM ratings GROUP BY item_id""",
        ),
        "similarity_model_file": query(
            RATINGS, item_model("ratings"),
            select="SELECT CAST(a AS VARCHAR) AS b1, CAST(b AS VARCHAR) AS b2, sim FROM item_model",
        ),
        "predictions_file": query(
            SPLIT, item_model("train"), item_predictions("train", "test"),
            select="""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, stars
FROM item_predictions""",
        ),
        "profile_file": query(
            PROFILES, select="SELECT CAST(item_id AS VARCHAR) AS item_id, word FROM profile"
        ),
        "profiles_parquet": query(PROFILES, USER_WORDS, select="SELECT user_id, word FROM user_words"),
    }
