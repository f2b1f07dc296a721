"""Plain Python answers for small inputs."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import combinations


def random_ratings(seed: int, users: int, items: int, per_user: int, hot_user: bool = True):
    """Ratings without duplicates; with ``hot_user`` user 0 has rated every item."""
    draw = random.Random(seed)
    rows = {}
    for u in range(1, users):
        for i in draw.sample(range(items), min(per_user, items)):
            rows[u, i] = float(draw.randint(1, 5))
    if hot_user:
        for i in range(items):
            rows[0, i] = float(draw.randint(1, 5))
    return [(u, i, r) for (u, i), r in rows.items()]


def by(rows, key: int, member: int):
    groups = defaultdict(dict)
    for row in rows:
        groups[row[key]][row[member]] = row[2]
    return groups


def pearson_pairs(rows, key: int, member: int, min_support: int):
    """{(a, b): (n, sim or None)} for members compared over the keys they share."""
    vectors = by(rows, member, key)
    found = {}
    for a, b in combinations(sorted(vectors), 2):
        shared = sorted(set(vectors[a]) & set(vectors[b]))
        if len(shared) < min_support:
            continue
        x, y = [vectors[a][k] for k in shared], [vectors[b][k] for k in shared]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        dx, dy = [v - mx for v in x], [v - my for v in y]
        spread = math.sqrt(sum(v * v for v in dx)) * math.sqrt(sum(v * v for v in dy))
        sim = None if spread < 1e-9 else sum(p * q for p, q in zip(dx, dy)) / spread
        found[a, b] = (len(shared), sim)
    return found


def positive(pairs):
    return {k: round(s, 6) for k, (_, s) in pairs.items() if s is not None and round(s, 6) > 0}


def jaccard_pairs(rows, key: int, member: int, threshold: float):
    sets = {m: set(v) for m, v in by(rows, member, key).items()}
    found = {}
    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        score = common / (len(sets[a]) + len(sets[b]) - common)
        if score > threshold:
            found[a, b] = (common, score)
    return found


def words_of(text: str, stopwords=(), min_length: int = 2):
    """The kept tokens of a text, by Python's own idea of letters, numbers and whitespace."""
    cleaned = "".join(c for c in text if c.isalnum() or c == "_" or c.isspace())
    tokens = [t.strip().lower() for t in cleaned.replace("\n", " ").split(" ")]
    return [t for t in tokens if len(t) >= min_length and not t.isnumeric() and t not in stopwords]
