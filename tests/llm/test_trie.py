"""The prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from kindred.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, conv int, turns string, n int, container int"
EXTRA = (1, "x", 2, 3)


def brute(rows):
    """Nodes of (conv_id, turn, role, text) by the contract's words."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(own, key=lambda x: x[:3])] for c, own in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in said}
    whole = {c: said.get(c - c % 20, [])[: h[c]] + own[h[c] :] for c, own in said.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(own) - 1) * words
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, own in members.items()
    )


def nodes(spark, rows, **options):
    table = spark.createDataFrame([r + EXTRA for r in rows], SCHEMA)
    found = T.trie(T.rebuilt(T.conversations(table)), **options).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in found)


def made_up(seed, convs, turns, texts):
    random.seed(seed)
    return [(c, t, random.choice(["user", "bot"]), " ".join(random.choices(texts, k=2))) for c in range(0, convs * 3, 3) for t in range(random.randint(1, turns))]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"conversations_each": 3}), (3, {"conversations_each": 1, "turns_each": 1}), (4, {"turns_each": 6})])
def test_nodes_as_brute_force(spark, seed, options):
    rows = made_up(seed, 120, 6, ["a", "b c"])
    assert nodes(spark, rows, **options) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (40, None, "user", "first as null"), (40, 1, None, "x"), (40, 2, "user", None), (40, 3, "", ""), (40, 3, "", ""), (41, 0, "user", "first as null"), (41, 1, "", "x"),
        (None, 0, "user", "no conversation"), (43, 5, "user", "own"), (47, 1, "a", "b c \U0001f600\tword"), (47, 1, "a", "b c \U0001f600\tword"), (60, 0, "u", ""), (61, 0, "u", "only"), (62, 0, "u", "only"),
        (3, 0, "1", "0:x"), (4, 0, "10", ":x"), (5, -1, "10", "x"),
    ]
    for options in ({}, {"conversations_each": 1}):
        assert nodes(spark, rows, **options) == brute(rows)
    assert nodes(spark, []) == []


def test_long_shared_beginnings_copies_and_one_very_long_conversation(spark):
    """A common beginning of 300 turns takes one burst; 9,000 equal conversations are one list of members."""
    same = [(c, t, "u", f"turn {t}") for c in range(0, 20 * 8, 20) for t in range(300)]
    same += [(c, 300, "u", f"end of {c // 40}") for c in range(0, 20 * 8, 20)]
    copies = [(20 * c, 0, "u", "hello there") for c in range(1000, 10_000)]
    long = [(7, t, "u", str(t)) for t in range(20_000)]
    rows = same + copies + long
    for options in ({}, {"conversations_each": 2, "turns_each": 50}):
        got = nodes(spark, rows, **options)
        assert got == brute_of_few(rows)


def brute_of_few(rows):
    """As brute, with the prefixes of the one long conversation told apart by number instead of by value."""
    long = [r for r in rows if r[0] == 7]
    h = zlib.crc32(b"7") % 4
    rest = brute([r for r in rows if r[0] != 7])
    own = [r[3] for r in sorted(long, key=lambda r: r[1])][h:]
    borrowed = [f"turn {t}" for t in range(h)]  # of conversation 0
    turns = borrowed + own
    out = []
    for conv, depth, parent, n, children, leaves, saved, ends in rest:
        if depth <= len(borrowed) and (depth == 0 or conv == 0):  # on its way
            more = sum(len(t.split()) for t in borrowed[max(depth - 1, 0) :])
            out.append((conv, depth, parent, n + 1, children + (depth == len(borrowed)), leaves + 1, saved + more, ends))
        else:
            out.append((conv, depth, parent, n, children, leaves, saved, ends))
    empty, last = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"7").hexdigest()
    for d in range(len(borrowed) + 1, len(turns) + 1):
        end = d == len(turns)
        out.append((7, d, 0 if d == len(borrowed) + 1 else 7, 1, 0 if end else 1, 1, 0, last if end else empty))
    return sorted(out)
