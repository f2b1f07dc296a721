import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kindred.llm import packing as P


def test_both_libraries_give_the_same_ids():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    exact, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.byte_bpe()
    points = [c for c in [*range(1, 0x3000), *range(0x3000, 0x110000, 211)] if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b {chr(c)} 's" for c in points] + ["", "a  b\n\n c <|endoftext|> d", "x" * 3000]
    expected = [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]
    assert [e.tolist() for e in encode(texts)] == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(256, 1 + rng.exponential((20, 90, 300)[seed - 1], 3000).astype(int))
    counts = np.bincount(lengths, minlength=257)
    runs, sequences = P.plan(counts)
    ranks, taken = defaultdict(set), defaultdict(set)
    for n, rank, count, first, offset in zip(*[runs[c] for c in ("length", "rank", "count", "sequence", "offset")], strict=True):
        for k in range(count):
            assert rank + k not in ranks[n]
            ranks[n].add(rank + k)
            place = set(range(offset, offset + n))
            assert not place & taken[first + k] and offset + n <= 256
            taken[first + k] |= place
    assert {n: len(r) for n, r in ranks.items()} == {n: int(c) for n, c in enumerate(counts) if c}
    assert len(taken) == sequences <= -(-lengths.sum() // 256) * 1.03 + 2
    assert all(place == set(range(len(place))) for place in taken.values())


def test_pieces_and_sequences(odd):
    packed = P.pack(P.pieces(odd, keep_ids=True))
    rows = packed.collect()
    encode = P.byte_bpe()
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    expected = []
    for i, t in texts:
        ids = np.append(encode([t])[0], np.uint32(2)).astype("<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        expected += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    for r in P.sequences(packed).collect():
        whole = b"".join(ids for _, ids in sorted(by_sequence[r["sequence_id"]]))
        assert np.array(r["ids"], dtype="<u4").tobytes() == whole and len(r["ids"]) <= 1024


def test_no_documents(documents):
    assert P.pack(P.pieces(documents([]))).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_long_white_space_is_packed(spark, documents, blank):
    """tiktoken overflows its stack on a million blanks; such texts take the other way and keep all others."""
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a short text", blank * 2_000_000, "before " + blank * 1_000_000 + " after", None]
    got = P.pack(P.pieces(documents(list(enumerate(texts))), keep_ids=True)).groupBy("doc_id").sum("length").collect()
    want = {k: len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["sum(length)"] for r in got} == want


def test_a_panic_of_the_fast_encoder_is_survived(monkeypatch):
    import tiktoken

    class Panic(BaseException):
        pass

    def fails(self, text):
        raise Panic(text)

    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", fails)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert P.byte_bpe.__wrapped__()(["some text"])[0].tolist() == exact.encode("some text", add_special_tokens=False).ids
