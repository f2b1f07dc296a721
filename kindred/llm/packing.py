"""Packing of documents into sequences of bounded length by patterns of few lengths.

Documents become token ids plus an end, and only longer ones are cut. The pieces' lengths make a histogram of at
most ``max_length`` bars, whatever the size of the corpus. The driver enumerates the patterns of up to three lengths
that fill a sequence exactly, fits how often each is used to the histogram by non-negative least squares, rounds,
and packs what is left by best fit, longest first. The result is a list of runs: the pieces with ranks a to b among
those of one length go to the sequences s, s + 1, ... at one offset.

Tokens are counted once, where the texts are, and written as one narrow row a piece. A piece's rank among its
length is its rank within the task that wrote it plus the pieces of that length in earlier tasks, so that a length
which a third of all pieces share is never sorted or gathered in one place. Runs are shipped to the tasks; there
are at most about max_length ** 2 / 4 + max_length of them, a bound that does not depend on the corpus.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.texts import materialize, table

MAX_LENGTH = 1024
END = 2
#: Steps of the accelerated projected gradient; the fit no longer improves the packing beyond.
STEPS = 300
#: White space in a row from which a text goes to the slower encoder: the faster one's stack overflows on a million.
LONG_BLANK = 50_000
#: Texts encoded at a time within a task.
CHUNK = 256
#: Ranks within a length stay below 2^40.
RANK_BITS = 40


@lru_cache(maxsize=1)
def byte_bpe(vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> Callable[[list[str]], list[np.ndarray]]:
    """An encoder of texts to ids of a byte-level BPE, without special tokens added.

    ``ranks`` holds the vocabulary of the tokenizers file ``vocabulary`` for the library tiktoken, which gives the
    same ids five times as fast (tests compare them over all code points). Texts that spell a special token,
    which ``tokenizers`` turns into its id, that hold a long run of white space, or that tiktoken fails on go to
    ``tokenizers`` itself, which is loaded when one comes. A worker keeps one encoder for all its tasks.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    exact = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(public_tokenizers.path(vocabulary)))
    with open(public_tokenizers.path(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(text: str) -> list[int]:
        blank = max((m.end() - m.start() for m in re.finditer(r"\s+", text)), default=0) if len(text) > LONG_BLANK else 0
        if blank <= LONG_BLANK and not any(s in text for s in special):
            try:
                return fast.encode_ordinary(text)
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # a panic of the library is no Exception
                pass
        return exact().encode(text, add_special_tokens=False).ids

    return lambda texts: [np.asarray(ids(text), dtype="<u4") for text in texts]


def pieces(
    docs: DataFrame, max_length: int = MAX_LENGTH, doc_id: str = "doc_id", text: str = "text", end: int = END, keep_ids: bool = False,
    encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]] = byte_bpe,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, place (rank of the piece among its length in its part), ids if asked.

    A null text counts as empty and gives the end alone. A document of more than ``max_length`` ids is cut into
    pieces of that many, the first of which takes the rest and may be shorter.
    """
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.LongType()),
            T.StructField("place", T.LongType()), *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        part = TaskContext.get().partitionId()
        seen = np.zeros(max_length + 1, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(low, CHUNK)
                texts = rows.column(1).to_pylist()
                owner, number, start, length, crc, place, kept = [], [], [], [], [], [], []
                for row, ids in enumerate(encode([t or "" for t in texts])):
                    ids = np.append(ids, np.uint32(end))
                    first = len(ids) % max_length or max_length
                    for k, a in enumerate([0, *range(first, len(ids), max_length)]):
                        own = ids[a : first if a == 0 else a + max_length].tobytes()
                        n = len(own) // 4
                        owner.append(row), number.append(k), start.append(a), length.append(n)
                        crc.append(zlib.crc32(own)), place.append(int(seen[n]))
                        seen[n] += 1
                        if keep_ids:
                            kept.append(own)
                columns = [
                    rows.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(owner), pa.int64()),
                    pa.array(place, pa.int64()), *([pa.array(kept, pa.binary())] if keep_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def fit_patterns(counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of three lengths, 0 for none) that fill a sequence, and their fitted repeat counts.

    ``counts[n]`` pieces have the length n. Minimises sum of w_n (uses of n - counts[n])^2 over repeat counts of at
    least 0, with w_n in proportion to n: long pieces left over cost more, as short ones fill gaps anyway.
    """
    full = len(counts) - 1
    have = np.flatnonzero(counts)
    present = np.zeros(full + 1, dtype=bool)
    present[have] = True
    found = [np.array([[full, 0, 0]])] if present[full] else []
    for a in have[(have < full) & (have * 3 >= full)]:  # the longest of the pattern
        b = have[(have <= a) & (have <= full - a)]
        c = full - a - b
        fits = (c <= b) & ((c == 0) | present[c])
        found.append(np.column_stack([np.full(fits.sum(), a), b[fits], c[fits]]))
    patterns = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    if not len(patterns):
        return patterns, np.zeros(0)
    weight = np.maximum(np.arange(full + 1) / full, 0.1)
    weight[0] = 0.0
    goal = counts.astype(float)

    def uses(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, k], weights=x, minlength=full + 1) for k in range(3))

    def gradient(x: np.ndarray) -> np.ndarray:
        rest = weight * (uses(x) - goal)
        return rest[patterns].sum(axis=1)

    probe = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = (weight * uses(probe))[patterns].sum(axis=1)
        largest = np.linalg.norm(probe)
        probe /= largest
    step = 1 / (1.05 * largest)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(y - step * gradient(y), 0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return patterns, x


def plan(counts: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """Runs that place every piece, and the number of sequences: the fewest that any of three ways to round gives."""
    patterns, fitted = fit_patterns(counts)
    return min((place_all(counts, patterns, fitted, np.floor(fitted + up).astype(np.int64)) for up in (0.5, 0.25, 0.0)), key=lambda found: found[1])


def place_all(counts: np.ndarray, patterns: np.ndarray, fitted: np.ndarray, repeats: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """Uses the patterns as often as ``repeats`` says and pieces allow, those fitted highest first, then best fit.

    A run says that the pieces of ``length`` with ranks from ``rank`` on, ``count`` of them, go to the sequences
    from ``sequence`` on, one each, at ``offset``.
    """
    full = len(counts) - 1
    left = counts.astype(np.int64).copy()
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), count, sequence, offset))
        used[length] += count
        left[length] -= count

    for k in np.argsort(-fitted, kind="stable"):
        if not repeats[k]:
            break
        lengths = [int(n) for n in patterns[k] if n]
        times = min(int(repeats[k]), *(int(left[n]) // lengths.count(n) for n in lengths))
        if times > 0:
            offset = 0
            for n in lengths:
                place(n, times, sequences, offset)
                offset += n
            sequences += times
    # Best fit, longest first, on what rounding left: sequences with the same room are handled together.
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # sorted keys of room
    for n in range(full, 0, -1):
        while left[n]:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                first, many = sequences, -(-int(left[n]) // (full // n))
                sequences += many
                space = full
            else:
                space = rooms[k]
                first, many = heapq.heappop(room[space])
                if not room[space]:
                    del room[space], rooms[k]
            taken = min(many, int(left[n]))
            place(n, taken, first, full - space)
            for at, size, start in ((space - n, taken, first), (space, many - taken, first + taken)):
                if at and size:
                    if at not in room:
                        room[at] = []
                        bisect.insort(rooms, at)
                    heapq.heappush(room[at], (start, size))
    names = ("length", "rank", "count", "sequence", "offset")
    columns = dict(zip(names, np.array(sorted(runs), dtype=np.int64).reshape(-1, 5).T, strict=True))
    return columns, sequences


def pack(cut: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Adds sequence_id and offset to rows of ``pieces``.

    Sequences are gapless from offset 0, hold at most ``max_length`` ids, and are as few as the patterns allow.
    Repeated documents are packed each for itself; no rows give no rows.
    """
    spark = cut.sparkSession
    cut = materialize(cut, "pieces")
    by_part = cut.groupBy("part", "length").count()
    counts = np.zeros(max_length + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():  # max_length rows at most
        counts[row["length"]] = row["count"]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select(
        F.col("part").alias("p"), F.col("length").alias("n"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")
    )
    ranked = cut.join(before, (F.col("part") == F.col("p")) & (F.col("length") == F.col("n"))).drop("p", "n")
    runs = spark.sparkContext.broadcast(plan(counts)[0])
    kept = [f for f in cut.schema.fields if f.name not in ("part", "place")]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_of = runs.value
        keys = (plan_of["length"] << RANK_BITS) | plan_of["rank"]
        for batch in batches:
            length, place, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place", "before"))
            rank = place + before
            run = np.searchsorted(keys, (length << RANK_BITS) | rank, side="right") - 1
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(plan_of["sequence"][run] + rank - plan_of["rank"][run]), pa.array(plan_of["offset"][run])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(locate, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array), doc_ids and offsets of packed pieces that kept their ids; a group holds one sequence."""
    width = 8
    by_place = F.sort_array(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("hex"))))
    grouped = packed.groupBy("sequence_id").agg(by_place.alias("part"))
    digits = F.concat_ws("", F.transform("part", lambda p: p["hex"]))
    return grouped.select("sequence_id", F.transform("part", lambda p: p["doc_id"]).alias("doc_ids"),
        F.transform("part", lambda p: p["offset"]).alias("offsets"), digits.alias("hex"),
    ).select(
        "sequence_id", "doc_ids", "offsets",
        F.transform(
            F.sequence(F.lit(0), (F.length("hex") / width).cast("int") - 1),
            lambda i: F.conv(
                F.concat(*[F.substring("hex", i * width + 2 * b + 1, F.lit(2)) for b in (3, 2, 1, 0)]), 16, 10
            ).cast("long"),
        ).alias("ids"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    packed = pack(pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
