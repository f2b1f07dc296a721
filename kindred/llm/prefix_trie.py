"""The prefix trie of conversations, built as a burst trie.

A container holds the suffixes of all conversations below one node. All start in one container. A container of too many
conversations or turns bursts: the turns that all its suffixes begin with become trie heads, and the suffixes go on to one
container for each next turn id. The shared turns are found as the common prefix of the container's least and
greatest suffix, so a long shared beginning costs one round, not one a turn. Containers that remain are dealt to tasks,
sorted, and swept into nodes: adjacent suffixes share the nodes of their common prefix. Leaves and saved words of the heads are
then summed from their containers, last burst first.

Turns travel as 128-bit digests of role and text with their number of words, texts never move. Equal conversations
collapse to one with a count before the trie is built. Their member lists are hashed as streams: ids are joined to
pieces by tasks that each hold a range of them, and the pieces of one conversation are read in order, never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.texts import CRC_TABLE, WORD, crc32_sql, materialize, table, words

#: Different conversations and turns from which a container of more than one conversation bursts.
BURST_CONVERSATIONS = 1024
BURST_TURNS = 1 << 18
#: Conversations that borrow their beginning from one, and the most turns they borrow plus one.
SHARING = 20
BORROWED = 4
#: Decimal ids in a piece of a member list, rows of a batch, and places over which the marks of a burst container are spread.
PIECE_IDS = 4096
BATCH = 1 << 14
SALTS = 16

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, of binary"
NODE_NAMES = [c.split()[0] for c in NODE.split(", ")]


def digest(column: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the turns of each conversation in order, as (id, words).

    Turns are ordered by ``turn``, null first, then by role and digest; repeated rows are turns of their own. Null role
    or text count as empty, rows without conversation id take no part. The turns of one conversation are one
    row's array (24 bytes a turn).
    """
    said, content = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    known = F.struct(
        F.col(turn).alias("turn"), said.alias("role"), digest(F.concat(F.length(said).cast("string"), F.lit(":"), said, content).cast("binary")).alias("id"),
        F.size(words(content)).alias("words"),
    )
    kept = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), known.alias("known"))
    ordered = kept.groupBy("conv").agg(F.sort_array(F.collect_list("known")).alias("known"))
    return ordered.select("conv", F.transform("known", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the conversation it shares with; h is crc32 modulo 4."""
    base = F.col("conv") - F.col("conv") % SHARING
    heads = convs.where(F.col("conv") % SHARING == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, BORROWED - 1).alias("head"))
    own = convs.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED).cast("int"))
    joined = own.join(heads, base == F.col("base"), "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return joined.select("conv", F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sequence, conv), sorted, to pieces (sequence, first, n, ids): decimal ids joined by commas."""
    sequence, ids = None, []

    def piece() -> pa.RecordBatch:
        columns = [pa.array([sequence], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])]
        return pa.RecordBatch.from_arrays(columns, names=["sequence", "first", "n", "ids"])

    def gathered(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for one in pieces:
            waiting.append(one)
            if len(waiting) == 256:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting = []
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    def pieces() -> Iterator[pa.RecordBatch]:
        nonlocal sequence, ids
        for batch in batches:
            for found, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (found != sequence or len(ids) == PIECE_IDS):
                    yield piece()
                    ids = []
                sequence = found
                ids.append(conv)
        if ids:
            yield piece()

    yield from gathered(pieces())


def member_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by sequence and first id to (conv, n, sha256): smallest member, members, and the hash of their list."""
    sequence, conv, n, state = None, 0, 0, None
    out: list[tuple] = []

    def full(at_least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= at_least:
            columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "n", "sha256"])
            out.clear()

    for batch in batches:
        for found, first, count, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if state is None or found != sequence:
                if state is not None:
                    out.append((conv, n, state.hexdigest()))
                    yield from full(BATCH)
                sequence, conv, n, state = found, first, 0, hashlib.sha256()
            else:
                state.update(b",")
            n += count
            state.update(ids.encode())
    if state is not None:
        out.append((conv, n, state.hexdigest()))
    yield from full(1)


def classes(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different sequences (conv, n, turns) by their smallest member, and (conv, n, sha256) of their member lists."""
    sequence = digest(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "").cast("binary"))
    convs = materialize(convs.withColumn("sequence", sequence), "rebuilt")
    pieces = convs.select("sequence", "conv").repartitionByRange("sequence", "conv").sortWithinPartitions("sequence", "conv")
    pieces = pieces.mapInArrow(joined_ids, "sequence binary, first long, n long, ids string")
    dealt = pieces.repartition("sequence").sortWithinPartitions("sequence", "first")
    members = materialize(dealt.mapInArrow(member_lists, "conv long, n long, sha256 string"), "members")
    return materialize(convs.select("conv", "turns").join(members.select("conv", "n").hint("merge"), "conv"), "classes"), members


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` left-joined with one mark for each of some containers; a container's rows meet its mark in several places."""
    spread = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int"))
    return salted.join(spread.hint("merge"), ["container", "salt"], "left").drop("salt")


def burst(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads of burst containers, and what their suffixes go on in.

    ``rows`` are (container, parent, parent_conv, base, conv, n, turns) of containers that burst.
    """
    ends = rows.groupBy("container").agg(
        F.min("turns").alias("least"), F.max("turns").alias("greatest"), F.min("conv").alias("top"), F.sum("n").alias("members"),
        F.first("parent").alias("up"), F.first("parent_conv").alias("up_conv"), F.first("base").alias("from"),
    )
    other = F.array_position(F.zip_with("least", "greatest", lambda x, y: x["id"] == y["id"]), False)
    shared = F.when(other > 0, other - 1).otherwise(F.least(F.size("least"), F.size("greatest"))).cast("int")
    # The words of the turn that leads to each head, from the container's own node on; none lead to the root.
    leading = F.concat(F.array(F.lit(0)), F.transform(F.slice("least", F.lit(1), F.col("shared")), lambda t: t["words"]))
    heads = ends.withColumn("shared", shared).select(
        "container", "up", "up_conv", "from", "shared", "top", "members", F.slice(leading, F.col("from") + 1, F.col("shared") + 1).alias("words")
    )
    heads = materialize(heads, "heads")
    on = marked(rows, heads.select("container", "shared", "top"))
    ended = on.where(F.size("turns") == F.col("shared")).select(F.col("container").alias("in"), F.col("conv").alias("ends"))
    later = on.where(F.size("turns") > F.col("shared"))
    onward = later.select(
        digest(F.concat("container", F.element_at("turns", F.col("shared") + 1)["id"])).alias("container"), F.col("container").alias("parent"),
        F.col("top").alias("parent_conv"), (F.col("shared") + 1).alias("base"), "conv", "n", "turns",
    )
    heads = heads.join(ended.hint("merge"), F.col("container") == F.col("in"), "left").drop("in")
    return heads, materialize(onward, "containers")


def node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NODE_NAMES)


def chain(conv: int, base: int, parent_conv: int | None, n: int, words: np.ndarray, children: int, leaves: int, saved: int, ends: int | None, of: bytes | None) -> Iterator[pa.RecordBatch]:
    """The nodes from depth ``base`` down that hold the same conversations; ``children`` hang on the last of them."""
    size = len(words)
    kept = saved + (n - 1) * np.cumsum(words[::-1].astype(np.int64))[::-1]
    for low in range(0, size, BATCH):
        high = min(size, low + BATCH)
        k = high - low
        last = [high == size and i == k - 1 for i in range(k)]
        top = [low == 0 and i == 0 for i in range(k)]
        columns = [
            pa.array(np.full(k, conv)), pa.array(np.arange(base + low, base + high)), pa.array([parent_conv if t else conv for t in top], pa.int64()), pa.array(np.full(k, n)),
            pa.array([children if x else 1 for x in last], pa.int64()), pa.array(np.full(k, leaves)), pa.array(kept[low:high]),
            pa.array([ends if x else None for x in last], pa.int64()), pa.array([of if t else None for t in top], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=NODE_NAMES)


def swept(suffixes: list[tuple[int, int, list, list]], base: int, parent_conv: int | None, of: bytes | None) -> list[tuple]:
    """Nodes of a container's sorted suffixes (conv, members, ids, words); all share the first ``base`` turns."""
    rows: list[list] = []
    path: list[int] = []  # rows of the open nodes; the one at place i has depth base + i
    leading: list[int] = []

    def close(keep: int) -> None:
        while len(path) > keep:
            at, word = path.pop(), leading.pop()
            row = rows[at]
            row[5] = row[5] or 1  # a node without children is a leaf
            row[6] += (row[3] - 1) * word
            if path:
                up = rows[path[-1]]
                up[0] = min(up[0], row[0])
                up[3] += row[3]
                up[4] += 1
                up[5] += row[5]
                up[6] += row[6]
                row[2] = path[-1]  # the parent's place among the rows, until its smallest member is known

    before: list = []
    for conv, n, ids, words in suffixes:
        shared = base
        while shared < min(len(before), len(ids)) and before[shared] == ids[shared]:
            shared += 1
        if path:
            close(shared - base + 1)
        for depth in range(base + len(path), len(ids) + 1):
            path.append(len(rows))
            leading.append(words[depth - 1] if depth else 0)
            rows.append([conv, depth, None, 0, 0, 0, 0, None, None])
        end = rows[path[-1]]
        end[0] = min(end[0], conv)
        end[3] += n
        end[7] = conv
        before = ids
    close(0)
    done = [tuple(r[:2] + [parent_conv if r[2] is None else rows[r[2]][0]] + r[3:]) for r in rows]
    done[0] = done[0][:8] + (of,)
    return done


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole containers: rows (container, parent, parent_conv, base, conv, n, ids, words), sorted by container and ids."""
    key, head, waiting, out = None, (), [], []

    def finish() -> Iterator[pa.RecordBatch]:
        base, parent_conv, of = head
        if len(waiting) == 1:
            conv, n, ids, words = waiting[0]
            leading = np.array(([0] + words)[base:], np.int64)
            if len(leading) > BATCH:  # a conversation of its own needs no comparison, however long
                yield from chain(conv, base, parent_conv, n, leading, 0, 1, 0, conv, of)
                return
        out.extend(swept(waiting, base, parent_conv, of))
        if len(out) >= BATCH:
            yield node_batch(out)
            out.clear()

    for batch in batches:
        for container, parent, parent_conv, base, conv, n, ids, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if waiting and container != key:
                yield from finish()
                waiting = []
            key, head = container, (base, parent_conv, parent)
            waiting.append((conv, n, ids, words))
    if waiting:
        yield from finish()
    if out:
        yield node_batch(out)


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of heads: rows (up, up_conv, from, top, members, words, ends, children, leaves, saved)."""
    for batch in batches:
        for up, up_conv, base, top, members, words, ends, children, leaves, saved in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield from chain(top, base, up_conv, members, np.array(words, np.int64), children, leaves, saved, ends, up)


def tops(nodes: DataFrame) -> DataFrame:
    """Sums over the first nodes of containers, by the container they hang on."""
    return nodes.where("of is not null").groupBy("of").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def trie(convs: DataFrame, conversations_each: int = BURST_CONVERSATIONS, turns_each: int = BURST_TURNS) -> DataFrame:
    """One row per node of the prefix trie of (conv, turns): the contract's columns.

    A node is a distinct sequence of first turns, from the empty one on. ``conv_id`` is its smallest member, ``parent_conv_id``
    that of its parent (null for the root); ``saved_tokens`` sums (members - 1) * words of its turn over its subtree;
    ``ends_sha256`` hashes the ids of the members that end there, ascending and joined by commas. No conversations have
    no nodes, not even a root. Ids must not repeat.
    """
    sequences, members = classes(convs)
    root = digest(F.lit("").cast("binary"))
    active = sequences.select(
        root.alias("container"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("parent_conv"), F.lit(0).alias("base"), "conv", "n", "turns"
    )
    ready, rounds = None, []
    while True:
        load = active.groupBy("container").agg(F.count("*").alias("conversations"), F.sum(F.size("turns") - F.col("base")).alias("turns"))
        many = (F.col("conversations") > conversations_each) | ((F.col("conversations") > 1) & (F.col("turns") > turns_each))
        large = materialize(load.where(many).select("container", F.lit(True).alias("large")), "large-containers")
        if not large.head(1):
            ready = active if ready is None else ready.unionByName(active)
            break
        part = materialize(marked(active, large), "marked-containers")
        small = part.where("large is null").drop("large")
        ready = small if ready is None else ready.unionByName(small)
        heads, active = burst(part.where("large").drop("large"))
        rounds.append(heads)

    dealt = ready.select(
        "container", "parent", "parent_conv", "base", "conv", "n", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words")
    )
    dealt = dealt.repartition("container").sortWithinPartitions("container", "ids")
    nodes = materialize(dealt.mapInArrow(sweep, NODE), "nodes")
    below = materialize(tops(nodes), "container-sums") if rounds else None
    upper = None
    for heads in reversed(rounds):
        sums = below if upper is None else below.unionByName(tops(upper))
        sums = sums.groupBy("of").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
        joined = heads.join(sums.hint("merge"), F.col("container") == F.col("of"), "left")
        columns = ["up", "up_conv", "from", "top", "members", "words", "ends"]
        filled = joined.select(*columns, F.coalesce("children", F.lit(0)), F.coalesce("leaves", F.lit(1)), F.coalesce("saved", F.lit(0)))
        upper = materialize(filled.mapInArrow(chains, NODE), "head-nodes")
        nodes = nodes.unionByName(upper)

    known = NODE_NAMES[:7]
    lists = members.select(F.col("conv").alias("last"), F.col("sha256").alias("ends_sha256"))
    ended = nodes.where("ends is not null").join(lists.hint("merge"), F.col("ends") == F.col("last")).select(*known, "ends_sha256")
    none = nodes.where("ends is null").select(*known, F.sha2(F.lit("").cast("binary"), 256).alias("ends_sha256"))
    return ended.unionByName(none)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared beginnings."""
    return trie(rebuilt(conversations(table(spark, sf_dir, "conversations"))))


ORACLE = rf"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE} AS steps),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS seq FROM turns GROUP BY conv_id
), hashed AS (
  SELECT conv_id, seq, {crc32_sql("conv_id::VARCHAR", "steps")} % 4 AS h FROM convs, crc
), rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.seq, []), 1, c.h::BIGINT), list_slice(c.seq, c.h::BIGINT + 1, len(c.seq))) AS seq
  FROM hashed c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT list_slice(seq, 1, depth) AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(seq)), '') AS ids
  FROM prefixes GROUP BY ALL
), saving AS (
  SELECT *, list_slice(prefix, 1, depth - 1) AS up,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth].text, '{WORD}')) END AS saved
  FROM nodes
), children AS (
  SELECT up AS prefix, count(*) AS n_children FROM saving WHERE depth > 0 GROUP BY up
), counted AS (
  SELECT s.*, coalesce(n_children, 0) AS n_children FROM saving s LEFT JOIN children c ON c.prefix = s.prefix
), above AS (
  SELECT list_slice(prefix, 1, k) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, a.n_leaves, a.saved_tokens, sha256(c.ids) AS ends_sha256
FROM counted c JOIN above a ON a.prefix = c.prefix LEFT JOIN nodes p ON c.depth > 0 AND p.prefix = c.up
"""
