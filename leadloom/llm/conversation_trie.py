"""Prefix trie of conversations by van Emde Boas recursion over depths.

A conversation is a sequence of turns, and a node of the trie is a distinct prefix. The sequences are cut at half their
greatest depth: the first half, once named, is a leaf of the upper trie and the root of a lower trie of all second halves
that follow it, and both are built in the same way, all of a level at once. A prefix is thus named by the halves that
the recursion cuts before it (one for each bit of its depth that is set), so naming takes as many steps as a depth has
bits, not turns. The steps over the lowest ``leaf`` turns run on the arrays of a chunk; those above are joins of chunks
with the named halves beside them, which only conversations longer than a chunk take part in.

Totals come back the other way. Every node belongs to the conversation with its smallest id; a conversation's own nodes
are summed from its end upwards, the totals of second halves grafted on the first halves step by step, and a node's
total is the sum over its members of what they own below it.

Sequences are named by two 64-bit hashes. No text is shuffled: turns are hashed and measured where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.batches import ready
from leadloom.plans.storage import BROADCAST_IDS, materialise

#: Turns of a chunk, a power of two.
LEAF = 64
#: Ranks that share one copy of their conversation's row in a join.
_BLOCK = 4096
#: The name of the empty prefix.
ROOT = (0x243F6A8885A308D3, 0x13198A2E03707344)
NO_ENDS = hashlib.sha256(b"").hexdigest()

_MULTIPLIERS = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))


def _mix(a: np.ndarray, b: np.ndarray, lane: int, salt: int) -> np.ndarray:
    """Names of the sequence named ``a`` followed by that named ``b``."""
    x, y = (np.uint64(m) for m in _MULTIPLIERS[lane])
    h = (a ^ (a >> np.uint64(29))) * x + (b ^ (b >> np.uint64(32))) * y + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def halves(symbols: np.ndarray, lane: int) -> list[np.ndarray]:
    """Names of the halves that the recursion cuts, from single symbols up to the whole: level k has blocks of 2^k."""
    levels = [symbols]
    while levels[-1].shape[1] > 1:
        level = levels[-1]
        levels.append(_mix(level[:, 0::2], level[:, 1::2], lane, 1))
    return levels


def prefixes(context: np.ndarray, symbols: np.ndarray, lane: int) -> np.ndarray:
    """Names of the prefixes that end with each symbol, of rows whose sequences follow their ``context``.

    From the whole downwards every block hands its context to its first half, and to its second half the context
    followed by the name of the first.
    """
    levels = halves(symbols, lane)
    before = context[:, None]
    for level in levels[-2::-1]:
        after = np.empty((before.shape[0], before.shape[1] * 2), np.uint64)
        after[:, 0::2] = before
        after[:, 1::2] = _mix(before, level[:, 0::2], lane, 2)
        before = after
    return _mix(before, symbols, lane, 3)


def _matrix(lists: pa.ListArray, fields: tuple[str, ...], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Fields of lists of turns as matrices, padded with zeros to ``width``, and the lengths of the lists."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(size.size), size)
    place = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
    turns, out = lists.flatten(), []
    for name in fields:
        m = np.zeros((size.size, width), np.int64)
        m[row, place] = turns.field(name).to_numpy(zero_copy_only=False)
        out.append(m)
    return out, size


def _width(lists: pa.ListArray) -> int:
    """The power of two that the longest of these lists fits in."""
    most = pa.compute.max(lists.value_lengths()).as_py() or 1
    return 1 << (max(1, most) - 1).bit_length()


def _chunk_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, block, n1, n2): names of whole full chunks."""
    for batch in batches:
        lists = batch.column(2)
        if not batch.num_rows:
            continue
        (n1, n2), _ = _matrix(lists, ("n1", "n2"), _width(lists))
        names = [halves(n.view(np.uint64), lane)[-1][:, 0].view(np.int64) for lane, n in enumerate((n1, n2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, names)], names=["conv_id", "block", "n1", "n2"])


def _prefix_rows(leaf: int):
    """Rows of the prefixes that end in a chunk, of rows (conv_id, chunk, turns, c1, c2, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, chunk, c1, c2, total = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5))
            lists = batch.column(2)
            (n1, n2, size), many = _matrix(lists, ("n1", "n2", "bytes"), _width(lists))
            row = np.repeat(np.arange(many.size), many)
            place = np.arange(row.size) - np.repeat(np.cumsum(many) - many, many)
            columns = [conv[row], chunk[row] * leaf + place + 1]
            for lane, (context, n) in enumerate(((c1, n1), (c2, n2))):
                columns.append(prefixes(context.view(np.uint64), n.view(np.uint64), lane).view(np.int64)[row, place])
            columns += [size[row, place], total[row]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["conv_id", "depth", "n1", "n2", "bytes", "total"])

    return run


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n1, n2, ends): hashes of the comma-joined ids of rows (n1, n2, conv_id), sorted; ids are hashed as they come."""
    node, state = None, None

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["n1", "n2", "ends"])

    for batch in batches:
        n1, n2, conv = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not conv.size:
            continue
        begin = np.flatnonzero(np.concatenate(([True], (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])))).tolist()
        rows = []
        for a, b in zip(begin, [*begin[1:], conv.size], strict=True):
            joined = ",".join(map(str, conv[a:b].tolist())).encode()
            this = (int(n1[a]), int(n2[a]))
            if this == node:
                state.update(b"," + joined)
                continue
            if node:
                rows.append((*node, state.hexdigest()))
            node, state = this, hashlib.sha256(joined)
        yield told(rows)
    if node:
        yield told([(*node, state.hexdigest())])


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, n1, n2, bytes): turns in order, rank from 1, named by role and text.

    Turns are dealt by range of (conv_id, turn) and counted where they lie, so a conversation of any length is spread
    over tasks. A conversation that goes on from one range to the next counts on from what lies before.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    named = rows.select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("n1"), F.xxhash64(F.lit(1), "role", "text").alias("n2"), F.octet_length("text").cast("long").alias("bytes"), F.struct("role", "text").alias("said")
    )
    # Turns of one number are ordered by what is said; only those carry their texts.
    ties = materialise(named.groupBy("conv_id", "turn").count().filter("count > 1").select("conv_id", F.col("turn").alias("tied")), "tied-turns")
    if ties.limit(1).count():
        small = ties.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        right = ties.withColumnRenamed("conv_id", "tied_conv").withColumn("is_tied", F.lit(True))
        right = F.broadcast(right) if small else right
        named = named.join(right, (F.col("conv_id") == F.col("tied_conv")) & F.col("turn").eqNullSafe(F.col("tied")), "left")
        named = named.withColumn("said", F.when(F.col("is_tied"), F.col("said")))
    else:
        named = named.withColumn("said", F.lit(None).cast("struct<role:string,text:string>"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), F.col("said.role"), F.col("said.text"), "source"]
    # Turns that are alike in everything are dealt by where they were read.
    dealt = named.withColumn("source", F.spark_partition_id()).select("conv_id", "turn", "said", "source", "n1", "n2", "bytes")
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "n1", "n2", "bytes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy(zero_copy_only=False)
            if not conv.size:
                continue
            begin = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            size = np.diff(np.append(begin, conv.size))
            place = np.arange(1, conv.size + 1) - np.repeat(begin, size)
            if conv[0] == last:
                place[: size[0]] += done
            last, done = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(conv.size, part), pa.int32()), pa.array(place), *batch.columns[1:]], names=["conv_id", "part", "place", "n1", "n2", "bytes"])

    placed = materialise(dealt.mapInArrow(count, "conv_id long, part int, place long, n1 long, n2 long, bytes long"), "turn-places")
    held = placed.groupBy("conv_id", "part").agg(F.max("place").alias("held"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # One conversation at most goes on into a range, so there is at most one row for each.
    before = held.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before")
    rank = F.col("place") + F.coalesce("before", F.lit(0))
    return placed.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", rank.alias("rank"), "n1", "n2", "bytes")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of another: turns (conv_id, pos, n1, n2, bytes) and conversations (conv_id, total).

    With h = crc32 of the decimal id modulo ``most``, conversation c gets the first h turns of conversation
    c - c % ``every``, then its own turns after its first h.
    """
    lengths = materialise(turns.groupBy("conv_id").agg(F.max("rank").alias("own")), "conversation-lengths")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    convs = lengths.select("conv_id", "own", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("base_own", F.lit(0))))
    convs = materialise(convs.withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "rebuilt-conversations")
    # A long conversation's row has a copy for each block of its ranks, so no key of the join has more rows than that.
    blocks = convs.select("conv_id", "head", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {_BLOCK}"))).alias("block"))
    own = turns.withColumn("block", F.expr(f"rank div {_BLOCK}")).join(blocks, ["conv_id", "block"]).filter("rank > head")
    own = own.select("conv_id", (F.col("rank") - F.col("head") + F.col("taken")).alias("pos"), "n1", "n2", "bytes")
    heads = turns.filter(F.col("rank") < most).select(F.col("conv_id").alias("base"), F.col("rank").alias("pos"), "n1", "n2", "bytes")
    heads = heads.join(convs.filter("taken > 0").select("conv_id", "base", "head"), "base").filter("pos <= head")
    return own.unionByName(heads.select("conv_id", "pos", "n1", "n2", "bytes")), convs.select("conv_id", "total")


def _half(column: str, second: int) -> Column:
    return F.max(F.when(F.col("block") % 2 == second, F.col(column)))


def _with_contexts(chunks: DataFrame, many: int, leaf: int) -> DataFrame:
    """Chunks with (c1, c2), the name of all that lies before them in their conversation."""
    root = [F.lit(n).cast("long") for n in ROOT]
    if many == 1:
        return chunks.withColumns({"c1": root[0], "c2": root[1]})
    full = chunks.filter(F.size("turns") == leaf).select("conv_id", F.col("chunk").alias("block"), "turns")
    named = materialise(full.mapInArrow(_chunk_names, "conv_id long, block long, n1 long, n2 long"), "chunk-names")
    pair = [F.struct(_half("n1", 0), _half("n1", 1)).alias("a"), F.struct(_half("n2", 0), _half("n2", 1)).alias("b"), F.count("*").alias("k")]
    levels = [named]
    for _ in range((many - 1).bit_length() - 1):
        up = levels[-1].groupBy("conv_id", F.expr("block div 2").alias("block")).agg(*pair).filter("k = 2")
        levels.append(materialise(up.select("conv_id", "block", F.xxhash64("a").alias("n1"), F.xxhash64(F.lit(1), "b").alias("n2")), "half-names"))
    found = chunks.select("conv_id", "chunk").filter("chunk > 0").withColumns({"c1": root[0], "c2": root[1]})
    for k in reversed(range(len(levels))):
        # A second half follows the first one beside it.
        beside = levels[k].select("conv_id", (F.col("block") + 1).alias("beside"), "n1", "n2")
        found = found.withColumn("beside", F.when(F.expr(f"shiftright(chunk, {k}) % 2 = 1"), F.expr(f"shiftright(chunk, {k})")))
        found = found.join(beside, ["conv_id", "beside"], "left")
        found = found.select(
            "conv_id", "chunk", F.when(F.col("n1").isNotNull(), F.xxhash64("c1", "n1")).otherwise(F.col("c1")).alias("c1"), F.when(F.col("n2").isNotNull(), F.xxhash64("c2", F.lit(1), "n2")).otherwise(F.col("c2")).alias("c2")
        )
        if k % 3 == 0 and k:
            found = materialise(found, "contexts")
    first = chunks.filter("chunk = 0").withColumns({"c1": root[0], "c2": root[1]})
    return first.unionByName(chunks.filter("chunk > 0").join(found, ["conv_id", "chunk"]).select(*first.columns))


def _with_grafts(own: DataFrame, chunks: DataFrame, many: int) -> DataFrame:
    """Chunks (conv_id, chunk) with what their conversation owns in them, and the totals of what it owns behind them."""
    zero = F.lit(0).cast("long")
    totals = own.groupBy("conv_id", "chunk").agg(F.collect_list(F.struct("depth", "leaf", "saved")).alias("owned"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("tokens"))
    totals = materialise(totals, "owned")
    found = chunks.withColumns({"leaves_after": zero, "tokens_after": zero})
    level = totals.select("conv_id", F.col("chunk").alias("block"), "leaves", "tokens")
    for k in range((many - 1).bit_length()):
        # A first half gets the total of the second one beside it grafted on.
        beside = level.select("conv_id", (F.col("block") - 1).alias("beside"), "leaves", "tokens")
        found = found.withColumn("beside", F.when(F.expr(f"shiftright(chunk, {k}) % 2 = 0"), F.expr(f"shiftright(chunk, {k})")))
        found = found.join(beside, ["conv_id", "beside"], "left").select(
            "conv_id", "chunk", (F.col("leaves_after") + F.coalesce("leaves", zero)).alias("leaves_after"), (F.col("tokens_after") + F.coalesce("tokens", zero)).alias("tokens_after")
        )
        if k % 3 == 2:
            found = materialise(found, "grafts")
        level = materialise(level.groupBy("conv_id", F.expr("block div 2").alias("block")).agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens")), "half-totals")
    return found.join(totals.select("conv_id", "chunk", "owned"), ["conv_id", "chunk"], "left")


def prefix_trie(turns: DataFrame, convs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, total) with turns (conv_id, pos, n1, n2, bytes), pos from 1.

    A row a node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, bytes of a node's last turn times all
    its members but one), ends_sha256 (ids of the members that end there, ascending, comma-joined). ``leaf`` is the
    number of turns of a chunk, a power of two. Conversations without turns are members of the root alone; without
    conversations there is no node. ``conv_id`` of ``convs`` is distinct and not null.

    The hash of a node's members is a single sequence by its nature: they are sorted, and one task hashes them as they
    come, without holding them.
    """
    ready(turns.sparkSession)
    zero = F.lit(0).cast("long")
    chunks = turns.withColumn("chunk", F.expr(f"(pos - 1) div {leaf}")).groupBy("conv_id", "chunk")
    chunks = materialise(chunks.agg(F.sort_array(F.collect_list(F.struct("pos", "n1", "n2", "bytes"))).alias("turns")), "turn-chunks")
    many = (chunks.agg(F.max("chunk")).first()[0] or 0) + 1
    # Only the last chunk of a conversation ends it, so each chunk has its conversation's length beside it.
    blocks = convs.filter("total > 0").select("conv_id", "total", F.explode(F.sequence(zero, F.expr(f"(total - 1) div {leaf}"))).alias("chunk"))
    ready_chunks = _with_contexts(chunks, many, leaf).join(blocks, ["conv_id", "chunk"]).select("conv_id", "chunk", "turns", "c1", "c2", "total")
    rows = ready_chunks.mapInArrow(_prefix_rows(leaf), "conv_id long, depth long, n1 long, n2 long, bytes long, total long")
    rows = materialise(rows, "prefixes")
    root = convs.select("conv_id", zero.alias("depth"), *(F.lit(n).cast("long").alias(f"n{k}") for k, n in enumerate(ROOT, 1)), zero.alias("bytes"), "total")
    every = rows.unionByName(root)

    ends_here = F.col("depth") == F.col("total")
    nodes = every.groupBy("n1", "n2").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.count_if(ends_here).alias("n_ends")
    )
    # Of the smallest member's path: the node above is that member's prefix one shorter.
    nodes = materialise(nodes, "trie-nodes")
    above = every.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"))
    linked = nodes.filter("depth > 0").select("conv_id", "depth").join(above, ["conv_id", "depth"])
    linked = materialise(linked, "trie-parents")
    named = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    parents = linked.join(named, ["p1", "p2"]).select("conv_id", "depth", "parent_conv_id")

    own = nodes.select("conv_id", "depth", F.greatest(F.expr(f"(depth - 1) div {leaf}"), zero).alias("chunk"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    bare = convs.filter("total = 0").select("conv_id", zero.alias("chunk"))
    grafts = _with_grafts(own, blocks.select("conv_id", "chunk").unionByName(bare), many)
    below = lambda field: F.aggregate(F.filter(F.col("owned"), lambda x: x["depth"] >= F.col("depth")), zero, lambda s, x: s + x[field])
    sums = every.withColumn("chunk", F.greatest(F.expr(f"(depth - 1) div {leaf}"), zero)).join(grafts, ["conv_id", "chunk"])
    sums = sums.select("n1", "n2", (F.col("leaves_after") + F.coalesce(below("leaf"), zero)).alias("leaves"), (F.col("tokens_after") + F.coalesce(below("saved"), zero)).alias("tokens"))
    totals = sums.filter("leaves > 0 or tokens > 0").groupBy("n1", "n2").agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))

    ends = every.filter(ends_here).select("n1", "n2", "conv_id").repartition("n1", "n2").sortWithinPartitions("n1", "n2", "conv_id").mapInArrow(_end_hashes, "n1 long, n2 long, ends string")
    children = linked.groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    # What was found of each node meets in one shuffle.
    parts = nodes.select("n1", "n2", "conv_id", "depth", "n_convs")
    for more in (children, totals, ends):
        parts = parts.unionByName(more, allowMissingColumns=True)
    found = parts.groupBy("n1", "n2").agg(*(F.max(c).alias(c) for c in parts.columns[2:]))
    return found.join(parents, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("n_leaves", zero).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Prefix trie of all conversations, each rebuilt on the head of another (``rebuilt``).

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Rows without a conv_id belong to no
    conversation. Turns are ordered by number, null first, those of one number by role and text; repeated rows are turns
    of their own. A null role or text is empty. An empty table gives no node.
    """
    ready(conversations.sparkSession)
    turns, convs = rebuilt(ranked_turns(conversations))
    return prefix_trie(turns, convs, leaf)
