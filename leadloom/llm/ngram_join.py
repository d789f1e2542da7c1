"""N-gram Jaccard join: links between documents whose sets of word n-grams are alike, and their components.

Candidates: if two sets differ in at most d elements and the space of hashes is cut into more than d segments, at least
one segment holds the same elements in both. Sets are classed by size so that linked sets lie in the same class or in
neighbours; each document emits a hash of each of its segments for the scheme of its own class and of the class below,
and documents that share one stay. No link is lost, and most documents go. Of those that stay the elements are counted, and
each set's rarest elements, as many as linked sets must share one of, make the candidates: a document that shares a
common passage but has much of its own has none. Candidates form clusters; each cluster is joined by prefix trees.

Prefix tree: the sets of a block, their elements in one order for all of them (most frequent first), are stored in a trie
whose branches hold runs of elements. A query walks the branches level by level; the overlap of a shared prefix is
computed once for all sets below it, and runs of subtrees whose remaining length cannot reach the required overlap, or
that hold no set that is still looked for, are not read. Large clusters are dealt to chunks; members of chunks that are
not linked yet then meet those with whom they share one of the rarest elements, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.batches import Memo, ready, slices, texts_of
from leadloom.plans.components import connected_components
from leadloom.plans.storage import join_ids, materialise

#: Sets of one chunk of a cluster; a block holds two chunks at most.
CHUNK = 600
#: Members of a large cluster that each of its chunks gets besides its own.
HUBS = 8
#: Frequency from which elements count as equally common.
COMMON = 1000

_ODD = np.random.default_rng(7).integers(1, 1 << 62, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleSets:
    """Sorted distinct 64-bit hashes of the n-grams of texts. Words are lower-cased A-Z only."""

    def __init__(self, n: int):
        import xxhash

        self.n = n
        self.memo = Memo(lambda new: [xxhash.xxh64_intdigest(w) for w in new], most=40_000_000)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        words = [t.encode("utf-8", "replace").lower().split() for t in texts]
        self.memo.learn(set().union(*words))
        size = [len(w) for w in words]
        h = np.fromiter((self.memo[w] for ws in words for w in ws), np.uint64, sum(size))
        grams = np.zeros(max(0, h.size - self.n + 1), np.uint64)
        for k in range(self.n):
            grams += h[k : k + grams.size] * _ODD[k]
        grams = _mix(grams)
        out, at = [], 0
        for m in size:
            if m >= self.n:
                out.append(np.unique(grams[at : at + m - self.n + 1]))
            elif m:
                short = (h[at : at + m] * _ODD[:m]).sum(keepdims=True) + np.array([m], np.uint64) * _ODD[60]
                out.append(_mix(short))
            else:
                out.append(h[:0])
            at += m
        return out


class SegmentSchemes:
    """Segment hashes of sets, for links at ``percent`` of Jaccard similarity."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [1]  # largest size of each class
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // percent))

    def class_of(self, size: int) -> int:
        return int(np.searchsorted(self.tops, size))

    def segments(self, scheme: int) -> tuple[int, int]:
        """Segments of a scheme, and how many of them a set may leave empty before empty ones count."""
        differ = self.tops[scheme] * (100 - self.percent) // self.percent
        spare = 1 + (differ + 1) // 20 if differ else 0
        return differ + 1 + spare, spare

    def hashes(self, s: np.ndarray) -> np.ndarray:
        """Hashes for the set's own class and the one below. A smaller partner of a set is in one of these."""
        own = self.class_of(s.size)
        found = []
        for scheme in (own, own - 1) if own else (own,):
            m, spare = self.segments(scheme)
            segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            begin = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            sums = np.add.reduceat(s * _ODD[61] ^ (s >> np.uint64(29)), begin)
            label = segment[begin] + np.uint64(scheme << 40)
            found.append(_mix(_mix(sums) + label * _ODD[62]))
            if m - begin.size > spare:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), segment[begin]) + np.uint64(scheme << 40)
                found.append(_mix(empty * _ODD[62] + np.uint64(1)))
        return np.concatenate(found)


class PrefixTree:
    """Trie over sets of small integers, each given as an ascending array."""

    def __init__(self, sets: list[np.ndarray], universe: int):
        self.universe = universe
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order = np.array(order, np.int64)
        rows = [sets[i] for i in order]
        n = len(rows)
        self.size = np.array([r.size for r in rows], np.int64)
        self.depth = np.zeros(n, np.int64)  # where the branch of a row leaves its parent
        for i in range(1, n):
            m = min(rows[i - 1].size, rows[i].size)
            differ = np.flatnonzero(rows[i - 1][:m] != rows[i][:m])
            self.depth[i] = differ[0] if differ.size else m
        parent, stack = np.full(n, -1, np.int64), []
        for i in range(n):
            while stack and self.depth[stack[-1]] >= self.depth[i]:
                stack.pop()
            # The row before shares the prefix; the branch that holds its end is the last one that starts above it.
            parent[i] = stack[-1] if stack else -1
            stack.append(i)
        self.parent = parent
        level = np.zeros(n, np.int64)
        least, most = self.size.copy(), self.size.copy()
        for i in range(n):
            level[i] = level[parent[i]] + 1 if parent[i] >= 0 else 0
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                least[parent[i]] = min(least[parent[i]], least[i])
                most[parent[i]] = max(most[parent[i]], most[i])
        self.least, self.most = least, most
        self.levels = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1 if n else 0)]
        self.runs = np.concatenate([r[d:] for r, d in zip(rows, self.depth.tolist(), strict=True)]) if n else np.empty(0, np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size - self.depth)))
        self.alive, self.below = np.ones(n, bool), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                self.below[parent[i]] += self.below[i]
        self._has, self._upto = np.zeros(universe, bool), np.zeros(self.runs.size, np.int64)
        self.read = 0  # elements of runs that queries have read

    def take(self, row: int) -> None:
        """Look for a set no more."""
        self.alive[row] = False
        while row >= 0:
            self.below[row] -= 1
            row = int(self.parent[row])

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Rows that are still looked for with Jaccard similarity of ``percent`` or more."""
        n, q = self.size.size, query.size
        self._has[query] = True
        start, overlap, open_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for k, rows in enumerate(self.levels):
            if k:
                rows = rows[open_[self.parent[rows]]]
                p = self.parent[rows]
                before = self.depth[rows] - self.depth[p]  # what of its parent's run lies above a branch
                start[rows] = start[p] + np.where(before > 0, self._upto[self.begin[p] + before - 1], 0)
            most, least = self.most[rows], self.least[rows]
            reach = start[rows] + np.minimum(q - start[rows], most - self.depth[rows])
            wanted = np.maximum(q, least) * percent
            rows = rows[(self.below[rows] > 0) & (reach * 100 >= wanted) & (wanted <= 100 * np.minimum(q, most))]
            if not rows.size:
                break
            open_[rows] = True
            length = self.begin[rows + 1] - self.begin[rows]
            stops = np.cumsum(length)
            at = np.repeat(self.begin[rows] - stops + length, length) + np.arange(stops[-1])
            counted = np.concatenate(([0], np.cumsum(self._has[self.runs[at]])))
            self._upto[at] = counted[1:] - np.repeat(counted[stops - length], length)
            overlap[rows] = start[rows] + counted[stops] - counted[stops - length]
            self.read += at.size
        self._has[query] = False
        return np.flatnonzero(open_ & self.alive & (100 * overlap >= percent * (q + self.size - overlap)))


def join_block(names: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a block just as all its links do.

    Each search takes the sets that are not reached yet; sets that a query links leave the search and are queried in
    their turn, so a block is done after as many queries as are needed to reach or to rule out every set.
    """
    if len(sets) < 2:
        return []
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(values.size, np.int64)
    place[np.lexsort((values, -count))] = np.arange(values.size)
    flat, at, ranked = place[inverse], 0, []
    for s in sets:
        ranked.append(np.sort(flat[at : at + s.size]))
        at += s.size
    tree = PrefixTree(ranked, values.size)
    links = []
    for seed in range(len(sets)):
        if not tree.alive[seed]:
            continue
        tree.take(seed)
        queue = [seed]
        while queue and tree.alive.any():
            a = queue.pop()
            for b in tree.linked(ranked[tree.order[a]], percent).tolist():
                tree.take(b)
                queue.append(b)
                links.append((int(names[tree.order[a]]), int(names[tree.order[b]])))
    return links


def _segment_rows(n: int, percent: int):
    """Rows (hash, node, size): size -1 for a segment's hash; one row (k1, node, size) with the size of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, schemes = ShingleSets(n), SegmentSchemes(percent)
        for batch in slices(batches, "text"):
            nodes, pairs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sets = shingles.of(texts_of(batch))
            hashes = [schemes.hashes(s) if s.size else s for s in sets]
            sizes = np.array([s.size for s in sets], np.int64)
            many = [h.size for h in hashes]
            flat = np.concatenate([*hashes, pairs.astype(np.int64).view(np.uint64)]).view(np.int64)
            node = np.concatenate([np.repeat(nodes, many), nodes])
            size = np.concatenate([np.full(sum(many), -1), sizes])
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(node), pa.array(size, pa.int32())], names=["hash", "node", "size"])

    return run


def _size_rows(n: int):
    """Rows (k1, k2, size) of the sets of rows (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = ShingleSets(n)
        for batch in slices(batches, "text"):
            sizes = [s.size for s in shingles.of(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32())], names=["k1", "k2", "size"])

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (hash, node): sizes as they are, and hashes that two or more nodes have; one row is carried."""
    last: tuple[int, int, bool] | None = None  # hash and node of the last row, and whether it has been given out
    for batch in batches:
        h, node, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        told = size >= 0
        hh, nn = h[~told], node[~told]
        given = np.empty((2, 0), np.int64)
        if hh.size:
            if last is not None:
                hh, nn = np.concatenate(([last[0]], hh)), np.concatenate(([last[1]], nn))
            new = np.concatenate(([True], (hh[1:] != hh[:-1]) | (nn[1:] != nn[:-1])))
            hh, nn = hh[new], nn[new]
            same = hh[1:] == hh[:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            before = last is not None and last[2]
            last = (int(hh[-1]), int(nn[-1]), bool(shared[-1]) or (before and hh.size == 1))
            if before:
                shared[0] = False
            given = np.stack([hh[shared], nn[shared]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([h[told], given[0]])), pa.array(np.concatenate([node[told], given[1]])), pa.array(np.concatenate([size[told], np.full(given.shape[1], -1)]), pa.int32())],
            names=["hash", "node", "size"],
        )


def _join_rows(n: int, percent: int):
    """Links (a, b) of rows (block, node, text) sorted by block; a block's rows may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = ShingleSets(n)
        block, names, sets = None, [], []

        def done() -> pa.RecordBatch:
            links = join_block(np.array(names, np.int64), sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in slices(batches, "text"):
            for key, name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingles.of(texts_of(batch)), strict=True):
                if key != block:
                    if len(sets) > 1:
                        yield done()
                    block, names, sets = key, [], []
                names.append(name)
                sets.append(s)
        if len(sets) > 1:
            yield done()

    return run


def _token_rows(n: int):
    """Rows (hash, node, pair, size) of the elements of the set of each row; ``pair`` names its text among those of its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = ShingleSets(n)
        for batch in slices(batches, "text"):
            sets = shingles.of(texts_of(batch))
            many = np.array([s.size for s in sets], np.int64)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            node, pair = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), many) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(node), pa.array(pair), pa.array(np.repeat(many, many), pa.int32())], names=["hash", "node", "pair", "size"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hash, node, pair, size) sorted by hash, those of elements that two or more sets have, with their frequency.

    Frequencies of ``COMMON`` and more count as that, so no more than so many rows of an element are ever held back.
    """
    held = np.empty((4, 0), np.int64)
    common = None  # the hash of a common element whose rows are given out as they come
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        rows = np.concatenate([held, rows], axis=1)
        begin = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
        size = np.diff(np.append(begin, rows.shape[1]))
        df = np.minimum(size, COMMON)
        if rows[0][0] == common:
            df[0] = COMMON
        if df[-1] < COMMON:
            held, common = rows[:, begin[-1] :], None
            df[-1] = 0
        else:
            held, common = rows[:, :0], rows[0][-1]
        each = np.repeat(df, size)
        give = each > 1
        yield pa.RecordBatch.from_arrays([*(pa.array(r[give]) for r in rows[:3]), pa.array(rows[3][give], pa.int32()), pa.array(each[give], pa.int32())], names=["hash", "node", "pair", "size", "df"])
    if held.shape[1] > 1:
        yield pa.RecordBatch.from_arrays([*map(pa.array, held[:3]), pa.array(held[3], pa.int32()), pa.array(np.full(held.shape[1], held.shape[1]), pa.int32())], names=["hash", "node", "pair", "size", "df"])


def _rare_prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """(hash, node) of the rarest elements of each set, of which linked sets share at least one.

    A set of n elements needs its n - ⌈n · percent / 100⌉ + 1 rarest. Those that no other set has come first and meet
    nothing; a set with that many of them has no link at all and is gone. An id with several texts has a set for each; an
    element that several of them want is one row.
    """
    sets = tokens.groupBy("node", "pair").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("shared"))
    wanted = F.expr(f"size - (size * {percent} + 99) div 100 + 1")
    met = (wanted - (F.col("size") - F.size("shared"))).cast("int")
    return materialise(sets.withColumn("met", met).filter("met > 0").select("node", F.explode(F.expr("slice(shared, 1, met)")).alias("e")).select("e.hash", "node").distinct(), "prefixes")


def _chunked(clusters: DataFrame, chunk: int) -> DataFrame:
    """Members of clusters with ``mine``, the chunk of their cluster that they are dealt to."""
    return clusters.withColumn("mine", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / chunk)).cast("int"))


def _links(kept: DataFrame, dealt: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of blocks (node, block) of documents, by prefix trees."""
    dealt = materialise(dealt, "blocks")
    texts = join_ids(kept, dealt.select("node").distinct(), "node").select("node", "text")
    blocks = texts.join(dealt, "node").select("block", "node", "text")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_join_rows(n, percent), "a long, b long")


def _crossed(prefixes: DataFrame, parts: DataFrame, chunk: int) -> DataFrame:
    """Blocks (node, block) of clusters of several chunks that are not one yet.

    Members outside the largest part meet those that share an element of theirs; elements that the same members have count
    once.
    """
    parts = materialise(parts, "parts-apart")
    asked = materialise(join_ids(prefixes, parts.filter("component <> main").select("node"), "node"), "asked")
    met = materialise(join_ids(join_ids(prefixes, parts.select("node"), "node"), asked.select("hash").distinct(), "hash"), "met")
    groups = met.groupBy("hash").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2")).filter("m > 1")
    groups = groups.groupBy("m", "x1", "x2").agg(F.min("hash").alias("hash")).join(asked.groupBy("hash").agg(F.count("*").alias("s")), "hash")
    groups = materialise(groups.select("hash", F.ceil(F.col("m") / chunk).cast("int").alias("rows"), F.ceil(F.col("s") / chunk).cast("int").alias("cols")), "groups")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    name = F.concat_ws("/", "hash", "row", "col").alias("block")
    crossed = met.join(groups, "hash").select("node", "hash", own("rows").alias("row"), every("cols").alias("col")).select("node", name)
    return crossed.unionByName(asked.join(groups, "hash").select("node", "hash", own("cols").alias("col"), every("rows").alias("row")).select("node", name)).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    A document's set holds the distinct ``n``-grams of its words; fewer words, but not none, are one gram. Documents
    link if their Jaccard similarity is ``percent`` or more; ``component_id`` is the least doc_id that links reach,
    the document's own if it has no words. Rows that repeat an id are one document with the links of each; a null id
    links with nothing and has a null component. Null texts have no words. Copies of a text are joined once.
    """
    ready(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    narrow = materialise(rows.select("doc_id", "k1", "k2"), "text-keys")
    classes = narrow.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows"))
    classes = materialise(classes, "text-classes")
    # A text of an id is named by the id and 128 bits; what goes with an id besides needs no more than 64.
    key = ["node", "k1", "k2"]
    spare = narrow.join(classes.filter("n_rows > 1"), ["k1", "k2"]).filter("doc_id <> node").select(F.col("doc_id").alias("node"), "k1", "k2").distinct()
    kept = join_ids(rows.filter("doc_id is not null").select(F.col("doc_id").alias("node"), "text", "k1", "k2"), spare, key, "left_anti")

    hashed = kept.select("node", "k1", "text").mapInArrow(_segment_rows(n, percent), "hash long, node long, size int")
    shared = hashed.repartition("hash").sortWithinPartitions("hash", "node").mapInArrow(_shared_rows, "hash long, node long, size int")
    shared = materialise(shared, "shared-segments")
    sizes = shared.filter("size >= 0").groupBy("node", F.col("hash").alias("k1")).agg(F.max("size").alias("size"))
    # Texts that only rows without an id have are in no block, but have a size.
    lone = classes.filter("node is null")
    lone_sizes = rows.filter("doc_id is null").join(lone.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "text").mapInArrow(_size_rows(n), "k1 long, k2 long, size int")
    lone_sizes = lone_sizes.groupBy("k1", "k2").agg(F.max("size").alias("size"))
    columns = ["k1", "k2", "node", "n_rows", "size"]
    sized = classes.filter("node is not null").join(sizes, ["node", "k1"], "left").select(columns).unionByName(lone.join(lone_sizes, ["k1", "k2"], "left").select(columns))
    sized = materialise(sized, "sized-classes")
    # Ids with several texts are linked to the row that stands for each.
    several = narrow.filter("doc_id is not null").groupBy("doc_id").agg((F.count_distinct("k1", "k2") > 1).alias("several")).filter("several").select("doc_id")
    same = narrow.join(several, "doc_id").join(sized.filter("size > 0"), ["k1", "k2"]).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    candidates = shared.filter("size < 0").select("hash", "node")
    survivors = join_ids(kept, candidates.select("node").distinct(), "node")
    # Only rows that repeat both id and text are moved to be counted once.
    repeated = materialise(narrow.filter("doc_id is not null").groupBy(F.col("doc_id").alias("node"), "k1", "k2").count().filter("count > 1").select(key), "repeated-rows")
    if repeated.limit(1).count():
        survivors = join_ids(survivors, repeated, key, "left_anti").unionByName(join_ids(survivors, repeated, key).dropDuplicates(key))
    survivors = survivors.select("node", F.col("k1").alias("pair"), "text")
    tokens = survivors.mapInArrow(_token_rows(n), "hash long, node long, pair long, size int")
    tokens = tokens.repartition("hash").sortWithinPartitions("hash").mapInArrow(_frequencies, "hash long, node long, pair long, size int, df int")
    prefixes = _rare_prefixes(tokens, percent)
    first = prefixes.groupBy("hash").agg(F.min("node").alias("b"))
    stars = prefixes.join(first, "hash").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    clusters = connected_components(stars).withColumnRenamed("component", "cluster")
    counts = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(HUBS)]).alias("hubs"))
    clusters = materialise(_chunked(clusters.join(counts.withColumn("hubs", F.when(F.col("members") > chunk, F.col("hubs"))), "cluster"), chunk), "clusters")

    # First every chunk by itself, with a few members of the cluster that all its chunks have.
    alone = clusters.select("node", F.concat_ws("/", "cluster", "mine").alias("block"))
    hubs = clusters.filter("hubs is not null").select("cluster", "mine", "hubs").distinct().select(F.explode("hubs").alias("node"), F.concat_ws("/", "cluster", "mine").alias("block"))
    near = materialise(_links(kept, alone.unionByName(hubs).distinct(), n, percent), "links")
    links = near
    large = clusters.filter(F.col("members") > chunk)
    if large.limit(1).count():
        # Components stand for their links from here on.
        joined = connected_components(near)
        links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        parts = materialise(large.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "parts")
        sizes_of = parts.groupBy("cluster", "component").agg(F.count("*").alias("k"))
        largest = sizes_of.groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
        largest = materialise(largest, "largest-parts")
        if largest.limit(1).count():
            links = links.unionByName(_links(kept, _crossed(prefixes, parts.join(largest, "cluster"), chunk), n, percent))
    found = connected_components(links.unionByName(same))

    nodes = sized.join(found, "node", "left")
    nodes = nodes.select("k1", "k2", F.coalesce("component", "node").alias("component"), F.col("size").alias("class_size"))
    out = narrow.join(nodes, ["k1", "k2"], "left")
    size = F.coalesce("class_size", F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_shingles"), F.when(size > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents of which one of each component stays: that with the least id, once. Null ids stay."""
    found = near_duplicates(docs, n, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    rest = join_ids(docs, found, "doc_id", "left_anti")
    repeated = rest.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return rest.filter("doc_id is null").unionByName(rest.filter("doc_id is not null").dropDuplicates(["doc_id"])) if repeated else rest


def required_overlap(a: int, b: int, percent: int) -> int:
    """Least overlap of sets of sizes ``a`` and ``b`` with a Jaccard similarity of ``percent``."""
    return math.ceil(percent * (a + b) / (100 + percent))
