"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint holds in each of its 64 bits the majority of that bit over the hashes of its shingles. Two
fingerprints that differ in at most r bits agree on all but r of any r + 2 bands of bits, so every fingerprint is named
by each choice of two bands and meets those of the same name: no link is lost, and names made of 32 bits (r = 2) leave few
fingerprints to a name. Equal fingerprints are one before that, so copies meet once.

Fingerprints of a name are stored as bit planes: word w of plane j holds bit j of 64 fingerprints, one to a lane. A
query is compared with 64 lanes by one word operation a plane; carry-save adders count the differing bits of all lanes
in vertical counters, and after every few planes the words in which every lane exceeds the radius are abandoned. Names
that very many fingerprints share are dealt to tiles, pairs of chunks of them, so a task's memory is bounded.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.batches import ready, slices
from leadloom.plans.components import connected_components
from leadloom.plans.storage import BROADCAST_IDS, materialise

BITS = 64
#: Fingerprints of one chunk of a name that very many share; a tile holds two chunks at most.
CHUNK = 32_768
#: Rows that are sliced into planes together; names are never cut by it.
_TOGETHER = 65_536
#: Words (64 comparisons each) that are counted at once.
_WORDS = 1 << 17
#: Planes between two looks at what can be abandoned.
_PLANES = 8
#: Bytes of a text that are cut into words at once.
_STEP = 1 << 20

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``_STEP`` bytes, cut at white space."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + _STEP)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def shingle_hashes(text: bytes, n: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined ``n``-word shingles of a text, repeats included, in blocks; A-Z are lower-cased.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    import xxhash

    digest, carried, many = xxhash.xxh64_intdigest, [], 0
    for part in _parts(text):
        words = carried + part.lower().split()
        if len(words) >= n:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begin = np.concatenate(([0], ends[: len(words) - n] + 1))
            found = [digest(joined[a:b], seed) for a, b in zip(begin.tolist(), ends[n - 1 :].tolist(), strict=True)]
            many += len(found)
            yield np.array(found, np.uint64)
        carried = words[max(0, len(words) - n + 1) :] if n > 1 else []
    if not many and carried:
        yield np.array([digest(b" ".join(carried), seed)], np.uint64)


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text: a bit is 1 if over half of its shingles' hashes have it; zero without words."""
    count, many = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, n, seed):
        for k in range(0, h.size, 8192):
            part = h[k : k + 8192]
            count += np.unpackbits(part.view(np.uint8).reshape(part.size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        many += h.size
    return int(np.packbits(2 * count > many, bitorder="little").view("<u8")[0]) if many else 0


class BitPlanes:
    """Fingerprints stored vertically, and the pairs of them within a radius."""

    def __init__(self, values: np.ndarray):
        words = -(-values.size // 64)
        padded = np.zeros(words * 64, np.uint64)
        padded[: values.size] = values
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.values = values
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
        self.counted = 0  # words that planes were added to

    @staticmethod
    def _beyond(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
        """Lanes whose counter exceeds the radius or has run over."""
        beyond, equal = over, np.full_like(over, _ALL)
        for k in reversed(range(len(counter))):
            if radius >> k & 1:
                equal = equal & counter[k]
            else:
                beyond = beyond | (equal & counter[k])
                equal = equal & ~counter[k]
        return beyond

    def _within(self, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, lane) within the radius, of queries and words whose ``lanes`` are asked for."""
        over = ~lanes
        counter = [np.zeros_like(over) for _ in range(max(2, (radius + 1).bit_length()))]
        for first in range(0, BITS, _PLANES):
            asked = self.values[query]
            for j in range(first, first + _PLANES, 2):
                a, b = (self.planes[k][word] ^ (np.uint64(0) - ((asked >> np.uint64(k)) & np.uint64(1))) for k in (j, j + 1))
                # A full adder takes two planes and the lowest counter; its carry goes up.
                half = counter[0] ^ a
                carry = (counter[0] & a) | (half & b)
                counter[0] = half ^ b
                for k in range(1, len(counter)):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
                over = over | carry
            self.counted += word.size * _PLANES
            beyond = self._beyond(counter, over, radius)
            left = np.flatnonzero(beyond != _ALL)
            if left.size < word.size:
                query, word, over = query[left], word[left], beyond[left]
                counter = [c[left] for c in counter]
            if not left.size:
                break
        near = ~self._beyond(counter, over, radius)
        bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(bits)
        return query[at], word[at] * 64 + lane

    def pairs(self, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) within the radius, i < j < ``ends[i]``."""
        i = np.arange(self.values.size)
        i = i[i + 1 < ends]
        first = (i + 1) // 64
        many = (ends[i] - 1) // 64 - first + 1
        stops, found = np.cumsum(many), [(i[:0], i[:0])]
        at = 0
        while at < i.size:
            to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + _WORDS, "right")))
            k = many[at:to]
            query = np.repeat(i[at:to], k)
            word = np.repeat(first[at:to] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
            low = np.maximum(query + 1 - 64 * word, 0).astype(np.uint64)
            high = np.minimum(ends[query] - 64 * word, 64).astype(np.uint64)
            found.append(self._within(query, word, (_ALL << low) & (_ALL >> (np.uint64(64) - high)), radius))
            at = to
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, b


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as the links (a, b), one for each node but the least of a component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    label = np.arange(nodes.size)
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[moved], nodes[label[moved]]


def _fingerprint_rows(n: int, seed: int):
    """Rows (doc_id, fp) of rows (doc_id, bytes of a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, n, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def _link_rows(radius: int):
    """Links (a, b) of rows (name, tile, node, fp) sorted by name and tile; rows of a tile may span batches."""

    def linked(names: np.ndarray, tiles: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (tiles[1:] != tiles[:-1]))))
        stop = np.append(begin[1:], names.size)
        a, b = BitPlanes(fps.view(np.uint64)).pairs(np.repeat(stop, stop - begin), radius)
        links = forest(nodes[a], nodes[b])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False).astype(np.int64))) for h, c in zip(held, batch.columns, strict=True)]
            if held[0].size >= _TOGETHER:
                # The last tile may go on.
                last = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])).max(initial=-1)) + 1
                if last:
                    yield linked(*(h[:last] for h in held))
                    held = [h[last:] for h in held]
        if held[0].size:
            yield linked(*held)

    return run


def _names(radius: int) -> list:
    """Columns that name a fingerprint by each choice of the bands in which near ones may agree."""
    bands = radius + 2
    edges = [BITS * k // bands for k in range(bands + 1)]
    part = [F.expr(f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L") for a, b in itertools.pairwise(edges)]
    return [F.xxhash64(F.lit(k), part[x], part[y]) for k, (x, y) in enumerate(itertools.combinations(range(bands), 2))]


def fingerprint_links(classes: DataFrame, radius: int = 2, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect the rows (node, fp) of distinct fingerprints just as all links of the radius do."""
    named = materialise(classes.select("node", "fp", F.explode(F.array(*_names(radius))).alias("name")), "fingerprint-names")
    # Names that very many share are dealt to tiles; there are at most as many as fingerprints divided by a chunk's size.
    hot = named.groupBy("name").count().filter(F.col("count") > chunk).select("name", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    hot = materialise(hot, "hot-names")
    small = hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    dealt = named.join(F.broadcast(hot) if small else hot, "name", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tile = F.greatest("mine", "other").cast("long") * 1_000_000 + F.least("mine", "other")
    dealt = dealt.select("name", tile.alias("tile"), "node", "fp").repartition("name", "tile").sortWithinPartitions("name", "tile")
    return dealt.mapInArrow(_link_rows(radius), "a long, b long")


def simhash_duplicates(docs: DataFrame, n: int = 3, radius: int = 2, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    ``docs`` has doc_id and text; other columns are ignored. ``fingerprint`` is 16 lower-case hex digits over the
    ``n``-word shingles. Documents link if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    least doc_id that links reach, the document's own included. Null and empty texts and texts without words have the
    fingerprint zero, which links like any other. Rows that repeat an id are one document with the links of each, and
    each row has its own fingerprint; a null id links with nothing and has a null component. An empty table gives none.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = materialise(rows.mapInArrow(_fingerprint_rows(n, seed), "doc_id long, fp long"), "fingerprints")
    named = found.filter("doc_id is not null")
    classes = materialise(named.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-classes")
    # Ids with several texts link what stands for each.
    several = named.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("several")).filter("several").select("doc_id")
    same = named.join(several, "doc_id").join(classes, "fp").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(classes, radius, chunk).unionByName(same)
    joined = connected_components(links)
    classes = classes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = found.join(classes, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
