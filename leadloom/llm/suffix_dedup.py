"""Removal of every byte under a string of ``SPAN`` bytes that starts anywhere else in the corpus.

Method: anchors are the least hashed grams of ``GRAM`` bytes in each window of ``SPAN`` bytes, so equal strings of
``SPAN`` bytes hold equal anchors at equal places. Anchors meet by their hash in one shuffle of hashes and places.
Occurrences whose whole surroundings are equal (by two 64-bit hashes) repeat each other as far as an anchor can tell,
and one of them stands for all. Around what then still differs, the text to the right, and to the left reversed, is
sorted by deep-shallow suffix sorting, and the common prefixes of the two orders tell how far each occurrence is
repeated (see ``suffix_sort``). Only that text moves. Texts are named by two 64-bit hashes; texts that occur as a whole
more than once are removed as a whole.

No anchor's occurrences are all brought together in one task. Those of anchors with more than ``MOST_ROWS`` are dealt by
their surroundings and, within equal ones, to ``PARTS`` parts; one of each part then meets those of the others, which
gives the same classes. Those with more than ``MOST_MEMBERS`` different surroundings are not sorted: their strings are
hashed one by one and counted by a distributed aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.batches import ready, release, slices
from leadloom.llm.suffix_sort import shared_reach
from leadloom.plans.storage import BROADCAST_IDS, join_ids, materialise

SPAN, GRAM = 200, 32
LEFT = SPAN - GRAM
#: Surroundings of one anchor that a task may hold (about 20 MB of text), and rows of one that may go to one task.
MOST_MEMBERS, MOST_ROWS = 50_000, 10_000
#: Parts that the occurrences with equal surroundings of such an anchor are dealt to.
PARTS = 64

_CHUNK_BITS = 18
_RNG = np.random.default_rng(20240101)
_TABLE, _TABLE_2 = (_RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_STEP, _STEP_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_KEY = ["k1", "k2"]
_ANCHORS = "anchor long, near1 long, near2 long, k1 long, k2 long, at int, room short"
_FOUND = "anchor long, near1 long, near2 long, k1 long, k2 long, at int, room short, stop int"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Minimizers:
    """Anchors of texts that lie one after the other in a buffer."""

    def __init__(self):
        self.up, self.down = (self._powers(x) for x in (_STEP, pow(_STEP, -1, 1 << 64)))
        self.up2, self.down2 = (self._powers(x) for x in (_STEP_2, pow(_STEP_2, -1, 1 << 64)))

    @staticmethod
    def _powers(x: int) -> np.ndarray:
        out = np.full((1 << _CHUNK_BITS) + SPAN + 1, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of anchors in ``data``, their hashes and two hashes of their surroundings, within the texts.

        ``ends`` are the texts' ends, ascending. Surroundings that reach over a chunk of a long text get hashes of
        their own and thus equal no others; they are compared by their bytes later.
        """
        places, hashes, around, again = [], [], [], []
        begins = np.concatenate(([0], ends[:-1]))
        for c in range(0, max(0, data.size - SPAN + 1), 1 << _CHUNK_BITS):
            part = data[c : c + (1 << _CHUNK_BITS) + SPAN - 1]
            sums = np.zeros(part.size + 1, np.uint64)
            np.cumsum(_TABLE[part] * self.up[: part.size], out=sums[1:])
            h = (sums[GRAM:] - sums[:-GRAM]) * self.down[: part.size - GRAM + 1]
            h ^= h >> np.uint64(30)
            h *= _M1
            h ^= h >> np.uint64(27)
            h *= _M2
            h ^= h >> np.uint64(31)
            bits = np.uint64(_CHUNK_BITS + 1)
            key = (h >> bits << bits) | np.arange(h.size, dtype=np.uint64)
            w = LEFT + 1
            blocks = -(-key.size // w)
            padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
            padded[: key.size] = key
            square = padded.reshape(blocks, w)
            ahead = np.minimum.accumulate(square, axis=1).ravel()
            behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
            n = part.size - SPAN + 1
            least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
            start = c + np.arange(n)
            inside = start + SPAN <= ends[np.searchsorted(ends, start, "right")]
            at = (least[inside] & np.uint64((1 << (_CHUNK_BITS + 1)) - 1)).astype(np.int64)
            at = at[np.concatenate(([True], at[1:] != at[:-1]))] if at.size else at
            row = np.searchsorted(ends, at + c, "right")
            low, high = np.maximum(begins[row], at + c - LEFT) - c, np.minimum(ends[row], at + c + SPAN) - c
            inside = (low >= 0) & (high <= part.size)
            low, high = np.maximum(low, 0), np.minimum(high, part.size)
            near = (sums[high] - sums[low]) * self.down[low] + (at - low).astype(np.uint64) * _M1 + (high - at).astype(np.uint64) * _M2
            near = np.where(inside, near ^ (near >> np.uint64(29)), h[at] + (at + c).astype(np.uint64) * _M1)
            np.cumsum(_TABLE_2[part] * self.up2[: part.size], out=sums[1:])
            near2 = (sums[high] - sums[low]) * self.down2[low] + (at - low).astype(np.uint64) * _M2 + (high - at).astype(np.uint64)
            places.append(at + c)
            hashes.append(h[at])
            around.append(near)
            again.append(near2 ^ (near2 >> np.uint64(31)))
        if not places:
            none = np.empty(0, np.int64)
            return none, none, none, none
        places, hashes, around, again = map(np.concatenate, (places, hashes, around, again))
        first = np.concatenate(([True], places[1:] != places[:-1]))  # a chunk's last anchor may be the next one's first
        return places[first], *(x[first].view(np.int64) for x in (hashes, around, again))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes one after the other, and the end of each value."""
    values = [x if x is not None else b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([len(x) for x in values], dtype=np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ANCHORS`` of rows (k1, k2, data): room is what of ``SPAN`` bytes the text has from the anchor on."""
    finder = Minimizers()
    for batch in slices(batches, "data"):
        data, ends = _bytes_of(batch.column(2))
        at, hashes, around, again = finder.find(data, ends)
        row = np.searchsorted(ends, at, "right")
        begin = np.concatenate(([0], ends[:-1]))[row] if at.size else at
        room = np.minimum(ends[row] - at, SPAN) if at.size else at
        keys = [batch.column(k).to_numpy(zero_copy_only=False)[row] for k in (0, 1)]
        columns = [hashes, around, again, *keys, (at - begin).astype(np.int32), room.astype(np.int16)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "near1", "near2", "k1", "k2", "at", "room"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by part and surroundings: what equal surroundings repeat, and what must be compared.

    Rows of ``_FOUND``. With a stop of 0 or more, the bytes from ``at`` to there are repeated. With -1, the surroundings
    of this anchor stand for their equals and meet different ones. With -2, the row is one of an anchor that is dealt to
    several parts (other than 0), and meets those of the others. Of a part that goes on in the next batch only its first
    and its last row are carried, however long it is.
    """
    carried: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        told, shown = np.zeros((2, rows.shape[1]), bool)
        if carried is not None:
            rows = np.concatenate([carried[0], rows], axis=1)
            told, shown = np.concatenate([carried[1], told]), np.concatenate([carried[2], shown])
        same_place = (rows[[0, 1, 4, 5, 6], 1:] == rows[[0, 1, 4, 5, 6], :-1]).all(0)
        fresh = np.concatenate(([True], ~same_place))
        rows, told, shown = rows[:, fresh], told[fresh], shown[fresh]
        anchor, part, near1, near2, k1, k2, at, room = rows
        joint = (anchor[1:] == anchor[:-1]) & (part[1:] == part[:-1])
        equal = joint & (near1[1:] == near1[:-1]) & (near2[1:] == near2[:-1])
        repeated = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        first = np.flatnonzero(np.concatenate(([True], ~equal)))
        pair = (anchor[first][1:] == anchor[first][:-1]) & (part[first][1:] == part[first][:-1])
        meets = np.zeros(anchor.size, bool)
        meets[first] = np.concatenate(([False], pair)) | np.concatenate((pair, [False])) | (part[first] != 0)
        span, stand = repeated & ~told, meets & ~shown
        head = int(np.flatnonzero(np.concatenate(([True], ~joint)))[-1])
        keep = [head, anchor.size - 1] if head < anchor.size - 1 else [head]
        carried = rows[:, keep], (told | span)[keep], (shown | stand)[keep]
        stop = np.concatenate([at[span] + room[span], np.where(part[stand] != 0, -2, -1)])
        out_at = np.concatenate([np.maximum(at[span] - LEFT, 0), at[stand]])
        none = np.zeros(int(span.sum()), np.int64)  # what spans need not tell
        columns = [np.concatenate([anchor[span], anchor[stand]]), *(np.concatenate([none, x[stand]]) for x in (near1, near2))]
        columns += [np.concatenate([x[span], x[stand]]) for x in (k1, k2)]
        columns += [out_at.astype(np.int32), np.concatenate([none, room[stand]]).astype(np.int16), stop.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "near1", "near2", "k1", "k2", "at", "room", "stop"])


def _classified(anchors: DataFrame, part: Column) -> DataFrame:
    """``_classes`` of anchors, dealt by anchor and part."""
    rows = anchors.select("anchor", part.cast("long").alias("part"), "near1", "near2", *_KEY, "at", "room")
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "near1", "near2", *_KEY, "at")
    return rows.mapInArrow(_classes, _FOUND)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, k1, k2, at, left, right) for rows (k1, k2, data, anchors, ats)."""
    for batch in slices(batches, "data", 1_000_000):
        out: list[list] = [[], [], [], [], [], []]
        for k1, k2, data, anchors, ats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out[0].extend(anchors)
            out[1].extend([k1] * len(ats))
            out[2].extend([k2] * len(ats))
            out[3].extend(ats)
            out[4].extend([data[max(0, a - LEFT) : a] for a in ats])
            out[5].extend([data[a : a + SPAN] for a in ats])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["anchor", "k1", "k2", "at", "left", "right"])


def _padded(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    data, ends = _bytes_of(column)
    lengths = np.diff(np.concatenate(([0], ends)))
    out = np.zeros((len(lengths), width), np.uint8)
    out[np.arange(width) < lengths[:, None]] = _reverse_each(data, ends) if backwards else data
    return out, lengths


def _reverse_each(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each value's bytes in reverse, values in place."""
    lengths = np.diff(np.concatenate(([0], ends)))
    begin = np.repeat(ends - lengths, lengths)
    return data[np.repeat(ends, lengths) - 1 - (np.arange(data.size) - begin)]


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (k1, k2, start, stop) from contexts sorted by anchor; a group that reaches into the next batch is carried."""
    carried: list[pa.RecordBatch] = []

    def spans(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        group = table.column("anchor").to_numpy()
        right, right_len = _padded(table.column("right").combine_chunks(), SPAN, False)
        left, left_len = _padded(table.column("left").combine_chunks(), LEFT, True)
        r, l_, ok = shared_reach(right, right_len, left, left_len, group, SPAN)
        at = table.column("at").to_numpy().astype(np.int64)[ok]
        keys = [pa.array(table.column(k).to_numpy()[ok]) for k in _KEY]
        return pa.RecordBatch.from_arrays([*keys, pa.array(at - l_[ok]), pa.array(at + r[ok])], names=[*_KEY, "start", "stop"])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if cut or (carried and carried[-1].column(0)[0].as_py() != group[-1]):
            whole = [*carried, batch.slice(0, cut)] if cut else carried
            yield spans(pa.Table.from_batches(whole))
            carried = []
        carried.append(batch.slice(cut))
    if carried:
        yield spans(pa.Table.from_batches(carried))
    release()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept) from rows (doc_id, data, starts, stops)."""
    for batch in slices(batches, "data"):
        n_bytes, removed, runs, kept = [], [], [], []
        for data, starts, stops in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted(zip(starts, stops, strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            rest, last = [], 0
            for a, b in merged:
                rest.append(data[last:a])
                last = b
            rest.append(data[last:])
            n_bytes.append(len(data))
            removed.append(sum(b - a for a, b in merged))
            runs.append(len(merged))
            kept.append(b"".join(rest))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, runs)), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _hot_spans(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Spans around anchors with very many occurrences: every string over the anchor is hashed and counted."""
    members = members.groupBy(_KEY).agg(F.collect_set("at").alias("ats"))
    found = texts.join(members, _KEY).select(*_KEY, "data", F.explode("ats").alias("at"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - LEFT), F.least(F.col("at"), F.octet_length("data") - SPAN))
    windows = found.select(*_KEY, "data", F.explode(starts).alias("start"))
    string = F.substring("data", F.col("start") + 1, F.lit(SPAN))
    windows = windows.select(*_KEY, "start", F.xxhash64(string).alias("w1"), F.xxhash64(F.lit(1), string).alias("w2")).distinct()
    windows = materialise(windows, "hot-strings")
    place = F.struct(*_KEY, "start")
    twice = windows.groupBy("w1", "w2").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least <> most")
    shared = windows.join(twice.select("w1", "w2"), ["w1", "w2"], "left_semi")
    return shared.select(*_KEY, F.col("start").cast("long").alias("start"), (F.col("start") + SPAN).cast("long").alias("stop"))


def _key_of(text: str = "text") -> list:
    """The two hashes that name a text; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def repeated_spans(docs: DataFrame, most_members: int = MOST_MEMBERS, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts as (doc_id, k1, k2, data), and per k1, k2 with any the lists ``starts`` and ``stops``.

    ``k1`` and ``k2`` are hashes of the whole text, shared by copies. Spans may overlap.
    """
    ready(docs.sparkSession)
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    texts = docs.select("doc_id", *_key_of(), data.alias("data"))
    copies = texts.filter(F.octet_length("data") >= SPAN).groupBy(_KEY).agg(F.count("*").alias("n"), F.max(F.octet_length("data")).cast("long").alias("stop"))
    copies = copies.filter("n > 1").select(*_KEY, F.lit(0).cast("long").alias("start"), "stop")

    anchors = materialise(texts.select(*_KEY, "data").mapInArrow(_anchors, _ANCHORS), "anchors")
    hot = anchors.groupBy("anchor").count().filter(F.col("count") > most_rows).select("anchor", F.lit(True).alias("hot"))
    hot = materialise(hot, "hot-anchors")
    few = hot.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = anchors.join(F.broadcast(hot) if few else hot, "anchor", "left")
    part = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("near1", "near2", F.pmod(F.xxhash64(*_KEY, "at"), F.lit(PARTS))), F.lit((1 << 31) - 1))).otherwise(0)
    classes = materialise(_classified(marked, part), "anchor-classes")
    parts = classes.filter("stop = -2").drop("stop")
    classes = classes.filter("stop > -2").unionByName(materialise(_classified(parts, F.lit(0)), "part-classes"))
    equal = classes.filter("stop >= 0").select(*_KEY, F.col("at").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    members = classes.filter("stop < 0").select("anchor", *_KEY, "at")
    crowded = materialise(members.groupBy("anchor").count().filter(F.col("count") > most_members).select("anchor"), "crowded-anchors")
    any_crowded = crowded.limit(1).count() > 0

    own = join_ids(texts, members.select(*_KEY).distinct(), _KEY).dropDuplicates(_KEY).select(*_KEY, "data")
    few = join_ids(members, crowded, "anchor", "left_anti") if any_crowded else members
    few = few.groupBy(_KEY).agg(F.collect_list("anchor").alias("anchors"), F.collect_list("at").alias("ats"))
    around = own.join(few, _KEY).select(*_KEY, "data", "anchors", "ats")
    around = around.mapInArrow(_contexts, "anchor long, k1 long, k2 long, at int, left binary, right binary")
    spans = around.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_groups, "k1 long, k2 long, start long, stop long")
    spans = spans.unionByName(equal).unionByName(copies)
    if any_crowded:
        spans = spans.unionByName(_hot_spans(own, join_ids(members, crowded, "anchor").select(*_KEY, "at")))
    spans = spans.groupBy(_KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return texts, materialise(spans, "repeated-spans")


def remove_repeats(docs: DataFrame, most_members: int = MOST_MEMBERS, most_rows: int = MOST_ROWS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, and (kept) with ``with_text``.

    A byte is removed if a string of ``SPAN`` bytes over it also starts anywhere else, in this document or another;
    strings are judged on the input. All occurrences go, the first included. ``n_spans`` counts maximal removed runs.
    A null text is empty; an empty or short text is never cut; rows that repeat an id are documents of their own, and
    rows with equal texts are repeats of each other. Columns besides doc_id and text are ignored.
    """
    texts, spans = repeated_spans(docs, most_members, most_rows)
    ids = spans.select(*_KEY)
    cut = join_ids(texts, ids, _KEY).join(spans, _KEY).select("doc_id", "data", "starts", "stops")
    kind = dict(docs.dtypes)["doc_id"]
    cut = cut.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = join_ids(texts, ids, _KEY, "left_anti")
    none = F.lit(0).cast("long")
    whole = whole.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("data").alias("kept"))
    out = cut.unionByName(whole)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] if with_text else []))


def cut_texts(docs: DataFrame, most_members: int = MOST_MEMBERS, most_rows: int = MOST_ROWS) -> DataFrame:
    """``docs`` with all their columns, ``text`` without repeated strings and ``n_chars``, if there, to match.

    A character that is cut in part goes whole. Texts of which nothing is left are dropped; texts that were null or
    empty stay as they are.
    """
    _, spans = repeated_spans(docs, most_members, most_rows)
    rows = docs.select(F.struct("*").alias("row"), *_key_of())
    ids = spans.select(*_KEY)
    whole = join_ids(rows, ids, _KEY, "left_anti").select("row.*")
    cut = join_ids(rows, ids, _KEY).join(spans, _KEY)
    cut = cut.select(F.struct("row").alias("held"), F.encode("row.text", "UTF-8").alias("data"), "starts", "stops").select("held.row", "data", "starts", "stops")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut([pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[1:]], names=["doc_id", "data", "starts", "stops"])]):
                kept = [x.decode("utf-8", "ignore") for x in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string())], names=["row", "left"])

    kind = cut.schema["row"].dataType.simpleString()
    cut = cut.mapInArrow(left, f"row {kind}, left string").filter("length(left) > 0")
    fresh = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    columns = [(fresh[f.name].cast(f.dataType) if f.name in fresh else F.col("row")[f.name]).alias(f.name) for f in docs.schema.fields]
    return whole.unionByName(cut.select(*columns))
