"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

Training takes a bounded sample of labelled documents. Terms are words and word beginnings, and all terms of the sample
are dimensions. A weight is tf times idf, times 1 + z² where toxic examples hold the term z standard deviations more often
than chance gives: no term is left out, and what says nothing about the label keeps its plain TF-IDF weight. Examples with
equal vectors share one entry of the index with the counts of both labels, so the index is bounded by the sample.

The most frequent terms are stored as rows over blocks of entries, with the largest weight of each term in each block, the
others as postings. Of a query the postings are summed first; with the largest products of the frequent terms they bound
what a block can reach. Blocks that can reach the k-th best cosine found so far are summed too, which makes the neighbours
exact; their cosines are then computed anew in double precision. They vote with weights that fall with distance, smoothed
by the share of toxic examples, and the nearest of them, with their cosines and labels, are the evidence. Texts without
any of the terms get the smoothed share among examples without.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.batches import ready, release, slices, texts_of
from leadloom.plans.storage import materialise

_WORD = regex.compile(r"[^\W_]+")
_BEGINNINGS = (5, 7)
#: Marks after a word that need no pattern to be cut off.
_ENDS = ".,;:!?"
#: Text that is cut at once, and queries that meet the index together.
_SLICE_BYTES, _QUERIES = 1_000_000, 64
#: Terms stored as rows; more than the error of sums in single precision.
_FREQUENT, _MARGIN = 768, 1e-4
#: Postings whose weights are made at once.
_POSTINGS = 1 << 17

#: Places of a text's terms in the model, ascending, and how often it holds each.
Vector = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class ToxicityParams:
    """``examples`` and ``example_bytes`` bound what a model is fitted on, ``shown`` the neighbours given as evidence."""

    examples: int = 4_000
    example_bytes: int = 64_000_000
    neighbours: int = 25
    threshold: float = 0.3
    prior_weight: float = 2.0
    softness: float = 0.1
    block: int = 64
    shown: int = 5


def terms_of(piece: str) -> list[str]:
    """Terms of a stretch of text: its words in lower case, and beginnings of 5 and 7 letters of longer words."""
    low = piece.lower()
    words = [low] if low.isalpha() else [low[:-1]] if low[-1:] in _ENDS and low[:-1].isalpha() else _WORD.findall(low)
    return words + [w[:k] + "*" for w in words for k in _BEGINNINGS if len(w) > k]


def base_rate(toxic: int, total: int) -> float:
    """Share of toxic examples, drawn towards a tenth; that without examples, so that nothing is rejected unlearnt."""
    return (toxic + 1) / (total + 10)


def _hashes(names: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))


class Terms(Mapping):
    """Weights of a model's terms by term. Places ascend with the weights: what many hold lies together."""

    def __init__(self, names: list[str], weights: np.ndarray):
        weights = np.asarray(weights, float)
        order = np.array(sorted(range(len(names)), key=lambda i: (weights[i], names[i])), np.int64)
        self.weights, self.names = weights[order], pa.array(names, pa.string()).take(pa.array(order))
        hashes = _hashes(self.names.to_pylist())
        self.by_hash = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.by_hash]

    def places(self, names: list[str]) -> np.ndarray:
        """Places of terms, -1 for unknown ones. Sorted hashes tell where a term can be, its name whether it is there:
        no worker keeps a Python object a term, nor makes a table of all terms to look up a few."""
        asked, out = pa.array(names, pa.string()), np.full(len(names), -1, np.int32)
        hashes = _hashes(names)
        at, open_ = np.searchsorted(self.hashes, hashes), np.arange(len(names))
        while (open_ := open_[at[open_] < self.hashes.size]).size and (open_ := open_[self.hashes[at[open_]] == hashes[open_]]).size:
            place = self.by_hash[at[open_]]
            same = pc.equal(self.names.take(pa.array(place)), asked.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            out[open_[same]] = place[same]
            open_ = open_[~same]
            at[open_] += 1
        return out

    def __len__(self) -> int:
        return self.weights.size

    def __iter__(self) -> Iterator[str]:
        return iter(self.names.to_pylist())

    def __getitem__(self, term: str) -> float:
        at = int(self.places([term])[0])
        if at < 0:
            raise KeyError(term)
        return float(self.weights[at])


@dataclass
class ToxicityModel:
    """Terms and examples of a fitted model: vectors one after the other, with the counts of both labels."""

    params: ToxicityParams
    idf: Terms
    begin: np.ndarray
    places: np.ndarray
    counts: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    toxic: int = 0
    total: int = 0
    #: The least id among each entry's examples.
    ids: pa.Array | None = None

    def __getstate__(self) -> dict:
        """Vectors are packed for the way to the executors, each of which writes them to its disk."""
        packed = {k: _packed(np.diff(v.astype(np.int32), prepend=np.int32(0))) for k, v in (("places", self.places), ("counts", self.counts))}
        return {k: v for k, v in self.__dict__.items() if k != "_index"} | packed

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {k: np.cumsum(_unpacked(state[k]), dtype=np.int32) for k in ("places", "counts")})

    def index(self) -> BlockMaxIndex:
        """The model's index, made once a process."""
        if "_index" not in self.__dict__:
            release()
            self._index = BlockMaxIndex(self)
            self.counts = self._index.counts  # of the two one is kept
            release()
        return self._index

    @property
    def vectors(self) -> list[tuple[tuple[tuple[str, int], ...], int, int]]:
        """Each entry's (term, count) pairs and its counts of toxic and other examples."""
        names = list(self.idf)
        parts = zip(self.begin[:-1].tolist(), self.begin[1:].tolist(), self.pos.tolist(), self.neg.tolist(), strict=True)
        return [(tuple((names[d], n) for d, n in zip(self.places[a:z].tolist(), self.counts[a:z].tolist(), strict=True)), int(p), int(q)) for a, z, p, q in parts]


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    planes = np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()
    return x.size, pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def _unpacked(packed: tuple[int, bytes]) -> np.ndarray:
    n, data = packed
    planes = pa.decompress(data, 4 * n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view(np.int32).ravel()


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of runs that start at ``begin``, one after the other."""
    return np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


class BlockMaxIndex:
    """Inverted index over a model's examples, with the largest weight of each frequent term in each block of entries."""

    def __init__(self, model: ToxicityModel):
        p = self.params = model.params
        self.terms = model.idf
        self.prior = base_rate(model.toxic, model.total)
        size = np.diff(model.begin)
        some = size > 0
        pos, neg = model.pos[~some].sum(), model.neg[~some].sum()
        self.empty_score = float((pos + p.prior_weight * self.prior) / (pos + neg + p.prior_weight))
        self.pos, self.neg, size = model.pos[some], model.neg[some], size[some]
        self.ids = model.ids.filter(pa.array(some)) if model.ids is not None else None
        self.n = n = int(size.size)
        self.n_blocks = -(-n // p.block)
        self.begin = np.concatenate(([0], np.cumsum(size)))
        self.places = model.places
        most = int(model.counts.max(initial=1))
        self.tf = 1 + np.log(np.arange(1, most + 1))
        # Weights in double precision are made anew from the counts where they are asked for: those of all would take much memory.
        self.counts, self.norm = model.counts.astype(np.min_scalar_type(most)), np.empty(n)
        df = np.bincount(self.places, minlength=len(self.terms))
        self.frequent = np.sort(np.argsort(-df, kind="stable")[:_FREQUENT])
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[self.frequent] = np.arange(self.frequent.size)
        self.df = np.where(self.row < 0, df, 0)
        self.first = np.cumsum(self.df) - self.df
        self.rows = np.zeros((self.n_blocks * p.block, self.frequent.size), np.float32)
        few = int(self.df.sum())
        places, entry, weight = (np.empty(few, t) for t in (np.int32, np.min_scalar_type(n), np.float32))
        done = 0
        for i in range(0, n, 8 * p.block):  # a few entries at a time: the weights of all would take much memory
            k = min(n, i + 8 * p.block)
            part = slice(self.begin[i], self.begin[k])
            w = self.tf[self.counts[part] - 1] * self.terms.weights[self.places[part]]
            self.norm[i:k] = np.sqrt(np.add.reduceat(w * w, self.begin[i:k] - self.begin[i]))
            w /= np.repeat(self.norm[i:k], size[i:k])
            own = self.row[self.places[part]]
            of, often = np.repeat(np.arange(i, k, dtype=np.int32), size[i:k]), own >= 0
            self.rows[of[often], own[often]] = w[often]
            more = slice(done, done + int((~often).sum()))
            places[more], entry[more], weight[more] = self.places[part][~often], of[~often], w[~often]
            done = more.stop
        self.block_max = self.rows.reshape(self.n_blocks, p.block, self.frequent.size).max(1).T.copy()
        order = np.argsort(places, kind="stable")
        del places
        self.entry, self.weight = entry[order], weight[order]
        self.asked = np.zeros(len(self.terms))
        self._known: dict[bytes, tuple[float, list[int]]] = {}

    def _weigh(self, vector: Vector) -> np.ndarray:
        w = (1 + np.log(vector[1])) * self.terms.weights[vector[0]]
        return w / np.sqrt((w * w).sum())

    def _vector(self, vector: tuple[tuple[str, int], ...]) -> Vector:
        places, counts = self.terms.places([t for t, _ in vector]), np.array([n for _, n in vector], np.int64)
        order = np.argsort(places, kind="stable")[int((places < 0).sum()) :]
        return places[order], counts[order]

    def weigh(self, vector: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        """Places and unit-length TF-IDF weights of (term, count) pairs."""
        v = self._vector(vector)
        return v[0], self._weigh(v)

    def nearest(self, vector: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines of the nearest ``neighbours`` examples, with all that tie with the last."""
        return self.nearest_of([self._vector(vector)])[0]

    def nearest_of(self, vectors: list[Vector]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest of each of a few vectors, none of them empty."""
        p, n, m = self.params, self.n, len(vectors)
        if not n:
            return [(np.empty(0, np.int64), np.empty(0))] * m
        weights = [self._weigh(v) for v in vectors]
        q = np.zeros((m, self.frequent.size), np.float32)
        scores = np.zeros((m, self.n_blocks * p.block), np.float32)
        for k, ((places, _), w) in enumerate(zip(vectors, weights, strict=True)):
            row = self.row[places]
            q[k, row[row >= 0]] = w[row >= 0]
            df = self.df[places]
            at = _runs(self.first[places], df)
            if at.size:
                scores[k, :n] = np.bincount(self.entry[at], self.weight[at] * np.repeat(w, df), n)
        bounds = q @ self.block_max + scores.reshape(m, self.n_blocks, p.block).max(2)
        done = np.zeros(bounds.shape, bool)
        k = min(p.neighbours, n)
        seeds = np.argpartition(-bounds, min(3, self.n_blocks - 1), axis=1)[:, :4] if self.n_blocks > 4 else np.tile(np.arange(self.n_blocks), (m, 1))
        wanted = np.zeros(bounds.shape, bool)
        np.put_along_axis(wanted, seeds, True, 1)
        for _ in range(2):
            for b in np.flatnonzero(wanted.any(0)).tolist():
                own, part = np.flatnonzero(wanted[:, b]), slice(b * p.block, (b + 1) * p.block)
                scores[own, part] += q[own] @ self.rows[part].T
            done |= wanted
            # What postings alone give is a lower bound where a block has not been summed.
            kth = np.partition(scores[:, :n], n - k, axis=1)[:, n - k]
            wanted = ~done & (bounds > 0) & (bounds >= kth[:, None] - _MARGIN)
        at_least = np.where(np.repeat(done, p.block, axis=1), scores, 0)[:, :n]
        return [self._exact(v, w, np.flatnonzero((s > 0) & (s >= t - _MARGIN))) for v, w, s, t in zip(vectors, weights, at_least, kth, strict=True)]

    def _exact(self, vector: Vector, w: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates the nearest, by cosines in double precision."""
        if not e.size:
            return e, np.empty(0)
        size = self.begin[e + 1] - self.begin[e]
        self.asked[vector[0]] = w
        c, upto = np.empty(e.size), np.cumsum(size)
        i = 0
        while i < e.size:  # some candidates at a time: there can be very many
            k = max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + _POSTINGS, "right")))
            at, part = _runs(self.begin[e[i:k]], size[i:k]), size[i:k]
            places = self.places[at]
            product = self.asked[places]
            hit = np.flatnonzero(product)
            product[hit] *= self.tf[self.counts[at[hit]] - 1] * self.terms.weights[places[hit]] / np.repeat(self.norm[e[i:k]], part)[hit]
            c[i:k] = np.add.reduceat(product, np.cumsum(part) - part)
            i = k
        self.asked[vector[0]] = 0
        o = np.argsort(-c, kind="stable")
        last = int(np.searchsorted(np.cumsum((self.pos + self.neg)[e[o]]), self.params.neighbours))
        reach = float(c[o[last]]) if last < o.size else 0.0
        keep = o[c[o] >= reach - 1e-9]
        return e[keep], c[keep]

    def score_all(self, vectors: list[Vector]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each vector a score between 0 and 1, and the nearest of the entries that gave it, with their cosines."""
        import xxhash

        p, known = self.params, self._known
        keys = [xxhash.xxh3_128_digest(v[0].tobytes() + v[1].tobytes()) if v[0].size and self.n else b"" for v in vectors]
        if len(known) > 20_000:
            known.clear()
        new = {k: v for k, v in zip(keys, vectors, strict=True) if k and k not in known}
        for a in range(0, len(new), _QUERIES):
            part = dict(islice(new.items(), a, a + _QUERIES))
            for key, (e, c) in zip(part, self.nearest_of(list(part.values())), strict=True):
                w = c / (p.softness + 1 - np.minimum(c, 1)) * p.softness
                s = (float((w * self.pos[e]).sum()) + p.prior_weight * self.prior) / (float((w * (self.pos + self.neg)[e]).sum()) + p.prior_weight)
                known[key] = (s, e[: p.shown].astype(np.int32), c[: p.shown])
        return [known[k] if k else (self.empty_score, np.empty(0, np.int32), np.empty(0)) for k in keys]

    def evidence(self, found: list[tuple[float, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Array:
        """Lists of (doc_id, toxic, cosine) of what ``score_all`` found."""
        at, cosine = (np.concatenate([f[k] for f in found]) if found else np.empty(0, int) for k in (1, 2))
        stops = np.concatenate(([0], np.cumsum([f[1].size for f in found], dtype=np.int64)))
        ids = self.ids.take(pa.array(at.astype(np.int64))).cast(kind) if at.size else pa.array([], kind)
        toxic = pa.array((self.pos[at] > self.neg[at]).astype(np.int32)) if at.size else pa.array([], pa.int32())
        items = pa.StructArray.from_arrays([ids, toxic, pa.array(np.minimum(cosine, 1.0).astype(float))], names=["doc_id", "toxic", "cosine"])
        return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), items)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit a model on documents whose ids ``labels`` (doc_id, toxic) marks 0 or 1; null labels are left out.

    At most ``params.examples`` labelled ids, least by hash, are used; ids labelled twice count as toxic if any label
    says so, and of an id with several texts the least counts. Of these the first ones by hash are taken whose texts hold
    ``params.example_bytes`` in all, so a model is as large as its parameters allow, however long texts are; a text longer
    than that is no example. Without examples the model scores every text alike, as clean.
    """
    ready(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.examples)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sample = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", "doc_id")
    sample = materialise(sample.repartition(max(1, params.examples // 500)), "toxicity-examples")
    # At most ``params.examples`` sizes are summed up; texts beyond the bound are left where they are.
    sizes = sample.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).filter(F.col("bytes") <= params.example_bytes)
    upto = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.join(F.broadcast(sizes.withColumn("upto", upto).filter(F.col("upto") <= params.example_bytes).select("doc_id")), "doc_id", "left_semi").select("text", "toxic", "doc_id")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches, "text"):
            for text, label in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True):
                seen[label].update(set(terms_of(text)))
        rows = [(t, n, seen[0][t]) for t, n in seen[1].items()] + [(t, 0, n) for t, n in seen[0].items() if t not in seen[1]]
        for k in range(0, len(rows), 50_000):
            part = rows[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), *(pa.array([r[j] for r in part], pa.int64()) for j in (1, 2))], names=["term", "pos", "neg"])

    counts = sample.mapInArrow(count_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = counts.toArrow()
    pos, n = found["pos"].to_numpy(), found["pos"].to_numpy() + found["neg"].to_numpy()
    base = base_rate(toxic, total)
    z = np.maximum(0, (pos - n * base) / np.sqrt(n * base * (1 - base)))
    terms = Terms(found["term"].to_pylist(), (np.log((1 + total) / (1 + n)) + 1) * (1 + z * z))
    del found
    share = docs.sparkSession.sparkContext.broadcast(terms)

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(share.value)
        lists = pa.list_(pa.int32())
        for batch in slices(batches, "text"):
            vectors = counter.vectors(batch.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array([v[k] for v in vectors], lists) for k in (0, 1)), batch.column(1).cast(pa.int32()), batch.column(2)], names=["places", "counts", "toxic", "doc_id"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = sample.mapInArrow(vectorise, f"places array<int>, counts array<int>, toxic int, doc_id {kind}").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    flat = [rows[c].chunk(0).flatten().to_numpy() if rows.num_rows else np.empty(0, np.int32) for c in ("places", "counts")]
    stop = np.cumsum(np.diff(rows["places"].chunk(0).offsets.to_numpy()) if rows.num_rows else np.empty(0, np.int64), dtype=np.int64)
    label = rows["toxic"].to_numpy().astype(int)
    ids = rows["doc_id"].combine_chunks()
    del rows
    entries: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(zip([0, *stop[:-1].tolist()], stop.tolist(), strict=False)):
        key = hashlib.sha256(flat[0][a:b].tobytes() + flat[1][a:b].tobytes()).digest()
        entries.setdefault(key, [a, b, 0, 0, i])[3 - label[i]] += 1
    # Entries with the same strongest of the terms that many have share blocks, so that languages and topics lie together.
    often = np.zeros(len(terms), bool)
    often[np.argsort(-np.bincount(flat[0], minlength=len(terms)), kind="stable")[:_FREQUENT]] = True

    def strongest(a: int, b: int) -> tuple[int, ...]:
        own = flat[0][a:b][often[flat[0][a:b]]]
        return tuple(own[np.argsort(-terms.weights[own], kind="stable")[:2]].tolist())

    table = np.array([v for _, v in sorted(entries.items(), key=lambda x: (strongest(*x[1][:2]), x[0]))], np.int64).reshape(-1, 5)
    at = _runs(table[:, 0], table[:, 1] - table[:, 0])
    begin = np.concatenate(([0], np.cumsum(table[:, 1] - table[:, 0])))
    return ToxicityModel(params, terms, begin, flat[0][at], flat[1][at], table[:, 2].astype(float), table[:, 3].astype(float), toxic, total, ids.take(pa.array(table[:, 4])))


class TermCounter:
    """Places and counts of a model's terms in texts.

    Arrow cuts texts at white space and numbers the pieces; what a piece holds is computed once. Pieces are remembered
    until they hold ``most`` bytes; a text of more pieces is counted all the same.
    """

    def __init__(self, terms: Terms, most: int = 40_000_000):
        self.terms, self.most = terms, most
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.stops, self.held = np.empty(0, np.int32), np.zeros(1, np.int64), 0

    def _learn(self, pieces: list[str]) -> None:
        found = [terms_of(p) for p in pieces]
        places = self.terms.places([t for f in found for t in f])
        known = np.concatenate(([0], np.cumsum(places >= 0)))
        stops = known[np.cumsum([len(f) for f in found])]
        first = self.stops.size - 1
        self.flat, self.stops = np.concatenate((self.flat, places[places >= 0])), np.concatenate((self.stops, self.stops[-1] + stops))
        self.numbers.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.held += 4 * int(stops[-1]) + 200 * len(pieces) + sum(map(len, pieces))

    def vectors(self, texts: pa.Array) -> list[Vector]:
        """Of each text the places of its terms, ascending, and how often it holds each; null is the empty text."""
        if self.held > self.most:
            self._forget()
        cut = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        numbered = cut.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        if new := [p for p in distinct if p not in self.numbers]:
            self._learn(new)
        own = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        row = np.repeat(np.arange(len(texts)), cut.value_lengths().to_numpy())
        # Each piece counts once a text, then each term.
        key, times = np.unique(row * max(1, len(distinct)) + numbered.indices.to_numpy(), return_counts=True)
        row, pieces = key // max(1, len(distinct)), own[key % max(1, len(distinct))] if len(distinct) else key
        size = self.stops[pieces + 1] - self.stops[pieces]
        key = np.repeat(row, size) * max(1, len(self.terms)) + self.flat[_runs(self.stops[pieces], size)]
        times = np.repeat(times, size)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if key.size else np.empty(0, np.int64)
        counts = np.add.reduceat(times[order], first).astype(np.int32) if first.size else np.empty(0, np.int32)
        row, places = key[first] // max(1, len(self.terms)), (key[first] % max(1, len(self.terms))).astype(np.int32)
        stops = np.searchsorted(row, np.arange(1, len(texts)))
        return list(zip(np.split(places, stops), np.split(counts, stops), strict=True)) if len(texts) else []

    def __call__(self, text: str) -> Vector:
        return self.vectors(pa.array([text], pa.string()))[0]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted, evidence) of every document, from its whole text and nothing else.

    ``evidence`` lists the nearest examples, at most ``shown``, as (doc_id, toxic, cosine), nearest first. A null or empty
    text has none and gets the score of texts without terms. Equal rows give equal results; columns besides doc_id and text are ignored. No rows are shuffled.
    """
    ready(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = share.value.index()
        counter, least = TermCounter(index.terms), index.params.threshold
        for batch in slices(batches, "text", _SLICE_BYTES):
            found = index.score_all(counter.vectors(batch.column(1)))
            scores = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= least) for s in scores], pa.int32()), index.evidence(found, batch.column(0).type)],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id: {kind}, toxic: int, cosine: double>>")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text the model does not take for toxic."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = share.value.index()
        counter, least = TermCounter(index.terms), index.params.threshold
        for batch in slices(batches, "text", _SLICE_BYTES):
            clean = [f[0] < least for f in index.score_all(counter.vectors(batch.column(at)))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows kept out of training: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
