"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each piece of text has a segment tree whose leaf i holds the rank of the pair that starts at the live node i, packed
with i itself, so that a tree's root is the leftmost pair of least rank. A merge takes the root, joins two live
neighbours and updates the leaves of the merged node, of the dead one and of the left neighbour, each on a path of
logarithmic length. Trees of pieces of like length stand side by side in one array and advance together, one merge
of every unfinished tree at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leadloom.llm.batches import Memo, ready, slices, texts_of
from leadloom.llm.pieces import pieces_of

_NONE = np.int64(1) << 62
_POS = 32
#: Leaves of the trees that advance together; bounds memory for long pieces as well as for many.
_LEAVES = 1 << 19


class BpeCodec:
    """Encoder and decoder for a table of ranks: token bytes to id, where a lower id merges earlier."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, merged = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(r)
        keys, merged = np.array(keys, np.int64), np.array(merged, np.int64)
        order = np.argsort(keys)
        self._keys, self._merged = np.append(keys[order], np.int64((1 << 63) - 1)), np.append(merged[order], -1)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BpeCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _pair_keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of pairs; ``_NONE`` for pairs that do not merge."""
        key = left.astype(np.int64) << 32 | right
        i = np.searchsorted(self._keys, key)
        return np.where(self._keys[i] == key, self._merged[i] << _POS | at, _NONE)

    def _merge_all(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes (a power of two), as little-endian 32-bit integers."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces], np.int64)
        tok = np.zeros((n, width), np.int32)
        used = np.arange(width) < length[:, None]
        tok[used] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        if width > 1:
            for k in range(0, n, rows_at_once := max(1, _LEAVES // 8 // width)):
                r, c = np.nonzero(used[k : k + rows_at_once, 1:])
                r += k
                tree[r, width + c] = self._pair_keys(tok[r, c], tok[r, c + 1], c)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = used.copy()

        def update(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            i = leaf + width
            tree[row, i] = value
            while width > 1 and (i := i >> 1)[0]:
                tree[row, i] = np.minimum(tree[row, 2 * i], tree[row, 2 * i + 1])

        rows = np.nonzero(tree[:, 1] < _NONE)[0] if width > 1 else np.empty(0, np.int64)
        while rows.size:
            root = tree[rows, 1]
            a, rank = root & ((1 << _POS) - 1), root >> _POS
            b = after[rows, a]
            c = after[rows, b]
            tok[rows, a], live[rows, b], after[rows, a] = rank, False, c
            more = c < length[rows]
            before[rows[more], c[more]] = a[more]
            nxt = np.where(more, c, 0)
            update(rows, b, np.full(rows.size, _NONE))
            update(rows, a, np.where(more, self._pair_keys(rank, tok[rows, nxt], a), _NONE))
            p = before[rows, a]
            has = p >= 0
            if has.any():
                r, q = rows[has], p[has]
                update(r, q, self._pair_keys(tok[r, q], rank[has], q))
            rows = rows[tree[rows, 1] < _NONE]
        flat = tok[live].astype("<u4").tobytes()
        stops = np.concatenate(([0], np.cumsum(live.sum(1)))) * 4
        return [flat[i:j] for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def encode_matches(self, matches: list[bytes]) -> list[bytes]:
        """Ids of single matches of the pattern. A match that is a token stands for itself."""
        out: list[bytes] = [b""] * len(matches)
        by_width: dict[int, list[int]] = {}
        for i, m in enumerate(matches):
            r = self.ranks.get(m)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif m:
                by_width.setdefault(1 << (len(m) - 1).bit_length(), []).append(i)
        for width, where in by_width.items():
            step = max(1, _LEAVES // width)
            for k in range(0, len(where), step):
                part = where[k : k + step]
                for i, ids in zip(part, self._merge_all([matches[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each cut by the pattern and each match encoded by itself."""
        cut = [[m.encode("utf-8", "replace") for m in self.pattern.findall(p)] for p in pieces]
        known = list(set().union(*cut))
        ids = dict(zip(known, self.encode_matches(known), strict=True))
        return [b"".join([ids[m] for m in ms]) for ms in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and (ids, decoded) with ``with_ids``.

    Every whole text is encoded without special tokens, then its ids are decoded; the hashes are of the ids as
    little-endian unsigned 32-bit integers and of the decoded bytes. A null or empty text has no ids. Rows that repeat
    an id stay; other columns are ignored. No rows are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec.from_file(ranks_path, pattern)
        memo = Memo(codec.encode_pieces, most=100_000_000)
        for batch in slices(batches, "text"):
            cut = [pieces_of(t) for t in texts_of(batch)]
            memo.learn(set().union(*cut))
            ids = [b"".join(map(memo.__getitem__, x)) for x in cut]
            decoded = [codec.decode(x) for x in ids]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in part]) for part in (ids, decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                stops = pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))), pa.int32())
                columns += [pa.ListArray.from_arrays(stops, values), pa.array([x.decode("utf-8", "replace") for x in decoded])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ready(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
