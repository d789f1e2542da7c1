"""Alignment of two tokenizers over the same bytes.

Both encode a text with a space before it. A token of either points to the token of the other that reaches farthest
right of those that it overlaps (the one over its last byte), and to itself where both end together. Doubling these
successors until they stand still takes every token to the last one of its group, so tokens with the same terminal are a
group: the bytes between two neighbouring offsets at which both tokenizers end a token.

Both tokenizers start a new token at a space or line feed after a visible character, whatever stands around it, so the
groups of a text are those of its pieces in order. Distinct pieces are encoded and aligned together, once in a worker's
memory, which is bounded in bytes. Where the vocabulary does not allow such cuts, whole texts are aligned.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.batches import ready, slices
from leadloom.plans.storage import materialise

#: Text aligned at once.
_SLICE_BYTES = 1_000_000
#: Bytes of pieces and their alignments that a worker remembers.
REMEMBERED = 60_000_000
#: New pieces that the libraries get as one text, and that are aligned together.
_JOINED, _TOGETHER = 100, 20_000
#: Distinct linked pairs of ids (a few words each) that may be broadcast; more take the shuffled join.
BROADCAST_PAIRS = 400_000

# What Unicode takes for white space, as code points.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLANK = set(map(chr, _SPACES))
_ANY = "[" + "".join(rf"\x{{{c:x}}}" for c in _SPACES) + "]"
#: Texts in which white space stands at the beginning or next to white space.
_ADJACENT = f"^{_ANY}|{_ANY}{_ANY}"
_VISIBLE = "[^" + "".join(map(chr, _SPACES)) + "]"
_CUT = regex.compile(f"(?V1)(?<={_VISIBLE})(?=[ \n])")
_UNSAFE = regex.compile("[^▁]▁|\n")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The last token of each token's group: tokens of A first, then those of B, as places in that order.

    Ends ascend, are those of tokens without gaps over the same bytes, and the last ones are equal.
    """
    n = a_ends.size
    b_over = np.searchsorted(b_ends, a_ends)
    a_over = np.searchsorted(a_ends, b_ends)
    farther = a_ends[a_over] > b_ends if n else np.zeros(b_ends.size, bool)
    successor = np.concatenate((n + b_over, np.where(farther, a_over, n + np.arange(b_ends.size))))
    while True:
        doubled = successor[successor]
        if (doubled == successor).all():
            return successor
        successor = doubled


class Aligner:
    """Alignment of texts by a tokenizer file of the tokenizers library (A) and one of sentencepiece (B)."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        import sentencepiece
        from tokenizers import Tokenizer

        # A task has one core; threads of the library would each hold memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.remembered = Tokenizer.from_file(a_path), remembered
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = byte_characters()
        self.a_token = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_token[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_token = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_token, self.b_token))
        self.space = self.b.piece_to_id("▁")
        # No entry may run over a cut, and a single space must not be joined with a line feed.
        self.cuts = self.space != self.b.unk_id() and not any(_UNSAFE.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self._forget()

    def _forget(self) -> None:
        # Keys are pieces without their first space; a piece that starts otherwise, or with a space and a line feed, is
        # its own key in a tuple, unless it starts with a line feed.
        self.numbers: dict[str | tuple[str], int] = {}
        self.counts = np.empty((5, 0), np.int64)  # valid, tokens of A, of B, groups, links
        self.pairs, self.pair_stops = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.written, self.written_stops = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.held = 0

    def _b_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of B, which adds a space of its own: that of a text is left to it, or its token is dropped again."""
        asked = [t[1:] if t[0] == " " else t for t in texts]
        found = self.b.encode(asked, num_threads=1)
        return [ids[1:] if t[0] != " " else ids if q else [self.space] for t, q, ids in zip(texts, asked, found, strict=True)]

    def _spelt(self, texts: list[str], ends: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B of texts, one after the other; None if they do not spell ``raw`` or no token ends at an end."""
        found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self._b_ids(texts)
        sides = []
        for lists, tokens, sizes in zip(found, (self.a_token, self.b_token), (self.a_size, self.b_size), strict=True):
            flat = list(chain.from_iterable(lists))
            ids = np.array(flat, np.int64)
            at = np.cumsum(sizes[ids])
            if b"".join(map(tokens.__getitem__, flat)) != raw or not np.isin(ends, at, assume_unique=True).all():
                return None
            sides.append(ids)
        return sides[0], sides[1]

    def _encode(self, pieces: list[str], join: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, bytes of each piece) of pieces, one after the other; no ids and no bytes if not spelt.

        The libraries get ``join`` pieces as one text where they cut it as it was joined: pieces end visibly.
        """
        raw = [p.encode("utf-8", "replace") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = ["".join(pieces[k : k + join]) for k in range(0, len(pieces), join)]
        if sides := self._spelt(joined, np.cumsum(size), b"".join(raw)):
            return *sides, size
        if len(pieces) == 1:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        step = join if len(pieces) > join else 1
        parts = [self._encode(pieces[k : k + step], join) for k in range(0, len(pieces), step)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _learn(self, keys: list[str | tuple[str]]) -> None:
        """Encode and align new pieces, all together."""
        keys = sorted(keys, key=self._ends_blank)
        blank = sum(map(self._ends_blank, keys))
        pieces = [k[0] if isinstance(k, tuple) else k if k[:1] == "\n" else " " + k for k in keys]
        first, n = self.counts.shape[1], len(pieces)
        parts = [self._encode(x, join) for x, join in ((pieces[: n - blank], _JOINED if self.cuts else 1), (pieces[n - blank :], 1)) if x]
        a, b, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        a_ends, b_ends, ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(size)
        last = terminals(a_ends, b_ends)
        ends_group = last[a.size :] == a.size + np.arange(b.size)
        number = np.cumsum(ends_group) - 1  # of the group that a terminal ends
        group = number[last - a.size]
        # Links: tokens that end together.
        low, high = np.searchsorted(b_ends, a_ends, "left"), np.searchsorted(b_ends, a_ends, "right")
        links = high - low
        linked = np.repeat(np.arange(a.size), links)
        other = np.repeat(low - np.cumsum(links) + links, links) + np.arange(linked.size)
        a_piece, b_piece = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        of_piece = lambda x: np.bincount(x, minlength=n)
        counts = np.stack([size > 0, of_piece(a_piece), of_piece(b_piece), of_piece(b_piece[ends_group]), of_piece(a_piece[linked])]).astype(np.int64)
        pairs = a[linked] * self.b_size.size + b[other]
        text, length = self._write(a, b, group, np.concatenate((a_piece, b_piece)), n)
        self.pairs = np.concatenate((self.pairs, pairs))
        self.pair_stops = np.concatenate((self.pair_stops, self.pair_stops[-1] + np.cumsum(counts[4])))
        self.written = np.concatenate((self.written, text))
        self.written_stops = np.concatenate((self.written_stops, self.written_stops[-1] + np.cumsum(length)))
        self.counts = np.concatenate((self.counts, counts), axis=1)
        self.numbers.update(zip(keys, range(first, first + n), strict=True))
        self.held += int(size.sum()) + text.size + 8 * pairs.size + 250 * n

    @staticmethod
    def _write(a: np.ndarray, b: np.ndarray, group: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups of pieces as bytes, and how many each of ``n`` pieces has: ids of A, a bar, ids of B, a semicolon."""
        key = 2 * group + np.repeat([0, 1], [a.size, b.size])
        order = np.argsort(key, kind="stable")
        key, ids, piece = key[order], np.concatenate((a, b))[order], piece[order]
        digits = max(1, len(str(int(ids.max(initial=0)))))
        # A row a token: its digits, blank where it has fewer, and the mark behind it.
        marks = np.empty((ids.size, digits + 1), np.uint8)
        rest = ids.copy()
        for k in range(digits - 1, -1, -1):
            marks[:, k] = np.where((rest > 0) | (k == digits - 1), rest % 10 + ord("0"), 0)
            rest //= 10
        marks[:, digits] = ord(",")
        if ids.size:
            ends = np.append(key[1:] != key[:-1], True)
            marks[ends, digits] = np.where(key[ends] % 2 == 1, ord(";"), ord("|"))
        used = marks > 0
        return marks[used], np.bincount(piece, used.sum(axis=1), n).astype(np.int64)

    @staticmethod
    def _ends_blank(key: str | tuple[str]) -> bool:
        text = key[0] if isinstance(key, tuple) else key
        return not text or text[-1] in _BLANK

    def pieces_of(self, text: str) -> list[str]:
        """A text, with a space before it, cut where both tokenizers start a new token."""
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    @staticmethod
    def _key(piece: str) -> str | tuple[str]:
        if piece[0] == "\n":
            return piece
        return piece[1:] if piece[0] == " " and piece[1:2] != "\n" else (piece,)

    def _cut(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """(keys of distinct pieces, pieces of all texts by their place there, how many each text has) of texts that are not empty."""
        plain = self.cuts and not pc.any(pc.match_substring_regex(texts, _ADJACENT)).as_py()
        if plain:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
            numbered = lists.flatten().dictionary_encode()
            return numbered.dictionary.to_pylist(), numbered.indices.to_numpy(), lists.value_lengths().to_numpy()
        lists = [self.pieces_of(t) for t in texts.to_pylist()]
        numbered = pa.array([p for x in lists for p in x], pa.large_string()).dictionary_encode()
        return [self._key(p) for p in numbered.dictionary.to_pylist()], numbered.indices.to_numpy(), np.array([len(x) for x in lists])

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of texts that are not empty: counts (tokens of A, of B, groups, links), written groups, and their links.

        Links are (row, pair), repeated as often as they occur; a pair of ids is a · (size of B) + b. Texts whose tokens
        do not spell them have no tokens.
        """
        if self.held > self.remembered:
            self._forget()
        distinct, place, many = self._cut(texts)
        new = [k for k in distinct if k not in self.numbers]
        for at in range(0, len(new), _TOGETHER):
            self._learn(new[at : at + _TOGETHER])
        own = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        piece = own[place]
        row = np.repeat(np.arange(len(texts)), many)
        valid = np.bincount(row, 1 - self.counts[0][piece], len(texts)) == 0
        counts = np.stack([np.bincount(row, c[piece], len(texts)) for c in self.counts[1:]]).astype(np.int64) * valid
        row, piece = row[valid[row]], piece[valid[row]]
        text, length = _gathered(self.written, self.written_stops, piece)
        stops = np.cumsum(np.bincount(row, length, len(texts)).astype(np.int64)).tolist()
        # The last semicolon of a text goes.
        view = memoryview(text)
        written = [bytes(view[x : max(x, y - 1)]) for x, y in zip([0, *stops], stops, strict=False)]
        pairs, size = _gathered(self.pairs, self.pair_stops, piece)
        return counts, written, np.repeat(row, size), pairs


def _gathered(values: np.ndarray, stops: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted lists, one list after the other, and the length of each.

    Arrow copies whole lists; places of single values would take eight bytes for each byte that is written.
    """
    size = stops[wanted + 1] - stops[wanted]
    lists = pa.Array.from_buffers(pa.large_binary(), stops.size - 1, [None, pa.py_buffer(stops * values.itemsize), pa.py_buffer(values)])
    total = int(size.sum())
    return np.frombuffer(lists.take(pa.array(wanted)).buffers()[2], values.dtype, total) if total else values[:0], size


_ALIGNERS: dict[tuple[str, str], Aligner] = {}

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned_rows(a_path: str, b_path: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = a_path, b_path
        aligner = _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(*key))
        n_pairs = len(aligner.a_token) * len(aligner.b_token)
        for batch in slices(batches, "text", _SLICE_BYTES):
            texts = batch.column(1)
            irregular = pc.match_substring_regex(texts, _ADJACENT).to_numpy(zero_copy_only=False)
            # Texts without adjacent white space are cut by columns, the others one by one.
            for rows in (np.flatnonzero(~irregular), np.flatnonzero(irregular)):
                if not rows.size:
                    continue
                counts, written, row, pairs = aligner.align(texts.take(pa.array(rows)))
                codes, times = np.unique(row * n_pairs + pairs, return_counts=True)
                stops = np.searchsorted(codes, np.arange(rows.size + 1) * n_pairs).astype(np.int32)
                columns = [batch.column(0).take(pa.array(rows)), *map(pa.array, counts), pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written])]
                columns += [pa.ListArray.from_arrays(pa.array(stops), pa.array(x)) for x in (codes % n_pairs, times.astype(np.int32))]
                names = ["doc_id", *_COUNTS, "groups_sha256", "pairs", "times"]
                if with_groups:
                    columns, names = [*columns, pa.array([w.decode() for w in written])], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def align_documents(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every document, with ``groups`` if asked for.

    ``docs`` has doc_id and text; other columns are ignored, rows that repeat an id stay rows of their own. ``groups`` is
    text: ids of A, comma-joined, a bar, those of B, groups divided by semicolons; ``groups_sha256`` is its hash.
    ``pairs`` holds the distinct linked pairs of ids of a document (a · size of B's vocabulary + b), ``times`` how often
    each occurs. Texts that are null or empty, and those whose tokens do not spell them with a space before, have no
    tokens: zeros, empty lists and an empty string in place of the hash.
    """
    ready(docs.sparkSession)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    zero, bare = F.lit(0).cast("long"), rows.filter("text is null or text = ''")
    empty = bare.select("doc_id", *(zero.alias(c) for c in _COUNTS), F.lit("").alias("groups_sha256"), F.array().cast("array<bigint>").alias("pairs"), F.array().cast("array<int>").alias("times"))
    if with_groups:
        schema, empty = schema + ", groups string", empty.withColumn("groups", F.lit(""))
    found = rows.filter("text <> ''").mapInArrow(_aligned_rows(a_path, b_path, with_groups), schema)
    return found.unionByName(empty)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) over all documents; ``best``: no other pair of the same id of B occurs more often.

    The table is bounded by the pairs of two vocabularies, whatever the number of documents.
    """
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.times").alias("count"))
    return materialise(counts, "pair-counts")


def with_best(counts: DataFrame, b_size: int) -> DataFrame:
    """``counts`` with ``best``. Ids of B are few and so are the ids of A that each of them meets."""
    b_id = F.col("pair") % b_size
    top = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("top"))
    return counts.withColumn("b_id", b_id).join(top, "b_id").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    ``count_sum`` adds up, over a document's links, how often the link's pair of ids is linked in all documents;
    ``n_best`` counts the links whose pair is the most frequent of its id of B, ties included. Other columns and odd
    rows are as in ``align_documents``.
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned = align_documents(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id())
    aligned = materialise(aligned, "aligned")
    counts = pair_counts(aligned)
    best = with_best(counts, b_size)
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        best = F.broadcast(best)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    sums = links.join(best, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = aligned.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", *_COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
