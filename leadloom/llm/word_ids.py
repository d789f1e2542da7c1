"""Whole-text encoding with the tokenizers library where a tokenizer drops white space and encodes words apart.

Arrow cuts a column of texts into the parts that the tokenizer encodes apart (runs of letters, digits, runs of signs) and
numbers them. The library encodes each distinct part once per worker process, many in one call, and a text's ids are
gathered from those of its parts. Texts in which neighbours could interact (a special token's string, characters that
only some take for white space, combining marks that the normalizer would join) go to the library whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What the tokenizer's own pattern cuts off, over lower-cased texts; letters between are left.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_CUTS = rf"({_CONTRACTIONS}|[0-9]|[!-/:-@\[-`{{-~]+)"
_CUTS = rf"({_CONTRACTIONS}|\pN|[^\s\x0b\x85\pZ\pL\pN]+)"
_WHOLE = r"<\||[\x1c-\x1f]|\x{0130}"
#: Beyond ASCII and composed Latin letters, texts are tested for normal form and cut by the full pattern.
_OTHER = r"[^\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
#: Bytes of parts and of their ids that a worker remembers.
REMEMBERED = 160_000_000
#: Parts that the library gets as one text.
_JOINED = 100


class WordEncoder:
    """Encoder of one tokenizer file. What it remembers is bounded in bytes and outlives a task with its worker."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {"": -1}
        self.ids, self.stops = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.held = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Keep the ids of some strings, given one after the other; returns the number of the first."""
        first = self.stops.size - 1
        self.stops = np.concatenate((self.stops, self.stops[-1] + np.cumsum(sizes, dtype=np.int64)))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.held += 4 * ids.size + 8 * sizes.size
        return first

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, and how many each has: a part's last token, and no other, is one that ends a word."""
        joined = [" ".join(parts[k : k + _JOINED]) for k in range(0, len(parts), _JOINED)]
        ids, sizes = self._one_by_one(joined)
        stop = np.flatnonzero(self.ends[ids]) + 1
        ends_in = np.searchsorted(stop, np.cumsum(sizes), "right")
        wanted = np.minimum(np.arange(1, len(joined) + 1) * _JOINED, len(parts))
        if stop.size != len(parts) or (ends_in != wanted).any() or stop[-1] != ids.size:
            return self._one_by_one(parts)
        return ids, np.diff(stop, prepend=0)

    def _cut(self, texts: pa.Array, whole: np.ndarray, other: np.ndarray) -> pa.ListArray:
        """Parts of each text but of those that go ``whole``; ``other`` texts are cut by the full pattern."""
        low = pc.ascii_lower(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        if not other.any():
            return pc.utf8_split_whitespace(pc.replace_substring_regex(low, _ASCII_CUTS, r" \1 "))
        mask = pa.array(other)
        plain = pc.replace_substring_regex(pc.if_else(mask, "", low), _ASCII_CUTS, r" \1 ")
        return pc.utf8_split_whitespace(pc.if_else(mask, pc.replace_substring_regex(pc.if_else(mask, low, ""), _CUTS, r" \1 "), plain))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), ``end_id`` after each text; null counts as the empty text."""
        if self.held > self.remembered:
            self._forget()
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False).copy()
        other = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False) & ~whole
        for i in np.flatnonzero(other).tolist():
            whole[i] = not unicodedata.is_normalized("NFC", texts[i].as_py())
        lists = self._cut(texts, whole, other & ~whole)
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.numbers]
        if new:
            first = self._add(*self._parts(new))
            self.numbers.update(zip(new, range(first, first + len(new)), strict=True))
            self.held += sum(map(len, new)) + 200 * len(new)
        own = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        parts = own[numbered.indices.to_numpy()] if distinct else np.empty(0, np.int64)
        row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
        row, parts = row[parts >= 0], parts[parts >= 0]
        kept = self.ids, self.stops, self.held
        if whole.any():
            extra = np.flatnonzero(whole)
            first = self._add(*self._one_by_one([texts[i].as_py() for i in extra.tolist()]))
            at = np.searchsorted(row, extra)
            row, parts = np.insert(row, at, extra), np.insert(parts, at, np.arange(first, first + extra.size))
        if end_id is not None:
            first = self._add(np.array([end_id]), np.ones(1, np.int64))
            at = np.searchsorted(row, np.arange(n), "right")
            row, parts = np.insert(row, at, np.arange(n)), np.insert(parts, at, first)
        ids, stops = self.ids, self.stops
        self.ids, self.stops, self.held = kept
        begin = stops[parts]
        size = stops[parts + 1] - begin
        flat = ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        return flat, np.bincount(row, size, n).astype(np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """The worker's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
