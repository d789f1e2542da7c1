"""Quality rules: repetition inside a document, from its suffix array over words.

Method: the suffixes of each text, as sequences of words, are sorted; the longest common prefix of neighbours in that
order bounds the intervals of maximal repeated substrings. For each word the longest repeat that starts there is the
larger of its two neighbours' prefixes; the union of the spans of repeats of ``min_words`` or more gives the covered
share of the text, and the largest prefix gives the longest repeat. A text is kept if both stay within their limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadloom.llm.batches import ready, slices, texts_of

_BLANKS = " \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the rules; shares are of a text's words."""

    least_words: int = 10
    window: int = 5
    most_window_percent: int = 20
    min_words: int = 5
    most_covered: float = 0.2
    most_longest: int = 50


def suffix_order(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes of many sequences that lie one after the other.

    ``ids`` holds non-negative integers that no two sequences share, ``ends`` for each position the end of its
    sequence. Returns the positions in suffix order and, for each rank, the prefix that it shares with the rank before.
    Ranks double their depth each round, and only suffixes that still tie take part.
    """
    n = ids.size
    order = np.argsort(ids, kind="stable")
    key = ids[order]
    first = np.concatenate(([True], key[1:] != key[:-1])) if n else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.empty(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels = [rank.astype(np.int32)]
    size = np.diff(np.append(np.flatnonzero(first), n))
    tied = order[np.repeat(size > 1, size)]
    depth = 1
    while tied.size:
        nxt = tied + depth
        inside = nxt < ends[tied]
        second = np.where(inside, rank[np.where(inside, nxt, 0)], -1)
        composite = rank[tied] * (n + 1) + second + 1
        o = np.argsort(composite, kind="stable")
        tied, composite = tied[o], composite[o]
        group = rank[tied]
        new = np.concatenate(([True], composite[1:] != composite[:-1]))
        head = np.concatenate(([True], group[1:] != group[:-1]))
        at = np.arange(tied.size)
        slot = group + at - np.maximum.accumulate(np.where(head, at, 0))
        order[slot] = tied
        began = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[tied] = slot[began]
        levels.append(rank.astype(np.int32))
        size = np.diff(np.append(np.flatnonzero(new), tied.size))
        tied = tied[np.repeat(size > 1, size)]
        depth *= 2
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        same = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            i, j = a + same, b + same
            ok = (i < ends[a]) & (j < ends[b])
            ok &= levels[k][np.where(ok, i, 0)] == levels[k][np.where(ok, j, 0)]
            same += np.where(ok, 1 << k, 0)
        lcp[1:] = same
    return order, lcp


def longest_repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that its sequence has elsewhere too."""
    order, lcp = suffix_order(ids, ends)
    best = np.zeros(ids.size, np.int64)
    best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Positions under any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(texts: list[str], rules: RepetitionRules) -> list[np.ndarray]:
    encoded = [t.encode("utf-8", "replace") for t in texts]
    words = [e.split() for e in encoded]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    seen = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    doc = np.repeat(np.arange(len(texts)), n_words)
    ids = doc * max(1, len(seen)) + np.fromiter(map(seen.__getitem__, flat), np.int64, len(flat))
    stops = np.concatenate(([0], np.cumsum(n_words)))
    best = longest_repeats(ids, stops[doc + 1])
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[stops])
    hit = np.flatnonzero(best >= rules.window)
    repeat_words = sums(_covered(hit, np.full(hit.size, rules.window), ids.size))
    hit = np.flatnonzero(best >= rules.min_words)
    covered_words = sums(_covered(hit, best[hit], ids.size))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, best)
    word_chars = np.array([len(t) - sum(map(t.count, _BLANKS)) for t in texts], np.int64)
    symbols = np.array([sum(e.count(s) for s in _SYMBOLS) for e in encoded], np.int64)
    dup_lines = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(_BLANKS)]
        dup_lines[i] = len(lines) - len(set(lines))
    failed = (n_words < rules.least_words) | (100 * repeat_words > rules.most_window_percent * n_words)
    share = covered_words / np.maximum(n_words, 1)
    kept = ~failed & (share <= rules.most_covered) & (longest <= rules.most_longest)
    return [n_words, word_chars, symbols, dup_lines, repeat_words, failed, kept, covered_words, longest, share]


def repetition_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """Word counts, repetition and the verdict of every document.

    Words are runs of anything but ASCII white space, over whole texts. A null or empty text has no words and fails
    the base rules. Equal rows give equal results; columns besides doc_id and text are ignored. No rows are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, chars, symbols, lines, repeat, failed, kept, covered, longest, share = map(pa.array, _measure(texts_of(batch), rules))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n, chars, symbols, lines, repeat, failed, kept, covered, longest, share],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat", "covered_share"],
            )

    ready(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long, covered_share double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
