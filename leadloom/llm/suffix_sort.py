"""Deep-shallow sorting of byte strings that belong to groups, and what their order tells about shared stretches."""

from __future__ import annotations

import numpy as np

#: Eight-byte characters that the multikey quicksort compares before a group that still ties goes to a blind trie.
SHALLOW = 3
#: Groups up to this size compare all their pairs at once; larger ones go through levels of their prefixes.
_PAIRS = 40


class BlindTrie:
    """Trie that keeps only branching depths; a string is compared in full once, with the leaf it is led to."""

    def __init__(self, width: int):
        self.width, self.root = width, None

    def insert(self, text: bytes, name: int) -> None:
        number = int.from_bytes(text, "big")
        if self.root is None:
            self.root = ("leaf", text, number, [name])
            return
        node = self.root
        while node[0] != "leaf":
            kids = node[2]
            node = kids.get(text[node[1]]) or next(iter(kids.values()))
        differ = number ^ node[2]
        if not differ:
            node[3].append(name)
            return
        depth = self.width - (differ.bit_length() + 7) // 8
        other = node[1][depth]
        above, node = None, self.root
        while node[0] != "leaf" and node[1] < depth:
            above, node = node, node[2][text[node[1]]]
        leaf = ("leaf", text, number, [name])
        if node[0] != "leaf" and node[1] == depth:
            node[2][text[depth]] = leaf
            return
        fork = ("node", depth, {text[depth]: leaf, other: node})
        if above is None:
            self.root = fork
        else:
            above[2][text[above[1]]] = fork

    def names(self, lengths: np.ndarray) -> list[int]:
        """Names of the strings in their order; of equal ones the shorter comes first."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == "leaf":
                found.extend(sorted(node[3], key=lengths.__getitem__))
            else:
                stack.extend(node[2][c] for c in sorted(node[2], reverse=True))
        return found


def deep_shallow_order(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of byte strings by (group, content), where a string's end comes before any byte.

    ``rows`` is a matrix of bytes whose width is a multiple of eight, filled up with NULs after each string's ``lengths``
    bytes; of strings that such filling makes equal the shorter comes first, which sets an end before a NUL. ``group``
    ascends. The shallow part is a multikey
    quicksort with eight bytes as a character: each depth sorts what still ties on that character alone. Groups that
    tie beyond ``SHALLOW`` characters have long common prefixes and are ordered by blind tries.
    """
    n, width = rows.shape
    order = np.arange(n)
    if n < 2:
        return order
    words = np.ascontiguousarray(rows).view(">u8")
    slot = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    rank = np.repeat(slot, np.diff(np.append(slot, n)))

    def ties(sorted_rank: np.ndarray) -> np.ndarray:
        same = sorted_rank[1:] == sorted_rank[:-1]
        return np.concatenate(([False], same)) | np.concatenate((same, [False]))

    tied = order[ties(rank)]
    for depth in range(min(SHALLOW, words.shape[1])):
        if not tied.size:
            break
        char = words[tied, depth].astype(np.uint64)
        o = np.lexsort((char, rank[tied]))
        tied, char = tied[o], char[o]
        old = rank[tied]
        at = np.arange(tied.size)
        head = np.concatenate(([True], old[1:] != old[:-1]))
        place = old + at - np.maximum.accumulate(np.where(head, at, 0))
        order[place] = tied
        new = head | np.concatenate(([True], char[1:] != char[:-1]))
        rank[tied] = place[np.maximum.accumulate(np.where(new, at, 0))]
        tied = tied[ties(rank[tied])]
    if tied.size:
        old = rank[tied]
        begin = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        size = np.diff(np.append(begin, tied.size))
        two = begin[size == 2]
        a, b = tied[two], tied[two + 1]
        differ = words[a] != words[b]
        first = differ.argmax(1)
        k = np.arange(two.size)
        swap = np.where(differ.any(1), words[a][k, first] > words[b][k, first], lengths[a] > lengths[b])
        order[old[two]], order[old[two] + 1] = np.where(swap, b, a), np.where(swap, a, b)
        for i, m in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            trie = BlindTrie(width)
            for name in tied[i : i + m].tolist():
                trie.insert(rows[name].tobytes(), name)
            order[old[i] : old[i] + m] = trie.names(lengths)
    return order


def neighbour_prefixes(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each rank, the common prefix with the rank before it, within the strings' own lengths; 0 between groups."""
    out = np.zeros(order.size, np.int64)
    step = max(1, (16 << 20) // max(1, rows.shape[1]))
    for i in range(1, order.size, step):
        a, b = order[i - 1 : min(order.size, i + step) - 1], order[i : i + step]
        differ = rows[a] != rows[b]
        lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[i : i + step] = np.where(group[a] == group[b], np.minimum(lcp, np.minimum(lengths[a], lengths[b])), 0)
    return out


def _reach_by_pairs(r_order, r_lcp, l_order, l_lcp, span):
    """Largest right and left reach of each member of one small group, over all of its pairs."""
    g = r_order.size

    def matrix(order, lcp):
        m = np.full((g, g), 1 << 30, np.int64)
        for i in range(g - 1):
            m[i, i + 1 :] = np.minimum.accumulate(lcp[i + 1 :])
        m = np.minimum(m, m.T)
        back = np.empty(g, np.int64)
        back[order] = np.arange(g)
        return m[np.ix_(back, back)]

    right, left = matrix(r_order, r_lcp), matrix(l_order, l_lcp)
    valid = right + left >= span
    np.fill_diagonal(valid, False)
    return np.where(valid, right, 0).max(1), np.where(valid, left, 0).max(1), valid.any(1)


def _reach_by_levels(r_order, r_lcp, l_order, l_lcp, span):
    """The same for a large group: at each level, members that share both a right and a left class have a partner."""
    g = r_order.size

    def classes(order, lcp, least):
        out = np.empty(g, np.int64)
        out[order] = np.cumsum(np.concatenate(([0], (lcp[1:] < least).astype(np.int64))))
        return out

    def best(order, lcp, other_order, other_lcp):
        reach, any_ = np.zeros(g, np.int64), np.zeros(g, bool)
        for level in np.unique(lcp[1:])[::-1].tolist():
            pair = classes(order, lcp, level) * g + classes(other_order, other_lcp, span - level)
            _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            hit = (count[inverse] > 1) & ~any_
            reach[hit] = level
            any_ |= hit
        return reach, any_

    right, valid = best(r_order, r_lcp, l_order, l_lcp)
    left, _ = best(l_order, l_lcp, r_order, r_lcp)
    return right, left, valid


def shared_reach(right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray, group: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far the stretch around each member's anchor that occurs at another member of its group reaches.

    ``right`` holds the bytes from the anchor on, ``left`` those before it, reversed. Members a and b share a string of
    ``span`` bytes over their anchors just if their common right and left stretches R and L add up to ``span``; all such
    strings of a together cover its bytes from the largest L before the anchor to the largest R after it. Returns the
    right reach, the left reach and whether there is any, for each row.
    """
    n = group.size
    r_order, l_order = deep_shallow_order(right, right_len, group), deep_shallow_order(left, left_len, group)
    r_lcp = neighbour_prefixes(right, right_len, group, r_order)
    l_lcp = neighbour_prefixes(left, left_len, group, l_order)
    r, l_, ok = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.empty(0, np.int64)
    size = np.diff(np.append(begin, n))
    two = begin[size == 2]
    hit = two[r_lcp[two + 1] + l_lcp[two + 1] >= span]
    for k in (0, 1):
        r[hit + k], l_[hit + k], ok[hit + k] = r_lcp[hit + 1], l_lcp[hit + 1], True
    for i, m in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        s = slice(i, i + m)
        if r_lcp[i + 1 : i + m].max() + l_lcp[i + 1 : i + m].max() < span:
            continue
        reach = _reach_by_pairs if m <= _PAIRS else _reach_by_levels
        r[s], l_[s], ok[s] = reach(r_order[s] - i, r_lcp[s], l_order[s] - i, l_lcp[s], span)
    return r, l_, ok
