"""Alignment of two tokenizers against both libraries on whole texts and plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from leadloom.llm import alignment

A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    byte = alignment.byte_characters()
    assert sorted(byte.values()) == list(range(256))
    vocabulary = {i: t for t, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def encode(text):
        """Ids and bytes of both, or nothing."""
        if not text:
            return None
        x = [(i, bytes(byte[c] for c in vocabulary[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        same = {b"".join(t for _, t in side) for side in (x, y)} == {(" " + text).encode()}
        return (x, y) if same else None

    return encode


def plain_groups(x, y):
    """Groups ([ids of A], [ids of B]) between the offsets at which both end."""
    groups, i, j, p, q = [], 0, 0, 0, 0
    a, b = [], []
    while i < len(x) or j < len(y):
        if p <= q and i < len(x):
            a.append(x[i][0])
            p += len(x[i][1])
            i += 1
        else:
            b.append(y[j][0])
            q += len(y[j][1])
            j += 1
        if p == q and a and b:
            groups.append((a, b))
            a, b = [], []
    return groups


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", " word", "é", "naïve", "日本語", "\n", "\n\n", "  ", " ", "\t", "\r\n", ");\r\n", "{\r", "▁", "<|endoftext|>", "<s>", "<0x41>", " ", "　", "'s", "don't", "123", "!!", "ﬁ", "\x00", "\x1c", "𝒳", "🙂", "ab" * 30, " ", "x"]
    return ["".join(rng.choices(parts, k=rng.choice([1, 2, 3, 8, 20]))) for _ in range(n)]


def sentences(seed, n):
    rng = random.Random(seed)
    words = ["Alignment", "of", "tokens", "Straße", "été", "2024,", "(foo)", "bar.", "naïveté", "über", "co-op"]
    return [rng.choice([" ", " ", "\n"]).join(rng.choices(words, k=rng.choice([1, 3, 30]))) for _ in range(n)]


@pytest.mark.parametrize("remembered", [0, alignment.REMEMBERED])
def test_groups_equal_the_libraries_on_whole_texts(libraries, remembered):
    aligner = alignment.Aligner(A, B, remembered)
    assert aligner.cuts
    texts = [t for t in odd_texts(1, 1500) + sentences(1, 300) if t]
    for at in range(0, len(texts), 100):
        for irregular in (False, True):
            some = [t for t in texts[at : at + 100] if bool(len(aligner.pieces_of(t)) % 2) == irregular]
            counts, written, _, _ = aligner.align(pa.array(some))
            for k, t in enumerate(some):
                found = libraries(t)
                groups = plain_groups(*found) if found else []
                assert written[k].decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups), t
                assert counts[:3, k].tolist() == ([len(found[0]), len(found[1]), len(groups)] if found else [0, 0, 0])


def test_terminals_are_those_of_the_components():
    rng = np.random.default_rng(2)
    for _ in range(50):
        total = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(total - 1) < p) + 1, total) for p in rng.random(2))
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        got = alignment.terminals(a, b)
        want = [next(c for c in cuts if c >= e) for e in [*a.tolist(), *b.tolist()]]
        assert [b[t - a.size] for t in got] == want


@pytest.mark.parametrize("broadcast_pairs", [0, alignment.BROADCAST_PAIRS])
def test_documents_equal_plain_python(frame, libraries, broadcast_pairs):
    texts = odd_texts(3, 150) + sentences(3, 60) + ["", None, "word " * 3000]
    rows = [(i % 190, t) for i, t in enumerate(texts)] + [(None, "the word"), (None, None)]
    links, counts = [], Counter()
    for _, t in rows:
        found = libraries(t)
        own = [(a[-1], b[-1]) for a, b in plain_groups(*found)] if found else []
        links.append(own)
        counts.update(own)
    top = defaultdict(int)
    for (_, b), k in counts.items():
        top[b] = max(top[b], k)
    want = []
    for (i, t), own in zip(rows, links, strict=True):
        found = libraries(t)
        groups = plain_groups(*found) if found else []
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""
        n = [len(found[0]), len(found[1])] if found else [0, 0]
        want.append((i, *n, len(groups), len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own), digest))
    got = alignment.alignment(frame(rows), A, B, broadcast_pairs).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_groups_are_given_on_request(frame):
    row = alignment.align_documents(frame([(1, "ab cd")]), A, B, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count("|") == row.n_groups


def test_empty_table(frame):
    assert alignment.alignment(frame([(1, "a")]).filter("doc_id > 1"), A, B).count() == 0


def test_lists_are_gathered_without_places_of_single_values():
    import tracemalloc

    rng = np.random.default_rng(5)
    stops = np.concatenate(([0], np.cumsum(rng.integers(0, 9, 1000))))
    wanted = rng.integers(0, 1000, 400_000)
    for values in (rng.integers(0, 256, stops[-1]).astype(np.uint8), rng.integers(0, 1 << 40, stops[-1])):
        few, size = alignment._gathered(values, stops, wanted[:500])
        assert few.tolist() == [x for i in wanted[:500] for x in values[stops[i] : stops[i + 1]].tolist()]
        assert size.tolist() == [stops[i + 1] - stops[i] for i in wanted[:500]]
        empty = np.flatnonzero(np.diff(stops) == 0)
        assert alignment._gathered(values, stops, empty)[0].size == alignment._gathered(values, stops, wanted[:0])[0].size == 0
    tracemalloc.start()
    gathered = alignment._gathered(values.astype(np.uint8), stops, wanted)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert gathered.size > 1_000_000 and peak < 8 * gathered.size


def test_a_worker_encodes_without_threads_of_the_library(monkeypatch):
    import os

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    alignment.Aligner(A, B)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
