"""SimHash near-duplicates against a plain comparison of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from leadloom.llm import simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    """Component of each row (id, fingerprint); rows of an id are one."""
    fps = {}
    for i, fp in rows:
        fps.setdefault(i, set()).add(fp)
    least = {i: i for i in fps}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(fps)
    for x in ids:
        for y in ids:
            if x < y and any((a ^ b).bit_count() <= radius for a in fps[x] for b in fps[y]):
                a, b = root(x), root(y)
                least[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def texts(seed):
    """Texts with copies, near copies, odd white space and no words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "ab c", "X"]
    made = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 5, 60, 200]))
        for _ in range(rng.choice([1, 1, 3, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            made.append(rng.choice([" ", "\n", " \t"]).join(w))
    return [*made, "", None, " \n", "\x0b"]


def test_fingerprints_equal_the_rule(monkeypatch):
    for step in (7, 1 << 20):
        monkeypatch.setattr(simhash, "_STEP", step)
        for t in texts(1) + ["a" * 50 + " b c  D", "A b", "x  y\tz "]:
            assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t), t


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_planes_find_the_pairs_of_all(radius, monkeypatch):
    monkeypatch.setattr(simhash, "_WORDS", 13)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, np.uint64) * np.uint64(2)
    values = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, base.size).astype(np.uint64)) for _ in range(6)] + [base])
    ends = np.minimum((np.arange(values.size) // 90 + 1) * 90, values.size)
    a, b = simhash.BitPlanes(values).pairs(ends, radius)
    want = {(i, j) for i in range(values.size) for j in range(i + 1, ends[i]) if (int(values[i]) ^ int(values[j])).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)


def test_words_beyond_the_radius_are_abandoned():
    values = np.random.default_rng(3).integers(0, 1 << 63, 2000, np.uint64)
    planes = simhash.BitPlanes(values)
    planes.pairs(np.full(values.size, values.size), 2)
    asked = sum((1999 // 64) - (i + 1) // 64 + 1 for i in range(1999))
    assert planes.counted < 0.5 * 64 * asked


@pytest.mark.parametrize("chunk", [2, simhash.CHUNK])
def test_components_equal_the_comparison_of_all_pairs(spark, frame, chunk):
    rows = [(3 * i % 400, t) for i, t in enumerate(texts(2))]
    rows += rows[:7] + [(rows[3][0], "another text of the same id"), (rows[9][0], rows[40][1]), (None, rows[5][1]), (None, None)]
    got = [tuple(r) for r in simhash.simhash_duplicates(frame(rows), chunk=chunk).select("doc_id", "fingerprint", "component_id").collect()]
    component = plain_components([(i, plain_fingerprint(t)) for i, t in rows if i is not None])
    want = [(i, f"{plain_fingerprint(t):016x}", component.get(i)) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(set(component.values())) < len(component) - 10


def test_links_of_many_near_fingerprints(spark):
    """Chains of fingerprints two bits apart, some under one name, are whole in one component."""
    rng, rows, fp = random.Random(5), [], 0x0123456789ABCDEF
    for i in range(600):
        rows.append((i, fp if fp < 1 << 63 else fp - (1 << 64)))
        fp ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    rows = list({fp: (i, fp) for i, fp in reversed(rows)}.values())
    df = spark.createDataFrame(rows, "node long, fp long").repartition(3)
    for chunk in (3, 50, 1000):
        links = simhash.fingerprint_links(df, chunk=chunk).collect()
        least = {i: i for i, _ in rows}

        def root(i, least=least):
            while least[i] != i:
                i = least[i]
            return i

        for a, b in links:
            x, y = root(a), root(b)
            least[max(x, y)] = min(x, y)
        assert {root(i) for i, _ in rows} == {0}


def test_empty_table(frame):
    assert simhash.simhash_duplicates(frame([(1, "a")]).filter("doc_id > 1")).count() == 0
