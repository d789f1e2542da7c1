"""What a worker keeps between slices of text."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from leadloom.llm import batches, bpe, toxicity


def test_terms_are_found_without_an_object_each():
    names = [f"term{k}" for k in range(200_000)]
    terms = toxicity.Terms(names, np.random.default_rng(2).random(len(names)))
    order = {t: k for k, t in enumerate(terms)}
    asked = ["term7", "none", "term199999", "", "term7"]
    tracemalloc.start()
    found = terms.places(asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tolist() == [order.get(t, -1) for t in asked] and found.dtype == np.int32
    assert peak < 1_000_000
    assert terms.places([]).size == 0 and toxicity.Terms([], np.empty(0)).places(["a"]).tolist() == [-1]


def test_memory_is_given_back_after_each_slice(monkeypatch):
    calls = []
    monkeypatch.setattr(batches, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 400] * 10)], names=["text"])
    sizes = [s.num_rows for s in batches.slices([batch], "text", most=800)]
    assert sizes == [2] * 5 and len(calls) == 6


def test_terms_are_looked_up_without_a_table_of_all(monkeypatch):
    names = [f"term{k}" for k in range(300_000)]
    terms = toxicity.Terms(names, np.random.default_rng(3).random(len(names)))
    order = {t: k for k, t in enumerate(terms)}
    monkeypatch.setattr(toxicity.pc, "index_in", None)
    assert terms.places(["term5", "x"]).tolist() == [order["term5"], -1]


def test_terms_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(toxicity, "_hashes", lambda names: np.array([len(n) for n in names], np.uint64))
    terms = toxicity.Terms(["aa", "bb", "cc", "d", "eeee"], np.array([3.0, 1.0, 2.0, 5.0, 4.0]))
    order = {t: k for k, t in enumerate(terms)}
    asked = ["cc", "aa", "zz", "bb", "d", "e", "eeee", "fffff", ""]
    assert terms.places(asked).tolist() == [order.get(t, -1) for t in asked]


def _model(n=1500, size=1200, terms=40_000):
    rng = np.random.default_rng(4)
    places = np.concatenate([np.sort(rng.choice(terms, size, replace=False)) for _ in range(n)]).astype(np.int32)
    known = toxicity.Terms([f"t{k}" for k in range(terms)], rng.random(terms) + 0.5)
    counts = rng.integers(1, 9, places.size).astype(np.int32)
    pos = (rng.random(n) < 0.2).astype(float)
    return toxicity.ToxicityModel(toxicity.ToxicityParams(), known, np.arange(n + 1) * size, places, counts, pos, 1 - pos, int(pos.sum()), n)


def test_an_index_keeps_no_double_a_posting_and_weighs_few_at_once():
    model = _model()
    index = model.index()
    kept = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray) and x.size >= model.places.size // 2)
    assert kept <= 14 * model.places.size
    vector = (np.sort(np.random.default_rng(5).choice(40_000, 600, replace=False)).astype(np.int32), np.ones(600, np.int32))
    w, every = index._weigh(vector), np.arange(index.n)
    tracemalloc.start()
    e, c = index._exact(vector, w, every)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000
    asked = np.zeros(40_000)
    asked[vector[0]] = w
    counts = pickle.loads(pickle.dumps(model)).counts
    assert counts.dtype == np.int32 and (counts == model.counts).all()
    full = (1 + np.log(counts)) * model.idf.weights[model.places]
    both = (asked[model.places] * full).reshape(index.n, -1).sum(1) / np.sqrt((full * full).reshape(index.n, -1).sum(1))
    assert np.allclose(c, both[e]) and set(np.argsort(-both)[:25].tolist()) <= set(e.tolist())


def test_trees_of_a_merge_stand_in_narrow_arrays():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257}
    codec = bpe.BpeCodec(ranks, r"\S+")
    pieces = [b"ab" * 500 + b"c"] * 256
    tracemalloc.start()
    ids = codec._merge_all(pieces, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.frombuffer(x, "<u4").tolist() == [257] * 250 + [99] for x in ids)
    assert peak < 18_000_000


def test_batches_are_bounded_in_bytes(spark):
    batches.ready(spark)

    def sizes(parts):
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(0, 2000, 1, 1).selectExpr("id", "repeat('x', 4000) as text").mapInArrow(sizes, "n long").collect()
    assert len(rows) > 1 and max(r.n for r in rows) <= 1.1 * batches.BATCH_BYTES
