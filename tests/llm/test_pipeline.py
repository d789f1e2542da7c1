"""The corpus pipeline over small tables equals its stages written out in plain Python."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from test_text import brute_components, brute_contamination, brute_scores

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, hash string, row int"


def made(tmp_path, spark, rows, labels, items):
    folder = str(tmp_path / "sf")
    n = lambda t: len(t) if t is not None else None
    docs = spark.createDataFrame([(d, t, "en", "s", n(t), "clash", 1) for d, t in rows], DOCUMENTS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_cut(rows):
    """Texts without their repeated bytes; those of which nothing is left go."""
    data = [(d, t, (t or "").encode()) for d, t in rows]
    count = {}
    for _, _, b in data:
        for i in range(len(b) - 199):
            count[b[i : i + 200]] = count.get(b[i : i + 200], 0) + 1
    out = []
    for d, t, b in data:
        cut = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                cut[i : i + 200] = b"\1" * 200
        if not any(cut):
            out.append((d, t))
        elif kept := bytes(x for x, y in zip(b, cut) if not y).decode("utf-8", "ignore"):
            out.append((d, kept))
    return out


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import tiktoken

    random.seed(31)
    words, bad = [f"word{i}" for i in range(400)], ["nasty", "vilest", "horrid"]
    para = lambda n: " ".join(random.choices(words, k=n))
    items = [(1, para(30)), (2, para(20)), (3, "just three words"), (4, None)]
    passage = para(60)
    rows, labels = [], []
    for i in range(160):
        w = para(random.randint(30, 90)).split()
        if i % 5 == 0:
            w[3:3] = random.sample(bad, 2)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + i, para(80) + " " + passage + " " + para(80)) for i in range(4)]
    rows += [(300, rows[1][1]), (301, rows[2][1].upper()), (302, rows[3][1] + " end"), (1, rows[1][1]), (None, rows[4][1]), (None, rows[4][1])]
    rows += [(400, items[1][1] + " " + para(20)), (401, para(300) + " " + " ".join(items[1][1].split()[:13])), (402, items[0][1])]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "é" * 300), (504, "x" * 900), (505, "nasty vilest horrid"), (506, "plain éñ text\0" + para(40))]
    folder = made(tmp_path, spark, rows, labels, items)

    # toxicity: learnt from the labels that are not held out
    import zlib

    texts = {}
    for d, t in rows:
        texts[d] = min(texts.get(d, t or ""), t or "")
    learnt = [(texts[d], y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    scores = brute_scores([t for _, t in rows], learnt)
    assert 20 < sum(s >= 0.3 for s in scores) < 45
    left = [r for r, s in zip(rows, scores) if s < 0.3]
    # near copies: of each component the document with the least id stays, once
    head = {d: c for d, _, c in brute_components(left, 5, 80)}
    kept, seen = [], set()
    for d, t in left:
        if d is None or (head[d] == d and d not in seen):
            kept.append((d, t))
            seen.add(d)
    assert len(kept) < len(left) - 3
    cut = plain_cut(kept)
    assert sum(len(t or "") for _, t in cut) < sum(len(t or "") for _, t in kept) - 300
    judged = {str(d) + (t or ""): bad for (d, t), bad in ((r, brute_contamination([r], items)[0][4]) for r in cut)}
    clean = [(d, t) for d, t in cut if not judged[str(d) + (t or "")]]
    assert len(clean) < len(cut)

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in clean:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()), tuple(ids)))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows = [(i, f"text number {i} of a few") for i in range(8)]
    folder = made(tmp_path, spark, rows, [(i, 1, i % 2) for i in range(4)], [(1, "nothing of it")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        out.collect()


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_over_empty_tables(spark, tmp_path, empty):
    tables = {"documents": [(1, "a few words"), (2, None)], "labels": [(1, 1, 0)], "benchmark": [(1, "other words")]} | {empty: []}
    folder = made(tmp_path, spark, tables["documents"], tables["labels"], tables["benchmark"])
    assert corpus_pipeline.run(spark, folder).count() == len(tables["documents"])
