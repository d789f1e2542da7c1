import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P

from leadloom.llm import bpe, token_counts, token_files
from leadloom.plans.storage import shared_dir

random.seed(4)
_ALPHA = " \n\t\r 　\x1c\x85ab'sSé1２!?漢字🙂́ΣςİK﻿|<'RELL.,ß"
ODD = ["".join(random.choice(_ALPHA) for _ in range(random.randint(0, 50))) for _ in range(200)]
TEXTS = [*ODD, "a" * 3000, "", None, "  ", "x  y   z \n\n w\n", "hi <|endoftext|> you", "ΟΔΟΣ. ΑΣΑ", "plain words, twice. plain words"]


def ranks(name):
    with open(P.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe_equals_library(frame):
    import tiktoken

    table = ranks("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[5])]
    got = bpe.encode_and_decode(frame(rows), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    want = sorted((i, enc.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in got)
    assert bpe.encode_and_decode(frame(rows).limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_files_round_trip(spark, frame):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i * 7, t) for i, t in enumerate(TEXTS)]
    path = shared_dir(spark, "t")
    token_files.write_token_files(frame(rows), path, P.path("word_bpe_49k.json"), 2)
    got = {r["doc_id"]: r for r in token_files.with_crc32(token_files.read_token_files(spark, path)).collect()}
    at = 0
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    pruned = token_files.read_token_files(spark, path).filter("doc_id = 14")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,14)" in pruned
    empty = shared_dir(spark, "t")
    token_files.write_token_files(frame(rows).limit(0), empty, P.path("word_bpe_49k.json"), 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_of_null_and_repeated_ids(spark, frame):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(None, "no id"), (None, None), (4, "four"), (4, "four"), (4, "and another four"), (1, "one"), (9, "")]
    path = shared_dir(spark, "t")
    token_files.write_token_files(frame(rows), path, P.path("word_bpe_49k.json"), 2)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 4, 4, 4, 9]
    encode = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == sorted((d or -1, encode(t)) for d, t in rows)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]


def test_token_files_have_indexes_bloom_filters_and_stripe_statistics(spark):
    """Read from the written files: row groups of 1,000 rows, their least and largest ids, and filters on the id."""
    path = shared_dir(spark, "t")
    docs = spark.range(0, 5000, 2).selectExpr("id as doc_id", "concat('word', id) as text")
    token_files.write_token_files(docs, path, P.path("word_bpe_49k.json"), 2, parts=1)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
    conf = spark._jsc.hadoopConfiguration()
    name = next(f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().startswith("part-"))
    reader = jvm.org.apache.orc.OrcFile.createReader(name, jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000
    column = reader.getStripeStatistics()[0].getColumnStatistics()[1]
    assert (column.getMinimum(), column.getMaximum()) == (0, 4998)
    filters = gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
    for k in range(len(filters)):
        filters[k] = k == 1
    index = reader.rows().readRowIndex(0, None, filters)
    groups = index.getRowGroupIndex()[1].getEntryList()
    least = [groups[k].getStatistics().getIntStatistics().getMinimum() for k in range(len(groups))]
    blooms = index.getBloomFilterIndex()[1].getBloomFilterList()
    assert least == [0, 2000, 4000] and len(blooms) == 3 and blooms[0].getNumHashFunctions() > 0
    assert [r["doc_id"] for r in token_files.read_token_files(spark, path).filter("doc_id = 2468").collect()] == [2468]


def test_word_encoder_forgets_and_takes_long_texts_without_blanks():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from leadloom.llm.word_ids import WordEncoder

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    small = WordEncoder(P.path("word_bpe_49k.json"), remembered=2_000)
    texts = [*[t or "" for t in TEXTS], "x1" * 30_000, "“quoted” it’s 'sure'‘s …'s \"'s", "漢字" * 4000, " ".join(f"w{i}" for i in range(500))]
    for _ in range(2):
        ids, sizes = small.encode(pa.array([*texts, None]))
        at = 0
        for t, n in zip([*texts, ""], sizes.tolist()):
            assert ids[at : at + n].tolist() == tok.encode(t, add_special_tokens=False).ids
            at += n
    assert small.encode(pa.array([], pa.string()))[0].size == 0


def test_memory_of_pieces_is_bounded_in_bytes():
    from leadloom.llm.batches import Memo

    memo, asked = Memo(lambda new: [p.encode() * 2 for p in new], most=1_000_000), []
    for k in range(40):
        piece = chr(97 + k % 26) * 100_000 + str(k)
        memo.learn([piece, "x"])
        asked.append(memo[piece] == piece.encode() * 2 and memo["x"] == b"xx")
        assert sum(map(len, memo)) + sum(map(len, memo.values())) < 1_400_000
    assert all(asked)


def test_texts_of_ten_megabytes_without_blanks(spark):
    """One line of letters and digits, and one of ideographs with stops: counted whole, without memory of their pieces."""
    import tiktoken
    from tokenizers import Tokenizer

    from leadloom.llm import ngram_join, repetition

    line = hashlib.sha256(b"x").hexdigest()
    texts = [(1, line * 160_000), (2, "漢字假名。" * 20_000), (3, "short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks("byte_bpe_50k.tiktoken"), special_tokens={})
    got = dict(map(tuple, token_counts.document_lengths(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()))
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in texts}
    coded = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in bpe.encode_and_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert all(coded[i][1] == hashlib.sha256(t.encode()).hexdigest() for i, t in texts)
    path = shared_dir(spark, "t")
    token_files.write_token_files(docs, path, P.path("word_bpe_49k.json"), 2)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in token_files.read_token_files(spark, path).collect()} == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts}
    assert {r["doc_id"]: r["n_shingles"] for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r["doc_id"]: r["n_words"] for r in repetition.repetition_quality(docs).collect()} == {1: 1, 2: 1, 3: 1}


def test_histogram(spark, frame):
    lengths = spark.createDataFrame([(i, n) for i, n in enumerate([0, 0, 3, 3, 3, 200, 5000, 127, 128])], "doc_id long, n_tokens long")
    h = token_counts.length_histogram(lengths)
    all_ = [0, 0, 3, 3, 3, 200, 5000, 127, 128]
    for r in h.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == all_.count(n) and r["docs_reaching"] == sum(x >= n for x in all_) and r["tokens_reaching"] == sum(x for x in all_ if x >= n)
        assert r["tokens_cut"] == sum(min(x, n) for x in all_) and abs(r["share_below_or_at"] - sum(x <= n for x in all_) / 9) < 1e-12
    assert token_counts.quantile(h, 0.5) == 3 and [token_counts.cut_total(h, k) for k in (0, 2, 128, 9999)] == [sum(min(x, k) for x in all_) for k in (0, 2, 128, 9999)]
    assert token_counts.length_histogram(lengths.limit(0)).count() == 0
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks("byte_bpe_50k.tiktoken"), special_tokens={})
    rows = list(enumerate(TEXTS))
    got = dict(map(tuple, token_counts.document_lengths(frame(rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()))
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
