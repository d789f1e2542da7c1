"""Prefix trie of conversations against plain Python and against SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from leadloom.llm import conversation_trie, queries
from leadloom.llm.oracles import ORACLES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """Nodes from rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 9, abs(c) % 5 * (1 if c > 0 else -1)
        built[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix in members:
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += not children.get(prefix)
            saved[prefix[:d]] += (len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
    out = []
    for prefix, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(built[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(found), len(prefix), parent, len(found), len(children.get(prefix, [])), leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, most=300):
    """Conversations of few different turns, some long, with nulls, ties, repeated rows and gaps in ids."""
    rng, rows = random.Random(seed), []
    for c in [*range(0, 60), 71, 73, 1000, -7, -3]:
        length = rng.choice([1, 1, 2, 3, 5, 9, 12, 20])
        for t in range(length):
            turn = rng.choice([t, t, t, 0, None])
            rows.append((c, turn, rng.choice(["user", "user", "user", None]), rng.choice(["a", "a", "a", "é b", "", None])))
    long = [("user" if t % 2 else "assistant", f"t{t % 7}") for t in range(most)]
    rows += [(200, t, *x) for t, x in enumerate(long)] + [(201, t, *x) for t, x in enumerate(long[: most - 9])] + [(205, t, *x) for t, x in enumerate(long)]
    rows += rows[:9] + [(None, 1, "user", "x"), (90, None, None, None)]
    return rows


@pytest.mark.parametrize("leaf", [2, 16, 64])
def test_trie_equals_plain_python(spark, leaf):
    rows = conversations(leaf, 300 if leaf > 2 else 23)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"chunk": F.lit(1), "n1": F.lit("x"), "bytes": F.lit(2.0), "depth": F.lit(None).cast("int")}).repartition(5)
    got = sorted((tuple(r) for r in conversation_trie.conversation_trie(df, leaf=leaf).select(COLUMNS).collect()), key=repr)
    assert got == plain_trie(rows)


def test_one_conversation_over_many_ranges(spark):
    """A conversation that most rows belong to is counted on over the ranges that it is dealt to."""
    rows = [(1, t // 2, "user", f"t{t % 2}") for t in range(4000)] + [(c, t, "user", "x") for c in range(2, 6) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = conversation_trie.ranked_turns(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r.conv_id, r["rank"]) for r in ranked) == [(1, t) for t in range(1, 4001)] + [(c, t) for c in range(2, 6) for t in (1, 2, 3)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(df).count() == 0


def test_query_equals_sql(spark):
    tables = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tables}/conversations.parquet'")
    want = con.sql(ORACLES["op12_conversation_trie"])
    order = [want.columns.index(c) for c in COLUMNS]
    got = queries.op12_conversation_trie(spark, tables).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
