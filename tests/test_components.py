"""Connected components by broadcasts and by shuffled joins, against union-find."""

import random

import pytest

from leadloom.plans import components


def edges_of(seed):
    rng = random.Random(seed)
    chain = [(k, k + 1) for k in range(1000, 1200)]
    hub = [(5, rng.randrange(2000, 2600)) for _ in range(400)]
    loose = [(rng.randrange(3000, 4000), rng.randrange(3000, 4000)) for _ in range(300)]
    return [*chain, *hub, *loose, (7, 7), (5, None)]


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("broadcast", [200_000, 300, 0])
def test_components_by_broadcasts_and_by_shuffled_joins(spark, monkeypatch, broadcast):
    monkeypatch.setattr(components, "BROADCAST_IDS", broadcast)
    edges = edges_of(3)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == union_find(edges)
    assert len(found) == len(union_find(edges))


def test_few_edges_take_few_tasks(spark, monkeypatch):
    files, write = {}, components.materialise

    def counted(df, name):
        out = write(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "materialise", counted)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        components.connected_components(spark.createDataFrame(edges_of(4), "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files["stars"]) <= spark.sparkContext.defaultParallelism
