"""The n-gram join and components against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
from folianth.llm import ngram_join as J
from folianth.operators.components import components

from .common import HAVE, SF, documents, empty, rows, words


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(data):
    """(id, class, copy, links, shingles) of (id, text) rows."""
    sets = [shingles(t) if i is not None else frozenset() for i, t in data]
    n, root = [0] * len(data), list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least, copy = defaultdict(list), defaultdict(list)
    for k, (i, _) in enumerate(data):
        least[find(k)].append(i)
        copy[sets[k] or k].append(i)
    return Counter((i, min(least[find(k)]) if i is not None else None, min(copy[sets[k] or k]) if i is not None else None, n[k], len(shingles(t))) for k, (i, t) in enumerate(data))


def near_copies(seed, groups=12, vocabulary=400):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(vocabulary)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


def test_awkward_rows(spark):
    got = Counter(map(tuple, J.similarity_classes(documents(spark)).collect()))
    assert got == plain([(r[0], r[1]) for r in rows()])


def test_near_copies_lose_no_link(spark, monkeypatch):
    data = near_copies(5)
    monkeypatch.setattr(J, "BLOCK", 8)  # groups span many blocks
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, J.similarity_classes(df).collect())) == plain(data)


def test_one_of_each(spark):
    kept = J.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len([t for _, t in got if t and t.startswith("alpha beta")]) == 2  # of the copies one, and the row without an id
    assert {t for _, t in got} >= {None, "", "a", "tail\n", "another text under an id that exists"}


def test_empty(spark):
    assert J.similarity_classes(empty(spark)).count() == 0
    assert J.one_of_each(empty(spark)).count() == 0


def test_pruning_bound():
    """A pair at the threshold is dropped with a probability that its tolerance bounds."""
    rng = np.random.default_rng(1)
    needs = J.least_matches(0.8, 1e-7, 30, 150)
    assert [n for n, _ in needs] == [30, 60, 90, 120, 150]
    draws = rng.random((20000, 150)) < 0.8
    assert all((draws[:, :n].sum(1) >= need).all() for n, need in needs)
    assert not all(((rng.random((200, 150)) < 0.3)[:, :n].sum(1) >= need).any() for n, need in needs)


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (900, 800), (900, 800)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_equal_brute_force(spark):
    """All links of the driver's documents, long and hot ones among them."""
    if not HAVE:
        return
    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    data = [tuple(r) for r in df.collect()]
    assert Counter(map(tuple, J.similarity_classes(df).collect())) == plain(data)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",  # a partition is split by the tasks that wrote it, so there must be several
}


def test_a_hub_of_all_nodes_is_split(spark):
    """A star of 30,000 nodes: the executed plans split the joins on its centre."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions = lambda: [x for x in map(store.executionsList().apply, range(store.executionsList().size()))]
    before = max((x.executionId() for x in executions()), default=-1)
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(1, 30_000).selectExpr("id AS a", "0L AS b").union(spark.range(50_000, 80_000).selectExpr("id AS a", "id + 100000 AS b"))
        got = components(edges).groupBy("root").count().orderBy("root").collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert (got[0].root, got[0]["count"]) == (0, 30_000) and len(got) == 30_001
    assert sum(x.physicalPlanDescription().count("SortMergeJoin(skew=true)") for x in executions() if x.executionId() > before) >= 2


def test_blocks_of_large_groups():
    """Small groups keep their blocks; of large ones each text is copied for fewer pairs of blocks."""
    side = lambda n: max(J.BLOCK, min(J.LARGEST_BLOCK, J.BLOCK_GROWTH * n**0.5))
    assert [round(side(n)) for n in (10, 4096, 65_536, 1_000_000)] == [256, 256, 1024, 2048]
