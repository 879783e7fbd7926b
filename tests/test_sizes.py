"""What is exchanged where many rows share a key: it grows with the rows, not with their pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans import registry


def exchanged(spark, run):
    """MB that the tasks of run() exchange, and its result."""
    facts = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6
    before = facts()
    got = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return facts() - before, got


def _baskets(n, items, each, seed=1):
    rng = random.Random(seed)
    return {f"basket-{rng.getrandbits(60):020d}": {f"item{min(int(rng.expovariate(8 / items)), items - 1):04d}" for _ in range(each)} for _ in range(n)}


def _rows(spark, baskets):
    return spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s], "basket string, item string")


def test_cooccurrence_exchanges_no_pairs(spark):
    """800 baskets that nearly all share items with each other."""
    baskets = _baskets(800, 400, 14)
    want = {(a, b, n) for a, b in combinations(sorted(baskets), 2) if (n := len(baskets[a] & baskets[b])) >= 4}
    rows = _rows(spark, baskets)
    mb, got = exchanged(spark, lambda: graph.cooccurrence_edges(rows, 4).collect())
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0
    assert mb < 2
    twice = graph.cooccurrence_edges(rows.unionByName(rows).unionByName(rows.limit(1).select(F.lit(None).cast("string").alias("basket"), "item")), 4, 3000)
    assert {tuple(r) for r in twice.collect()} == want


@pytest.mark.parametrize("name", ["graph_communities", "label_propagation", "graph_components", "graph_modularity"])
def test_graph_queries_exchange_no_pairs(spark, tmp_path, name):
    """the queries that build on those edges."""
    rows = _rows(spark, _baskets(800, 400, 14)).select(F.col("basket").alias("user_id"), F.col("item").alias("business_id"))
    rows.write.parquet(f"{tmp_path}/user_business.parquet")
    mb, n = exchanged(spark, lambda: registry.queries()[name](spark, str(tmp_path)).count())
    assert n > 0 and mb < 5


def test_large_baskets_travel_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(graph, "PIECE", 5)
    baskets = _baskets(60, 60, 25)
    want = Counter({(a, b, n): 1 for a, b in combinations(sorted(baskets), 2) if (n := len(baskets[a] & baskets[b])) >= 3})
    assert Counter(tuple(r) for r in graph.cooccurrence_edges(_rows(spark, baskets), 3, 400).collect()) == want


def test_itemsets_exchange_no_pairs_of_a_large_basket(spark):
    """1,200 items of which one basket holds all."""
    from millrace.operators import itemsets

    baskets = {f"b{k}": {f"item{k % 40:04d}", f"item{(k + 1) % 40:04d}", f"item{(k + 2) % 40:04d}"} for k in range(80)}
    baskets |= {f"c{k}-{j}": {f"item{k:04d}"} for k in range(1200) for j in range(2)} | {"all": {f"item{k:04d}" for k in range(1200)}}
    mb, got = exchanged(spark, lambda: {(tuple(r["itemset"]), r["count"]) for r in itemsets.frequent_itemsets(_rows(spark, baskets), 3).collect()})
    counts = Counter(s for n in (1, 2, 3) for b in baskets.values() for s in combinations(sorted(b), n) if len(b) < 10)
    counts.update(s for s in list(counts) if set(s) <= baskets["all"])
    assert got == {(s, c) for s, c in counts.items() if c >= 3} and max(len(s) for s, _ in got) == 3
    assert mb < 4


def test_itemsets_of_many_sizes(spark):
    from millrace.operators import itemsets

    baskets = _baskets(60, 25, 9, seed=3)
    counts = Counter(s for b in baskets.values() for n in range(1, len(b) + 1) for s in combinations(sorted(b), n))
    for most in (None, 1, 2, 3):
        got = {(tuple(r["itemset"]), r["size"], r["count"]) for r in itemsets.frequent_itemsets(_rows(spark, baskets), 5, most).collect()}
        assert got == {(s, len(s), c) for s, c in counts.items() if c >= 5 and (most is None or len(s) <= most)}
    assert max(len(s) for s, c in counts.items() if c >= 5) > 3


def test_candidate_pairs_are_not_exchanged(spark):
    """900 frequent items have 404,550 candidate pairs."""
    from millrace.operators import itemsets

    found = spark.createDataFrame([([f"item{k:04d}"], 1, 9) for k in range(900)] + [(["item0001", "item0002"], 2, 5), (["item0001", "item0003"], 2, 5), (["item0002", "item0003"], 2, 5), (["item0002", "item0004"], 2, 5)], "itemset array<string>, size int, count long")
    mb, got = exchanged(spark, lambda: itemsets.candidate_itemsets(found).groupBy("size").agg(F.count("*").alias("n"), F.min("itemset").alias("least")).orderBy("size").collect())
    assert [tuple(r) for r in got] == [(2, 404_550, ["item0000", "item0001"]), (3, 1, ["item0001", "item0002", "item0003"])]
    assert mb < 2


def test_lsh_user_model_lists_no_buckets(spark):
    """F8: 1,500 users of one item each are a few classes of equal signatures."""
    from millrace.operators import recommend, similarity

    rng = random.Random(5)
    rated = [(f"single{k:05d}", f"item{k % 30:02d}", 3.0) for k in range(1500)] + [(f"user{k:02d}", f"item{i:02d}", float(rng.randint(1, 5))) for k in range(30) for i in rng.sample(range(30), 8)]
    df = spark.createDataFrame(rated, "user string, item string, stars double")
    mb, got = exchanged(spark, lambda: {tuple(r) for r in recommend.user_model_lsh(df).collect()})
    assert mb < 1
    sets = df.select(F.col("user").alias("id"), F.col("item").alias("member"))
    near = similarity.lsh_candidates(similarity.minhash_signatures(sets, 20, 15, 29, 15), 5, 4)
    want = recommend.pearson_model(df, "user", "item", 3, similarity.jaccard(near, sets, 0.01).select("a", "b"))
    assert got == {tuple(r) for r in want.collect()} and got


def test_betweenness_searches_only_its_component():
    """1,500 components of 10 vertices."""
    import time

    import numpy as np

    pairs = np.array([(10 * c + x, 10 * c + y) for c in range(1500) for x, y in combinations(range(10), 2)])
    began = time.time()
    g = graph._Adjacency(pairs[:, 0], pairs[:, 1])
    got = g.credits(np.arange(15_000))
    assert time.time() - began < 15 and np.allclose(got, 1.0) and len(got) == 2 * len(pairs)
