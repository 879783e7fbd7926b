"""Hand-checked cases of the core operators."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster, explore, graph, itemsets, recommend, similarity, sketch
from millrace.plans import registry

RNG = random.Random(3)


# exploration


def test_explore(spark, rows):
    reviews = spark.createDataFrame(
        [("r1", "u1", "b1", 4.0, "2016-01-02", "The soup, the SOUP\nÉclair"), ("r1", "u1", "b1", 4.0, "2016-01-02", None), ("r2", "u2", "b2", 2.0, None, "good [food]"), ("r3", None, "b9", None, "2017-1-1", "")],
        "review_id string, user_id string, business_id string, stars double, date string, text string",
    )
    stop = spark.createDataFrame([("the",), (" The ",), ("",)], "word string")
    assert rows(explore.count_distinct(reviews, "review_id")) == [(3,)]
    assert rows(explore.rows_in_year(reviews, "date", "2016", "review_id")) == [(1,)]
    assert rows(explore.rows_in_year(reviews, "date", "1999", "review_id")) == [(0,)]
    assert [tuple(r) for r in explore.top_counts(reviews, "user_id", 5).collect()] == [("u1", 2), ("u2", 1)]
    assert [tuple(r) for r in explore.top_words(reviews, "text", stop, 9).collect()] == [("food", 1), ("good", 1), ("soup", 1), ("soup\nÉclair", 1)]
    one = explore.review_summary(reviews, stop, "2016", 1, 1).first()
    assert (one["a"], one["b"], one["c"], one["d"][0]["user_id"], one["e"][0]["word"]) == (3, 1, 2, "u1", "food")
    assert rows(explore.frequent_keys(reviews, "business_id", 1)) == [("b1", 2)]


def test_categories(spark, rows):
    reviews = spark.createDataFrame([("b1", 4.0), ("b1", 2.0), ("b2", 5.0), ("b2", None), ("b4", 1.0)], "business_id string, stars double")
    businesses = spark.createDataFrame([("b1", "A, B"), ("b2", "B "), ("b3", "C"), ("b4", None)], "business_id string, categories string")
    assert rows(explore.category_avg_stars(reviews, businesses)) == [("A", 3.0), ("B", round(11 / 3, 6)), ("None", 1.0)]
    assert [r["category"] for r in explore.category_avg_stars(reviews, businesses, 2).collect()] == ["B", "A"]


def test_partition_profile(spark, rows):
    df = spark.createDataFrame([(c,) for c in "aaabbz"], "k string")
    assert rows(explore.partition_profile(df, 4, placement=F.ascii("k"))) == [(0, 0), (1, 3), (2, 3), (3, 0)]
    for got in (explore.partition_profile(df, 3), explore.partition_profile(df, 3, "k")):
        assert [p for p, _ in rows(got)] == [0, 1, 2] and sum(n for _, n in rows(got)) == 6
    assert explore.partition_count(df.repartition(5)) == 5


# itemsets


def test_itemsets(spark, rows):
    df = spark.createDataFrame([(u, b) for u, bs in {"1": "abc", "2": "ab", "3": "ac", "4": "bc", "5": "abc"}.items() for b in bs] + [("1", "a"), ("user_id", "business_id"), (None, "a"), ("6", " ")], "user_id string, business_id string")
    base = itemsets.baskets(df)
    got = itemsets.frequent_itemsets(base, 3)
    assert sorted((",".join(r["itemset"]), r["count"]) for r in got.collect()) == [("a", 4), ("a,b", 3), ("a,c", 3), ("b", 4), ("b,c", 3), ("c", 4)]
    assert [r["itemset"] for r in itemsets.candidate_itemsets(got).where("size = 3").collect()] == [["a", "b", "c"]]
    assert itemsets.frequent_itemsets(base, 99).count() == 0
    assert rows(itemsets.large_baskets(base, 2).select("basket").distinct()) == [("1",), ("5",)]
    assert itemsets.baskets(df, 2).where("basket = 'a'").count() == 4


@pytest.mark.parametrize("support", [2, 4])
def test_itemsets_against_brute_force_and_fp_growth(spark, support):
    baskets = {str(k): {RNG.choice("abcdefg") for _ in range(RNG.randint(1, 6))} for k in range(40)}
    want = Counter(c for s in baskets.values() for k in range(1, 8) for c in combinations(sorted(s), k))
    want = {c: n for c, n in want.items() if n >= support}
    base = spark.createDataFrame([(b, i) for b, s in baskets.items() for i in s], "basket string, item string")
    for got in (itemsets.frequent_itemsets(base, support), itemsets.fp_growth_itemsets(base, support)):
        assert {tuple(r["itemset"]): r["count"] for r in got.collect()} == want
    for c in want:  # every subset is at least as frequent
        assert all(want[s] >= want[c] for s in combinations(c, len(c) - 1) if s)


def test_state_baskets(spark, rows):
    reviews = spark.createDataFrame([("u", "b1"), ("u", "b1"), ("u", "b2")], "user_id string, business_id string")
    businesses = spark.createDataFrame([("b1", "NV"), ("b2", "AZ")], "business_id string, state string")
    assert rows(itemsets.state_baskets(reviews, businesses)) == [("u", "b1")]


# similarity


def _sets(spark):
    return {"a": set(range(10)), "b": set(range(10)), "c": set(range(5, 15)), "d": {99}, "e": set(range(100, 120)), "f": {100}}


def test_jaccard_and_lsh(spark, rows):
    sets = _sets(spark)
    df = spark.createDataFrame([(k, str(v)) for k, s in sets.items() for v in s], "id string, member string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    exact = {(r["a"], r["b"]): r["sim"] for r in similarity.jaccard_pairs(df, 0.05).collect()}
    assert exact == pytest.approx({p: s for p, s in want.items() if s >= 0.05}) and exact["e", "f"] == 0.05 and exact["a", "b"] == 1
    found = {(r["a"], r["b"]): r["sim"] for r in similarity.lsh_pairs(df).collect()}
    assert set(found) <= set(exact) and all(found[p] == exact[p] for p in found) and ("a", "b") in found
    signatures = {r["id"]: r["signature"] for r in similarity.minhash_signatures(df, 30).collect()}
    assert signatures["a"] == signatures["b"] and len(signatures["d"]) == 30


def test_lsh_default_finds_pairs_near_the_threshold(spark):
    data = [(f"{side}{k:02}", f"{k}-{side if i else ''}{i}") for k in range(60) for side in "xy" for i in range(6)]
    df = spark.createDataFrame(data, "id string, member string")  # 60 pairs of 1 common member in 11
    found = {(r["a"], r["b"]) for r in similarity.lsh_pairs(df).collect()}
    assert len(found & {(f"x{k:02}", f"y{k:02}") for k in range(60)}) >= 54
    assert len(similarity.minhash_signatures(df).first()["signature"]) == 1000


# recommenders


def _rated(spark, data):
    return spark.createDataFrame(data, "user string, item string, stars double")


def test_pearson(spark, rows):
    data = [("u1", "a", 1.0), ("u2", "a", 3.0), ("u3", "a", 5.0), ("u1", "b", 2.0), ("u2", "b", 3.0), ("u3", "b", 4.0), ("u1", "c", 3.0), ("u2", "c", 3.0), ("u3", "c", 3.0), ("u1", "d", 5.0), ("u2", "d", 1.0), ("u1", "e", 5.0), ("u2", "e", 3.0), ("u3", "e", 1.0)]
    assert rows(recommend.pearson_model(_rated(spark, data))) == [("a", "b", 1.0)]  # c: no variance, d: two raters, e: negative


def test_pearson_with_popular_raters(spark, rows):
    data = [(f"u{u}", f"i{i}", float(RNG.randint(1, 5))) for u in range(14) for i in range(12) if u < 3 or RNG.random() < 0.5]
    rated = _rated(spark, data)
    assert rows(recommend.pearson_model(rated, block=7)) == rows(recommend.pearson_model(rated)) != []


def test_ratings_and_item_forecast(spark, rows):
    raw = spark.createDataFrame([("u", "a", 4.0), (" u", "a ", 2.0), (None, "a", 1.0), ("u", "b", 5.0), ("u", "c", 1.0), ("u", "d", 2.0), ("u", "e", None)], "user_id string, business_id string, stars double")
    rated = recommend.ratings(raw)
    assert rows(rated.where("item = 'a'")) == [("u", "a", 3.0)]
    model = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.5), ("c", "x", 0.5), ("d", "x", 0.25), ("w", "x", 0.9)], "a string, b string, sim double")
    pairs = recommend.test_pairs(spark.createDataFrame([("u", "x"), ("u", "x"), (None, "x"), ("u", "y"), ("v", "x")], "user_id string, business_id string"))
    assert rows(recommend.predict_by_items(pairs, rated, model)) == [("u", "x", 3.0)]
    assert rows(recommend.predict_by_items(pairs, rated, model, 2)) == [("u", "x", 3.0)]  # ties: the later ids c and b


def test_user_forecast(spark, rows):
    rated = _rated(spark, [("u", "a", 5.0), ("v", "a", 2.0), ("v", "x", 4.0), ("w", "x", 5.0), ("w", "b", 1.0), ("z", "x", 3.0)])
    model = spark.createDataFrame([("u", "v", 0.5), ("u", "w", 0.5)], "a string, b string, sim double")
    pairs = spark.createDataFrame([("u", "x"), ("z", "x")], "user string, item string")
    assert rows(recommend.predict_by_users(pairs, rated, model)) == [("u", "x", 5.0)]  # 5 + (0.5 * 2 + 0.5 * 4) / 1, capped


def test_content(spark, rows):
    df = spark.createDataFrame([("b1", "So\nup soup-bar the 42"), ("b1", "soup"), ("b2", "salad the"), (None, "soup"), ("b3", None)], "business_id string, text string")
    words = recommend.content_words(df, spark.createDataFrame([("the",)], "word string"))
    assert rows(words.where("item = 'b1'"), "word") == [("soup",), ("soup",), ("soupbar",)]
    profiles = recommend.item_profiles(words)
    assert rows(profiles) == [("b1", "soup", 1.0), ("b1", "soupbar", 0.5), ("b2", "salad", 1.0)]
    assert rows(recommend.item_profiles(words, top=1), "word") == [("salad",), ("soup",)]
    assert [(r["item"], r["words"]) for r in recommend.indexed_profiles(profiles).orderBy("item").collect()] == [("b1", [1, 2]), ("b2", [0])]
    users = recommend.user_profiles(_rated(spark, [("u", "b1", 1.0), ("u", "zz", 1.0)]), profiles)
    assert rows(users) == [("u", "soup"), ("u", "soupbar")]
    pairs = spark.createDataFrame([("u", "b1"), ("u", "b2"), ("nobody", "b1")], "user string, item string")
    assert rows(recommend.predict_by_content(pairs, users, profiles)) == [("u", "b1", 1.0)]


# graphs


def _edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "a string, b string")


def _random_graph(n, m):
    return sorted({tuple(sorted(RNG.sample([f"v{k:02d}" for k in range(n)], 2))) for _ in range(m)})


def _brute_betweenness(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def paths(s, t):
        level = [[s]]
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in p]
        return []

    total = dict.fromkeys(pairs, 0.0)
    for s, t in combinations(sorted(near), 2):
        found = paths(s, t) if len(near) < 12 else []
        for p in found:
            for e in zip(p, p[1:], strict=False):
                total[tuple(sorted(e))] += 1 / len(found)
    return total


def test_betweenness(spark, rows):
    assert rows(graph.edge_betweenness(_edges(spark, ["ab", "bc", "cd"]))) == [("a", "b", 3.0), ("b", "c", 4.0), ("c", "d", 3.0)]
    for n, m in ((8, 11), (9, 9)):
        pairs = _random_graph(n, m)
        got = {(r["a"], r["b"]): r["betweenness"] for r in graph.edge_betweenness(spark.createDataFrame(pairs, "a string, b string")).collect()}
        assert got == pytest.approx(_brute_betweenness(pairs))
    assert graph.edge_betweenness(_edges(spark, ["ab"]).where("false")).count() == 0


def test_components_and_labels(spark, rows):
    chain = [f"{chr(97 + k)}{chr(98 + k)}" for k in range(20)]
    got = dict(rows(graph.components(_edges(spark, [*chain, "AB", "BC"]))))
    assert set(got.values()) == {"a", "A"} and sum(v == "A" for v in got.values()) == 3
    labels = graph.label_propagation(_edges(spark, ["ab", "ac", "bc", "xy"]), 5)
    assert {v: c for v, c in rows(labels) if v in "abc"} == {"a": "a", "b": "a", "c": "a"}
    assert graph.components(_edges(spark, ["ab"]).where("false")).count() == 0


def test_components_take_few_rounds(spark, rows):
    """Paths whose names are shuffled, ordered, or alternate between the ends."""
    import math

    n = 300
    shuffled = [f"v{k:04d}" for k in RNG.sample(range(n), n)]
    ordered = [f"v{k:04d}" for k in range(n)]
    zigzag = [f"v{(k // 2 if k % 2 else n - 1 - k // 2):04d}" for k in range(n)]
    for names in (shuffled, ordered, zigzag):
        edges = spark.createDataFrame([(min(p), max(p)) for p in zip(names, names[1:], strict=False)], "a string, b string").repartition(4)
        took: list = []
        got = dict(rows(graph.components(edges, contract=False, rounds=took)))
        assert len(got) == n and set(got.values()) == {"v0000"} and len(took) <= 2 * math.log2(n) + 4
    took = []
    assert set(dict(rows(graph.components(edges, rounds=took))).values()) == {"v0000"} and len(took) <= 6


def test_hot_keys_meet_in_blocks(spark, rows):
    """The same pairs whether a hot key is cut into blocks or not."""
    from millrace.plans.store import meet

    df = spark.createDataFrame([(f"i{k:03d}", "hot" if k % 3 else f"c{k % 7}") for k in range(150)] + [("i001", "c1")], "i string, k string")
    want = rows(meet(df, ["k"], "i").select("l.k", "l.i", F.col("r.i").alias("j")))
    assert rows(meet(df, ["k"], "i", 10).select("l.k", "l.i", F.col("r.i").alias("j"))) == want
    assert len(want) == sum(1 for (a, k), (b, j) in combinations(sorted(rows(df)), 2) if k == j and a != b)
    sets = spark.createDataFrame([(f"s{k}", m) for k in range(40) for m in ("hot", f"m{k % 9}", f"n{k}")], "id string, member string")
    assert rows(similarity.jaccard_pairs(sets, 0.2, 4)) == rows(similarity.jaccard_pairs(sets, 0.2))
    baskets = sets.select(F.col("id").alias("basket"), F.col("member").alias("item"))
    assert rows(graph.cooccurrence_edges(baskets, 2, 4)) == rows(graph.cooccurrence_edges(baskets, 2)) != []


def test_jaccard_against_brute_force(spark):
    sets = {f"s{k:02d}": {f"m{int(RNG.expovariate(0.08))}" for _ in range(RNG.randint(1, 40))} for k in range(60)}
    df = spark.createDataFrame([(k, m) for k, s in sets.items() for m in s], "id string, member string")
    for least in (0.05, 0.3, 0.5, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
        for prefix in (True, False):
            got = {(r["a"], r["b"]): r["sim"] for r in similarity.jaccard_pairs(df, least, 8, prefix).collect()}
            assert got == pytest.approx({p: s for p, s in want.items() if s >= least})


def test_signatures_of_sets_signed_in_parts(spark, rows):
    df = spark.createDataFrame([(f"s{k % 3}", f"m{k}") for k in range(600)] + [("one", "m1")], "id string, member string").repartition(5)
    assert rows(similarity.minhash_signatures(df, 40, part=50)) == rows(similarity.minhash_signatures(df, 40))


def test_modularity(spark, rows):
    edges = _edges(spark, ["ab", "bc", "ac", "de", "ef", "df", "cd"])
    labels = spark.createDataFrame([(v, "x" if v in "abc" else "y") for v in "abcdef"], "v string, c string")
    assert rows(graph.modularity(edges, labels, "c")) == [(round(2 * (3 / 7 - (7 / 14) ** 2), 9),)]


def test_girvan_newman(spark, rows):
    edges = _edges(spark, ["ab", "bc", "ac", "de", "ef", "df", "cd"])
    got = rows(graph.girvan_newman(edges))
    assert {(v, c) for v, c, _ in got} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d")} and got[0][2] == round(2 * (3 / 7 - 0.25), 9)
    two = rows(graph.girvan_newman(_edges(spark, ["ab", "xy"])))
    assert {(v, c) for v, c, _ in two} == {("a", "a"), ("b", "b"), ("x", "x"), ("y", "x")}  # the unsplit graph isn't scored


def test_girvan_newman_step_by_step(spark, rows):
    """A component that is too large for a task comes apart in the same way."""
    edges = _edges(spark, ["ab", "bc", "ac", "cd", "xy"])
    assert rows(graph.girvan_newman(edges, most_edges=3)) == rows(graph.girvan_newman(edges))


def test_betweenness_in_parts(spark, rows):
    edges = spark.createDataFrame(_random_graph(12, 20), "a string, b string")
    want = rows(graph.edge_betweenness(edges, 6))
    assert rows(graph.edge_betweenness(edges, 6, sources=4, sent=0)) == rows(graph.edge_betweenness(edges, 6, sent=0)) == want


def test_girvan_newman_against_brute_force(spark, rows):
    for n, m in ((8, 10), (10, 12)):
        pairs = _random_graph(n, m)
        near = defaultdict(set)
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        vs, live, best, chosen, closed = sorted(near), list(pairs), 0.0, None, False

        def parts(edges):
            of = {v: {v} for v in vs}
            for a, b in edges:
                if of[a] is not of[b]:
                    of[a] |= of[b]
                    for v in of[b]:
                        of[v] = of[a]
            return {min(s): s for s in of.values()}

        chosen = parts(live)
        while live:
            bt = graph._betweenness({v: {w for e in live for w in e if v in e and w != v} for v in vs}, vs)
            live.remove(min(bt, key=lambda e: (-round(bt[e], 9), e)))
            p = parts(live)
            q = sum(sum(a in s and b in s for a, b in pairs) / len(pairs) - (sum(len(near[v]) for v in s) / (2 * len(pairs))) ** 2 for s in p.values() if len(s) > 1)
            if q > best + 1e-12:
                best, chosen, closed = q, p, False
            elif abs(q - best) <= 1e-12 and best > 0 and not closed:
                chosen = p
            else:
                closed = True
            if q < best - 0.05:
                break
        edges = spark.createDataFrame(pairs, "a string, b string")
        got = rows(graph.girvan_newman(edges))
        assert {(v, c) for v, c, _ in got} == {(v, c) for c, s in chosen.items() for v in s} and got[0][2] == pytest.approx(best, abs=1e-8)


def test_cooccurrence_edges(spark, rows):
    df = spark.createDataFrame([(u, i) for u, s in {"u": "abc", "v": "abd", "w": "a"}.items() for i in s], "basket string, item string")
    assert rows(graph.cooccurrence_edges(df, 2)) == [("u", "v", 2)]


# clustering


def _points(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(x)], "id long, features array<double>")


def test_kmeans(spark, rows):
    x = np.concatenate([np.random.default_rng(k).normal(10 * k, 0.5, (30, 3)) for k in range(3)])
    pts = _points(spark, x)
    centroids = cluster.kmeans(pts, 3)
    labels = dict(rows(cluster.assign(pts, centroids)))
    assert all(len({labels[k] for k in range(30 * c, 30 * c + 30)}) == 1 for c in range(3)) and len(set(labels.values())) == 3
    assert len(cluster.kmeans(_points(spark, [[1, 1]] * 5), 3)) == 1  # fewer distinct points than clusters
    assert cluster.kmeans(pts.where("false"), 3).size == 0
    assert np.allclose(cluster.kmeans(pts, 3, local=0), centroids) and cluster.kmeans(pts.where("false"), 3, local=0).size == 0


def test_mahalanobis(spark):
    df = spark.createDataFrame([([3.0, 5.0], 4, [4.0, 20.0], [8.0, 100.0])], "f array<double>, n long, s array<double>, q array<double>")
    assert df.select(cluster.mahalanobis("f", "n", "s", "q")).first()[0] == pytest.approx(2.0)  # second dimension without variance
    s = cluster.Summary(np.array([4]), np.array([[4.0, 20.0]]), np.array([[8.0, 100.0]]))
    assert s.distances(np.array([[3.0, 6.0]]))[0, 0] == pytest.approx(5**0.5)


def test_summaries_merge():
    s = cluster.Summary(np.array([1, 2, 3]), np.arange(6.0).reshape(3, 2), np.ones((3, 2)))
    m = s.merge(np.array([0, 1, 0]))
    assert m.n.tolist() == [4, 2] and m.sums.sum() == s.sums.sum() and m.squares.sum() == s.squares.sum()


def test_empty_chunks_and_negative_ids(spark, rows, tmp_path):
    x = np.concatenate([np.random.default_rng(k).normal(20 * k, 1.0, (40, 2)) for k in range(2)])
    pts = _points(spark, x)
    none = pts.where("false")
    got = cluster.cluster_chunks([none, pts.where("id % 2 = 0"), none, pts.where("id % 2 = 1")], 2)
    assert sorted(k for k, _ in rows(got.labels)) == list(range(80))
    assert [r[0] for r in got.rounds] == [1, 2, 3, 4] and got.rounds[0] == (1, 0, 0, 0, 0, 0) and got.rounds[-1][2] + got.rounds[-1][5] == 80
    assert [tuple(r) for r in cluster.cluster_chunks([none, none], 2).rounds] == [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0)]
    pts.select((F.col("id") - 40).alias("vec_id"), F.col("features").alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(k for k, _ in rows(registry.queries()["chunked_labels"](spark, str(tmp_path)))) == list(range(-40, 40))


def test_chunks(spark, rows):
    x = np.concatenate([np.random.default_rng(k).normal(20 * k, 1.0, (100, 2)) for k in range(3)] + [np.array([[500.0, -500.0]])])
    order = np.random.default_rng(9).permutation(len(x))
    pts = _points(spark, x[order])
    got = cluster.cluster_chunks([pts.where(F.col("id") % 3 == k) for k in range(3)], 3)
    labels = rows(got.labels)
    assert sorted(k for k, _ in labels) == list(range(301))  # every point once
    assert got.rounds[-1][2] + got.rounds[-1][5] == 301 and got.rounds[-1][3] == 0
    truth = spark.createDataFrame([(k, int(min(order[k] // 100, 3))) for k in range(301)], "id long, t int")
    assert cluster.nmi(got.labels.join(truth, "id"), "cluster", "t").first()[0] > 0.9
    assert dict(labels)[int(np.flatnonzero(order == 300)[0])] == -1


def test_nmi(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "a int, b int")
    assert cluster.nmi(df, "a", "b").first()[0] == 1.0
    assert cluster.nmi(spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int"), "a", "b").first()[0] == 0.0


# sketches


def test_bytes_mod(spark):
    words = ["Montréal", "", "a", "x" * 500]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(sketch.bytes_mod("w", 24593)).collect()] == [int.from_bytes(w.encode(), "big") % 24593 for w in words]
    assert sketch.bloom_multipliers() == [55, 64, 42, 16, 3, 34, 63, 76]


def test_bloom(spark, rows):
    inside = spark.createDataFrame([(f"city{k}",) for k in range(300)] + [("",), (None,)], "c string")
    built = sketch.bloom_build(inside, "c")
    got = dict(rows(sketch.bloom_probe(inside, "c", built)))
    assert got[""] == 0 and got[None] == 0 and all(got[f"city{k}"] == 1 for k in range(300))
    outside = sketch.bloom_probe(spark.createDataFrame([(f"town{k}",) for k in range(300)], "c string"), "c", built)
    assert outside.where("seen = 1").count() < 30
    assert sketch.bloom_probe(inside, "c", built.where("false")).where("seen = 1").count() == 0


def test_fm(spark, rows):
    zeros = spark.createDataFrame([(0,), (8,), (7,), (256,)], "x long").select(sketch.fm_zeros(F.col("x"), 1, 0)).collect()
    assert [r[0] for r in zeros] == [8, 3, 0, 8]
    df = spark.createDataFrame([("g", f"v{k % 60}") for k in range(500)] + [("e", ""), ("e", None)], "g string, v string")
    got = rows(sketch.fm_distinct(df, "v", ["g"]))
    assert len(got) == 1 and got[0][1] == 60 and 10 < got[0][2] < 300


def test_tags(spark, rows):
    df = spark.createDataFrame([("#Fun and #fun #Fun",), ("#x1 # ##a #Fun #Sad",), (None,)], "t string")
    tags = sketch.hashtags(df, "t")
    assert [tuple(r) for r in sketch.top_tags(tags, 1).collect()] == [("Fun", 3)]
    assert [tuple(r) for r in sketch.top_tags(tags, 2).collect()] == [("Fun", 3), ("Sad", 1), ("fun", 1)]
    changes = spark.createDataFrame([("a", 1), ("a", 1), ("a", -1), ("b", 1), ("b", -1)], "tag string, sign int")
    assert rows(sketch.count_changes(changes, "sign")) == [("a", 1)]


def test_reservoir(spark, rows):
    df = spark.range(1000).withColumnRenamed("id", "k")
    whole = rows(sketch.reservoir(df, "k", 50), "k")
    parts = sketch.reservoir(df.where("k < 300"), "k", 50).unionByName(sketch.reservoir(df.where("k >= 300"), "k", 50)).drop("priority")
    assert len(whole) == 50 and rows(sketch.reservoir(parts, "k", 50), "k") == whole
    assert sketch.reservoir(df.limit(7), "k", 50).count() == 7
    assert sketch.reservoir(spark.range(4_000_000_000_000, 4_000_000_001_000).withColumnRenamed("id", "k"), "k", 50).count() == 50
    assert sketch.reservoir(spark.createDataFrame([("a",), (None,)], "k string"), "k", 50).count() == 2
    big = spark.range(20_000).withColumnRenamed("id", "k")
    low = sum(r["k"] < 10_000 for r in sketch.reservoir(big, "k", 2000).collect())
    assert 880 < low < 1120  # uniform


def test_hll(spark, rows):
    df = spark.range(60_000).selectExpr("concat('v', id % 30000) v", "cast(id % 2 as string) g")
    assert all(abs(n - 15_000) < 450 for _, n in rows(sketch.hll_distinct(df, "v", ["g"])))


def test_peaks(spark, rows):
    df = spark.createDataFrame(list(enumerate([0.1, 0.4, 0.4, 0.2, 0.4])), "i int, q double")
    assert rows(sketch.peaks(df, "i", "q"), "i") == [(2,), (4,)]
