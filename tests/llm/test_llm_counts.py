"""Pair counts, term counts, distinctive terms, similar sets, frequent values, top N: against brute force on dirty rows."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import cooccur, elite, queries
from millrace.llm.cooccur import cooccurrence
from millrace.llm.elite import distinctive_terms, fit_two_poisson, most_distinctive
from millrace.llm.heavy import frequent_values
from millrace.llm.simjoin import similar_sets
from millrace.llm.termfreq import BurstTrie, term_frequency
from millrace.llm.topn import top_n

RNG = random.Random(11)


def _pairs(data, min_pairs, lift):
    baskets = defaultdict(set)
    for u, b in data:
        if u and b and u.strip() and b.strip() and u.strip() != "u" and b.strip() != "b":
            baskets[u.strip(" ")].add(b.strip(" "))
    n = len(baskets)
    single, both = Counter(), Counter()
    for s in baskets.values():
        single.update(s)
        both.update(combinations(sorted(s), 2))
    return sorted((a, b, single[a], single[b], c, n) for (a, b), c in both.items() if c >= min_pairs and (not lift or c * n >= lift * single[a] * single[b]))


def test_pairs_query_keeps_pairs_of_few_baskets(spark, rows, tmp_path):
    data = [(f"u{i}", v) for i in range(7) for v in "ab"] + [("u0", "c")]
    spark.createDataFrame(data, "user_id string, business_id string").write.parquet(str(tmp_path / "user_business.parquet"))
    got = queries.queries()["p1_pairs"](spark, str(tmp_path))
    assert rows(got.select("item_a", "item_b", "n_ab")) == [("a", "b", 7), ("a", "c", 1), ("b", "c", 1)]


@pytest.mark.parametrize("min_pairs,lift,block", [(1, 0, 512), (3, 0, 512), (3, 2, 512), (3, 0, 5), (2, 0, 4), (1, 0, 4), (5, 1, 7)])
def test_pairs(spark, rows, min_pairs, lift, block):
    items = [f"i{k}" for k in range(40)]
    data = [(f"u{k % 60}", RNG.choice(items[: 5 + k % 36])) for k in range(900)]
    data += [("hot", i) for i in items] + [("hot2", i) for i in items[:30]] + [(f"u{k}", "everyone") for k in range(60)]
    data += [(" u1 ", " i1"), (None, "i1"), ("u1", None), ("", "i1"), ("u1", "  "), ("u", "b"), ("u2", "i2"), ("u2", "i2")]
    df = spark.createDataFrame([(u, b, 1, "x") for u, b in data], "u string, b string, code int, _k string").repartition(3)
    got = cooccurrence(df, "u", "b", min_pairs, lift, block)
    assert rows(got.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n")) == sorted(_pairs(data, min_pairs, lift), key=repr)
    if (r := got.first()) is None:
        return
    cells = [r["n_ab"] + 0.5, r["n_a"] - r["n_ab"] + 0.5, r["n_b"] - r["n_ab"] + 0.5, r["n"] - r["n_a"] - r["n_b"] + r["n_ab"] + 0.5]
    assert math.isclose(r["odds_ratio"], cells[0] * cells[3] / cells[1] / cells[2], rel_tol=1e-9)
    assert math.isclose(r["log_odds_se"], math.sqrt(sum(1 / c for c in cells)), rel_tol=1e-9)


def test_pairs_of_small_runs(spark, rows, monkeypatch):
    """Many runs a task give the same counts."""
    monkeypatch.setattr(cooccur, "RUN", 16)
    data = [(f"u{k % 50}", f"i{RNG.randint(0, 12)}") for k in range(600)]
    df = spark.createDataFrame(data, "u string, b string")
    assert rows(cooccurrence(df, "u", "b").select("item_a", "item_b", "n_a", "n_b", "n_ab", "n")) == sorted(_pairs(data, 2, 0), key=repr)


def test_pairs_empty(spark):
    assert cooccurrence(spark.createDataFrame([], "u string, b string"), "u", "b").count() == 0


def test_burst_trie():
    words = ["".join(RNG.choice("abc") for _ in range(RNG.randint(1, 7))) for _ in range(5000)]
    trie, want = BurstTrie(burst=8), Counter(words)
    for w in words:
        trie.add(w, 1, 2)
    got = {p + r: at for p, leaf in trie.subtrees() if leaf for r, at in leaf.items()}
    assert {w: trie.uses[at] for w, at in got.items()} == want and all(trie.records[at] == 2 * trie.uses[at] for at in got.values())
    assert trie.size == len(want) and all(len(leaf) <= 8 for _, leaf in trie.subtrees() if leaf)
    assert [p for p, _ in trie.subtrees()] == sorted(p for p, _ in trie.subtrees())


def _terms(text):
    return re.findall(r"(?:(?![\u00b2\u00bc\u00bd])[^\W_])+", text.lower())


@pytest.mark.parametrize("burst,hold,meet", [(4096, 500_000, 1_000_000), (3, 10, 1_000_000), (3, 10, 5), (50, 40, 12)])
def test_term_frequency(spark, rows, burst, hold, meet):
    texts = [" ".join(RNG.choice(["the", "The", "cat", "Ñandú", "x1", "42", "a_b", "über-cool", f"w{k}"]) for _ in range(RNG.randint(0, 30))) for k in range(120)]
    texts += [None, "", "  \n", "!!!", "the " * 20_000, "the cat", "10\u00b2 \u00bd \u00c3\u00bcber"] * 2
    counted = [_terms(t) for t in texts if t and t.strip()]
    uses, held, n = Counter(w for t in counted for w in t), Counter(w for t in counted for w in set(t)), len(counted)
    mark = lambda w: "rare" if held[w] <= 2 else "common" if held[w] * 100 > 32 * n else None
    df = spark.createDataFrame([(t, "y", 3) for t in texts], "t string, term string, records int").repartition(5)
    assert rows(term_frequency(df, "t", burst=burst, hold=hold, meet=meet)) == sorted([(w, uses[w], held[w], n, mark(w)) for w in uses], key=repr)


def test_term_frequency_empty(spark):
    assert term_frequency(spark.createDataFrame([], "t string"), "t").count() == 0
    assert term_frequency(spark.createDataFrame([(None,), (" ",)], "t string"), "t").count() == 0


def test_distinctive_terms(spark, rows):
    words = ["good", "bad", "soup", "the", "12", *(f"z{k}" for k in range(30))]
    data = [(f"b{k % 9}", " ".join(RNG.choice(words) for _ in range(RNG.randint(0, 40)))) for k in range(80)]
    data += [(None, "soup"), (" ", "soup"), ("b1 ", "SOUP"), ("b2", None), ("b3", ""), ("b4", "z1 " * 50)] * 2
    stop = {"the"}
    tf = defaultdict(Counter)
    for b, t in data:
        if b and b.strip() and t:
            tf[b.strip(" ")].update(w for w in _terms(t) if w not in stop and not w.isdigit())
    tf = {b: c for b, c in tf.items() if c}
    df_, n = Counter(w for c in tf.values() for w in c), len(tf)
    df = spark.createDataFrame([(b, t, "x", 1.0) for b, t in data], "b string, t string, term string, score double")
    words_df = spark.createDataFrame([(" The",), ("",), (None,), ("the",)], "word string")
    got = distinctive_terms(df, "b", "t", words_df)
    want = [(b, w, c, df_[w], n, round(c * math.log2(n / df_[w]), 9)) for b, t in tf.items() for w, c in t.items()]
    assert rows(got.selectExpr("record", "term", "tf", "df", "n", "round(score, 6)")) == sorted([(*w[:5], round(w[5], 6)) for w in want], key=repr)
    best = {b: min(t, key=lambda w: (-round(t[w] * math.log2(n / df_[w]), 9), w)) for b, t in tf.items()}
    assert dict(rows(most_distinctive(got).select("record", "term"))) == best
    assert all(0 <= r["elite"] <= 1 for r in got.collect())
    assert distinctive_terms(df.where("false"), "b", "t").count() == 0


def test_posterior_tells_the_elite_records():
    """Records known to be about a term, among others that mention it: the posterior ranks them (area under the curve 0.9 or more)
    over many terms of different rates and shares."""
    rng = np.random.default_rng(5)
    areas, recalls = [], []
    for _ in range(40):
        n, share, high, low = 4000, rng.uniform(0.01, 0.2), rng.uniform(4, 9), rng.uniform(0.05, 0.6)
        elite = rng.random(n) < share
        counts = np.where(elite, rng.poisson(high, n), rng.poisson(low, n))
        values, freq = np.unique(counts[counts > 0], return_counts=True)
        a, b, s = fit_two_poisson(values.astype(float), freq.astype(float), np.zeros(len(values), int), 1, n, 40)
        odds = np.log(s / (1 - s)) - (b - a) + counts * (np.log(b) - np.log(a))
        ranks = np.argsort(np.argsort(odds + rng.random(n) * 1e-9)) + 1.0
        areas.append((ranks[elite].sum() - elite.sum() * (elite.sum() + 1) / 2) / (elite.sum() * (~elite).sum()))
        recalls.append((odds[elite] > 0).mean())
    assert np.mean(recalls) > 0.9 and np.mean(areas) > 0.95 and min(areas) > 0.9


def test_two_poisson_finds_the_elite():
    """Counts drawn from a known mixture: the rates come out, and the posterior rises with the count."""
    rng = np.random.default_rng(3)
    n = 20_000
    is_elite = rng.random(n) < 0.1
    counts = np.where(is_elite, rng.poisson(6.0, n), rng.poisson(0.3, n))
    values, freq = np.unique(counts[counts > 0], return_counts=True)
    low, high, share = fit_two_poisson(values.astype(float), freq.astype(float), np.zeros(len(values), int), 1, n, 200)
    assert abs(low[0] - 0.3) < 0.03 and abs(high[0] - 6.0) < 0.3 and abs(share[0] - 0.1) < 0.01
    assert elite.ROUNDS >= 20


def _similar(data, sim, least):
    sets = defaultdict(set)
    for b, u in data:
        if b and u and b.strip() and u.strip():
            sets[b.strip(" ")].add(u.strip(" "))
    sets = {b: s for b, s in sets.items() if len(s) >= least}
    return sets, sorted((a, b) for a, b in combinations(sorted(sets), 2) if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= sim)


@pytest.mark.parametrize("sim,least,small,how", [(Fraction(1, 2), 3, 24, {}), (Fraction(1, 2), 3, 4, {"block": 5}), (Fraction(4, 5), 4, 6, {"subset": 3}), (Fraction(1, 4), 1, 5, {}), (Fraction(1, 3), 2, 3, {"block": 7})])
def test_similar_sets(spark, rows, sim, least, small, how):
    users = [f"u{k}" for k in range(60)]
    data = []
    for k in range(60):
        base = RNG.sample(users, RNG.randint(1, 25))
        for c in range(RNG.choice([1, 1, 2, 3])):
            own = [u for u in base if RNG.random() > 0.15 * c] + RNG.sample(users, c)
            data += [(f"b{k}_{c}", u) for u in own]
    data += [(f"copy{k}", u) for k in range(12) for u in users[:4]] + [(f"big{k}", u) for k in range(4) for u in users[: 50 + k]]
    data += [(f"b{k}_0", "everywhere") for k in range(60)] + [(None, "u1"), ("b1_0", None), ("", "u1"), (" b1_0 ", " u1"), ("b1_0", " ")]
    sets, want = _similar(data, sim, least)
    df = spark.createDataFrame([(b, u, 1, 2) for b, u in data + data[:50]], "b string, u string, size int, rep int").repartition(3)
    found = similar_sets(df, "b", "u", sim, least, small, **how)
    assert rows(found.expanded(), "a", "b") == want
    links = Counter(x for p in want for x in p)
    got = {r["id"]: r for r in found.links().collect()}
    assert set(got) == set(sets) and all(r["links"] == links[b] for b, r in got.items())
    assert all(r["rep"] == min(b for b in sets if sets[b] == sets[r["id"]]) for r in got.values())


def test_similar_sets_empty(spark):
    assert similar_sets(spark.createDataFrame([], "b string, u string"), "b", "u").expanded().count() == 0


@pytest.mark.parametrize("buckets,counters,k", [(1 << 14, 1 << 18, 25), (64, 128, 25), (8, 16, 5), (4, 4, 25)])
def test_frequent_values(spark, buckets, counters, k):
    """Small sketches evict much, and the exact check still gives the right values."""
    data = [f"v{min(int(RNG.expovariate(0.03)), 400)}" for _ in range(6000)] + ["hot"] * 3000 + ["tie_b", "tie_a"] * 200 + [None, "é" * 500, ""]
    want = sorted(((v, c) for v, c in Counter(x for x in data if x is not None).items()), key=lambda x: (-x[1], x[0]))[:k]
    df = spark.createDataFrame([(v, 1, 2) for v in data], "v string, count int, at int").repartition(6)
    got = frequent_values(df, "v", k, buckets, counters).orderBy("pos").collect()
    assert [(r["value"], r["count"]) for r in got] == want and [r["pos"] for r in got] == list(range(1, len(want) + 1))
    assert all(r["estimate"] >= r["count"] for r in got)


def test_frequent_values_of_few_and_none(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    assert rows(frequent_values(df, "v", 25), "value", "count") == [("a", 2), ("b", 1)]
    assert frequent_values(df.where("false"), "v", 25).count() == 0


@pytest.mark.parametrize("hold", [1_000_000, 10])
def test_top_n(spark, rows, hold):
    data = [(f"g{RNG.choice([0, 0, 0, k % 30])}", f"i{RNG.randint(0, 40)}", RNG.choice([0.5, 0.25, -1.0, 0.0, -0.0, None, float("nan"), RNG.random()])) for k in range(4000)]
    data += [(None, "i", 1.0), ("g1", None, 1.0), (" ", "i", 1.0), (" g1 ", " i1", 0.7)] + data[:100]
    best = defaultdict(dict)
    for g, i, s in data:
        if g and i and g.strip() and s is not None and s == s:
            cell = best[g.strip(" ")]
            cell[i.strip(" ")] = max(s, cell.get(i.strip(" "), -9))
    want = [(g, p, i) for g, c in best.items() for p, i in enumerate(sorted(c, key=lambda i: (-c[i], i))[:5], 1)]
    df = spark.createDataFrame([(g, i, s, 7, "q") for g, i, s in data], "g string, i string, s double, pos int, item string").repartition(5)
    assert rows(top_n(df, "g", "i", "s", 5, hold), "group", "pos", "item") == sorted(want, key=repr)
    assert top_n(df.where("false"), "g", "i", "s").count() == 0
