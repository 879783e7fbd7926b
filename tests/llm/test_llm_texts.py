"""Leaks, mixing and reading level: against brute force, round trips and held-out accuracy."""

import os
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.leaks import leaked_items
from millrace.llm.mixing import TOKENIZER, deviations, mix_sources, schedule
from millrace.llm.reading import CONNECTIVES, FEATURES, Boosted, _isotonic, feature_matrix, floor_for, reading_level, train

RNG = random.Random(7)


def _terms(text):
    return re.findall(r"(?:(?![\u00b2\u00bc\u00bd])[^\W_])+", text.lower())


def _leaks(docs, items, window):
    out = set()
    for d, text in docs:
        words = f" {' '.join(_terms(text or ''))} "
        for i, item in items:
            w = _terms(item or "")
            m = min(window, len(w))
            if m and any(f" {' '.join(w[k : k + m])} " in words for k in range(len(w) - m + 1)):
                out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"sent": 0}, {"most_bits": 1 << 10}])
def test_leaks(spark, rows, how):
    vocabulary = ["the", "cook", "served", "4", "17", "minutes", "Tholmar", "Vexby", "soup\u00b2", "\u0130z", "to", "guests", "and", "left", "Norton's"]
    text = lambda n: " ".join(RNG.choice(vocabulary) for _ in range(n))
    items = [(k, text(RNG.choice([2, 5, 13, 20, 40]))) for k in range(12)] + [(50, None), (51, ""), (52, "!?"), (53, "soup"), (1, text(20))]
    docs = []
    for k in range(120):
        i = RNG.choice(items[:12])[1].split()
        a = RNG.randint(0, max(0, len(i) - 5))
        part = " ".join(i[a : a + RNG.randint(5, 30)])
        docs.append((k, f"{text(RNG.randint(0, 30))} {RNG.choice([part, part.upper(), part.replace(' ', ' -- '), ''])}. {text(5)}"))
    docs += [(900, None), (901, ""), (902, "x " * 50_000 + items[0][1]), (902, "x"), (None, items[0][1])]
    want = _leaks([d for d in docs if d[0] is not None], items, 13)
    a = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, item_id int, windows string").repartition(3)
    b = spark.createDataFrame([(*i, 5) for i in items], "item_id int, text string, doc_id int")
    assert rows(leaked_items(a, b, **how), "doc_id", "item_id") == sorted(set(want), key=repr) and want


def test_no_leaks_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert leaked_items(docs.where("false"), items).count() == 0
    assert leaked_items(docs, items.where("false")).count() == 0
    assert leaked_items(docs, items).count() == 1


def test_reworded_questions(spark, rows):
    item = "In the bakery of Tholmar the baker Wendel sold 14 loaves to Tholmar before 9 guests came in at noon"
    good = "Earlier: in the bakery of Kravish the baker Olmo sold 33 loaves to Kravish before 7 guests came in at noon, they say."
    bad = "In the bakery of Kravish the baker Olmo sold 33 loaves to Zendar before 7 guests came in at noon"
    other = "In the garage of Kravish the driver Olmo sold 33 wheels to Kravish before 7 guests came in at noon"
    docs = spark.createDataFrame([(1, good), (2, bad), (3, other), (4, item)], "doc_id long, text string")
    items = spark.createDataFrame([(8, item), (9, "By Zed the Nile and by Tholmar Wendel there")], "item_id int, text string")
    got = {r["doc_id"]: r for r in leaked_items(docs, items, reworded=True, window=18).collect()}
    assert set(got) == {1, 4} and got[1]["changed"] == 5 and got[4]["changed"] == 0


def test_reworded_does_not_depend_on_other_items(spark, rows):
    """A word that only another item writes as a name is a name for all of them."""
    frame = "in the bakery by the mill the baker {} sold {} loaves to guests who came at noon"
    items = [(k, frame.format(w, k + 10)) for k, w in enumerate(["wendel", "olmo", "tavik", "bruno"])]
    items += [(k + 50, f"By the river there lived {w.title()} with a dog") for k, w in enumerate(["wendel", "olmo", "tavik", "bruno"])]
    docs = spark.createDataFrame([(1, frame.format("Sorin", 99)), (2, frame.format("Olmo", 98))], "doc_id long, text string")
    df = spark.createDataFrame(items, "item_id int, text string")
    whole = rows(leaked_items(docs, df, reworded=True))
    assert {(r[0], r[1]) for r in whole} >= {(d, i) for d in (1, 2) for i in range(4)}
    assert rows(leaked_items(docs, df.repartition(5), reworded=True, sent=0)) == whole


def test_units_are_learned_and_numbers_may_be_words(spark):
    item = "The cellar of the old inn holds 14 firkins and 30 firkins of ale for the twelve guests who stay there"
    doc = "the cellar of the old inn holds 15 firkins and 31 firkins of ale for the eleven guests who stay there"
    other = "the cellar of the old inn holds 15 hogsheads and 31 hogsheads of ale for the eleven guests who stay there"
    docs = spark.createDataFrame([(1, doc), (2, other), (3, other.replace("hogsheads", "liters"))], "doc_id long, text string")
    got = leaked_items(docs, spark.createDataFrame([(1, item)], "item_id int, text string"), reworded=True, window=19).collect()
    assert {r["doc_id"] for r in got} == {1, 3}


@pytest.mark.parametrize("weights", [[Fraction(1, 2), Fraction(1, 3), Fraction(1, 6)], [Fraction(3, 25), Fraction(2, 25), Fraction(6, 25), Fraction(4, 25), Fraction(1, 10), Fraction(2, 25), Fraction(7, 50), Fraction(2, 25)], [Fraction(1, 7)], [Fraction(0), Fraction(1)]])
def test_schedule_is_fair(weights):
    got = schedule(weights, 700)
    assert len({s for g in got for s in g}) == sum(map(len, got))
    for t in range(701):
        for w, g in zip(weights, got, strict=True):
            assert abs(sum(s < t for s in g) - w * t) < 1


def _docs(spark):
    data = []
    for k in range(600):
        source = RNG.choice(["a", "a", "a", "B ", " b", "c", None, "", "zz"])
        data.append((k, " ".join(["w"] * RNG.randint(0, 40)), source))
    data += [(1000, None, "a"), (1001, "", "c"), (1002, "w " * 5000, "c")]
    return data, spark.createDataFrame([(*d, 1, 0.5) for d in data], "doc_id long, text string, source string, tokens int, weight double").repartition(4)


@pytest.mark.parametrize("block", [None, 1, 300])
def test_mix(spark, block):
    data, df = _docs(spark)
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("missing", 0.1, 2)], "source string, weight double, max_repeats int")
    mix = mix_sources(df, targets, tokenizer=None, block=block)
    size: dict = {}
    for _, t, s in data:
        if t is not None and s and s.strip():
            size[s.strip().lower()] = size.get(s.strip().lower(), 0) + len(t.split())
    total = sum(size.values())
    shares = {r["source"]: r for r in mix.shares.collect()}
    uses = mix.uses.collect()
    for s, w, m in [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("missing", 0.1, 2)]:
        have = size.get(s, 0)
        own = [r for r in uses if r["source"] == s]
        used = sum(r["tokens"] * r["uses"] for r in own)
        assert shares[s]["short"] == (w * total > m * have) and shares[s]["used"] == used and shares[s]["available"] == have
        assert all(1 <= r["uses"] <= m for r in own) and len({r["doc_id"] for r in own}) == len(own)
        if shares[s]["short"]:
            assert used == m * have
        else:
            assert w * total <= used + 1 and used < w * total + 1 + max(r["tokens"] for r in own)
        assert all(r["first_slot"] is not None for r in own)
    assert abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9
    assert all(r["missed"] == r["blocks"] - r["filled"] and r["short"] == (r["missed"] > 0) for r in shares.values())
    for r in deviations(mix).collect():
        assert r["worst"] < mix.block + r["longest"] and r["uses"] == sum(u["uses"] for u in uses if u["source"] == r["source"])
    taken: dict = {}
    for r in uses:
        for at in r["slots"]:
            assert taken.setdefault(at, r["source"]) == r["source"]


def test_mix_of_odd_weights(spark):
    """A period longer than the driver schedules, and weights of more than 1 in all, which count divided by their sum."""
    docs = spark.createDataFrame([(k, "w " * 7, "abc"[k % 3]) for k in range(300)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3333333333, 2), ("b", 0.1234567891, 1), ("c", 0.2, 9)], "source string, weight double, max_repeats int")
    mix = mix_sources(docs, targets, tokenizer=None, block=5)
    assert {r["source"]: r["used"] for r in mix.shares.collect()} == {"a": 700, "b": 266, "c": 420}
    assert all(r["worst"] < 5 + 7 for r in deviations(mix).collect())
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 9), ("c", 1.0, 9)], "source string, weight double, max_repeats int")
    got = {r["source"]: r for r in mix_sources(docs, targets, tokenizer=None).shares.collect()}
    assert [got[s]["target"] for s in "abc"] == [525.0, 1050.0, 525.0] and [got[s]["short"] for s in "abc"] == [False, False, False]


def test_mix_places_every_use(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "a" if k < 10 else "b") for k in range(40)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, weight double, max_repeats int")
    uses = mix_sources(docs, targets, tokenizer=None, block=10).uses.collect()
    plan = dict(zip("ab", schedule([Fraction(1, 2)] * 2, 40), strict=True))
    for r in uses:
        assert len(r["slots"]) == len(r["starts"]) == r["uses"] and r["slots"][0] == r["first_slot"]
        assert r["slots"] == [plan[r["source"]][s // 10] for s in r["starts"]]
    assert sorted(s for r in uses if r["source"] == "a" for s in r["starts"]) == list(range(0, 200, 10))
    assert len({s for r in uses for s in r["slots"]}) == 40


def test_mix_of_nothing(spark):
    _, df = _docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    mix = mix_sources(df.where("false"), targets, tokenizer=None)
    assert [(r["short"], r["share"]) for r in mix.shares.collect()] == [(False, 0.0)] and mix.uses.count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no public tokenizer here")
def test_token_sizes_round_trip(spark):
    """Sizes equal those of the tokenizer used directly, and its tokens give the text back."""
    import base64

    import tiktoken

    from millrace.llm.mixing import PATTERN, document_sizes

    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world's\n soup", "", "Ñandú 👎 1234", "a" * 3000, "  "]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["tokens"] for r in document_sizes(df).collect()}
    assert got == {k: len(coder.encode_ordinary(t)) for k, t in enumerate(texts)}
    assert all(coder.decode(coder.encode_ordinary(t)) == t for t in texts)


def _plain(text):
    words = re.findall(r"[^\W\d_]+", text)
    pieces = [p for line in re.split(r"\n", text) for p in re.split(r"[.!?]+(?=\s|$)", line) if any(c.isalpha() for c in p)]
    return len(words), len(pieces), sum(max(1, len(re.findall(r"[aeiouy]+", w.lower()))) for w in words)


@pytest.mark.parametrize("text", ["One two. Three!? Four", "It cost $3.50 at 5.30 p.m. today...\n\n- soup\n- 12\nNo end", "", "123 !!", "Crêpes né hmm rhythm. A", "a.b.c. d", "x" * 5000])
def test_features(text):
    f = dict(zip(FEATURES, feature_matrix([text])[0].tolist(), strict=True))
    assert (f["words"], f["sentences"], f["syllables"]) == (_plain(text) if _plain(text)[0] else (0, 0, 0))
    assert all(np.isfinite(v) for v in f.values())


def _slow(text):
    """The other features, text by text."""
    sentences = [re.findall(r"[^\W\d_]+", p) for line in re.split(r"\n", text) for p in re.split(r"[.!?]+(?=\s|$)", line)]
    sentences = [s for s in sentences if s]
    words = [w for s in sentences for w in s]
    if not words:
        return [0.0] * len(FEATURES)
    n, lengths, lower = len(words), [len(s) for s in sentences], [w.lower() for w in words]
    syllables = [max(1, len(re.findall(r"[aeiouy]+", w))) for w in lower]
    by = sorted(map(len, words))
    sets = [{w.lower() for w in s} for s in sentences]
    overlap = sum(len(a & b) / min(len(a), len(b)) for a, b in zip(sets, sets[1:], strict=False)) / max(1, len(sets) - 1)
    return [
        n, len(lengths), sum(syllables), n / len(lengths), sum(syllables) / n, sum(by) / n, np.quantile(lengths, 0.5), np.quantile(lengths, 0.9), np.std(lengths),
        by[max(0, -(-n // 2) - 1)], by[max(0, int(np.ceil(0.9 * n)) - 1)], sum(x >= 8 for x in by) / n, sum(x >= 3 for x in syllables) / n, sum(x <= 3 for x in by) / n,
        len(set(lower)) / n, sum(lower.count(w) == 1 for w in set(lower)) / n, sum(text.count(c) for c in ",;:") / len(lengths),
        sum(w in CONNECTIVES for w in lower) / n, overlap, sum(c in "0123456789" for c in text) / len(text), sum(w[0].isupper() for w in words) / n,
    ]


def test_feature_matrix_equals_text_by_text():
    pieces = ["The soup", "because", "Extraordinary deliberation", "ñandú Éclair", "42", ",", ". ", "!? ", "\n", "; ", "we the we", "hmm"]
    texts = [" ".join(RNG.choice(pieces) for _ in range(RNG.randint(0, 60))) for _ in range(200)] + ["", "...", "\n\n"]
    assert np.allclose(feature_matrix(texts), np.array([_slow(t) for t in texts]))
    assert feature_matrix([]).shape == (0, len(FEATURES))


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((1500, 5))
    y = 10 * (x[:, 0] > 0.5) + 5 * x[:, 1] + rng.normal(0, 0.3, 1500)
    p = Boosted().fit(x[:1000], y[:1000]).predict(x[1000:])
    assert np.abs(p - y[1000:]).mean() < 0.6 < np.abs(y[1000:] - np.median(y)).mean() / 4


def _graded():
    short, long = ["cat", "sat", "hat", "the", "on"], ["institutional", "deliberation", "multidimensional", "configuration", "of"]
    rows = []
    for k in range(240):
        level = RNG.random()
        sentences = [" ".join(RNG.choice(long if RNG.random() < level else short) for _ in range(int(4 + 20 * level))) for _ in range(4)]
        rows.append((k, ". ".join(sentences) + ".", RNG.choice(["a", "b", "c"]), min(25, max(1, round(1 + 22 * level + RNG.gauss(0, 1))))))
    return rows


def test_reading_level_held_out(spark):
    data = _graded()
    docs = spark.createDataFrame([(*d[:3], 0.0) for d in data] + [(900, None, "a", 0.0), (901, "", None, 0.0), (902, "12 !", "", 0.0), (903, "word " * 100_000, "a", 0.0)], "doc_id long, text string, source string, level double")
    labels = spark.createDataFrame([(d[0], r, d[3]) for d in data if d[0] < 160 for r in (1, 2)] + [(1, 3, None), (77777, 1, 5)], "doc_id long, rater_id int, school_year int")
    levels, model = reading_level(docs, labels)
    got = {r["doc_id"]: r for r in levels.collect()}
    assert set(got) == {d[0] for d in data} | {901, 902, 903} and all(1 <= r["level"] <= 25 for r in got.values())
    held = [abs(got[d[0]]["level"] - d[3]) for d in data if d[0] >= 160]
    assert np.mean(held) < 2.5
    assert set(model.errors) == {"a", "b", "c"} and sum(n for n, _ in model.errors.values()) == 160
    one = docs.withColumn("source", F.lit("a"))
    levels, model = reading_level(one, labels)
    got = {r["doc_id"]: r["level"] for r in levels.collect()}
    assert np.mean([abs(got[d[0]] - d[3]) for d in data if d[0] >= 160]) < 2.5 and len({round(v, 3) for v in got.values()}) > 5
    assert set(model.errors) == {"a"} and model.errors["a"][0] == 160 and model.errors["a"][1] < 2.5


def test_errors_are_held_out():
    """Labels that are pure noise can't be foretold: the error is no less than that of the median."""
    rng = np.random.default_rng(2)
    x, y = rng.random((600, 6)), rng.integers(1, 25, 600).astype(float)
    model = train(x, y, [f"s{k % 6}" for k in range(600)])
    assert sum(n * e for n, e in model.errors.values()) / 600 > np.abs(y - np.median(y)).mean() - 0.1
    assert floor_for(model, y, 12.0) < 12 and floor_for(model, np.zeros(600), 12.0) == 1.0


def test_isotonic_pools_ties():
    knots, levels = _isotonic(np.zeros(4), np.array([1.0, 3.0, 5.0, 7.0]))
    assert knots.tolist() == [0.0] and levels.tolist() == [4.0]


def test_reading_level_without_labels(spark):
    docs = spark.createDataFrame([(1, "Some words here.", "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, rater_id int, school_year int")
    assert [r["level"] for r in reading_level(docs, labels)[0].collect()] == [1.0]
    assert reading_level(docs.where("false"), labels)[0].count() == 0
    assert train(np.zeros((3, 2)), np.array([3.0, 3.0, 3.0]), ["a", "a", "b"]).grade(np.zeros((1, 2))).tolist() == [3.0]


def test_p10_found_takes_cases_that_trees_would_place_low(spark, tmp_path, rows):
    """Hard documents among the labelled ones are long: trees go by the length, and the hard short one is a case all the same."""
    from millrace.llm.queries import p10_found

    text = lambda word, n: ". ".join([" ".join([word] * n)] * 4) + "."
    docs = [(k, text("institutional", 15) if k % 2 else text("cat", 10), "en", "abc"[k // 2 % 3]) for k in range(240)]
    docs += [(900, text("institutional", 10), "EN", "a"), (901, text("institutional", 7), "en", "a"), (902, text("institutional", 10), "fr", "a"), (903, None, "en", "a"), (904, "...", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 20 if k % 2 else 2) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, rater_id int, school_year int").write.parquet(f"{tmp_path}/reading_labels.parquet")
    assert rows(p10_found(spark, str(tmp_path))) == sorted([(k,) for k in range(1, 240, 2)] + [(900,)], key=repr)


def test_all_labelled_documents_train(spark, monkeypatch):
    from millrace.llm import reading

    seen = []
    monkeypatch.setattr(reading, "train", lambda x, y, source: seen.append(len(y)) or train(x[:40], y[:40], source[:40]))
    docs = spark.range(20_050).selectExpr("id AS doc_id", "concat('Word ', id % 7, ' here.') AS text", "'a' AS source")
    reading_level(docs, docs.selectExpr("doc_id", "1 AS rater_id", "cast(doc_id % 9 + 1 AS int) AS school_year"))
    assert seen == [20_050]
