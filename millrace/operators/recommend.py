"""Recommenders: neighbourhood models by Pearson correlation, and content profiles by tf-idf."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from millrace.functions.text import ascii_lower, clean_id
from millrace.operators.graph import cooccurrence_edges
from millrace.operators.similarity import minhash_signatures
from millrace.plans.store import BLOCK, dense_codes, materialize, meet, small

#: ASCII punctuation, deleted (not blanked) before content words are cut. Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def ratings(df: DataFrame) -> DataFrame:
    """(user, item, stars): the mean of a user's repeat ratings of an item; rows without user, item or stars don't count."""
    rows = df.select(clean_id("user_id").alias("user"), clean_id("business_id").alias("item"), "stars").where("user is not null and item is not null and stars is not null")
    return rows.groupBy("user", "item").agg(F.avg("stars").alias("stars"))


def test_pairs(df: DataFrame) -> DataFrame:
    """Distinct (user, item) to be rated."""
    return df.select(clean_id("user_id").alias("user"), clean_id("business_id").alias("item")).where("user is not null and item is not null").distinct()


def pearson_model(rated: DataFrame, of: str = "item", by: str = "user", min_common: int = 3, candidates: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of `of` with at least min_common common raters and a positive Pearson correlation over them: a, b, sim.

    Sums of the co-rated values are aggregated per pair (partly before the exchange). Values without variance give no row;
    a correlation counts as positive if it is when rounded to 9 places; sim is rounded to 6. candidates (a, b) restricts the pairs.
    The min_common - 1 most frequent values of `by`, if they have more than `block` ratings, pair nothing up: a pair has another
    one in common, and their part in the sums is added to it. Of further such values two blocks meet at a time.
    """
    enough = rated.groupBy(of).agg(F.count("*").alias("c")).where(F.col("c") >= min_common).select(of)
    x = rated.join(enough, of, "left_semi").select(F.col(of).alias("a"), by, F.col("stars").alias("x"))
    popular: list = []
    if candidates is None:
        x = materialize(x)
        popular = [r[by] for r in x.groupBy(by).agg(F.count("*").alias("c")).where(F.col("c") > block).orderBy(F.desc("c"), by).limit(min_common - 1).collect()]
        co = meet(x.where(~F.col(by).isin(popular)) if popular else x, [by], "a", block).select("l.a", F.col("r.a").alias("b"), "l.x", F.col("r.x").alias("y"))
    else:
        co = candidates.join(x, "a").join(x.select(F.col("a").alias("b"), by, F.col("x").alias("y")), ["b", by])
    sums = {"n": F.lit(1).cast("long"), "sx": F.col("x"), "sy": F.col("y"), "sxy": F.col("x") * F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y")}
    s = co.groupBy("a", "b").agg(*(F.sum(v).alias(k) for k, v in sums.items())).where(F.col("n") >= min_common - len(popular))
    for value in popular:
        own = x.where(F.col(by) == value)
        s = s.join(own.select("a", "x"), "a", "left").join(own.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left")
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        s = s.select("a", "b", *((F.col(k) + F.when(both, v).otherwise(0)).alias(k) for k, v in sums.items()))
    s = s.where(F.col("n") >= min_common)
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    s = s.withColumn("v", F.round(vx, 9) * F.round(vy, 9)).where("v > 0")
    sim = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt("v")
    return s.withColumn("sim", sim).where(F.round("sim", 9) > 0).select("a", "b", F.round("sim", 6).alias("sim"))


#: The user model's hash family, seed, bands and rows. Fixed values.
_B, _P, _SEED, _BANDS, _ROWS = 15, 29, 15, 5, 4


def user_model_lsh(rated: DataFrame, bands: int = _BANDS, rows: int = _ROWS, b: int = _B, p: int = _P, seed: int = _SEED, at_least: float = 0.01, min_common: int = 3) -> DataFrame:
    """The user-user model over LSH candidates of at least the given Jaccard similarity.

    Candidates agree in all rows of a band. With so few rows of so small a hash family that holds for a fixed share of all pairs, so they aren't
    listed: the pairs that have min_common items in common, which the model needs anyway, are, and their signatures are compared.
    """
    sets = materialize(rated.select(F.col("user").alias("id"), F.col("item").alias("member")))
    signatures = materialize(minhash_signatures(sets, bands * rows, b, p, seed))
    met = cooccurrence_edges(sets.select(F.col("id").alias("basket"), F.col("member").alias("item")), max(1, min_common))
    known = signatures.join(sets.groupBy("id").agg(F.count("*").alias("n")), "id")
    for side in "ab":
        met = met.join(known.select(F.col("id").alias(side), F.col("signature").alias(f"s{side}"), F.col("n").alias(f"n{side}")), side)
    band = lambda s, k: F.slice(s, k * rows + 1, rows)
    agree = F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: band(F.col("sa"), k) == band(F.col("sb"), k))
    near = met.where(agree & (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) >= at_least)).select("a", "b")
    return pearson_model(rated, "user", "item", min_common, materialize(near))


def neighbours(model: DataFrame) -> DataFrame:
    """The model in both directions: id, other, sim."""
    return model.select(F.col("a").alias("id"), F.col("b").alias("other"), "sim").unionByName(model.select(F.col("b").alias("id"), F.col("a").alias("other"), "sim"))


def predict_by_items(pairs: DataFrame, rated: DataFrame, model: DataFrame, n: int = 3) -> DataFrame:
    """Forecast of each pair from the n most similar items that the user rated: sum(w s) / sum |w|, at most 5; only positive
    ones: user, item, stars. Ties by the greater id. Pairs without a rated neighbour drop out."""
    seen = pairs.join(rated.select("user", F.col("item").alias("other"), "stars"), "user")
    met = seen.join(neighbours(model).withColumnRenamed("id", "item"), ["item", "other"])
    first = met.withColumn("k", F.row_number().over(W.partitionBy("user", "item").orderBy(F.desc("sim"), F.desc("other")))).where(F.col("k") <= n)
    got = first.groupBy("user", "item").agg((F.sum(F.col("sim") * F.col("stars")) / F.sum(F.abs("sim"))).alias("p"))
    return got.withColumn("p", F.round(F.least("p", F.lit(5.0)), 6)).where("p > 0").select("user", "item", F.col("p").alias("stars"))


def predict_by_users(pairs: DataFrame, rated: DataFrame, model: DataFrame, n: int = 3) -> DataFrame:
    """Forecast from the n most similar users who rated the item: the user's mean plus the weighted deviations from each
    neighbour's mean without this item, at most 5; only positive ones. A neighbour with no other rating deviates by 0."""
    means = rated.groupBy("user").agg(F.sum("stars").alias("s"), F.count("*").alias("c"))
    others = rated.join(means, "user").select(F.col("user").alias("other"), "item", "stars", F.coalesce(F.try_divide(F.col("s") - F.col("stars"), F.col("c") - 1), F.col("stars")).alias("rest"))
    met = pairs.join(others, "item").join(neighbours(model).withColumnRenamed("id", "user"), ["user", "other"])
    first = met.withColumn("k", F.row_number().over(W.partitionBy("user", "item").orderBy(F.desc("sim"), F.desc("other")))).where(F.col("k") <= n)
    got = first.groupBy("user", "item").agg((F.sum(F.col("sim") * (F.col("stars") - F.col("rest"))) / F.sum(F.abs("sim"))).alias("d"))
    got = got.join(means, "user").withColumn("p", F.round(F.least(F.col("s") / F.col("c") + F.col("d"), F.lit(5.0)), 6))
    return got.where("p > 0").select("user", "item", F.col("p").alias("stars"))


def content_words(df: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(item, word) of every use: newlines and punctuation deleted, A-Z lower-cased, cut at spaces; no stopwords, no numbers.
    Reviews are cut one by one, so that no item's whole text is gathered."""
    clean = ascii_lower(F.translate("text", "\n" + PUNCTUATION, ""))
    words = df.select(clean_id("business_id").alias("item"), F.explode(F.split(clean, " ")).alias("word")).where(r"item is not null and word <> '' and not rlike(word, '^\\p{Nd}+$')")
    listed = stopwords.select(F.lower(F.trim("word")).alias("word")).distinct()
    return words.join(small(listed), "word", "left_anti")


def item_profiles(words: DataFrame, top: int = 200, rare: float = 1e-6) -> DataFrame:
    """The `top` words of each item by (count / greatest count) * log2(N / df), ties by the later word: item, word, score.
    Words used less often than the share `rare` of all uses are left out."""
    counts = materialize(words.groupBy("item", "word").agg(F.count("*").alias("c")))
    total = counts.agg(F.sum("c")).first()[0] or 0
    kept = counts.groupBy("word").agg(F.sum("c").alias("uses"), F.count("*").alias("df")).where(F.col("uses") >= total * rare)
    n = counts.select("item").distinct().count()
    counts = materialize(counts.join(kept.select("word", "df"), "word"))
    most = counts.groupBy("item").agg(F.max("c").alias("most"))
    scored = counts.join(most, "item").withColumn("score", F.round(F.col("c") / F.col("most") * F.log2(F.lit(float(n)) / F.col("df")), 9))
    first = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.desc("word")))
    return scored.withColumn("k", first).where(F.col("k") <= top).select("item", "word", "score")


def indexed_profiles(profiles: DataFrame) -> DataFrame:
    """item, words: the profile as sorted numbers of its words in the vocabulary's order."""
    codes = dense_codes(profiles.select("word").distinct(), "word", "i")
    return profiles.join(codes, "word").groupBy("item").agg(F.array_sort(F.collect_set("i")).alias("words"))


def user_profiles(rated: DataFrame, profiles: DataFrame) -> DataFrame:
    """The union of the profiles of a user's items: user, word."""
    return rated.select("user", "item").distinct().join(profiles.select("item", "word"), "item").select("user", "word").distinct()


#: Words of a user's profile that travel as one array at most.
ARRAY = 100_000


def predict_by_content(pairs: DataFrame, users: DataFrame, profiles: DataFrame, at_least: float = 0.01, array: int = ARRAY) -> DataFrame:
    """Cosine of the word sets of user and item: user, item, sim >= at_least. Unknown users and items have similarity 0.

    Words may be numbers already. Profiles of items (bounded by their `top`) and of users travel as arrays of word numbers, one row each, so the pairs are joined
    once to either and the common words are counted inside the row. The common words of users of more than `array` words are
    counted by a join.
    """
    known = pairs.select("user").distinct()
    users = users.join(known, "user", "left_semi")
    if isinstance(profiles.schema["word"].dataType, IntegralType):
        profiles, users = profiles.select("item", F.col("word").alias("i")), users.select("user", F.col("word").alias("i"))
    else:
        codes = dense_codes(profiles.select("word").distinct(), "word", "i")
        profiles, users = profiles.join(codes, "word").select("item", "i"), users.join(codes, "word").select("user", "i")
    coded = materialize(users)
    sizes = coded.groupBy("user").agg(F.count("*").alias("nu"))
    large = materialize(sizes.where(F.col("nu") > array))
    held = profiles.groupBy("item").agg(F.collect_list("i").alias("wi"))
    own, rest = coded, None
    if large.limit(1).count():
        own = coded.join(large, "user", "left_anti")
        met = pairs.join(large, "user").join(held, "item").select("user", "item", "nu", F.size("wi").alias("ni"), F.explode("wi").alias("i"))
        rest = met.join(coded, ["user", "i"]).groupBy("user", "item", "nu", "ni").agg(F.count("*").alias("c"))
    own = own.groupBy("user").agg(F.collect_list("i").alias("wu"))
    both = pairs.join(held, "item").join(own, "user").select("user", "item", F.size("wu").cast("long").alias("nu"), F.size("wi").alias("ni"), F.size(F.array_intersect("wi", "wu")).cast("long").alias("c"))
    both = both if rest is None else both.unionByName(rest)
    sim = F.round(F.col("c") / F.sqrt(F.col("nu") * F.col("ni")), 6)
    return both.select("user", "item", sim.alias("sim")).where(F.col("sim") >= at_least)
