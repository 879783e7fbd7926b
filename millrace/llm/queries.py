"""Registered queries of the operators of this subpackage, with the SQL that gives the same rows where SQL can."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import clean_id, has_text
from millrace.llm.cooccur import cooccurrence
from millrace.llm.elite import distinctive_terms, most_distinctive
from millrace.llm.heavy import frequent_values
from millrace.llm.leaks import leaked_items, reparameterised
from millrace.llm.mixing import Mix, deviations, mix_sources
from millrace.llm.reading import reading_counts, reading_level
from millrace.llm.simjoin import similar_sets
from millrace.llm.termfreq import term_frequency
from millrace.llm.topn import top_n
from millrace.plans.store import latest, materialize
from millrace.sources import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence(read_table(spark, d, "user_business"), "user_id", "business_id", min_pairs=6, lift=4)
    return pairs.select(F.col("item_a").alias("business_a"), F.col("item_b").alias("business_b"))


def _odds(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", F.round("odds_ratio", 4).alias("odds_ratio"), F.round("log_odds", 6).alias("log_odds"))


def p1_odds(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least 6 baskets with their odds ratios, as in its SQL. All pairs come out of p1_pairs."""
    return _odds(cooccurrence(read_table(spark, d, "user_business"), "user_id", "business_id", min_pairs=6))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that share a basket with their odds ratios."""
    return _odds(cooccurrence(read_table(spark, d, "user_business"), "user_id", "business_id", min_pairs=1))


def _reviews(spark: SparkSession, d: str, *values: str) -> DataFrame:
    review = read_table(spark, d, "review").withColumn("review_id", F.trim("review_id"))
    return latest(review, "review_id", "loaded_at", *values)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency(_reviews(spark, d, "text"), "text").where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """Uses and records of every term."""
    return term_frequency(_reviews(spark, d, "text"), "text")


def _train(spark: SparkSession, d: str) -> DataFrame:
    train = read_table(spark, d, "train_review")
    return train.select(F.trim("user_id").alias("user_id"), F.trim("business_id").alias("business_id"), "stars", "text").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that their business more likely is about than not (posterior of the elite component), then checked: the highest tf * log2(N / df) of
    the business, tf >= 4 and df <= 5."""
    best = most_distinctive(distinctive_terms(_train(spark, d), "business_id", "text", read_table(spark, d, "stopwords")))
    return best.where("elite >= 0.5").where("tf >= 4 and df <= 5").select(F.col("record").alias("business_id"), "term")


def p3_elite(spark: SparkSession, d: str) -> DataFrame:
    """Terms whose business very likely is about them: posterior of the elite component 0.99 or more."""
    scored = distinctive_terms(_train(spark, d), "business_id", "text", read_table(spark, d, "stopwords"))
    return scored.where("elite >= 0.99").select(F.col("record").alias("business_id"), "term", "tf", "df", F.round("elite", 6).alias("elite"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_sets(read_table(spark, d, "train_review"), "business_id", "user_id").expanded()
    return pairs.select(F.col("a").alias("business_a"), F.col("b").alias("business_b"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per business of at least 3 users: class of equal sets and number of similar businesses."""
    links = similar_sets(read_table(spark, d, "train_review"), "business_id", "user_id").links()
    return links.select(F.col("id").alias("business_id"), F.col("rep").alias("class"), "size", "copies", "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    users = _reviews(spark, d, "user_id").select(clean_id("user_id").alias("user_id"))
    return frequent_values(users, "user_id", 25).select(F.col("value").alias("user_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "task3item_model").where(F.coalesce(F.trim("b1") != F.trim("b2"), F.lit(True)))
    return top_n(rows, "b1", "b2", "sim", 5).select(F.col("group").alias("b1"), "pos", F.col("item").alias("b2"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.select("doc_id", F.col("item_id").cast("int").alias("item_id"))


def p8_reworded(spark: SparkSession, d: str) -> DataFrame:
    """Passages of items with other names and figures put in consistently."""
    return leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), reworded=True).where("changed > 0")


def p8_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many re-parameterised questions are found: every document with a text gets one of the items at its end, with other figures and
    names put in. One row: planted, and whether 0.9 of them or more are found in their document."""
    items = read_table(spark, d, "eval_items")
    other = reparameterised(items).withColumn("k", F.row_number().over(W.orderBy("item_id")) - 1)  # the fixed 120 items
    docs = read_table(spark, d, "documents").where("doc_id is not null and text is not null").withColumn("k", F.pmod("doc_id", F.lit(max(1, other.count()))).cast("int"))
    planted = materialize(docs.join(F.broadcast(other.select("k", "item_id", F.col("text").alias("passage"))), "k").select("doc_id", "item_id", F.concat("text", F.lit(".\n"), "passage").alias("text")))
    found = leaked_items(planted.select("doc_id", "text"), items, reworded=True).select("doc_id", "item_id", F.lit(1).alias("hit"))
    return planted.join(found, ["doc_id", "item_id"], "left").agg(F.count("*").alias("planted"), (F.count("hit") >= 0.9 * F.count("*")).alias("found_most"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources with blocks of the schedule that their placed documents can't fill."""
    mix = mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))
    return mix.shares.where("missed > 0").select("source")


def p9_token_uses(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix in tokens, how often each is used, and the block and place in its source of every use."""
    return mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets")).uses


def _words_mix(spark: SparkSession, d: str) -> Mix:
    return mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"), tokenizer=None)


def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix in words, which SQL can count too: uses of each and the place in its source of every use."""
    return _words_mix(spark, d).uses.select("doc_id", "source", "tokens", "uses", F.array_join(F.transform("starts", lambda x: x.cast("string")), " ").alias("starts"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source, in words, and its blocks."""
    return _words_mix(spark, d).shares.withColumn("share", F.round("share", 6)).select("source", "max_repeats", "available", "used", "share", "blocks", "filled", "missed", "short")


def p9_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Uses of each source, and whether no block of it is further from its weight than a block and a document."""
    mix = _words_mix(spark, d)
    return deviations(mix).select("source", "uses", (F.col("worst") < mix.block + F.col("longest")).alias("fair"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level(read_table(spark, d, "documents").where("text is not null"), read_table(spark, d, "reading_labels"))[0]


def _grade(words, sentences, syllables):
    return 0.39 * words / sentences + 11.8 * syllables / words - 15.59


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The exact formula over every English document; no model decides which are looked at."""
    counts = reading_counts(read_table(spark, d, "documents").where("lower(lang) = 'en'"))
    return counts.where("words >= 30").where(_grade(F.col("words"), F.col("sentences"), F.col("syllables")) >= 12).select("doc_id")


def p10_features(spark: SparkSession, d: str) -> DataFrame:
    """The counts behind the level of every document, whatever its language."""
    return _levels(spark, d).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("words", "sentences", "syllables")))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document."""
    return _levels(spark, d).select("doc_id", "source", F.round("level", 3).alias("level"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents, mean level and share of demanding documents (level 12 or more) by source."""
    by = _levels(spark, d).groupBy("source")
    return by.agg(F.count("*").alias("docs"), F.round(F.avg("level"), 3).alias("level"), F.round(F.avg((F.col("level") >= 12).cast("double")), 4).alias("demanding"))


def p10_errors(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents and mean absolute error in school years of each source, judged by a model that saw nothing of it."""
    _, model = reading_level(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels"))
    return spark.createDataFrame([(s, n, round(e, 3)) for s, (n, e) in model.errors.items()], "source string, labelled long, error double")


def p10_skill(spark: SparkSession, d: str) -> DataFrame:
    """One row: labelled documents, and whether the held-out error over all of them is less than 0.7 of that of the median label as everyone's level (not asked of fewer than 20)."""
    documents, labels = read_table(spark, d, "documents"), read_table(spark, d, "reading_labels")
    _, model = reading_level(documents, labels)
    own = labels.where("school_year is not null").groupBy("doc_id").agg(F.median("school_year").alias("y")).join(documents.where("text is not null").select("doc_id"), "doc_id")
    median = own.agg(F.median("y").alias("m"))
    plain = own.crossJoin(F.broadcast(median)).agg(F.count("*").alias("labelled"), F.sum(F.abs(F.col("y") - F.col("m"))).alias("plain"))  # one row each
    return plain.select("labelled", ((F.lit(float(sum(n * e for n, e in model.errors.values()))) < 0.7 * F.col("plain")) | (F.col("labelled") < 20)).alias("better"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
