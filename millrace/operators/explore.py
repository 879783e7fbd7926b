"""Exploration: counts, top-k users and words, averages over multi-valued attributes, partition profiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ascii_lower
from millrace.plans.store import small

#: Characters that become a space before words are counted. Fixed values.
WORD_PUNCTUATION = "([,.!?:;])"


def count_distinct(df: DataFrame, key: str) -> DataFrame:
    """One row `n`: the number of distinct non-null values."""
    return df.agg(F.countDistinct(key).alias("n"))


def rows_in_year(df: DataFrame, date: str, year: str, key: str) -> DataFrame:
    """One row `n`: distinct keys whose date string has the year before its first hyphen; 0 if there is none."""
    return df.where(F.substring_index(date, "-", 1) == str(year)).agg(F.countDistinct(key).alias("n"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent non-null values: key, count; ties by key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(n)


def plain_words(df: DataFrame, text: str) -> DataFrame:
    """Column `word`: the text with punctuation blanked and A-Z lower-cased, cut at single spaces (a newline doesn't cut); no empty words."""
    words = F.explode(F.split(ascii_lower(F.translate(text, WORD_PUNCTUATION, " " * len(WORD_PUNCTUATION))), " "))
    return df.select(words.alias("word")).where("word <> ''")


def top_words(df: DataFrame, text: str, stopwords: DataFrame, n: int) -> DataFrame:
    """The n most frequent words outside `stopwords` (column word): word, count; ties by word. Counts first, so the list is joined to few rows."""
    listed = stopwords.select(F.lower(F.trim("word")).alias("word")).distinct()
    counts = plain_words(df, text).groupBy("word").agg(F.count("*").alias("count"))
    return counts.join(small(listed), "word", "left_anti").orderBy(F.desc("count"), "word").limit(n)


def review_summary(reviews: DataFrame, stopwords: DataFrame, year: str, m: int, n: int) -> DataFrame:
    """One row: a (distinct reviews), b (of the year), c (distinct users), d (top m users), e (top n words)."""
    pack = lambda df, k: df.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), F.col(k).alias("k"), "count"))).alias("l")).select(F.transform("l", lambda x: F.struct(x["k"].alias(k), x["count"].alias("count"))).alias("l"))
    a = count_distinct(reviews, "review_id").withColumnRenamed("n", "a")
    b = rows_in_year(reviews, "date", year, "review_id").withColumnRenamed("n", "b")
    c = count_distinct(reviews, "user_id").withColumnRenamed("n", "c")
    d = pack(top_counts(reviews, "user_id", m), "user_id").withColumnRenamed("l", "d")
    e = pack(top_words(reviews, "text", stopwords, n), "word").withColumnRenamed("l", "e")
    return a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)  # five rows of one row each


def category_avg_stars(reviews: DataFrame, businesses: DataFrame, n: int | None = None) -> DataFrame:
    """Mean stars per category of the comma list `categories` (null counts as 'None'; names trimmed of spaces): category, stars.

    Stars are summed per business before the join, so the join carries a row a business, not a row a review. Businesses
    without reviews drop out. Ordered by mean, then name, if n is given.
    """
    sums = reviews.where(F.col("stars").isNotNull()).groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("*").alias("c"))
    names = businesses.select("business_id", F.explode(F.split(F.coalesce("categories", F.lit("None")), ",")).alias("category")).withColumn("category", F.trim("category"))
    means = names.join(sums, "business_id").groupBy("category").agg(F.round(F.sum("s") / F.sum("c"), 6).alias("stars"))
    return means if n is None else means.orderBy(F.desc("stars"), "category").limit(n)


def frequent_keys(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys with more than `more_than` rows: key, count."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count")).where(F.col("count") > more_than)


def partition_profile(df: DataFrame, n: int, key: str | None = None, placement=None) -> DataFrame:
    """Rows of each of n partitions: partition, rows; empty partitions too.

    By default rows are spread round-robin; with `key` by its hash; with `placement` (an integer expression, e.g. of a key's first
    character) to exactly the partition it gives, modulo n.
    """
    if placement is not None:
        df = df.repartitionById(n, F.pmod(placement.cast("int"), F.lit(n)))
    else:
        df = df.repartition(n, key) if key else df.repartition(n)
    sizes = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return every.join(F.broadcast(sizes), "partition", "left").select("partition", F.coalesce("rows", F.lit(0)).alias("rows"))


def partition_count(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()
