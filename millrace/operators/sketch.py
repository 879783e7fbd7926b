"""Sketches: Bloom filter, Flajolet-Martin counter, hashtag top lists, reservoir samples."""

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.store import dense_codes, materialize

#: A token that is a hashtag.
TAG = "^#[A-Za-z]+$"


def bytes_mod(c: Column | str, q: int) -> Column:
    """The value's UTF-8 bytes, read as one big-endian whole number, modulo q. Folded byte by byte, so no big number is made."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("[0-9A-F]{2}"), F.lit(0))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 256 + F.conv(d, 16, 10).cast("long")) % q)


#: The Bloom filter's size, hashes and hash family, and the counter's modulus, groups, hashes a group and seed. Fixed values.
BLOOM_BITS, BLOOM_HASHES, BLOOM_B, BLOOM_P, BLOOM_SEED = 10_000, 8, 1301, 24593, 1301
FM_MODULUS, FM_GROUPS, FM_PER_GROUP, FM_SEED = 450, 9, 5, 15


def bloom_multipliers(k: int = BLOOM_HASHES, seed: int = BLOOM_SEED) -> list[int]:
    return random.Random(seed).sample(range(1, 10 * k), k)


def bloom_positions(c: Column | str, bits: int = BLOOM_BITS, k: int = BLOOM_HASHES, b: int = BLOOM_B, p: int = BLOOM_P, seed: int = BLOOM_SEED) -> Column:
    """The k bit positions of a value; they may coincide."""
    x = bytes_mod(c, p)
    return F.transform(F.array(*[F.lit(a).cast("long") for a in bloom_multipliers(k, seed)]), lambda a: ((a * x + b) % p) % bits)


def bloom_build(df: DataFrame, value: str, bits: int = BLOOM_BITS, **kind) -> DataFrame:
    """The filter of the non-empty values, as the words of its bit array that aren't 0: word, mask. At most bits / 64 rows, whatever the input; tasks
    set bits before the exchange."""
    rows = df.where(F.col(value).isNotNull() & (F.col(value) != "")).select(F.explode(bloom_positions(value, bits, **kind)).alias("p"))
    return rows.groupBy(F.expr("p div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask"))


def bloom_probe(df: DataFrame, value: str, built: DataFrame, bits: int = BLOOM_BITS, **kind) -> DataFrame:
    """Adds `seen`: 1 if all bits of the value are set, 0 if not or if the value is empty or null. The filter travels as one packed array of bits / 64 numbers,
    in which a bit is found by its place."""
    words = built.agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
    packed = words.select(F.transform(F.sequence(F.lit(0), F.lit((bits - 1) // 64)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_set"))
    hit = F.forall(bloom_positions(value, bits, **kind), lambda p: F.call_function("shiftright", F.get("_set", F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return df.crossJoin(F.broadcast(packed)).withColumn("seen", F.when(F.col(value).isNull() | (F.col(value) == ""), 0).when(hit, 1).otherwise(0)).drop("_set")


def fm_coefficients(n: int, seed: int) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randint(1, 100), rng.randint(1, 100)) for _ in range(n)]


def fm_zeros(x: Column, a: int, b: int, n: int = FM_MODULUS) -> Column:
    """Trailing zeros of (a x + b) mod n in binary; 8 for the value 0."""
    y = (F.lit(a).cast("long") * x + b) % n
    return F.when(y == 0, 8).otherwise(F.bit_count(y.bitwiseAND(-y) - 1))


def fm_aggregates(value: str, groups: int = FM_GROUPS, per_group: int = FM_PER_GROUP, n: int = FM_MODULUS, seed: int = FM_SEED) -> list[Column]:
    """One mergeable maximum per hash, named z0, z1, ...; usable in batch and streaming aggregation. Needs the column _x from fm_input."""
    return [F.max(fm_zeros(F.col("_x"), a, b, n)).alias(f"z{k}") for k, (a, b) in enumerate(fm_coefficients(groups * per_group, seed))]


def fm_input(df: DataFrame, value: str, n: int = FM_MODULUS) -> DataFrame:
    """The rows with a non-empty value, with its number modulo n as _x."""
    return df.where(F.col(value).isNotNull() & (F.col(value) != "")).withColumn("_x", bytes_mod(value, n))


def fm_estimate(groups: int = FM_GROUPS, per_group: int = FM_PER_GROUP) -> Column:
    """The median over groups of the mean of 2^max in each group."""
    means = F.array_sort(F.array(*[sum((F.pow(F.lit(2.0), F.col(f"z{g * per_group + k}")) for k in range(1, per_group)), F.pow(F.lit(2.0), F.col(f"z{g * per_group}"))) / per_group for g in range(groups)]))
    half = groups // 2
    return F.get(means, F.lit(half)) if groups % 2 else (F.get(means, F.lit(half - 1)) + F.get(means, F.lit(half))) / 2


def fm_distinct(df: DataFrame, value: str, by: list, groups: int = FM_GROUPS, per_group: int = FM_PER_GROUP, n: int = FM_MODULUS, seed: int = FM_SEED) -> DataFrame:
    """Per group of `by`: truth (distinct values) and estimate. An empty group has no row. Values are taken modulo n, so the estimate can't
    tell more than some hundreds of values; `hll_distinct` can."""
    rows = fm_input(df, value, n).groupBy(*by).agg(F.countDistinct(value).alias("truth"), *fm_aggregates(value, groups, per_group, n, seed))
    keep = [c for c in rows.columns if not (c[0] == "z" and c[1:].isdigit())]
    return rows.select(*keep, fm_estimate(groups, per_group).alias("estimate"))


#: Binary logarithm of the registers of a HyperLogLog sketch: a relative error of about 1.04 / sqrt(2**14), 0.8 %.
HLL_LOG = 14


def hll_distinct(df: DataFrame, value: str, by: list, log: int = HLL_LOG) -> DataFrame:
    """Per group of `by`: estimate of the distinct non-empty values, whatever their number, from a mergeable sketch of bounded size."""
    rows = df.where(F.col(value).isNotNull() & (F.col(value) != ""))
    return rows.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(log))).alias("estimate"))


def hashtags(df: DataFrame, text: str) -> DataFrame:
    """Rows with `tag`: one per token of # and ASCII letters only; a tag repeated in a text comes repeatedly."""
    return df.withColumn("tag", F.explode(F.split(F.trim(text), r"\s+"))).where(F.col("tag").rlike(TAG)).withColumn("tag", F.expr("substring(tag, 2)"))


def top_tags(tags: DataFrame, ranks: int = 3) -> DataFrame:
    """Tags whose count is among the `ranks` highest distinct counts: tag, count; ties stay, ordered by (count, tag)."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("count"))
    highest = counts.select("count").distinct().orderBy(F.desc("count")).limit(ranks)
    return counts.join(F.broadcast(highest), "count", "left_semi").select("tag", "count").orderBy(F.desc("count"), "tag")


def reservoir(df: DataFrame, key: str, k: int = 100, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows: those of the least `priority`, the md5 of key and seed, so keys of any type and size will do. Mergeable: samples of
    parts merge into the sample of the whole."""
    return df.withColumn("priority", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))).orderBy("priority", key).limit(k)


def count_changes(tags: DataFrame, sign: str) -> DataFrame:
    """Counts after additions (+1) and removals (-1) of tags; tags that fall to 0 drop out."""
    return tags.groupBy("tag").agg(F.sum(sign).alias("count")).where(F.col("count") > 0)


def peaks(df: DataFrame, step: str, value: str) -> DataFrame:
    """Rows whose value is the greatest, not below the one before and above the next; the ends count as having low neighbours. Steps (distinct) are
    numbered by ranges and neighbours met by their numbers, so no task sees the whole sequence."""
    low = F.lit(float("-inf"))
    at = materialize(dense_codes(df, step, "_i"))
    top = at.agg(F.max(value).alias("_m"))
    other = lambda by, name: at.select((F.col("_i") + by).alias("_i"), F.col(value).alias(name))
    rows = at.join(F.broadcast(top), F.col(value) == F.col("_m"), "left_semi").join(other(1, "_b"), "_i", "left").join(other(-1, "_n"), "_i", "left")
    return rows.where((F.col(value) >= F.coalesce("_b", low)) & (F.col(value) > F.coalesce("_n", low))).drop("_i", "_b", "_n")
