"""All pairs of records whose sets are similar: size-aware overlap join."""

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import clean_id
from millrace.plans.store import BLOCK, dense_codes, materialize, meet

#: Largest set whose token subsets are enumerated; larger sets are looked up in inverted lists.
SMALL = 24
#: Buckets of the token order for the prefixes of large sets.
BUCKETS = 1024


@dataclass
class SimilarSets:
    """pairs: (a, b, size_a, size_b, common), a < b, between representatives of different sets. members: (id, rep, size);
    records with equal sets share the representative, the least id."""

    pairs: DataFrame
    members: DataFrame

    def expanded(self) -> DataFrame:
        """All pairs (a, b, common, total) of records, a < b, those of equal sets included; total is the size of the union."""
        m = self.members
        same = meet(m, ["rep"], "id")
        same = same.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.size").alias("common"), F.col("l.size").alias("total"))
        other = self.pairs.join(m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
        other = other.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "common", (F.col("size_a") + F.col("size_b") - F.col("common")).alias("total"))
        return same.unionByName(other)

    def links(self) -> DataFrame:
        """One row per record: id, rep (its class of equal sets), size, copies (other records of the class), links (all similar records)."""
        copies = self.members.groupBy("rep").agg(F.count("*").alias("c"))
        both = self.pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(self.pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        near = both.join(copies.select(F.col("rep").alias("other"), "c"), "other").groupBy("rep").agg(F.sum("c").alias("near"))
        got = self.members.join(copies, "rep").join(near, "rep", "left")
        return got.select("id", "rep", "size", (F.col("c") - 1).alias("copies"), (F.col("c") - 1 + F.coalesce("near", F.lit(0))).alias("links"))


def _subsets(tokens: str, c: int, packed: bool):
    """Keys of all subsets of c tokens of an ordered array."""
    if c == 2 and packed:
        return F.flatten(F.transform(tokens, lambda x, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda y: F.shiftleft(x, 32).bitwiseOR(y))))
    level = F.transform(tokens, lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h")))
    for _ in range(c - 1):
        level = F.flatten(F.transform(level, lambda s: F.transform(F.slice(tokens, s["i"] + 2, F.size(tokens)), lambda y, j: F.struct((s["i"] + 1 + j).alias("i"), F.xxhash64(s["h"], y).alias("h")))))
    return F.transform(level, lambda s: s["h"])


def similar_sets(df: DataFrame, id: str, token: str, similarity: float | Fraction = Fraction(1, 2), min_size: int = 3, small_size: int = SMALL, subset: int = 2, block: int = BLOCK) -> SimilarSets:
    """Finds all pairs of records whose token sets have a Jaccard similarity of at least `similarity`, both sets holding at least min_size tokens.

    Records with equal sets become one class first (equal in size and in two 64-bit hashes of the set), so a large group
    of copies costs one record. Tokens get numbers in the order of their frequency, rare ones first. Then:
    - two small sets (up to small_size tokens) of the pair: each set enumerates its subsets of c tokens (`subset`, or fewer where
      the similarity lets the least sets have a smaller overlap) within the prefix of its token order that must hold c
      common tokens (size - overlap + c); sets meet by subset;
    - at least one large set: the large set's prefix tokens are looked up in inverted lists of the sets that are large
      enough to be its partners (at least similarity * small_size tokens), then all common tokens are counted.
    Both are united, and whole sets are compared. Frequent tokens come last and thus in few prefixes; where more than `block` sets
    share one that does (or a subset), they meet block by block.

    Null and blank ids and tokens don't count, ids are trimmed, repeated rows count once; other columns are ignored; an
    empty table gives no pairs.
    """
    sim = Fraction(similarity).limit_denominator(10**6)
    num, den = sim.numerator, sim.denominator
    rows = df.select(clean_id(id).alias("id"), clean_id(token).alias("token")).where("id is not null and token is not null").distinct()
    rows = materialize(rows)
    sizes = rows.groupBy("id").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("token", F.lit(1))).alias("h1"), F.bit_xor(F.xxhash64("token", F.lit(2))).alias("h2"))
    sizes = materialize(sizes.where(F.col("size") >= min_size))
    classes = sizes.groupBy("size", "h1", "h2").agg(F.min("id").alias("rep"))
    members = materialize(sizes.join(classes, ["size", "h1", "h2"]).select("id", "rep", "size", F.monotonically_increasing_id().alias("k")))
    reps = members.where("id = rep").select("id", "k", "size")
    codes = dense_codes(rows.groupBy("token").agg(F.count("*").alias("f")), ["f", "token"])
    facts = codes.agg(F.count("*").alias("n"), F.max("f").alias("f")).first()
    n, hot = max(1, facts["n"]), (facts["f"] or 0) > block
    tokens = materialize(rows.join(reps, "id").join(codes.select("token", "code"), "token").select("k", "size", "code"))

    overlap = F.ceil(F.col("size") * num / F.lit(den)).cast("int")  # with any partner
    least = 2 * min_size * sim / (1 + sim)
    c = max(1, min(subset, -(-least.numerator // least.denominator)))
    prefix = F.col("size") - F.greatest(overlap, F.lit(c)) + c
    fits = lambda a, b: (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)
    enough = F.col("common") * den >= (F.col("size_a") + F.col("size_b") - F.col("common")) * num
    pairs = lambda met: met.select(F.col("l.k").alias("a"), F.col("r.k").alias("b")).distinct()

    # small with small
    sets = materialize(tokens.where(F.col("size") <= small_size).groupBy("k", "size").agg(F.array_sort(F.collect_list("code")).alias("tokens")))
    keyed = sets.select("k", "size", F.slice("tokens", 1, prefix.cast("int")).alias("p")).select("k", "size", F.explode(_subsets("p", c, n < 1 << 31)).alias("key"))
    if hot:
        near = pairs(meet(materialize(keyed), ["key"], "k", block, fits("l.size", "r.size")))
    else:
        near = pairs(keyed.alias("l").join(keyed.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.k") < F.col("r.k")) & fits("l.size", "r.size")))
    for side in "ab":
        near = near.join(sets.select(F.col("k").alias(side), F.col("size").alias(f"size_{side}"), F.col("tokens").alias(f"t{side}")), side)
    near = near.withColumn("common", F.size(F.array_intersect("ta", "tb")).cast("long")).where(enough).select("a", "b", "size_a", "size_b", "common")

    # at least one large
    long = tokens.where(F.col("size") * den >= F.lit(small_size * num)).withColumn("q", F.floor(F.col("code") * BUCKETS / n).cast("int"))
    upto = long.groupBy("k", "size", "q").agg(F.count("*").alias("m"))
    upto = upto.withColumn("before", F.sum("m").over(W.partitionBy("k").orderBy("q")) - F.col("m")).where(F.col("before") < F.col("size") - overlap + 1)
    upto = upto.groupBy("k").agg(F.max("q").alias("last"))
    listed = long.join(upto, "k").where(F.col("q") <= F.col("last")).select("k", "size", "code")
    large = lambda x: F.col(x) > small_size
    if hot:
        far = meet(materialize(listed), ["code"], "k", block, fits("l.size", "r.size") & (large("l.size") | large("r.size")))
        far = far.select(F.col("l.k").alias("a"), F.col("r.k").alias("b")).distinct()
    else:
        far = listed.where(large("size")).alias("l").join(listed.alias("r"), (F.col("l.code") == F.col("r.code")) & (F.col("l.k") != F.col("r.k")) & fits("l.size", "r.size"))
        far = far.select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b")).distinct()
    side = lambda s: long.select(F.col("k").alias(s), "code", F.col("size").alias(f"size_{s}"))
    far = far.join(side("a"), "a").join(side("b"), ["b", "code"]).groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("common"))
    found = near.unionByName(far.where(enough).select("a", "b", "size_a", "size_b", "common"))
    for s in "ab":
        found = found.join(reps.select(F.col("k").alias(s), F.col("id").alias(f"id_{s}")), s)
    first = F.col("id_a") < F.col("id_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    found = found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), pick("size_a", "size_b").alias("size_a"), pick("size_b", "size_a").alias("size_b"), "common")
    return SimilarSets(materialize(found), members.select("id", "rep", "size"))
