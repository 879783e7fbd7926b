"""Similarity of sets: exact Jaccard, MinHash signatures, banded LSH."""

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import clean_id
from millrace.plans.store import BLOCK, dense_codes, materialize, meet

#: The hash family (a * x + b) % p, its seed, and the signature's bands and rows. Fixed values.
B, P, SEED, BANDS, ROWS = 1301, 24593, 1301, 500, 2
#: Similarity from which the exact join goes by prefixes.
PREFIX_FROM = 0.3
#: Members of one set that one task takes; larger sets are signed in parts.
PART = 100_000


def memberships(df: DataFrame, set_id: str, member: str) -> DataFrame:
    """Distinct (id, member) without nulls and blanks, ids trimmed."""
    return df.select(clean_id(set_id).alias("id"), clean_id(member).alias("member")).where("id is not null and member is not null").distinct()


def coefficients(n: int, seed: int) -> list[int]:
    """n distinct multipliers below 10 n, the same for a seed in every run."""
    return random.Random(seed).sample(range(1, 10 * n), n)


def jaccard(pairs: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """Exact similarity of the pairs (a, b): a, b, sim, where sim >= at_least. Counts common members by joins; no set is gathered."""
    sizes = sets.groupBy("id").agg(F.count("*").alias("n"))
    common = pairs.join(sets.select(F.col("id").alias("a"), "member"), "a").join(sets.select(F.col("id").alias("b"), "member"), ["b", "member"]).groupBy("a", "b").agg(F.count("*").alias("c"))
    both = common.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return both.withColumn("sim", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where(F.col("sim") >= at_least).select("a", "b", "sim")


def jaccard_pairs(sets: DataFrame, at_least: float = 0.05, block: int = BLOCK, prefix: bool | None = None) -> DataFrame:
    """All pairs a < b of similarity at_least or more: a, b, sim.

    Without `prefix` (by default below PREFIX_FROM, where prefixes leave out next to nothing) pairs are counted from all their
    common members, in one aggregation. With it sets meet on the members of their prefix: in the order of frequency, rare ones first, two sets of that similarity share one
    of the first size - ceil(at_least * size) + 1 members of each, so frequent members of larger sets pair nothing up. A
    member that still brings more than `block` sets together is taken block by block. Pairs met are then counted over all
    their members.
    """
    near = (F.col("l.n") >= F.col("r.n") * at_least) & (F.col("r.n") >= F.col("l.n") * at_least)
    if not (at_least >= PREFIX_FROM if prefix is None else prefix):
        x = sets.join(sets.groupBy("id").agg(F.count("*").alias("n")), "id").select("id", "member", "n")
        common = meet(materialize(x), ["member"], "id", block, near)
        common = common.groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.n").alias("na"), F.col("r.n").alias("nb")).agg(F.count("*").alias("c"))
        return common.withColumn("sim", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where(F.col("sim") >= at_least).select("a", "b", "sim")
    sizes = materialize(sets.groupBy("id").agg(F.count("*").alias("n")))
    codes = dense_codes(sets.groupBy("member").agg(F.count("*").alias("f")), ["f", "member"], "x")
    coded = materialize(sets.join(codes.select("member", "x"), "member").join(sizes, "id").select("id", "n", "x"))
    overlap = F.ceil(F.round(F.col("n") * at_least, 9))
    # members by 1,024 steps of the order: a prefix ends with the step in which it is full, so no set is sorted as a whole
    n = max(1, codes.count())
    stepped = coded.withColumn("q", F.floor(F.col("x") * 1024 / n).cast("int"))
    upto = stepped.groupBy("id", "n", "q").agg(F.count("*").alias("m"))
    upto = upto.withColumn("before", F.sum("m").over(W.partitionBy("id").orderBy("q")) - F.col("m")).where(F.col("before") < F.col("n") - overlap + 1)
    first = materialize(stepped.join(upto.groupBy("id").agg(F.max("q").alias("last")), "id").where("q <= last").select("id", "n", "x"))
    pairs = meet(first, ["x"], "id", block, near).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    return jaccard(pairs, coded.select("id", F.col("x").alias("member")), at_least)


def _hashed(n: int, b: int, p: int, m: int, factors: np.ndarray):
    """Least hashes of runs of equal ids; rows arrive sorted by id, so only the last run of a batch is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, mins) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(mins.ravel().astype(np.int64)), n).cast(pa.list_(pa.int64()))], names=["id", "signature"])

        last, carry = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                ids = batch.column(0).slice(k, 2048)
                x = (batch.column(1).slice(k, 2048).to_numpy() % p).astype(np.uint64)
                h = (((x[:, None] * factors + np.uint64(b)) % np.uint64(p)) % np.uint64(m)).astype(np.uint32)
                names = ids.to_numpy(zero_copy_only=False)
                edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
                mins = np.minimum.reduceat(h, edge, axis=0)
                if last is not None and names[0] == last.as_py():
                    mins[0] = np.minimum(mins[0], carry)
                elif last is not None:
                    yield out(pa.array([last.as_py()], ids.type), carry[None, :])
                yield out(ids.take(pa.array(edge[:-1])), mins[:-1])
                last, carry = ids[-1], mins[-1]
        if last is not None:
            yield out(pa.array([last.as_py()], last.type), carry[None, :])

    return run


def _merged(n: int):
    """The elementwise least of the signatures of one id; rows arrive sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, None
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, n)
            for id, row in zip(batch.column(0).to_pylist(), rows, strict=True):
                if last is not None and id != last:
                    yield pa.RecordBatch.from_arrays([pa.array([last], batch.column(0).type), pa.array([carry], pa.list_(pa.int64()))], names=["id", "signature"])
                    carry = None
                last, carry = id, row if carry is None else np.minimum(carry, row)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.column(0).type), pa.array([carry], pa.list_(pa.int64()))], names=["id", "signature"])

    return run


def minhash_signatures(sets: DataFrame, n: int = BANDS * ROWS, b: int = B, p: int = P, seed: int = SEED, m: int | None = None, part: int = PART) -> DataFrame:
    """id, signature: for each multiplier a the least ((a * x + b) % p) % m over the members' dense numbers x (in word order).
    m: the number of sets, unless given. All n hashes of many members are computed at once; a set of more than `part` members
    is signed in parts, whose signatures are merged."""
    members = dense_codes(sets.select("member").distinct(), "member", "x")
    sizes = sets.groupBy("id").agg(F.count("*").alias("c"))
    facts = sizes.agg(F.count("*").alias("n"), F.max("c").alias("c")).first()
    if m is None:
        m = max(1, facts["n"])
    rows = sets.join(members, "member").select("id", "x")
    kind = rows.schema["id"].dataType.simpleString()
    sign = _hashed(n, b, p, m, np.array(coefficients(n, seed), np.uint64) % np.uint64(p))
    schema = f"id {kind}, signature array<long>"
    if (facts["c"] or 0) <= part:
        return rows.repartition("id").sortWithinPartitions("id").mapInArrow(sign, schema)
    large = sizes.where(F.col("c") > part).select("id", F.ceil(F.col("c") / part).cast("int").alias("_n"))
    cut = rows.join(large, "id", "left").withColumn("_k", F.pmod(F.xxhash64("x"), F.coalesce("_n", F.lit(1))))
    parts = cut.repartition("id", "_k").sortWithinPartitions("id", "_k").select("id", "x").mapInArrow(sign, schema)
    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(_merged(n), schema)


def _band_keys(bands: int, rows: int):
    """For each set and band a key of the band's number and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(1).flatten().to_numpy().astype(np.uint64).reshape(batch.num_rows, -1)[:, : bands * rows].reshape(-1, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), h.shape[:2]).copy()
            with np.errstate(over="ignore"):
                for k in range(rows):
                    key = (key * np.uint64(0x9E3779B97F4A7C15) + h[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
            codes = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(key.ravel().view(np.int64))], names=["c", "key"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another row has too. Rows arrive sorted by key; only the last one of a batch is held back."""
    codes, keys, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def out(on: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes[: len(on)][on]), pa.array(keys[: len(on)][on])], names=["c", "key"])

    for batch in batches:
        codes, keys = np.concatenate([codes, batch.column(0).to_numpy()]), np.concatenate([keys, batch.column(1).to_numpy()])
        if len(keys) < 2:
            continue
        same = keys[1:] == keys[:-1]
        on = np.concatenate(([met], same[:-1])) | same
        yield out(on)
        codes, keys, met = codes[-1:], keys[-1:], bool(same[-1])
    if met:
        yield out(np.ones(1, bool))


def lsh_candidates(signatures: DataFrame, bands: int, rows: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs a < b whose signatures agree in all rows of some band.

    Sets of equal signatures form a class, of which the least id is banded; its other members are paired by the class. Sets travel as
    numbers; of the many bands' keys only those that two sets share are joined, and buckets of more than `block`
    classes are taken block by block.
    """
    known = materialize(signatures.select("id", F.xxhash64("signature").alias("c1"), F.hash("signature").alias("c2"), "signature", F.monotonically_increasing_id().alias("c")))
    reps = known.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    several = reps.where("n > 1").limit(1).count()
    of = materialize(known.join(reps, ["c1", "c2"]).select("id", "rep")) if several else None
    banded = known.join(of.where("id = rep").select("id"), "id", "left_semi") if several else known
    keyed = banded.select("c", "signature").mapInArrow(_band_keys(bands, rows), "c long, key long")
    shared = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "c long, key long"))
    pairs = meet(shared, ["key"], "c", block).select(F.col("l.c").alias("x"), F.col("r.c").alias("y")).distinct()
    for code, name in (("x", "ia"), ("y", "ib")):
        pairs = pairs.join(known.select(F.col("c").alias(code), F.col("id").alias(name)), code)
    if several:
        for name in ("ia", "ib"):
            pairs = pairs.join(of.select(F.col("rep").alias(name), F.col("id").alias(f"own_{name}")), name)
        pairs = pairs.select(F.col("own_ia").alias("ia"), F.col("own_ib").alias("ib"))
    pairs = pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    if several:
        pairs = pairs.unionByName(meet(of, ["rep"], "id", block).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")))
    return pairs


def lsh_pairs(sets: DataFrame, bands: int = BANDS, rows: int = ROWS, at_least: float = 0.05, b: int = B, p: int = P, seed: int = SEED) -> DataFrame:
    """Pairs found by banded MinHash and verified exactly: a, b, sim. A pair of similarity s is found with a chance of about 1 - (1 - s ** rows) ** bands:
    0.99 at 0.1 and above, 0.71 at 0.05 exactly. `jaccard_pairs` is the exact way."""
    signatures = minhash_signatures(sets, bands * rows, b, p, seed)
    return jaccard(lsh_candidates(signatures, bands, rows), sets, at_least)
