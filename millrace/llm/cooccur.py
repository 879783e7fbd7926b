"""Items that appear together: pair counts over baskets and how far they exceed chance."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_id
from millrace.plans.store import dense_codes, materialize

#: Pair codes held by a task before it sorts them into a run.
RUN = 1 << 21
#: Largest number of items of one basket that one task pairs with each other; larger baskets are cut into blocks.
BLOCK = 512


def _within(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Packed codes of all pairs within each list, lists of one length at a time."""
    for m in np.unique(sizes[sizes > 1]):
        at = starts[sizes == m]
        i, j = np.triu_indices(int(m), 1)
        step = max(1, RUN // len(i))
        for k in range(0, len(at), step):
            rows = np.sort(values[at[k : k + step, None] + np.arange(m)], axis=1)
            yield ((rows[:, i] << 32) | rows[:, j]).ravel()


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False), offsets[:-1], np.diff(offsets)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of packed pair codes with their run lengths."""
    held: list[np.ndarray] = []
    n = 0

    def run() -> pa.RecordBatch:
        codes = np.concatenate(held)
        codes.sort()
        edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(codes[edge]), pa.array(np.diff(np.append(edge, len(codes))))], names=["code", "n"])

    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        lv, ls, ln = _lists(left)
        rv, rs, rn = _lists(right)
        alone = rn == 0
        pieces = [_within(lv, ls[alone], ln[alone])]
        for k in np.flatnonzero(~alone):  # two blocks of one large basket: only pairs across them
            a, b = np.meshgrid(lv[ls[k] : ls[k] + ln[k]], rv[rs[k] : rs[k] + rn[k]])
            pieces.append(iter([((np.minimum(a, b) << 32) | np.maximum(a, b)).ravel()]))
        for piece in pieces:
            for codes in piece:
                held.append(codes)
                n += len(codes)
                if n >= RUN:
                    yield run()
                    held, n = [], 0
    if n:
        yield run()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sums over codes that arrive sorted; a run may cross batches."""
    code, total = None, 0
    for batch in batches:
        codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(codes):
            continue
        edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        keys, sums = codes[edge], np.add.reduceat(n, edge)
        if code is not None and keys[0] == code:
            sums[0] += total
        elif code is not None:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], names=["code", "n"])
        code, total = int(keys[-1]), int(sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], names=["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], names=["code", "n"])


def cooccurrence(df: DataFrame, basket: str, item: str, min_pairs: int = 2, lift: int = 0, block: int = BLOCK) -> DataFrame:
    """Counts of item pairs over baskets by an external sort of packed pair codes.

    Returns item_a < item_b (word order), n_a, n_b, n_ab (baskets holding a, b, both), n (baskets), and the odds ratio of
    the 2x2 table with 0.5 added to each cell, its logarithm and the logarithm's standard error. Rows have
    n_ab >= min_pairs and, if lift > 0, n_ab * n >= lift * n_a * n_b (whole numbers).

    Items get dense 32-bit codes in word order; a pair is one 64-bit code. Tasks pair the items of whole baskets, or of two
    blocks of a large basket, sort the codes in bounded buffers and count run lengths; Spark's external sort spills and
    merges the runs by code, and a last pass adds up equal codes. Nothing is left out:
    - items in fewer than min_pairs baskets, or, under a lift, in more than n / lift, can be in no row (n_ab <= n_a), and go first;
    - a pair of a row shares at least one basket besides any min_pairs - 1 baskets, so those largest baskets, if
      larger than a block, are not paired up: items carry a bit for each, and the pair's common bits are added.

    Nulls, blanks and header lines (a value equal to its column's name) don't count, spaces at the ends of ids are trimmed,
    repeated rows count once; other columns are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    if min_pairs < 1:
        raise ValueError("min_pairs must be 1 at least")
    rows = df.select(clean_id(basket).alias("_k"), clean_id(item).alias("_v"))
    rows = materialize(rows.where((F.col("_k") != basket) & (F.col("_v") != item)).distinct())
    per_basket = rows.groupBy("_k").agg(F.count("*").alias("_m"))
    n, largest = per_basket.agg(F.count("*"), F.max("_m")).first()
    items = rows.groupBy("_v").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pairs)
    if lift:
        items = items.where(F.col("_n").cast("decimal(38,0)") * lift <= n)
    items = materialize(dense_codes(items, "_v", "_c"))
    if items.count() > 1 << 31:
        raise ValueError("more than 2**31 items remain: raise min_pairs")
    coded = rows.join(items.select("_v", "_c"), "_v").select("_k", "_c")

    giants = []
    if min_pairs > 1 and (largest or 0) > block:
        giants = [r["_k"] for r in per_basket.where(F.col("_m") > block).orderBy(F.desc("_m"), "_k").limit(min(min_pairs - 1, 62)).collect()]
    extra = None
    if giants:
        where = spark.createDataFrame([(k, 1 << i) for i, k in enumerate(giants)], "_k string, _bit long")
        extra = materialize(coded.join(F.broadcast(where), "_k").groupBy("_c").agg(F.bit_or("_bit").alias("_bits")))
        coded = coded.join(F.broadcast(where), "_k", "left_anti")

    if (largest or 0) > block:
        big = per_basket.where(F.col("_m") > block).select("_k", F.ceil(F.col("_m") / block).cast("int").alias("_nb"))
        coded = coded.join(big, "_k", "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
        own = F.pmod(F.xxhash64("_c"), F.col("_nb")).cast("int")
        coded = coded.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        groups = coded.groupBy("_k", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j")).agg(
            F.collect_list(F.when(F.col("_b") == F.least("_b", "_o"), F.col("_c"))).alias("left"),
            F.collect_list(F.when(F.col("_b") != F.least("_b", "_o"), F.col("_c"))).alias("right"),
        )
        lists = groups.where((F.col("_i") == F.col("_j")) | (F.size("right") > 0)).select("left", "right")
    else:
        lists = coded.groupBy("_k").agg(F.collect_list("_c").alias("left")).where(F.size("left") > 1).select("left", F.expr("cast(array() as array<bigint>)").alias("right"))

    runs = lists.mapInArrow(_runs, "code long, n long")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge, "code long, n long")
    pairs = merged.where(F.col("n") >= min_pairs - len(giants)).select(F.shiftright("code", 32).alias("_a"), F.col("code").bitwiseAND((1 << 32) - 1).alias("_b"), F.col("n").alias("n_ab"))
    if extra is not None:
        for side in "ab":
            pairs = pairs.join(extra.select(F.col("_c").alias(f"_{side}"), F.col("_bits").alias(f"_bits{side}")), f"_{side}", "left")
        both = F.bit_count(F.coalesce("_bitsa", F.lit(0)).bitwiseAND(F.coalesce("_bitsb", F.lit(0))))
        pairs = pairs.withColumn("n_ab", F.col("n_ab") + both).where(F.col("n_ab") >= min_pairs)
    for side in "ab":
        pairs = pairs.join(items.select(F.col("_c").alias(f"_{side}"), F.col("_v").alias(f"item_{side}"), F.col("_n").alias(f"n_{side}")), f"_{side}")
    if lift:
        wide = [F.col(c).cast("decimal(19,0)") for c in ("n_ab", "n_a", "n_b")]
        pairs = pairs.where(wide[0] * F.lit(n).cast("decimal(19,0)") >= wide[1] * wide[2] * lift)
    cells = [F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5, F.lit(n) - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5]
    odds = (cells[0] / cells[1]) * (cells[3] / cells[2])
    error = F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0]))
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.lit(n).cast("long").alias("n"), odds.alias("odds_ratio"), F.ln(odds).alias("log_odds"), error.alias("log_odds_se"))
