"""Most frequent values in bounded memory: heavy buckets with votes over a light counter array."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import hash_strings
from millrace.plans.store import materialize

#: Buckets of the heavy part; each holds one value exactly until it is voted out.
BUCKETS = 1 << 14
#: Counters of the light part: as many as fit ROWS_A_COUNTER rows each, within these bounds.
LEAST_COUNTERS, MOST_COUNTERS, ROWS_A_COUNTER = 1 << 18, 1 << 22, 256
#: Votes against a bucket's value, as a multiple of its own, that evict it.
LAMBDA = 8

_SCHEMA = "part int, at int, value string, count long"


class HeavyLight:
    """The sketch. Buckets: value with its light cell, count, votes against. Values are added many at a time: of those that meet
    another value in their bucket all vote against it, and the most frequent one is its challenger."""

    def __init__(self, buckets: int, counters: int):
        self.values = np.full(buckets, None, object)
        self.cells, self.count, self.against = (np.zeros(buckets, np.int64) for _ in range(3))
        self.light = np.zeros(counters, np.int64)

    def add(self, values: np.ndarray, n: np.ndarray, at: np.ndarray, cell: np.ndarray) -> None:
        """Distinct values with their uses, buckets and light cells."""
        own = self.values[at] == values
        self.count[at[own]] += n[own]
        rest = np.flatnonzero(~own)
        if not len(rest):
            return
        rest = rest[np.lexsort((-n[rest], at[rest]))]
        first = np.concatenate(([True], at[rest][1:] != at[rest][:-1]))
        rival, bucket = rest[first], at[rest][first]
        votes = np.add.reduceat(n[rest], np.flatnonzero(first))
        empty = self.values[bucket] == None  # noqa: E711
        self.against[bucket] += np.where(empty, 0, votes)
        evicted = ~empty & (self.against[bucket] >= LAMBDA * self.count[bucket])
        np.add.at(self.light, self.cells[bucket[evicted]], self.count[bucket[evicted]])
        won = empty | evicted
        w, r = bucket[won], rival[won]
        self.values[w], self.cells[w], self.count[w], self.against[w] = values[r], cell[r], n[r], votes[won] - n[r]
        lit = np.concatenate([rest[~first], rival[~won]])
        np.add.at(self.light, cell[lit], n[lit])


def _places(values: pa.Array, buckets: int, counters: int) -> tuple[np.ndarray, np.ndarray]:
    h = hash_strings(values)
    return (h % np.uint64(buckets)).astype(np.int64), ((h >> np.uint64(20)) % np.uint64(counters)).astype(np.int64)


def _sketch(buckets: int, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = HeavyLight(buckets, counters)
        for batch in batches:
            if batch.num_rows:
                counted = batch.column(0).value_counts()
                values = counted.field(0)
                sketch.add(values.to_numpy(zero_copy_only=False), counted.field(1).to_numpy(), *_places(values, buckets, counters))
        used = np.flatnonzero(sketch.values != None)  # noqa: E711
        lit = np.flatnonzero(sketch.light)
        for part, at, values, count in ((0, used, pa.array(sketch.values[used], pa.string()), sketch.count[used]), (1, lit, pa.nulls(len(lit), pa.string()), sketch.light[lit])):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at.astype(np.int32)), values, pa.array(count)], names=["part", "at", "value", "count"])

    return run


def frequent_values(df: DataFrame, value: str, k: int = 25, buckets: int = BUCKETS, counters: int | None = None) -> DataFrame:
    """The k most frequent values with exact counts and the sketch's estimates, in bounded memory.

    Returns value, estimate, count, pos (1 to k; equal counts in word order). Each task keeps a heavy part (one value a
    bucket, evicted by votes) and a light array of counters for what is evicted. Tasks' parts are recombined bucket by
    bucket: of the values that hold one bucket in different tasks the one with the greatest sum stays and the others'
    counts go to the light part; light counters add up. What reaches the driver is bounded by buckets + counters (by default
    a counter for every 256 rows, 2**22 at most).

    An exact check follows. A value's heavy count plus its light counter is never below its true count, and the k-th
    greatest heavy count is never above the k-th greatest true count: only values whose upper bound reaches it can be
    among the k. A second pass counts exactly those values, most rows being dropped where they are read.

    Null values don't count. Fewer than k distinct values: all come out. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = materialize(df.select(F.col(value).alias("value")).where(F.col("value").isNotNull()))
    if counters is None:
        counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (rows.count() // ROWS_A_COUNTER).bit_length()))
    parts = materialize(rows.mapInArrow(_sketch(buckets, counters), _SCHEMA))
    held = parts.where("part = 0").groupBy("at", "value").agg(F.sum("count").alias("count"))
    heavy = materialize(held.groupBy("at").agg(F.max(F.struct("count", "value")).alias("top")).select("at", "top.value", "top.count"))
    lost = held.join(heavy.select(F.col("at"), F.col("value").alias("kept")), "at").where(F.col("value") != F.col("kept")).select("value", "count")
    light = np.zeros(counters, np.int64)
    cells = parts.where("part = 1").groupBy("at").agg(F.sum("count").alias("n")).toArrow()
    light[cells.column("at").to_numpy()] += cells.column("n").to_numpy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, cell = _places(b.column(0), buckets, counters)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(1)], names=["cell", "n"])

    cells = lost.mapInArrow(place, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    light[cells.column("cell").to_numpy()] += cells.column("n").to_numpy()
    top = heavy.orderBy(F.desc("count"), "value").limit(k).collect()
    floor = top[-1]["count"] if len(top) == k else 0
    kept = {r["at"]: (r["value"], r["count"]) for r in heavy.select("at", "value", "count").collect()}
    values = np.array([kept.get(a, (None, 0))[0] for a in range(buckets)], object)
    counts = np.array([kept.get(a, (None, 0))[1] for a in range(buckets)], np.int64)
    shared = spark.sparkContext.broadcast((light, values, counts))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light, values, counts = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            counted = b.column(0).value_counts()
            found, n = counted.field(0), counted.field(1)
            at, cell = _places(found, buckets, counters)
            upper = light[cell] + np.where(values[at] == found.to_numpy(zero_copy_only=False), counts[at], 0)
            on = pa.array(upper >= floor)
            yield pa.RecordBatch.from_arrays([found.filter(on), pa.array(upper).filter(on), n.filter(on)], names=["value", "estimate", "n"])

    exact = rows.mapInArrow(reach, "value string, estimate long, n long").groupBy("value").agg(F.max("estimate").alias("estimate"), F.sum("n").alias("count"))
    best = exact.orderBy(F.desc("count"), "value").limit(k)
    listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "value", "estimate", "count"))).alias("l"))
    return listed.select(F.posexplode("l").alias("p", "r")).select("r.value", "r.estimate", "r.count", (F.col("p") + 1).alias("pos"))
