"""Clustering: k-means with farthest-first seeds, diagonal Mahalanobis distances, clustering by summaries chunk by chunk, NMI.

Points are rows (id, features array<double>). Centroids and summaries are few and live on the driver; points never do.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.store import materialize


def points(df: DataFrame, id: str, features: str) -> DataFrame:
    """(id, features) with double features; rows without either don't count."""
    return df.select(F.col(id).alias("id"), F.col(features).cast("array<double>").alias("features")).where("id is not null and features is not null")


def parse_points(lines: DataFrame, value: str = "value") -> DataFrame:
    """Points from text lines id,f1,...,fd. Every field after the first is a feature, whatever its text."""
    parts = F.split(F.trim(value), ",")
    return lines.where(F.trim(value) != "").select(F.get(parts, F.lit(0)).cast("long").alias("id"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double")).alias("features"))


def squared_distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def mahalanobis(features: str, n: str, sums: str, squares: str):
    """Distance to a summary with diagonal variance; dimensions without variance use the plain difference, variances below 0 count as 0."""
    mean = F.transform(sums, lambda s: s / F.col(n))
    var = F.zip_with(F.transform(squares, lambda s: s / F.col(n)), mean, lambda q, m: F.greatest(q - m * m, F.lit(0.0)))
    diff = F.zip_with(features, mean, lambda x, m: x - m)
    terms = F.zip_with(diff, var, lambda d, v: d * d / F.when(v > 0, v).otherwise(1.0))
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))


#: Numbers (points times dimensions) up to which k-means takes its points into one array; beyond, every step is a pass over the table.
LOCAL = 4_000_000
#: Numbers of one block of differences between points and centroids.
_CELLS = 4_000_000


def farthest_first(pts: DataFrame, k: int) -> np.ndarray:
    """k starting centroids: the point of the least id, then again and again the point farthest from those taken (ties: the
    least id). Each step is one pass in which every task names its farthest point. Ends early if all points are taken."""
    first = pts.orderBy("id").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    taken = [first[0]["features"]]
    kind = pts.schema["id"].dataType.simpleString()
    for _ in range(k - 1):
        centroids = np.array(taken, float)

        def run(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            best = None
            for b in batches:
                if b.num_rows:
                    _, d = _nearest(_matrix(b.column(1)), centroids)
                    ids = b.column(0).to_pylist()
                    far = min(np.flatnonzero(d == d.max()).tolist(), key=lambda i: ids[i])
                    if best is None or (-d[far], ids[far]) < (-best[0], best[1]):
                        best = float(d[far]), ids[far], b.column(1)[far].as_py()
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2]], pa.list_(pa.float64()))], names=["d", "id", "features"])

        top = pts.select("id", "features").mapInArrow(run, f"d double, id {kind}, features array<double>").orderBy(F.desc("d"), "id").limit(1).collect()[0]
        if top["d"] == 0:
            break
        taken.append(top["features"])
    return np.array(taken, float)


def _local_seeds(x: np.ndarray, k: int) -> np.ndarray:
    """The same over points in the order of their ids."""
    if not len(x):
        return np.zeros((0, 0))
    taken, least = [x[0]], np.full(len(x), np.inf)
    for _ in range(k - 1):
        least = np.minimum(least, ((x - taken[-1]) ** 2).sum(axis=1))
        far = int(least.argmax())
        if least[far] == 0:
            break
        taken.append(x[far])
    return np.array(taken)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, the first of equal ones, and the squared distance; some points at a time."""
    at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, _CELLS // max(1, centroids.size))
    for k in range(0, len(x), step):
        part = ((x[k : k + step, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        at[k : k + step] = part.argmin(axis=1)
        d[k : k + step] = part.min(axis=1)
    return at, d


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def assign(pts: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster: the nearest centroid, ties to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, _ = _nearest(_matrix(b.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32())], names=["id", "cluster"])

    kind = pts.schema["id"].dataType.simpleString()
    return pts.select("id", "features").mapInArrow(run, f"id {kind}, cluster int")


def summaries(pts: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, n, sums, squares of points that carry a cluster; combined per dimension before the exchange."""
    long = pts.select(cluster, F.posexplode("features").alias("k", "x"))
    sums = long.groupBy(cluster, "k").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    packed = sums.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "s", "q"))).alias("l"))
    return packed.select(F.col(cluster).alias("cluster"), "n", F.transform("l", lambda r: r["s"]).alias("sums"), F.transform("l", lambda r: r["q"]).alias("squares"))


def _step(pts: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and sums of the nearest-centroid clusters; each task sends one row a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                at, _ = _nearest(x, centroids)
                n += np.bincount(at, minlength=len(centroids))
                np.add.at(s, at, x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n), pa.array(list(s), pa.list_(pa.float64()))], names=["c", "n", "s"])

    got = pts.select("features").mapInArrow(run, "c int, n long, s array<double>").select("c", "n", F.posexplode("s").alias("k", "v")).groupBy("c", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, s = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
    for r in got:
        n[r["c"]], s[r["c"], r["k"]] = r["n"], r["v"]
    return n, s


def _local_step(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, _ = _nearest(x, centroids)
    s = np.zeros(centroids.shape)
    np.add.at(s, at, x)
    return np.bincount(at, minlength=len(centroids)), s


def kmeans(pts: DataFrame, k: int, rounds: int = 100, tolerance: float = 1e-9, local: int = LOCAL) -> np.ndarray:
    """Centroids by Lloyd's rounds from farthest-first seeds, until no coordinate moves by more than `tolerance` (of the largest one) or after
    `rounds`. An empty cluster keeps its centroid. A table of up to `local` numbers is counted first and then searched in one
    array; of a larger one every round is a pass in which each task sends a row a cluster."""
    pts = materialize(pts)
    size = pts.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if not size["n"]:
        return np.zeros((0, 0))
    if size["n"] * size["d"] <= local:
        x = np.array(pts.orderBy("id").select("features").toArrow().column(0).to_pylist(), float).reshape(size["n"], -1)
        centroids, step = _local_seeds(x, k), lambda c: _local_step(x, c)
    else:
        centroids, step = farthest_first(pts, k), lambda c: _step(pts, c)
    for _ in range(rounds if len(centroids) else 0):
        n, s = step(centroids)
        moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centroids)
        still = np.abs(moved - centroids).max() <= tolerance * max(1.0, np.abs(centroids).max())
        centroids = moved
        if still:
            break
    return centroids


@dataclass
class Summary:
    """Clusters as counts, sums and sums of squares."""

    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @classmethod
    def none(cls, d: int) -> "Summary":
        return cls(np.zeros(0, np.int64), np.zeros((0, d)), np.zeros((0, d)))

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> "Summary":
        """The clusters with further points in them."""
        return Summary(self.n + n, self.sums + s, self.squares + q)

    def append(self, other: "Summary") -> "Summary":
        return Summary(np.concatenate([self.n, other.n]), np.concatenate([self.sums, other.sums]), np.concatenate([self.squares, other.squares]))

    def merge(self, groups: np.ndarray) -> "Summary":
        """One cluster per group number; no count or sum is lost."""
        k = int(groups.max(initial=-1)) + 1
        out = Summary(np.zeros(k, np.int64), np.zeros((k, self.sums.shape[1])), np.zeros((k, self.sums.shape[1])))
        np.add.at(out.n, groups, self.n)
        np.add.at(out.sums, groups, self.sums)
        np.add.at(out.squares, groups, self.squares)
        return out

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Mahalanobis distance of each point to each cluster."""
        if not len(self.n):
            return np.zeros((len(x), 0))
        mean = self.sums / self.n[:, None]
        var = np.maximum(self.squares / self.n[:, None] - mean**2, 0)
        scale = np.where(var > 0, var, 1.0)
        step = max(1, _CELLS // max(1, mean.size))
        return np.concatenate([np.sqrt((((x[k : k + step, None, :] - mean) ** 2) / scale).sum(axis=2)) for k in range(0, max(1, len(x)), step)])


@dataclass
class ChunkedClusters:
    """labels: (id, cluster), -1 for outliers. rounds: one row of statistics a chunk."""

    labels: DataFrame
    rounds: list[tuple]
    discard: Summary = field(default_factory=lambda: Summary.none(1))


_KINDS = {"discard": 0, "compression": 1, "retained": 2}


def _place(chunk: DataFrame, ds: Summary, cs: Summary, limit: float) -> DataFrame:
    """kind and cluster of each point: the nearest discard cluster within the limit, else the nearest compression cluster within it, else retained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            kind, at = np.full(len(x), 2, np.int32), np.full(len(x), -1, np.int32)
            for code, s in ((1, cs), (0, ds)):
                d = s.distances(x)
                if d.shape[1]:
                    near = d.argmin(axis=1)
                    on = d[np.arange(len(x)), near] < limit
                    kind[on], at[on] = code, near[on]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kind), pa.array(at)], names=["id", "features", "kind", "cluster"])

    kind = chunk.schema["id"].dataType.simpleString()
    return chunk.select("id", "features").mapInArrow(run, f"id {kind}, features array<double>, kind int, cluster int")


def _summary(pts: DataFrame, k: int, d: int) -> Summary:
    out = Summary(np.zeros(k, np.int64), np.zeros((k, d)), np.zeros((k, d)))
    for r in summaries(pts).collect():
        out.n[r["cluster"]], out.sums[r["cluster"]], out.squares[r["cluster"]] = r["n"], r["sums"], r["squares"]
    return out


def _linked(s: Summary, limit: float) -> np.ndarray:
    """Group numbers of clusters whose centroids are linked by distances below the limit."""
    k = len(s.n)
    group = np.arange(k)
    if k:
        near = s.distances(s.sums / s.n[:, None]) < limit
        for i, j in np.argwhere(near):
            a, b = group[i], group[j]
            if a != b:
                group[group == max(a, b)] = min(a, b)
    return np.unique(group, return_inverse=True)[1]


def _compress(rest: DataFrame, k: int, d: int) -> tuple[Summary, DataFrame, DataFrame]:
    """k-means over retained points: clusters of several points as summaries, those points with their cluster, and the single points."""
    centroids = kmeans(rest, k)
    tagged = materialize(rest.join(assign(rest, centroids), "id"))
    sizes = {r["cluster"]: r["n"] for r in tagged.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    many = sorted(c for c, n in sizes.items() if n > 1)
    number = {c: i for i, c in enumerate(many)}
    if not many:
        return Summary.none(d), tagged.where("false"), tagged.drop("cluster")
    to = F.create_map(*[F.lit(x) for c, i in number.items() for x in (c, i)])
    new = tagged.withColumn("cluster", F.try_element_at(to, F.col("cluster")))
    packed = new.where("cluster is not null")
    return _summary(packed, len(many), d), packed.select("id", "cluster"), new.where("cluster is null").drop("cluster")


def cluster_chunks(chunks: list[DataFrame], k: int, sample: float = 0.2, factor: int = 3, alpha: float = 3.0) -> ChunkedClusters:
    """Clusters points that arrive in chunks, keeping of earlier chunks only summaries and the retained points.

    The first chunk that has points: a hash sample (share `sample`) is clustered by k-means, clusters of one point are set aside and the rest is
    clustered again; these k clusters are the discard set. Every chunk's points go to the nearest discard cluster below
    alpha * sqrt(d) in Mahalanobis distance, else to the nearest compression cluster, else are retained; a chunk is judged by
    the summaries at its start. When more than factor * k points are retained they are clustered into new
    compression clusters, and compression clusters nearer to each other than the limit merge. At the end compression
    clusters join the nearest discard cluster within the limit or become outliers (-1), and so do retained points.

    Empty chunks count as rounds. Every point gets exactly one label.
    """
    chunks = [materialize(c) for c in chunks]
    spark = chunks[0].sparkSession
    begin, first = 0, chunks[0].limit(1).collect()
    while not first and begin < len(chunks) - 1:
        begin += 1
        first = chunks[begin].limit(1).collect()
    if not first:
        return ChunkedClusters(chunks[0].select("id", F.lit(-1).alias("cluster")), [(i + 1, 0, 0, 0, 0, 0) for i in range(len(chunks))])
    d = len(first[0]["features"])
    limit = alpha * d**0.5
    kind = chunks[begin].schema["id"].dataType.simpleString()
    start = chunks[begin].where(F.pmod(F.xxhash64("id"), F.lit(1000)) < int(sample * 1000))
    if start.limit(k).count() < k:
        start = chunks[begin]
    start = materialize(start)
    alone = spark.createDataFrame([], f"id {kind}")
    while True:
        tagged = materialize(start.join(assign(start, kmeans(start, k)), "id"))
        single = [r["cluster"] for r in tagged.groupBy("cluster").agg(F.count("*").alias("n")).where("n = 1").collect()]
        if not single or tagged.limit(k + len(single) + 1).count() <= k + len(single):
            break
        alone = alone.unionByName(tagged.where(F.col("cluster").isin(single)).select("id"))
        start = materialize(tagged.where(~F.col("cluster").isin(single)).drop("cluster"))
    ds = _summary(tagged, k, d)
    used = np.flatnonzero(ds.n)
    ds = Summary(ds.n[used], ds.sums[used], ds.squares[used])
    to = F.create_map(*[F.lit(x) for i, c in enumerate(used.tolist()) for x in (c, i)])
    labels = [tagged.select("id", F.element_at(to, F.col("cluster")).alias("cluster"))]
    cs, members = Summary.none(d), spark.createDataFrame([], f"id {kind}, cluster int")
    rest = spark.createDataFrame([], f"id {kind}, features array<double>")
    rounds = [(i + 1, 0, 0, 0, 0, 0) for i in range(begin)]
    for number, chunk in enumerate(chunks[begin:], begin):
        if number == begin:
            chunk = chunk.join(tagged.select("id"), "id", "left_anti")
        placed = materialize(_place(chunk, ds, cs, limit))
        own = placed.where("kind = 0")
        labels.append(own.select("id", "cluster"))
        s = _summary(own, len(ds.n), d)
        ds = ds.add(s.n, s.sums, s.squares)
        if len(cs.n):
            own = placed.where("kind = 1")
            s = _summary(own, len(cs.n), d)
            cs = cs.add(s.n, s.sums, s.squares)
            members = members.unionByName(own.select("id", "cluster"))
        rest = materialize(rest.unionByName(placed.where("kind = 2").select("id", "features")))
        kept = rest.count()
        if kept > factor * k:
            new, packed, rest = _compress(rest, factor * k, d)
            members = members.unionByName(packed.select("id", (F.col("cluster") + len(cs.n)).alias("cluster")))
            cs = cs.append(new)
            groups = _linked(cs, limit)
            if len(groups):
                cs = cs.merge(groups)
                to = F.create_map(*[F.lit(int(x)) for pair in enumerate(groups.tolist()) for x in pair])
                members = materialize(members.select("id", F.element_at(to, F.col("cluster")).alias("cluster")))
            rest = materialize(rest)
            kept = rest.count()
        if number == len(chunks) - 1:
            at = np.full(len(cs.n), -1)
            if len(cs.n):
                far = ds.distances(cs.sums / cs.n[:, None])
                near = far.argmin(axis=1)
                on = far[np.arange(len(near)), near] < limit
                at[on] = near[on]
                for c in np.flatnonzero(on):
                    ds.n[near[c]] += cs.n[c]
                    ds.sums[near[c]] += cs.sums[c]
                    ds.squares[near[c]] += cs.squares[c]
                to = F.create_map(*[F.lit(int(x)) for pair in enumerate(at.tolist()) for x in pair])
                labels.append(members.select("id", F.element_at(to, F.col("cluster")).alias("cluster")))
            labels.append(rest.select("id", F.lit(-1).alias("cluster")))
            kept += int(cs.n[at < 0].sum())
            cs = Summary.none(d)
        rounds.append((number + 1, len(ds.n), int(ds.n.sum()), len(cs.n), int(cs.n.sum()), int(kept)))
    every = labels[0]
    for part in labels[1:]:
        every = every.unionByName(part)
    return ChunkedClusters(materialize(every), rounds, ds)


def rounds_table(spark, rounds: list[tuple]) -> DataFrame:
    """The statistics of every round as a table."""
    return spark.createDataFrame(rounds, "round_id int, nof_cluster_discard int, nof_point_discard long, nof_cluster_compression int, nof_point_compression long, nof_point_retained long")


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row nmi: the mutual information of two labelings over the mean of their entropies; 1 if both have one class."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    n = cells.agg(F.sum("c").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("c").alias("ca"))
    cols = cells.groupBy(b).agg(F.sum("c").alias("cb"))
    entropy = lambda t, c: t.crossJoin(F.broadcast(n)).agg(F.sum(-(F.col(c) / F.col("n")) * F.ln(F.col(c) / F.col("n"))).alias(f"h_{c}"))
    mutual = cells.join(rows, a).join(cols, b).crossJoin(F.broadcast(n)).agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))).alias("i"))
    one = mutual.crossJoin(entropy(rows, "ca")).crossJoin(entropy(cols, "cb"))  # one row each
    mean = (F.col("h_ca") + F.col("h_cb")) / 2
    return one.select(F.round(F.when(mean < 1e-12, 1.0).otherwise(F.col("i") / mean), 6).alias("nmi"))
