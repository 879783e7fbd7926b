"""Intermediate results that are used more than once, and joins whose broadcast side is checked."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, tuple[object, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode (threads of this process, not local-cluster); an error
    on a cluster, whose executors share no such folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows once into the shared folder and returns the written table.

    Cuts the lineage, survives the loss of executors and is removed when the session ends, or by `release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made[path] = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
    got = spark.read.schema(df.schema).parquet(path)
    got._millrace_path = path
    return got


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of `materialize` that nothing reads any more, such as the round before the last of a search. Others are left alone."""
    for t in tables:
        fs, where = _made.pop(getattr(t, "_millrace_path", None), (None, None))
        if fs is not None:
            fs.delete(where, True)


@atexit.register
def _clean() -> None:
    for fs, path in _made.values():
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone already
            return


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Marks df for broadcast if it has at most max_rows rows; else leaves the join to the planner (shuffle, skew-split by AQE)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Rows of one key that meet each other in one task; more are cut into blocks.
BLOCK = 2000


def meet(rows: DataFrame, on: list[str], id: str, block: int = BLOCK, when=None, hot: bool = True) -> DataFrame:
    """Pairs of rows (aliases l and r) that are equal in `on`, with l.id < r.id and the further condition `when`.

    A key of more than `block` rows is cut into blocks by a hash of the id, and every two blocks meet under a key of their
    own, so no task takes more than two blocks of a hot key at a time. Without hot keys it is a plain join; hot=False
    tells that there are none, so that they needn't be looked for.
    """
    large = hot and materialize(rows.groupBy(*on).agg(F.count("*").alias("_f")).where(F.col("_f") > block).select(*on, F.ceil(F.col("_f") / block).cast("int").alias("_n")))
    match = F.col(f"l.{id}") < F.col(f"r.{id}")
    if when is not None:
        match = match & when
    for c in on:
        match = match & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    if not hot or not large.limit(1).count():
        return rows.alias("l").join(rows.alias("r"), match)
    cut = rows.join(small(large), on, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(id), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    l, r = cut.withColumn("_i", F.col("_own")).withColumn("_j", other), cut.withColumn("_j", F.col("_own")).withColumn("_i", other)
    return l.alias("l").join(r.alias("r"), match & (F.col("l._i") == F.col("r._i")) & (F.col("l._j") == F.col("r._j")))


def dense_codes(df: DataFrame, key: str | list[str], code: str = "code") -> DataFrame:
    """Adds consecutive numbers from 0 in the order of the distinct column (or columns) `key`, without a single-task sort.

    Range partitions are sorted and numbered where they lie; only the partitions' row counts go to the driver.
    """
    key = [key] if isinstance(key, str) else key
    at = materialize(df.repartitionByRange(*key).sortWithinPartitions(*key).select("*", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("_i")))
    start, offsets = 0, []
    for p, n in sorted((r["_p"], r["n"]) for r in at.groupBy("_p").agg((F.max("_i") + 1).alias("n")).collect()):
        offsets.append((p, start))
        start += n
    where = df.sparkSession.createDataFrame(offsets, "_p int, _o long")
    return at.join(F.broadcast(where), "_p").select(*df.columns, (F.col("_i") + F.col("_o")).alias(code))


#: Distinct values that are sent to all tasks with their numbers at most.
NAMES = 500_000


def coded_pairs(rows: DataFrame, first: str, second: str, most: int = NAMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct rows (first, second) as numbers in the order of the values: (x, y), and the tables (first, x) and (second, y) that name them.
    Up to `most` values of a column are sent to the tasks, so that only numbers are exchanged; rows with a null drop."""
    names, coded = [], rows.select(first, second)
    for column, code in ((first, "x"), (second, "y")):
        own = materialize(dense_codes(rows.select(column).where(F.col(column).isNotNull()).distinct(), column, code))
        names.append(own)
        coded = coded.join(small(own, most), column)
    return materialize(coded.select("x", "y").distinct()), names[0], names[1]


def named(df: DataFrame, names: DataFrame, *columns: str, most: int = NAMES) -> DataFrame:
    """df with the numbers in the given columns replaced by their names; names: (name, number)."""
    name, code = names.columns
    names = small(names, most)
    for c in columns:
        rest = [F.col(n) if n != c else F.col("_name").alias(c) for n in df.columns]
        df = df.join(names.select(F.col(name).alias("_name"), F.col(code).alias(c)), c).select(*rest)
    return df


def latest(df: DataFrame, key: str, version: str, *values: str) -> DataFrame:
    """One row per key with the values of its row of the greatest version; null keys form one group, as in SQL's GROUP BY.
    A null version is older than any other: a key of only such rows keeps one of them."""
    order = F.struct(F.col(version).isNotNull(), F.col(version))
    best = F.max_by(F.struct(*values), order) if len(values) > 1 else F.max_by(values[0], order)
    got = df.groupBy(key).agg(best.alias("_v"))
    return got.select(key, "_v.*") if len(values) > 1 else got.withColumnRenamed("_v", values[0])


def running_total(df: DataFrame, group: str, order: str, value: str, total: str, buckets: int = 256) -> DataFrame:
    """Adds to each row the sum of `value` over the rows before it in its group, in the order (md5 of `order` as text, order).

    Groups of any size: rows go by the first digits of the hash into buckets (a power of 2, 2**24 at most), whose sums give
    the offsets, so that no task sees more than a bucket of a group.
    """
    from pyspark.sql import Window as W

    first = F.conv(F.substring("_h", 1, 6), 16, 10).cast("int")
    df = df.withColumn("_h", F.md5(F.coalesce(F.col(order).cast("string"), F.lit("")))).withColumn("_b", F.shiftright(first, 24 - (buckets.bit_length() - 1)))
    sums = df.groupBy(group, "_b").agg(F.sum(value).alias("_s"))
    sums = sums.select(group, "_b", (F.sum("_s").over(W.partitionBy(group).orderBy("_b")) - F.col("_s")).alias("_o"))
    inside = W.partitionBy(group, "_b").orderBy("_h", order)
    return df.join(sums, [group, "_b"]).withColumn(total, F.col("_o") + F.sum(value).over(inside) - F.col(value)).drop("_h", "_b", "_o")
