"""Streaming forms of the sketches. Each has the batch operator's result over the same rows."""

import uuid
from collections import deque

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sketch import FM_GROUPS, FM_MODULUS, FM_PER_GROUP, FM_SEED, HLL_LOG, TAG, fm_aggregates, fm_estimate, fm_input, hashtags, reservoir, top_tags
from millrace.plans.store import shared_dir


def windowed_distinct(stream: DataFrame, ts: str, value: str, length: str = "30 seconds", slide: str = "10 seconds", late: str = "1 minute", groups: int = FM_GROUPS, per_group: int = FM_PER_GROUP, n: int = FM_MODULUS, seed: int = FM_SEED, exact: bool = True) -> DataFrame:
    """Per sliding event-time window: window_start, truth (exact distinct values), estimate (Flajolet-Martin), and hll (HyperLogLog) with exact=False.

    State per window: one maximum a hash, and for the truth the set of the window's values. With exact=False there is no such set: truth is
    null and the state is bounded whatever the stream holds. Rows later than the watermark drop; a window without values has no row.
    """
    rows = fm_input(stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), value, n)
    maxima = fm_aggregates(value, groups, per_group, n, seed)
    by = rows.groupBy(F.window(ts, length, slide))
    start, estimate = F.col("window.start").alias("window_start"), fm_estimate(groups, per_group).alias("estimate")
    if exact:
        return by.agg(F.size(F.collect_set(value)).alias("truth"), *maxima).select(start, "truth", estimate)
    return by.agg(F.hll_sketch_agg(value, F.lit(HLL_LOG)).alias("h"), *maxima).select(start, F.lit(None).cast("int").alias("truth"), estimate, F.hll_sketch_estimate("h").alias("hll"))


class ReservoirSink:
    """A foreachBatch sink that keeps a uniform sample of k rows of everything seen: the least k hash priorities of the sample
    and the batch together. The sample is a table of k rows, written anew each batch under its batch number, so a repeated
    batch gives the same sample. A key counts once. Of rows with `tag` (see `tag_stream`) the texts are sampled, with all their tags as
    `tags`, and each batch reports the top tags of the kept texts (the last ones in `reports`; all of them as lines of text in the folder `report`, if given); without a column `tags` a text's rows must be of one batch."""

    #: Reports kept at hand.
    KEPT = 1000

    def __init__(self, spark: SparkSession, key: str, k: int = 100, seed: int = 0, report: str | None = None):
        self.spark, self.key, self.k, self.seed, self.report = spark, key, k, seed, report
        self.path = f"{shared_dir(spark)}/reservoir-{uuid.uuid4().hex}"
        self.last: str | None = None
        self.reports: deque[tuple[int, list]] = deque(maxlen=self.KEPT)

    def __call__(self, batch: DataFrame, number: int) -> None:
        tagged = "tag" in batch.columns
        if tagged and "tags" not in batch.columns:
            others = [F.first(c).alias(c) for c in batch.columns if c not in (self.key, "tag")]
            batch = batch.groupBy(self.key).agg(*others, F.collect_list("tag").alias("tags"))
        batch = batch.drop("tag")
        rows = batch if self.last is None else batch.unionByName(self.spark.read.parquet(self.last))
        at = f"{self.path}/{number}"
        reservoir(rows.select(*batch.columns).dropDuplicates([self.key]), self.key, self.k, self.seed).drop("priority").write.mode("overwrite").parquet(at)
        self.last = at
        if tagged:
            tags = self.sample().select(F.explode("tags").alias("tag"))
            self.reports.append((number, [(r["tag"], r["count"]) for r in top_tags(tags).collect()]))
            if self.report is not None:
                lines = [f"Batch {number}: the tags of {self.sample().count()} texts", *(f"{tag} : {n}" for tag, n in self.reports[-1][1])]
                self.spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("overwrite").text(f"{self.report}/batch={number:08d}")

    def sample(self) -> DataFrame:
        return self.spark.read.parquet(self.last)


def tag_stream(stream: DataFrame, text: str) -> DataFrame:
    """The rows that hold a hashtag, one per tag, each with all `tags` of its text."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike(TAG))
    return hashtags(stream.withColumn("tags", F.transform(words, lambda w: F.substring(w, 2, 1 << 30))), text)


def csv_per_trigger(path: str):
    """A sink that appends the rows of every trigger to CSV files of a folder: Time, Ground Truth, Estimation. Written under the batch number, so
    a repeated batch gives the same files."""

    def sink(batch: DataFrame, number: int) -> None:
        named = batch.select(F.col("window_start").cast("string").alias("Time"), F.col("truth").alias("Ground Truth"), F.col("estimate").alias("Estimation"))
        named.coalesce(1).sortWithinPartitions("Time").write.mode("overwrite").option("header", True).csv(f"{path}/batch={number:08d}")

    return sink


def run(stream: DataFrame, sink, every: str = "5 seconds", mode: str = "append", seconds: float | None = None) -> str | None:
    """Runs a stream with a trigger of processing time, each batch to `sink`, until the source or an operator fails or `seconds` have passed. A
    source that breaks off (a closed socket, a refused request) ends the stream in order; what it said is returned, None if nothing failed."""
    at = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.option("checkpointLocation", at).trigger(processingTime=every).outputMode(mode).foreachBatch(sink).start()
    try:
        query.awaitTermination(seconds) if seconds is not None else query.awaitTermination()
    except StreamingQueryException as e:
        return str(e)
    finally:
        query.stop()
    return None


def run_once(stream: DataFrame, sink=None, mode: str = "append") -> DataFrame | None:
    """Runs a stream over everything available. Rows go to a table, which is returned, or each batch to `sink`."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if sink is not None:
        writer.foreachBatch(sink).start().awaitTermination()
        return None
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")

    def whole(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows")

    writer.foreachBatch(whole).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
