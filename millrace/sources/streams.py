"""Streaming sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP socket with their time of arrival: value, ts."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load().withColumnRenamed("timestamp", "ts")


def json_field(lines: DataFrame, field: str) -> DataFrame:
    """Adds one string field of JSON lines; null where a line can't be parsed."""
    return lines.withColumn(field, F.get_json_object("value", f"$.{field}"))


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet table as a stream, some files a trigger, in order of their times. `name` may be a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")


def filtered(stream: DataFrame, text: str, track: list[str], lang: str | None = None) -> DataFrame:
    """Rows whose text holds one of the tracked words, whatever its case, in one language if given."""
    hit = F.lit(False)
    for word in track:
        hit = hit | F.contains(F.lower(text), F.lit(word.lower()))
    return stream.where(hit if lang is None else hit & (F.lower("lang") == lang.lower()))
