"""Batch sources with fixed schemas: parquet, JSON lines, CSV with header, word lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, categories string, state string, city string"
BASKET = "user_id string, business_id string"
SIMILARITY = "b1 string, b2 string, sim double"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` in a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column `value`."""
    return spark.read.text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, parsed once with a declared schema; absent fields are null."""
    return spark.read.schema(schema).json(path)


def read_csv_pairs(spark: SparkSession, path: str, schema: str = BASKET) -> DataFrame:
    """Two-column CSV with a header; header lines repeated further down are dropped too, and so are repeated lines."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    a, b = df.columns
    return df.where(~((F.col(a) == a) & (F.col(b) == b))).distinct()


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list, one word a line, as column `word`."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def chunk_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder in the order of their names. Only names are read."""
    files = spark.read.format("binaryFile").load(folder).select("path").collect()
    return sorted((r["path"] for r in files), key=lambda p: p.rsplit("/", 1)[-1])


def read_chunks(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The text files of a folder, one table of lines each, in the order of their names."""
    return [spark.read.text(p) for p in chunk_files(spark, folder)]


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document {id: label} as the table (id, label)."""
    return _document(spark, path, "map<string,int>").select(F.explode("d").alias("id", "label")).select(F.col("id").cast("long").alias("id"), "label")


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document {"itemfile": {id: [word numbers]}, "userfile": ...} as the tables (id, words) of items and of users."""
    d = _document(spark, path, "itemfile map<string,array<int>>, userfile map<string,array<int>>")
    return tuple(d.select(F.explode(f"d.{k}").alias("id", "words")) for k in ("itemfile", "userfile"))
