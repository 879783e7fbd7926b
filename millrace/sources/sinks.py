"""Batch sinks. Tables are written by the executors; reports of bounded size are formatted as lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.store import dense_codes


def write_json_rows(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_result(df: DataFrame, path: str) -> None:
    """A one-row result object as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every part."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_model(df: DataFrame, path: str) -> None:
    """Models are tables, not documents: profiles, similarities, cluster labels."""
    df.write.mode("overwrite").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """One JSON document {id: label}, as in `read_labels`. A document is one value; `write_model` is the form for labels of any number."""
    entries = F.collect_list(F.struct(F.col("id").cast("string"), "cluster"))
    labels.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode("overwrite").text(path)


def write_profiles(items: DataFrame, users: DataFrame, path: str) -> None:
    """One JSON document of the profiles (id, words), as in `read_profiles`. `write_model` is the form for profiles of any number."""
    pack = lambda df, k: df.agg(F.map_from_entries(F.collect_list(F.struct("id", "words"))).alias(k))
    one = pack(items, "itemfile").crossJoin(pack(users, "userfile"))  # one row each
    one.select(F.to_json(F.struct("itemfile", "userfile")).alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, one_file: bool = True) -> None:
    """The column `line` as text, in order of the column `pos`: one file, or with one_file=False as many as there are ranges, in the order of their names."""
    ordered = df.orderBy("pos").coalesce(1) if one_file else df.repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.select("line").write.mode("overwrite").text(path)


def flags_line(df: DataFrame, order: str, flag: str) -> DataFrame:
    """One line of the flags (0 or 1) in order, separated by spaces. Meant for results that fit a line."""
    got = df.agg(F.array_sort(F.collect_list(F.struct(order, flag))).alias("l"))
    return got.select(F.lit(0).alias("pos"), F.array_join(F.transform("l", lambda r: r[flag].cast("string")), " ").alias("line"))


def quoted(items) -> F.col:
    """('a','b') for an array column."""
    return F.concat(F.lit("("), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ","), F.lit(")"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Lines: 'Candidates:', one line of itemsets a size, 'Frequent Itemsets:', likewise: pos, line."""

    def lines(df: DataFrame, base: int) -> DataFrame:
        by = df.groupBy("size").agg(F.array_sort(F.collect_list("itemset")).alias("l"))
        return by.select((F.lit(base) + F.col("size")).alias("pos"), F.array_join(F.transform("l", quoted), ",").alias("line"))

    spark = frequent.sparkSession
    heads = spark.createDataFrame([(0, "Candidates:"), (1000, "Frequent Itemsets:")], "pos int, line string")
    return heads.unionByName(lines(candidates, 0)).unionByName(lines(frequent, 1000))


def community_report(communities: DataFrame) -> DataFrame:
    """One line per community, smallest first, quoted members: pos, line. Numbered by ranges."""
    line = F.array_join(F.transform("members", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return dense_codes(communities.select("size", "members"), ["size", "members"], "pos").select("pos", line.alias("line"))


def betweenness_report(edges: DataFrame) -> DataFrame:
    """Lines ('a', 'b'), value; greatest first, ties by the ends: pos, line. Numbered by ranges."""
    line = F.concat(F.lit("('"), "a", F.lit("', '"), "b", F.lit("'), "), F.col("betweenness").cast("string"))
    rows = edges.select((-F.col("betweenness")).alias("o"), "a", "b", "betweenness")
    return dense_codes(rows, ["o", "a", "b"], "pos").select("pos", line.alias("line"))
