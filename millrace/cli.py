"""The commands: `python -m millrace COMMAND ARGUMENTS`. Each reads files, runs one pipeline of operators and writes its result."""

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean_id
from millrace.operators import cluster, explore, graph, itemsets, recommend, similarity, sketch
from millrace.plans.store import dense_codes, materialize
from millrace.sources import chunk_files, read_csv_pairs, read_json, read_profiles, read_text, read_words, sinks, streams
from millrace.sources.tables import BUSINESS, REVIEW, SIMILARITY
from millrace.streaming import operators as streaming


def _reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, REVIEW).withColumns({c: clean_id(c) for c in ("review_id", "user_id", "business_id")})


def _businesses(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, BUSINESS).withColumn("business_id", clean_id("business_id"))


def explore_summary(spark, a):
    sinks.write_result(explore.review_summary(_reviews(spark, a.review), read_words(spark, a.stopwords), a.year, a.m, a.n), a.out)


def explore_categories(spark, a):
    sinks.write_json_rows(explore.category_avg_stars(_reviews(spark, a.review), _businesses(spark, a.business), a.n), a.out)


def explore_partitions(spark, a):
    """Partitions, their rows and the businesses of more than n reviews, with rows placed as they come or by the id's first character."""
    reviews = _reviews(spark, a.review).where("business_id is not null")
    placed = explore.partition_profile(reviews, a.partitions, placement=F.ascii("business_id") if a.mode == "customized" else None)
    sizes = placed.agg(F.count("*").alias("n_partitions"), F.transform(F.array_sort(F.collect_list(F.struct("partition", "rows"))), lambda r: r["rows"]).alias("n_items"))
    frequent = explore.frequent_keys(reviews, "business_id", a.n).agg(F.array_sort(F.collect_list(F.struct("business_id", "count"))).alias("result"))
    sinks.write_result(sizes.crossJoin(frequent), a.out)  # one row each


def preprocess(spark, a):
    sinks.write_csv(itemsets.state_baskets(_reviews(spark, a.review).where("user_id is not null"), _businesses(spark, a.business), a.state), a.csv)


def _itemset_report(rows: DataFrame, a) -> None:
    found = materialize(itemsets.frequent_itemsets(rows, a.support))
    singles = rows.select(F.array("item").alias("itemset")).distinct().withColumn("size", F.lit(1))
    sinks.write_lines(sinks.itemset_report(singles.unionByName(itemsets.candidate_itemsets(found).select("itemset", "size")), found), a.out)


def itemsets_small(spark, a):
    _itemset_report(materialize(itemsets.baskets(read_csv_pairs(spark, a.csv), a.case)), a)


def itemsets_large(spark, a):
    _itemset_report(materialize(itemsets.large_baskets(itemsets.baskets(read_csv_pairs(spark, a.csv)), a.threshold)), a)


def lsh(spark, a):
    sets = materialize(similarity.memberships(read_json(spark, a.train, REVIEW), "business_id", "user_id"))
    sinks.write_json_rows(similarity.lsh_pairs(sets).select(F.col("a").alias("b1"), F.col("b").alias("b2"), "sim"), a.out)


def content_train(spark, a):
    train = read_json(spark, a.train, REVIEW)
    profiles = materialize(recommend.item_profiles(recommend.content_words(train, read_words(spark, a.stopwords))))
    codes = dense_codes(profiles.select("word").distinct(), "word", "i")
    users = recommend.user_profiles(recommend.ratings(train.withColumn("stars", F.coalesce("stars", F.lit(0.0)))), profiles)
    pack = lambda df, id: df.join(codes, "word").groupBy(F.col(id).alias("id")).agg(F.array_sort(F.collect_set("i")).alias("words"))
    if a.document:
        sinks.write_profiles(pack(profiles, "item"), pack(users, "user"), a.model)
    else:
        sinks.write_model(pack(profiles, "item"), f"{a.model}/items")
        sinks.write_model(pack(users, "user"), f"{a.model}/users")


def content_predict(spark, a):
    items, users = read_profiles(spark, a.model) if a.document else (spark.read.parquet(f"{a.model}/{k}") for k in ("items", "users"))
    words = lambda df, id: df.select(F.col("id").alias(id), F.explode("words").alias("word"))
    got = recommend.predict_by_content(recommend.test_pairs(read_json(spark, a.test, REVIEW)), words(users, "user"), words(items, "item"))
    sinks.write_json_rows(got.select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), "sim"), a.out)


def cf_train(spark, a):
    rated = materialize(recommend.ratings(read_json(spark, a.train, REVIEW)))
    if a.mode == "item_based":
        sinks.write_json_rows(recommend.pearson_model(rated).select(F.col("a").alias("b1"), F.col("b").alias("b2"), "sim"), a.model)
    else:
        sinks.write_json_rows(recommend.user_model_lsh(rated).select(F.col("a").alias("u1"), F.col("b").alias("u2"), "sim"), a.model)


def cf_predict(spark, a):
    rated, pairs = materialize(recommend.ratings(read_json(spark, a.train, REVIEW))), recommend.test_pairs(read_json(spark, a.test, REVIEW))
    first, second = ("b1", "b2") if a.mode == "item_based" else ("u1", "u2")
    model = read_json(spark, a.model, SIMILARITY.replace("b1", first).replace("b2", second)).select(F.col(first).alias("a"), F.col(second).alias("b"), "sim")
    got = (recommend.predict_by_items if a.mode == "item_based" else recommend.predict_by_users)(pairs, rated, model)
    sinks.write_json_rows(got.select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), "stars"), a.out)


def _edges(spark, a) -> DataFrame:
    return materialize(graph.cooccurrence_edges(itemsets.baskets(read_csv_pairs(spark, a.csv)), a.threshold))


def label_propagation(spark, a):
    sinks.write_lines(sinks.community_report(graph.communities(graph.label_propagation(_edges(spark, a)), "label")), a.out)


def girvan_newman(spark, a):
    edges = _edges(spark, a)
    sinks.write_lines(sinks.betweenness_report(materialize(graph.edge_betweenness(edges))), a.betweenness)
    sinks.write_lines(sinks.community_report(graph.communities(graph.girvan_newman(edges), "community")), a.communities)


def cluster_chunks(spark, a):
    got = cluster.cluster_chunks([cluster.parse_points(read_text(spark, p)) for p in chunk_files(spark, a.folder)], a.clusters)
    if a.document:
        sinks.write_labels(got.labels, a.labels)
    else:
        sinks.write_model(got.labels, a.labels)
    sinks.write_csv(cluster.rounds_table(spark, got.rounds).coalesce(1), a.rounds)


def bloom(spark, a):
    """For each line of the second file 1 if its city may be in the first file, else 0, in the order of the lines."""
    first = read_json(spark, a.first, "city string").select(F.trim("city").alias("city"))
    second = read_json(spark, a.second, "city string").select(F.trim("city").alias("city"), F.monotonically_increasing_id().alias("k"))
    sinks.write_lines(sinks.flags_line(sketch.bloom_probe(second, "city", sketch.bloom_build(first, "city")), "k", "seen"), a.out)


def _say(error: str | None) -> None:
    if error is not None:
        print("the stream ended:", error.splitlines()[0])


def distinct_stream(spark, a):
    lines = streams.json_field(streams.socket_lines(spark, a.host, a.port), "city")
    got = streaming.windowed_distinct(lines, "ts", "city", late="0 seconds")
    _say(streaming.run(got, streaming.csv_per_trigger(a.out), "10 seconds", "append", a.seconds))


def reservoir_stream(spark, a):
    lines = streams.socket_lines(spark, a.host, a.port).withColumn("text", F.coalesce(F.get_json_object("value", "$.text"), "value"))
    kept = streams.filtered(lines, "text", a.track) if a.track else lines
    tags = streaming.tag_stream(kept.withColumn("id", F.concat(F.col("ts").cast("string"), F.lit(" "), F.md5("text"))).select("id", "text"), "text")
    _say(streaming.run(tags, streaming.ReservoirSink(spark, "id", a.size, report=a.out), "5 seconds", "append", a.seconds))


_YEAR, _N = ("--year", {"default": "2016"}), ("--n", {"type": int, "default": 20})
_MODE = ("mode", {"choices": ["item_based", "user_based"]})
_DOCUMENT = ("--document", {"action": "store_true", "help": "one JSON document instead of tables"})
_NUMBER = lambda name: (name, {"type": int})
_SECONDS = ("--seconds", {"type": float, "default": None, "help": "end after so many seconds"})
COMMANDS = {
    "explore-summary": (explore_summary, ["review", "out", "stopwords", _YEAR, ("--m", {"type": int, "default": 20}), _N]),
    "explore-categories": (explore_categories, ["review", "business", "out", _N]),
    "explore-partitions": (explore_partitions, ["review", "out", ("mode", {"choices": ["default", "customized"]}), _NUMBER("partitions"), _NUMBER("n")]),
    "preprocess": (preprocess, ["review", "business", "csv", ("--state", {"default": "NV"})]),
    "itemsets": (itemsets_small, [("case", {"type": int, "choices": [1, 2]}), _NUMBER("support"), "csv", "out"]),
    "itemsets-large": (itemsets_large, [_NUMBER("threshold"), _NUMBER("support"), "csv", "out"]),
    "lsh": (lsh, ["train", "out"]),
    "content-train": (content_train, ["train", "model", "stopwords", _DOCUMENT]),
    "content-predict": (content_predict, ["test", "model", "out", _DOCUMENT]),
    "cf-train": (cf_train, ["train", "model", _MODE]),
    "cf-predict": (cf_predict, ["train", "test", "model", "out", _MODE]),
    "label-propagation": (label_propagation, [_NUMBER("threshold"), "csv", "out"]),
    "girvan-newman": (girvan_newman, [_NUMBER("threshold"), "csv", "betweenness", "communities"]),
    "cluster-chunks": (cluster_chunks, ["folder", _NUMBER("clusters"), "labels", "rounds", _DOCUMENT]),
    "bloom": (bloom, ["first", "second", "out"]),
    "distinct-stream": (distinct_stream, [_NUMBER("port"), "out", ("--host", {"default": "localhost"}), _SECONDS]),
    "reservoir-stream": (reservoir_stream, [_NUMBER("port"), "out", ("--host", {"default": "localhost"}), ("--track", {"nargs": "*", "default": []}), ("--size", {"type": int, "default": 100}), _SECONDS]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description="Mining and analytics commands on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (do, arguments) in COMMANDS.items():
        own = sub.add_parser(name, help=(do.__doc__ or name).splitlines()[0])
        for x in arguments:
            own.add_argument(*([x] if isinstance(x, str) else [x[0]]), **({} if isinstance(x, str) else x[1]))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"millrace {a.command}").getOrCreate()
    COMMANDS[a.command][0](spark, a)
