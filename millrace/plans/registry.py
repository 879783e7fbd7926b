"""All queries of the core, and the SQL that gives the same rows in DuckDB where SQL can express them."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import clean_id
from millrace.operators import cluster, explore, graph, itemsets, recommend, similarity, sketch
from millrace.plans import queries_packed
from millrace.plans.store import dense_codes, latest, materialize, named, shared_dir
from millrace.sources import read_csv_pairs, read_json, read_table, read_text, read_words, sinks, streams
from millrace.sources.tables import REVIEW
from millrace.streaming import operators as streaming

Query = Callable[[SparkSession, str], DataFrame]
YEAR, TOP = "2016", 20


def _reviews(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current reviews: of rows delivered several times or in several versions the last one."""
    ids = {c: clean_id(c) for c in ("review_id", "user_id", "business_id")}
    return latest(read_table(s, d, "review").withColumns(ids), "review_id", "loaded_at", *columns)


def _businesses(s: SparkSession, d: str) -> DataFrame:
    return latest(read_table(s, d, "business").withColumn("business_id", clean_id("business_id")), "business_id", "updated_at", "categories", "state", "city")


def _baskets(s: SparkSession, d: str, case: int) -> DataFrame:
    return itemsets.baskets(read_table(s, d, "user_business"), case)


def _basket_rows(s: SparkSession, d: str, case: int) -> DataFrame:
    return itemsets.basket_rows(read_table(s, d, "user_business"), case)


def _sets(s: SparkSession, d: str) -> DataFrame:
    return similarity.memberships(read_table(s, d, "train_review"), "business_id", "user_id")


def _rated(s: SparkSession, d: str) -> DataFrame:
    return materialize(recommend.ratings(read_table(s, d, "train_review")))


def _to_rate(s: SparkSession, d: str) -> DataFrame:
    return recommend.test_pairs(read_table(s, d, "test_review"))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    words = recommend.content_words(read_table(s, d, "train_review"), read_table(s, d, "stopwords"))
    return materialize(recommend.item_profiles(words))


def _edges(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The edges between numbered users, and their names."""
    return graph.cooccurrence_coded(_basket_rows(s, d, 1), EDGE_SHARED)


def _points(s: SparkSession, d: str) -> DataFrame:
    return cluster.points(read_table(s, d, "embeddings"), "vec_id", "embedding")


SUPPORT = {1: 12, 2: 12}
EDGE_SHARED = 4


def distinct_reviews(s, d):
    return explore.count_distinct(_reviews(s, d, "user_id"), "review_id")


def distinct_users(s, d):
    return explore.count_distinct(_reviews(s, d, "user_id"), "user_id")


def reviews_in_year(s, d):
    return explore.rows_in_year(_reviews(s, d, "date"), "date", YEAR, "review_id")


def top_users(s, d):
    return explore.top_counts(_reviews(s, d, "user_id"), "user_id", TOP)


def top_words(s, d):
    return explore.top_words(_reviews(s, d, "text"), "text", read_table(s, d, "stopwords"), TOP)


def review_summary(s, d):
    """The summary's lists as text: key:count in order."""
    got = explore.review_summary(materialize(_reviews(s, d, "date", "user_id", "text")), read_table(s, d, "stopwords"), YEAR, TOP, TOP)
    flat = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit(":"), x["count"].cast("string"))), " ").alias(c)
    return got.select("a", "b", "c", flat("d", "user_id"), flat("e", "word"))


def _rated_reviews(s, d):
    """Current reviews with a possible number of stars."""
    return _reviews(s, d, "business_id", "stars").where("stars between 1 and 5")


def category_avg_stars(s, d):
    return explore.category_avg_stars(_rated_reviews(s, d), _businesses(s, d))


def top_categories(s, d):
    return explore.category_avg_stars(_rated_reviews(s, d), _businesses(s, d), TOP)


def popular_businesses(s, d):
    return explore.frequent_keys(_reviews(s, d, "business_id"), "business_id", 25)


def partition_profile(s, d):
    """Placement by the first character of the id."""
    return explore.partition_profile(_reviews(s, d, "business_id").where("business_id is not null"), 16, placement=F.ascii("business_id"))


def partition_profile_hash(s, d):
    """Rows and partitions of a placement by key, and the keys whose rows are in more than one partition."""
    reviews = materialize(_reviews(s, d, "business_id"))
    profile = explore.partition_profile(reviews, 16, "business_id").agg(F.sum("rows").alias("rows"), F.count("*").alias("partitions"))
    placed = materialize(reviews.repartition(16, "business_id").select("business_id", F.spark_partition_id().alias("p")))
    split = placed.groupBy("business_id").agg(F.countDistinct("p").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split_keys"))
    return profile.crossJoin(split)  # one row each


def state_baskets(s, d):
    return itemsets.state_baskets(_reviews(s, d, "user_id", "business_id").where("user_id is not null"), _businesses(s, d))


def frequent_itemsets_users(s, d):
    return itemsets.frequent_itemsets(_basket_rows(s, d, 1), SUPPORT[1])


def frequent_itemsets_businesses(s, d):
    return itemsets.frequent_itemsets(_basket_rows(s, d, 2), SUPPORT[2])


def frequent_itemsets_large(s, d):
    """Only baskets of more than 10 items."""
    return itemsets.frequent_itemsets(itemsets.large_baskets(_baskets(s, d, 1), 10), SUPPORT[1])


def candidate_itemsets(s, d):
    return itemsets.candidate_itemsets(materialize(frequent_itemsets_users(s, d)))


def fp_growth(s, d):
    return itemsets.fp_growth_itemsets(_baskets(s, d, 1), SUPPORT[1])


def jaccard_pairs(s, d):
    return similarity.jaccard_pairs(materialize(_sets(s, d))).select("a", "b", F.round("sim", 6).alias("sim"))


def minhash_signatures(s, d):
    """The 1000 hashes that lsh_pairs cuts into bands."""
    return similarity.minhash_signatures(_sets(s, d)).select("id", F.array_join("signature", " ").alias("signature"))


def lsh_pairs(s, d):
    """500 bands of 2 rows."""
    return similarity.lsh_pairs(materialize(_sets(s, d))).select("a", "b", F.round("sim", 6).alias("sim"))


def lsh_recall(s, d):
    """For thresholds of 0.1 and 0.2 the pairs that there are, and whether the bands find 0.9 of them or more."""
    sets = materialize(_sets(s, d))
    exact, found = (df.select("a", "b", F.round("sim", 6).alias("sim")) for df in (similarity.jaccard_pairs(sets, 0.1), similarity.lsh_pairs(sets)))
    both = exact.join(found.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").withColumn("at_least", F.explode(F.array(F.lit(0.1), F.lit(0.2)))).where(F.col("sim") >= F.col("at_least"))
    return both.groupBy("at_least").agg(F.count("*").alias("pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("found_most"))


def item_model(s, d):
    return recommend.pearson_model(_rated(s, d))


def user_model(s, d):
    return recommend.pearson_model(_rated(s, d), "user", "item")


def user_model_lsh(s, d):
    return recommend.user_model_lsh(_rated(s, d))


def item_predict(s, d):
    rated = _rated(s, d)
    return recommend.predict_by_items(_to_rate(s, d), rated, materialize(recommend.pearson_model(rated)))


def user_predict(s, d):
    rated = _rated(s, d)
    return recommend.predict_by_users(_to_rate(s, d), rated, materialize(recommend.pearson_model(rated, "user", "item")))


def stored_model_predict(s, d):
    """Forecasts from the stored item model, its pairs put in order and repeated ones reduced to the greatest similarity."""
    model = read_table(s, d, "task3item_model").select(clean_id("b1").alias("x"), clean_id("b2").alias("y"), "sim").where("x <> y and sim > 0 and not isnan(sim)")
    model = model.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("sim").alias("sim"))
    return recommend.predict_by_items(_to_rate(s, d), _rated(s, d), model)


def tfidf_profile(s, d):
    return _profiles(s, d)


def tfidf_indexed(s, d):
    return recommend.indexed_profiles(_profiles(s, d)).select("item", F.array_join("words", " ").alias("words"))


def user_profile(s, d):
    """The words of each user: their number, the first and the last, and their letters."""
    words = recommend.user_profiles(_rated(s, d), _profiles(s, d))
    return words.groupBy("user").agg(F.count("*").alias("words"), F.min("word").alias("first"), F.max("word").alias("last"), F.sum(F.length("word")).alias("letters"))


def content_predict(s, d):
    """Words are numbered first, and only the profiles of users that are asked for are put together."""
    profiles, pairs = _profiles(s, d), materialize(_to_rate(s, d))
    codes = dense_codes(profiles.select("word").distinct(), "word", "i")
    profiles = materialize(profiles.join(codes, "word").select("item", F.col("i").alias("word")))
    rated = _rated(s, d).join(pairs.select("user").distinct(), "user", "left_semi")
    return recommend.predict_by_content(pairs, recommend.user_profiles(rated, profiles), profiles)


def cooccur_graph(s, d):
    return graph.cooccurrence_edges(_basket_rows(s, d, 1), EDGE_SHARED)


def graph_components(s, d):
    edges, users = _edges(s, d)
    return named(graph.components(edges), users, "v", "component")


def graph_communities(s, d):
    edges, users = _edges(s, d)
    labels = named(graph.label_propagation(edges), users, "v")
    return graph.communities(labels, "label").select("size", F.array_join("members", " ").alias("members"))


def label_propagation(s, d):
    edges, users = _edges(s, d)
    return named(graph.label_propagation(edges), users, "v", "label")


def edge_betweenness(s, d):
    edges, users = _edges(s, d)
    return named(graph.edge_betweenness(edges, 6), users, "a", "b")


def graph_modularity(s, d):
    edges, _ = _edges(s, d)
    return graph.modularity(edges, graph.components(edges), "component")


def girvan_newman(s, d):
    """On the stronger ties: at least 7 shared businesses. The score is checked by girvan_newman_score."""
    return graph.girvan_newman(materialize(graph.cooccurrence_edges(_basket_rows(s, d, 1), 7)))


def girvan_newman_score(s, d):
    """Vertices, and whether the score that the search reports is the modularity of the communities that it returns, and not below 0."""
    edges = materialize(graph.cooccurrence_edges(_basket_rows(s, d, 1), 7))
    got = materialize(graph.girvan_newman(edges))
    own = graph.modularity(edges, got, "community").select(F.col("q").alias("own"))
    facts = got.agg(F.count("*").alias("vertices"), F.coalesce(F.max("q"), F.lit(0.0)).alias("q"))
    return facts.crossJoin(own).select("vertices", ((F.abs(F.col("q") - F.col("own")) < 1e-6) | (F.col("q") == 0)).alias("same"), (F.col("q") >= 0).alias("gain"))  # one row each


def kmeans_assign(s, d):
    pts = materialize(_points(s, d))
    return cluster.assign(pts, cluster.kmeans(pts, 10))


def mahalanobis(s, d):
    """Distance of every point to the summary of its label."""
    pts = read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")
    own = cluster.summaries(pts, "label").withColumnRenamed("cluster", "label")
    return pts.join(own, "label").select("id", "label", F.round(cluster.mahalanobis("features", "n", "sums", "squares"), 6).alias("distance"))


def _chunked(s, d):
    pts = materialize(_points(s, d))
    return cluster.cluster_chunks([pts.where(F.pmod(F.col("id"), F.lit(5)) == k) for k in range(5)], 10)


def chunked_labels(s, d):
    """Every point of the chunks, and whether its label is a cluster or that of the outliers."""
    return _chunked(s, d).labels.select("id", F.col("cluster").between(-1, 9).alias("labelled"))


def chunked_rounds(s, d):
    """For every round the points that its summaries and retained points account for, and whether clusters and points are in keeping."""
    t = cluster.rounds_table(s, _chunked(s, d).rounds)
    fits = (F.col("nof_cluster_discard") <= 10) & (F.col("nof_point_compression") >= 2 * F.col("nof_cluster_compression")) & (F.col("nof_point_retained") >= 0)
    return t.select("round_id", (F.col("nof_point_discard") + F.col("nof_point_compression") + F.col("nof_point_retained")).alias("points"), fits.alias("fits"))


def nmi(s, d):
    """Agreement of the k-means clusters with the labels of the vectors."""
    rows = kmeans_assign(s, d).join(read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return cluster.nmi(materialize(rows), "cluster", "label")


def squared_distances(s, d):
    """Squared distance of every point to the one with the next id."""
    pts = _points(s, d)
    near = pts.select((F.col("id") - 1).alias("id"), F.col("features").alias("other"))
    return pts.join(near, "id").select("id", F.round(cluster.squared_distance("features", "other"), 6).alias("distance"))


def points_round_trip(s, d):
    """The vectors written as lines of text and parsed again: id, dimensions, sum."""
    at = f"{shared_dir(s)}/lines-{uuid.uuid4().hex}"
    line = F.concat_ws(",", F.col("id").cast("string"), F.transform("features", lambda x: x.cast("string")))
    _points(s, d).select(line.alias("line")).write.text(at)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return cluster.parse_points(read_text(s, at)).select("id", F.size("features").alias("dimensions"), F.round(total, 6).alias("total"))


def source_round_trip(s, d):
    """Tables written as JSON lines, CSV and a word list and read again: rows and distinct values of each."""
    at = f"{shared_dir(s)}/files-{uuid.uuid4().hex}"
    sinks.write_json_rows(read_table(s, d, "review").drop("loaded_at"), f"{at}/json")
    sinks.write_csv(read_table(s, d, "user_business"), f"{at}/csv")
    read_table(s, d, "stopwords").select(F.coalesce("word", F.lit(""))).write.text(f"{at}/words")
    review, pairs, words = read_json(s, f"{at}/json", REVIEW), itemsets.baskets(read_csv_pairs(s, f"{at}/csv")), read_words(s, f"{at}/words")
    facts = lambda df, name, key: df.agg(F.lit(name).alias("source"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))
    return facts(review, "json", clean_id("review_id")).unionByName(facts(pairs, "csv", "item")).unionByName(facts(words, "text", F.lower(F.trim("word"))))


def _cities(s, d, there: bool):
    at = F.coalesce(F.upper(F.trim("state")) == "NV", F.lit(False))
    return read_table(s, d, "business").where(at if there else ~at).select(F.coalesce(F.trim("city"), F.lit("")).alias("city")).distinct()


def bloom_probe(s, d):
    return sketch.bloom_probe(_cities(s, d, False), "city", sketch.bloom_build(_cities(s, d, True), "city"))


def fm_estimate(s, d):
    rows = read_table(s, d, "business").select(F.upper(F.trim("state")).alias("state"), F.trim("city").alias("city"))
    return sketch.fm_distinct(rows, "city", ["state"]).withColumn("estimate", F.round("estimate", 6))


def hll_estimate(s, d):
    """Per state the distinct cities, and whether the sketch is within 5 % (or 1) of them."""
    rows = read_table(s, d, "business").select(F.upper(F.trim("state")).alias("state"), F.trim("city").alias("city")).where("city <> ''")
    truth = rows.groupBy("state").agg(F.countDistinct("city").alias("truth"))
    both = truth.alias("x").join(sketch.hll_distinct(rows, "city", ["state"]).alias("y"), F.col("x.state").eqNullSafe(F.col("y.state")))
    return both.select("x.state", "truth", (F.abs(F.col("estimate") - F.col("truth")) <= F.greatest(F.lit(1.0), 0.05 * F.col("truth"))).alias("close"))


def _tagged(s, d):
    return read_table(s, d, "events").select("event_id", "ts", F.concat(F.lit("#"), "event_type", F.lit(" at "), F.col("user_id").cast("string")).alias("text"))


def top_tags(s, d):
    return sketch.top_tags(sketch.hashtags(_tagged(s, d), "text"))


def reservoir_sample(s, d):
    return sketch.reservoir(read_table(s, d, "events"), "event_id", 100).select("event_id", "priority")


def tag_changes(s, d):
    """Counts of event types, events of a small value taking one away."""
    rows = read_table(s, d, "events").select(F.col("event_type").alias("tag"), F.when(F.col("value") < 0.3, -1).otherwise(1).alias("sign"))
    return sketch.count_changes(rows, "sign")


def busiest_minutes(s, d):
    """Peaks of the events a minute."""
    counts = read_table(s, d, "events").groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute")).agg(F.count("*").alias("n"))
    return sketch.peaks(counts, "minute", "n").select(F.col("minute").cast("timestamp_ntz").alias("minute"), "n")


def windowed_distinct(s, d):
    rows = read_table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user"))
    got = sketch.fm_distinct(rows, "user", [F.window("ts", "30 minutes", "10 minutes").alias("w")])
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "truth", F.round("estimate", 6).alias("estimate"))


def stream_windowed_distinct(s, d):
    """The same from a stream, in complete mode."""
    rows = streams.table_stream(s, d, "events").select("ts", F.col("user_id").cast("string").alias("user"))
    got = streaming.run_once(streaming.windowed_distinct(rows, "ts", "user", "30 minutes", "10 minutes"), mode="complete")
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("truth").cast("long").alias("truth"), F.round("estimate", 6).alias("estimate"))


def stream_bloom_probe(s, d):
    """Businesses of each city in the stream, and whether the filter knows the city."""
    rows = streams.table_stream(s, d, "business").select("business_id", F.trim("city").alias("city"))
    return streaming.run_once(sketch.bloom_probe(rows, "city", sketch.bloom_build(_cities(s, d, True), "city"))).groupBy("city", "seen").agg(F.count("*").alias("n"))


def stream_reservoir(s, d):
    sink = streaming.ReservoirSink(s, "event_id", 100)
    streaming.run_once(streams.table_stream(s, d, "events").select("event_id", "event_type"), sink)
    return sink.sample().select("event_id")


_NAMES = """distinct_reviews distinct_users reviews_in_year top_users top_words review_summary category_avg_stars top_categories popular_businesses
partition_profile partition_profile_hash state_baskets frequent_itemsets_users frequent_itemsets_businesses frequent_itemsets_large candidate_itemsets fp_growth
jaccard_pairs minhash_signatures lsh_pairs lsh_recall item_model user_model user_model_lsh item_predict user_predict stored_model_predict tfidf_profile tfidf_indexed
user_profile content_predict cooccur_graph graph_components graph_communities label_propagation edge_betweenness graph_modularity girvan_newman girvan_newman_score
kmeans_assign mahalanobis squared_distances chunked_labels chunked_rounds nmi points_round_trip source_round_trip bloom_probe fm_estimate hll_estimate top_tags
tag_changes busiest_minutes reservoir_sample windowed_distinct stream_windowed_distinct stream_bloom_probe stream_reservoir"""


def queries() -> dict[str, Query]:
    return {n: globals()[n] for n in _NAMES.split()} | queries_packed.QUERIES


def oracle_sql() -> dict[str, str]:
    from millrace.plans.sql import SQL

    return SQL | queries_packed.SQL
