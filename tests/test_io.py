"""Sources, sinks and streams."""

from millrace.operators import sketch
from millrace.sources import read_csv_pairs, read_json, read_text, read_words, sinks, streams
from millrace.sources.tables import REVIEW
from millrace.streaming import operators as streaming


def test_sources(spark, rows, tmp_path):
    (tmp_path / "pairs.csv").write_text("user_id,business_id\nu1,b1\nu1,b1\nuser_id,business_id\nu2,b2\n")
    assert rows(read_csv_pairs(spark, str(tmp_path / "pairs.csv"))) == [("u1", "b1"), ("u2", "b2")]
    (tmp_path / "r.json").write_text('{"review_id": "r", "stars": 4, "other": 1}\n')
    one = read_json(spark, str(tmp_path / "r.json"), REVIEW).first()
    assert one["review_id"] == "r" and one["stars"] == 4.0 and one["text"] is None
    (tmp_path / "w.txt").write_text("the\nand\n")
    assert rows(read_words(spark, str(tmp_path / "w.txt"))) == [("and",), ("the",)] and read_text(spark, str(tmp_path / "w.txt")).count() == 2


def test_sinks(spark, rows, tmp_path):
    at = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([("u", 1.5)], "user string, sim double")
    sinks.write_json_rows(df, at("j"))
    sinks.write_csv(df, at("c"))
    sinks.append_csv(df, at("c"))
    sinks.write_model(df, at("m"))
    sinks.write_result(df, at("r"))
    assert rows(spark.read.json(at("j")).select("user", "sim")) == rows(spark.read.parquet(at("m"))) == [("u", 1.5)]
    assert spark.read.option("header", True).csv(at("c")).count() == 2 and spark.read.json(at("r")).count() == 1
    found = spark.createDataFrame([(["a"], 1), (["b"], 1), (["a", "b"], 2)], "itemset array<string>, size int")
    report = sinks.itemset_report(found.where("size = 2"), found)
    sinks.write_lines(report, at("t"))
    assert [r["value"] for r in spark.read.text(at("t")).collect()] == ["Candidates:", "('a','b')", "Frequent Itemsets:", "('a'),('b')", "('a','b')"]
    groups = spark.createDataFrame([(["c", "d"], 2), (["x"], 1)], "members array<string>, size int")
    assert [r["line"] for r in sinks.community_report(groups).orderBy("pos").collect()] == ["'x'", "'c', 'd'"]
    edges = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 4.25)], "a string, b string, betweenness double")
    assert [r["line"] for r in sinks.betweenness_report(edges).orderBy("pos").collect()] == ["('b', 'c'), 4.25", "('a', 'b'), 3.0"]
    flags = spark.createDataFrame([(2, 1), (1, 0)], "k int, f int")
    assert sinks.flags_line(flags, "k", "f").first()["line"] == "0 1"


def test_streams_equal_batches(spark, rows, tmp_path):
    data = [(k, f"2024-01-01 00:0{k // 20}:{k % 20:02d}", f"c{k * k % 37}", f"x #tag{'AB'[k % 2]} {'Soup' if k % 3 else ''}", "EN" if k % 4 else "de") for k in range(100)]
    df = spark.createDataFrame(data, "id long, ts string, city string, text string, lang string").withColumn("ts", __import__("pyspark").sql.functions.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    source = lambda: streams.table_stream(spark, str(tmp_path), "t")
    got = streaming.run_once(streaming.windowed_distinct(source(), "ts", "city", "30 seconds", "10 seconds", "1 hour"), mode="complete")
    from pyspark.sql import functions as F

    want = sketch.fm_distinct(df, "city", [F.window("ts", "30 seconds", "10 seconds").alias("w")]).select(F.col("w.start").alias("window_start"), "truth", "estimate")
    assert rows(got.select("window_start", F.col("truth").cast("long"), "estimate")) == rows(want)
    built = sketch.bloom_build(df.where("id < 5"), "city")
    assert rows(streaming.run_once(sketch.bloom_probe(source().select("id", "city"), "city", built))) == rows(sketch.bloom_probe(df.select("id", "city"), "city", built))
    sink = streaming.ReservoirSink(spark, "id", 20)
    streaming.run_once(streaming.tag_stream(source().select("id", "text"), "text"), sink)
    assert rows(sink.sample(), "id") == rows(sketch.reservoir(df, "id", 20), "id") and sink.reports
    kept = streaming.run_once(streams.filtered(source(), "text", ["soup"], "en"))
    assert kept.count() == sum(d[4] == "EN" and "Soup" in d[3] for d in data)
    lines = spark.createDataFrame([('{"city": "Rome"}',), ("broken",)], "value string")
    assert [r["city"] for r in streams.json_field(lines, "city").collect()] == ["Rome", None]


def test_reservoir_reports_all_tags_of_its_texts(spark, rows, tmp_path):
    data = [(1, "#soup and #bread #soup"), (2, "#bread #salt"), (3, "no tag")]
    spark.createDataFrame(data, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    for columns in (["id", "text", "tag", "tags"], ["id", "text", "tag"]):
        sink = streaming.ReservoirSink(spark, "id", 20)
        stream = streaming.tag_stream(streams.table_stream(spark, str(tmp_path), "t"), "text").select(*columns)
        streaming.run_once(stream, sink)
        assert rows(sink.sample(), "id") == [(1,), (2,)]
        assert sink.reports[-1][1] == [("bread", 2), ("soup", 2), ("salt", 1)]
