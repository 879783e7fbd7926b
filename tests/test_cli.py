"""Every command over small files."""

import json
import socket
import threading
import time

import pytest

from millrace import cli


@pytest.fixture
def at(tmp_path):
    text = {"b1": "good soup and warm bread", "b2": "cold salad", "b3": "good bread"}
    reviews = [{"review_id": f"r{u}{b}", "user_id": f"u{u}", "business_id": b, "stars": float((u * 3 + int(b[1])) % 5 + 1), "date": "2016-05-01", "text": text[b]} for u in range(8) for b in text]
    (tmp_path / "review.json").write_text("\n".join(map(json.dumps, reviews)))
    (tmp_path / "business.json").write_text("\n".join(json.dumps({"business_id": b, "categories": "A, B", "state": "NV", "city": c}) for b, c in (("b1", "Reno"), ("b2", "Ely"), ("b3", ""))))
    (tmp_path / "elsewhere.json").write_text('{"city": "Reno"}\n{"city": ""}\n{"city": "Nowhere"}\n')
    (tmp_path / "stop.txt").write_text("and\n")
    return lambda name: str(tmp_path / name)


def lines(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


def test_exploration(spark, at):
    cli.main(["explore-summary", at("review.json"), at("a"), at("stop.txt"), "--m", "1", "--n", "1"], spark)
    one = spark.read.json(at("a")).first()
    assert (one["a"], one["b"], one["c"], one["e"][0]["word"]) == (24, 24, 8, "bread")
    cli.main(["explore-categories", at("review.json"), at("business.json"), at("b")], spark)
    assert {r["category"] for r in spark.read.json(at("b")).collect()} == {"A", "B"}
    for mode in ("default", "customized"):
        cli.main(["explore-partitions", at("review.json"), at(mode), mode, "3", "7"], spark)
        one = spark.read.json(at(mode)).first()
        assert one["n_partitions"] == 3 and sum(one["n_items"]) == 24 and len(one["result"]) == 3


def test_itemsets_and_graphs(spark, at):
    cli.main(["preprocess", at("review.json"), at("business.json"), at("csv")], spark)
    cli.main(["itemsets", "1", "8", at("csv"), at("i")], spark)
    assert lines(spark, at("i"))[-1] == "('b1','b2','b3')"
    cli.main(["itemsets-large", "2", "8", at("csv"), at("j")], spark)
    assert lines(spark, at("j"))[-1] == "('b1','b2','b3')"
    cli.main(["label-propagation", "3", at("csv"), at("l")], spark)
    assert lines(spark, at("l")) == ["'u0', 'u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7'"]
    cli.main(["girvan-newman", "3", at("csv"), at("bw"), at("cm")], spark)
    assert len(lines(spark, at("bw"))) == 28 and sum(x.count("'u") for x in lines(spark, at("cm"))) == 8


def test_recommenders(spark, at):
    cli.main(["lsh", at("review.json"), at("lsh")], spark)
    assert spark.read.json(at("lsh")).count() == 3
    for extra in ([], ["--document"]):
        model = at("model" + "".join(extra))
        cli.main(["content-train", at("review.json"), model, at("stop.txt"), *extra], spark)
        cli.main(["content-predict", at("review.json"), model, at("p" + "".join(extra)), *extra], spark)
    a, b = (sorted(map(tuple, spark.read.json(at(p)).collect())) for p in ("p", "p--document"))
    assert a == b and len(a) == 24
    for mode in ("item_based", "user_based"):
        cli.main(["cf-train", at("review.json"), at(f"m{mode}"), mode], spark)
        cli.main(["cf-predict", at("review.json"), at("review.json"), at(f"m{mode}"), at(f"f{mode}"), mode], spark)
        assert all(0 < r["stars"] <= 5 for r in spark.read.schema("stars double").json(at(f"f{mode}")).collect())


def test_chunks_and_bloom(spark, at, tmp_path):
    (tmp_path / "chunks").mkdir()
    for c in range(2):
        (tmp_path / "chunks" / f"data{c}.txt").write_text("\n".join(f"{k * 2 + c},{100 * (k % 2) + k / 50},{k / 40}" for k in range(40)))
    for extra in ([], ["--document"]):
        cli.main(["cluster-chunks", at("chunks"), "2", at("labels" + "".join(extra)), at("rounds" + "".join(extra)), *extra], spark)
    from millrace.sources import read_labels

    want = sorted((r["id"], r["cluster"]) for r in spark.read.parquet(at("labels")).collect())
    assert sorted((r["id"], r["label"]) for r in read_labels(spark, at("labels--document")).collect()) == want and [k for k, _ in want] == list(range(80))
    assert spark.read.option("header", True).csv(at("rounds")).count() == 2
    cli.main(["bloom", at("business.json"), at("elsewhere.json"), at("flags")], spark)
    assert lines(spark, at("flags")) == ["1 0 0"]


def test_streams(spark, at):
    """A socket that sends lines and closes: the stream ends in order or after its time, and its results are there."""
    server = socket.socket()
    server.bind(("localhost", 0))
    server.listen(2)

    def serve():
        while True:
            try:
                c, _ = server.accept()
            except OSError:
                return
            for k in range(6):
                c.sendall(f'{{"city": "c{k % 3}", "text": "#soup and #bread{k % 2} x"}}\n'.encode())
            time.sleep(8)
            c.close()

    threading.Thread(target=serve, daemon=True).start()
    port = str(server.getsockname()[1])
    cli.main(["reservoir-stream", port, at("tags"), "--seconds", "9"], spark)
    assert any("soup : " in x for x in lines(spark, at("tags")))
    server.close()


def test_csv_per_trigger_and_errors(spark, at, tmp_path):
    from pyspark.sql import functions as F

    from millrace.streaming import operators as streaming

    rate = spark.readStream.format("rate").option("rowsPerSecond", 20).load().withColumn("city", F.concat(F.lit("c"), F.col("value") % 3))
    got = streaming.windowed_distinct(rate, "timestamp", "city", "2 seconds", "1 second", exact=False)
    assert streaming.run(got, streaming.csv_per_trigger(at("fm")), "1 second", "update", 8) is None
    rows = spark.read.option("header", True).csv(at("fm"))
    assert rows.columns[:3] == ["Time", "Ground Truth", "Estimation"]

    def broken(batch, number):
        raise ConnectionError("420")

    assert "420" in streaming.run(rate, broken, "1 second", "append", 20)
