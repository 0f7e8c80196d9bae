from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks import probes
from veilwork.operators.injection import dual_filter, moderate_chat
from veilwork.session import run_dir, shared_dir
from veilwork.sources import sinks, texts
from veilwork.streaming import filters, metrics


def test_read_formats(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}, é", "x") for i in range(10)], "id long, body string, other string")
    want = sorted((i, f"text {i}, é") for i in range(10))
    for fmt, options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": True, "inferSchema": True})):
        path = str(tmp_path / fmt)
        df.write.format(fmt).options(**{k: v for k, v in options.items() if k == "header"}).save(path)
        got = texts.read_texts(spark, path, fmt, "id", "body", **options)
        assert got.columns == ["id", "text"]
        assert sorted(map(tuple, got.collect())) == want
    lines = str(tmp_path / "lines")
    df.select("body").write.text(lines)
    got = texts.read_texts(spark, lines, "text", "_line", "value")
    assert sorted(r["text"] for r in got.collect()) == [t for _, t in want]
    assert got.select("_line").distinct().count() == 10


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "'a' AS body", "'b' AS other").write.parquet(path)
    plan = texts.read_texts(spark, path, "parquet", "id", "body")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,body:string>" in plan


def test_values(spark):
    assert [tuple(r) for r in texts.texts_from_values(spark, "one").collect()] == [(0, "one")]
    assert [tuple(r) for r in texts.texts_from_values(spark, ["a", "b"]).collect()] == [(0, "a"), (1, "b")]


def test_capture(spark):
    df = spark.range(20_000).selectExpr("id", "concat('t', id) AS text")
    kept = {r["id"] for r in sinks.capture_sample(df, "id").collect()}
    assert 1800 < len(kept) < 2200
    again = {r["id"] for r in sinks.capture_sample(df.repartition(7), "id").collect()}
    assert again == kept
    more = {r["id"] for r in sinks.capture_sample(df, "id", 20).collect()}
    assert kept < more
    assert sinks.capture_sample(df, "id", enabled=False).count() == 0


def test_routed_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(probes.PII_PROBES + probes.INJECTION_PROBES)], "id int, text string")
    routed = dual_filter(df)
    base = str(tmp_path / "routed")
    sinks.write_routed(routed, base)
    sinks.write_capture(routed, "id", str(tmp_path / "audit"), pct=50)
    back = spark.read.parquet(base)
    assert sorted(back.select("id", "decision", "masked_text").collect()) == sorted(
        routed.select("id", "decision", "masked_text").collect()
    )
    assert 0 < spark.read.parquet(str(tmp_path / "audit")).count() < df.count()


def source(spark, tmp_path):
    rows = [(i, t) for i, (t, _) in enumerate(probes.PII_PROBES + probes.INJECTION_PROBES)]
    df = spark.createDataFrame(rows, "id int, text string")
    path = str(tmp_path / "in")
    df.repartition(5).write.parquet(path)
    return df, texts.stream_texts(spark, path, "parquet", "id int, text string", files_per_trigger=2)


def test_stream_filter_equals_batch(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    filters.filter_stream(stream, out, state, available_now=True).awaitTermination()
    filters.filter_stream(stream, out, state, available_now=True).awaitTermination()  # nothing new
    got = spark.read.parquet(out)
    want = dual_filter(df)
    assert sorted(got.select("id", "decision", "masked_text").collect(), key=lambda r: r["id"]) == sorted(
        want.select("id", "decision", "masked_text").collect(), key=lambda r: r["id"]
    )
    assert got.where("decision != 'blocked' AND blocked_text IS NOT NULL").count() == 0
    assert "text" not in got.columns


def test_stream_moderation_equals_batch(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    out = str(tmp_path / "out")
    filters.moderate_stream(stream, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    cols = ["id", "action", "confidence"]
    assert sorted(spark.read.parquet(out).select(*cols).collect()) == sorted(moderate_chat(df).select(*cols).collect())


def test_stream_metrics_close_windows(spark, tmp_path):
    calls = spark.range(600).selectExpr(
        "timestamp_seconds(id * 10) AS ts", "CAST(id % 7 AS double) AS latency", "id % 10 = 0 AS is_error"
    )
    path = str(tmp_path / "in")
    calls.coalesce(1).write.parquet(path)
    stream = texts.stream_texts(spark, path, "parquet", "ts timestamp, latency double, is_error boolean")
    out = str(tmp_path / "out")
    metrics.write_metrics(
        metrics.metrics_stream(stream, "10 minutes", "5 minutes"), out, str(tmp_path / "state"), available_now=True
    ).awaitTermination()
    rows = spark.read.parquet(out).collect()
    # the last call is at 5990 s: windows up to 5400 s are past the watermark
    assert len(rows) == 9 and all(r["n_calls"] == 60 and r["n_errors"] == 6 for r in rows)
    assert all(r["p50"] == 3.0 for r in rows)


def session_like(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_folder():
    assert shared_dir(session_like("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert run_dir(session_like("yarn", "hdfs://x"), "s").startswith("hdfs://x/s-")
    with pytest.raises(ValueError):
        shared_dir(session_like("yarn"))
    local = session_like("local[2]")
    assert shared_dir(local) == shared_dir(local) != ""
    assert run_dir(local, "s") != run_dir(local, "s")


def test_no_extra_shuffles(spark, tmp_path):
    """Row-by-row operators stay row by row."""
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "'a@b.co' AS text").repartition(20).write.parquet(path)
    df = spark.read.parquet(path)
    plan = dual_filter(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_tables_are_dealt_out_where_told(spark):
    df = spark.range(100).coalesce(1)
    deal = spark.conf.get("veilwork.deal")
    try:
        assert texts.spread(df).rdd.getNumPartitions() == int(deal)
        assert texts.spread(df, 3).rdd.getNumPartitions() == 3
        spark.conf.unset("veilwork.deal")
        assert "Exchange" not in texts.spread(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("veilwork.deal", deal)
