import pytest
from helpers import rows_of

from trajspark.operators.transitions import option_means
from trajspark.sources import tables as tb
from trajspark.streaming.sessions import sessions, stream_sessions


def test_csv_ids_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "trial string, subjid int")
    tb.write_table(df, f"{tmp_path}/p", ["trial"])
    assert tb.read_table(spark, f"{tmp_path}/p").count() == 2
    tb.write_csv(df, f"{tmp_path}/c")
    back = tb.read_csv(spark, f"{tmp_path}/c", df.schema, {"subjid": "id"})
    assert rows_of(back, "trial", "id") == [("A", 1), ("B", 2)]
    (tmp_path / "ids.txt").write_text("1.0e+00\n7\n\n")
    assert rows_of(tb.read_ids(spark, f"{tmp_path}/ids.txt")) == [(1,), (7,)]


def test_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1.5)], "metric string, value double")
    tb.write_metrics(df, f"{tmp_path}/m")
    assert rows_of(tb.read_metrics(spark, f"{tmp_path}/m")) == [("a/b", 1.5)]
    (tmp_path / "one.json").write_text('{"x": 1, "y": 2.5}')
    assert rows_of(tb.read_metrics(spark, f"{tmp_path}/one.json")) == [
        ("x", 1.0), ("y", 2.5)]


def test_ingest_raw(spark):
    df = spark.createDataFrame(
        [(b" A ", 1.0, "3", float("nan"), None, b"Y", 0.0, 1.0)],
        "trial binary, subjid double, study_day string, value double, dose "
        "double, value_type binary, interrupt_flag double, seq double")
    out = tb.ingest_raw(df, tb.VISITS)
    assert out.schema.simpleString() == tb.VISITS.simpleString()
    assert tuple(out.first()) == ("A", 1, 3, None, None, "Y", 0.0, 1)
    with pytest.raises(ValueError):
        tb.ingest_raw(df.drop("dose"), tb.VISITS)


def test_audit_taps(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,), (2,)], "subjid int")

    @tb.auditable("a", "b")
    def step(d):
        return d, d.limit(1)

    a, b = step(df, audit_path=str(tmp_path))
    assert a.count() == 3 and b.count() == 1
    assert (tmp_path / "step_a").is_dir() and (tmp_path / "step_b").is_dir()
    seen = tb.audited(df, "s")
    seen.collect()
    assert seen.observation.get == {"rows": 3, "subjects": 2}


def test_read_runs(spark, tmp_path):
    for run, x in (("r1", 1.0), ("r2", 2.0)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "result.json").write_text(
            f'{{"training_iteration": 1, "m": {x}}}\n')
    runs = tb.read_runs(spark, f"{tmp_path}/*/result.json",
                        "training_iteration int, m double")
    assert rows_of(runs, "run", "m") == [("r1", 1.0), ("r2", 2.0)]


def test_export_transitions(spark, tmp_path):
    df = spark.createDataFrame(
        [(3, 1.0, 2.0, 4, .5, 1.0, .1)], "k int, s double, next_s double, "
        "option int, reward double, not_done double, sample_prob double")
    tb.export_transitions(df, f"{tmp_path}/t", ["s"], ["next_s"])
    r = spark.read.parquet(f"{tmp_path}/t").first()
    assert r["state"] == [1.0] and r["next_state"] == [2.0]


def test_option_means_ignore_infinity(spark):
    df = spark.createDataFrame([(6, 1.5), (6, float("inf")), (None, 1.0)],
                               "option int, dose_ratio double")
    assert rows_of(option_means(df)) == [(6, 1.5)]


def test_stream_sessions(spark, tmp_path):
    src = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 01:00:00", 2.0),
         (1, "2024-01-01 09:00:00", 4.0), (2, "2024-01-03 00:00:00", 8.0)],
        "user_id long, ts string, value double").selectExpr(
        "user_id", "cast(ts as timestamp) ts", "value",
        "monotonically_increasing_id() event_id")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    out = stream_sessions(stream, "user_id", "ts", 6)
    q = (out.writeStream.outputMode("append").format("memory")
         .queryName("sess").option("checkpointLocation", f"{tmp_path}/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = rows_of(spark.table("sess"), "user_id", "events", "total")
    # The last session stays open: nothing later moves the watermark.
    assert got == [(1, 1, 4.0), (1, 2, 3.0)]
    batch = sessions(src, "user_id", "ts", 6)
    assert rows_of(batch, "user_id", "session", "events", "total") == [
        (1, 0, 2, 3.0), (1, 1, 1, 4.0), (2, 0, 1, 8.0)]
