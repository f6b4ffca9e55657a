import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajspark.operators import trajectories as tr
from trajspark.operators.scan import (PLAIN, ChunkedScan, by_key,
                                      choose_scan, hot_keys,
                                      lag, last_known, lead, next_known,
                                      remaining_sum, running_sum)
from trajspark.plans import pipeline as pl
from trajspark.sources import adapter

SF = "/root/testdata/sf0.001"


def history(spark, n=400, keys=3, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        # One key holds most of the rows.
        k = 0 if r.random() < 0.7 else r.randrange(keys)
        rows.append((k, r.randrange(60), i,
                     r.choice([None, 1.0, 2.0, 3.0]), r.randrange(3)))
    return spark.createDataFrame(
        rows, "k int, day int, seq int, x double, f int")


def test_chunked_scan_equals_windows(spark):
    df = history(spark)
    specs = dict(a=lag("x"), b=lag("f", 4), c=lead("x"), d=lead("f", 3),
                 e=running_sum("x"), g=remaining_sum("f"),
                 h=last_known("x"), i=next_known("x"))
    plain = PLAIN.add(df, ["k"], ["day", "seq"], **specs)
    for chunks in (2, 7, 60):
        other = ChunkedScan(chunks).add(df, ["k"], ["day", "seq"], **specs)
        assert other.columns == plain.columns
        assert plain.exceptAll(other).count() == 0
        assert other.exceptAll(plain).count() == 0


def test_chunks_split_a_hot_key(spark):
    df = history(spark, n=2000)
    cut = ChunkedScan(8)._chunk(df, ["k"], ["day", "seq"])
    per = cut.filter("k = 0").groupBy("__chunk").count().collect()
    assert len(per) >= 4
    assert max(r["count"] for r in per) < 800


def frames_read_again(df):
    """Whether a window has a frame from its row to the end of the key, which
    Spark reads anew for every row."""
    plan = df._jdf.queryExecution().executedPlan().toString().lower()
    return "currentrow$(), unboundedfollowing$()" in plan


def test_looking_ahead_costs_no_square_of_the_key(spark):
    df = history(spark, n=3000).withColumn("d", F.col("f").cast("double"))
    specs = dict(g=remaining_sum("d"), h=remaining_sum("f"),
                 i=next_known("x"))
    w = Window.partitionBy("k").orderBy("day", "seq").rowsBetween(
        0, Window.unboundedFollowing)
    wanted = df.withColumns({"g": F.sum("d").over(w), "h": F.sum("f").over(w),
                             "i": F.first("x", ignorenulls=True).over(w)})
    assert frames_read_again(wanted)
    for scan in (PLAIN, ChunkedScan(5)):
        found = scan.add(df, ["k"], ["day", "seq"], **specs)
        assert not frames_read_again(found)
        assert found.columns == wanted.columns
        assert found.exceptAll(wanted).count() == 0
        assert wanted.exceptAll(found).count() == 0


def with_nulls(df):
    """Null keys, one of them hot."""
    return df.unionAll(df.filter("k = 0").withColumn(
        "k", F.lit(None).cast("int")))


def test_scans_agree_on_null_keys(spark):
    df = with_nulls(history(spark))
    specs = dict(a=lag("x"), c=lead("f", 3), e=running_sum("x"),
                 g=remaining_sum("f"), h=last_known("x"), i=next_known("x"))
    order = ["day", "seq"]
    plain = PLAIN.add(df, ["k"], order, **specs)
    scans = [ChunkedScan(7), choose_scan([df], ["k"], 100, 5)]
    for scan in scans:
        other = scan.add(df, ["k"], order, **specs).select(plain.columns)
        assert plain.exceptAll(other).count() == 0
        assert other.exceptAll(plain).count() == 0
        a = PLAIN.group(df, ["k"], n=F.count("x"), m=F.max("day"))
        b = scan.group(df, ["k"], n=F.count("x"), m=F.max("day"))
        assert a.exceptAll(b.select(a.columns)).count() == 0
    hot = by_key(lambda s, d: s.add(d, ["k"], order, **specs), [df], ["k"],
                 limit=100, chunks=5).select(plain.columns)
    assert plain.exceptAll(hot).count() == 0
    assert hot.exceptAll(plain).count() == 0


def test_a_small_file_with_one_large_key_is_split(spark, tmp_path):
    """Rows count, not bytes: runs of one key compress to next to nothing."""
    df = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    df.coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    scan = choose_scan([df], ["k"], 50_000, 4)
    assert scan is not PLAIN
    out = scan.add(df, ["k"], ["o"], s=running_sum(F.lit(1)))
    assert out.filter("s <> o + 1").count() == 0
    # A table may grow by a join or an explode after it was read.
    many = df.limit(10).withColumn("e", F.explode(F.sequence(F.lit(1),
                                                             F.lit(6000))))
    assert choose_scan([many], ["k"], 50_000) is not PLAIN


def test_chunked_group_equals_window(spark):
    df = history(spark)
    aggs = dict(n=F.count("x"), m=F.max("day"))
    a = PLAIN.group(df, ["k"], **aggs)
    b = ChunkedScan(5).group(df, ["k"], **aggs).select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_keys(spark):
    df = history(spark)
    assert [r["k"] for r in hot_keys([df], ["k"], 150).collect()] == [0]
    assert hot_keys([df], ["k"], 10_000) is None


def test_hot_subjects_get_the_same_base(spark):
    v = adapter.visits(spark, SF)

    def work(scan, d):
        d = tr.collapse_days(d.filter("value_type = 'Y'"), pl.KEYS,
                             ["value", "dose"])
        d = tr.split_at_gaps(d, pl.KEYS, scan=scan)
        return tr.with_days_in_range(d, pl.KEYS, scan=scan)

    plain = work(PLAIN, v)
    hot = by_key(work, [v], pl.KEYS, limit=13, chunks=5).select(plain.columns)
    assert hot_keys([v], pl.KEYS, 13).count() > 3
    assert plain.exceptAll(hot).count() == 0
    assert hot.exceptAll(plain).count() == 0


def test_hot_subjects_get_the_same_pipeline(spark):
    args = [adapter.visits(spark, SF), adapter.events(spark, SF),
            adapter.baseline(spark, SF)]
    args = [a.filter("subjid < 40") for a in args]
    plain = pl.build_trajectories(*args)
    hot = pl.build_trajectories(*args, hot_rows=14)
    assert plain.exceptAll(hot).count() == 0
    assert hot.exceptAll(plain).count() == 0


def test_composites_do_not_depend_on_the_scan(spark):
    from trajspark.operators import evaluation as ev
    from trajspark.operators import transitions as tn
    from trajspark.params import VALUE_DOSE
    from trajspark.plans import catalog
    from trajspark.plans.catalog_reports import stand_in_policy

    d = catalog.base(adapter.visits(spark, SF).filter("subjid < 30"))
    d = d.withColumn("value", F.col("value")).checkpoint()
    a = tn.build_transitions(d, VALUE_DOSE, min_length=1)[0]
    b = tn.build_transitions(d, VALUE_DOSE, min_length=1,
                             scan=ChunkedScan(5))[0].select(a.columns)
    assert a.count() > 20
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

    def run(scan):
        c = ev.compare_policies(d, stand_in_policy(), extra=["stroke"],
                                scan=scan)
        h = ev.hierarchical_ttr(c, scan)
        cols = ["subjid", "trajid", "study_day", "policy_diff", "random_action",
                "next_value", "ttr", "length"]
        return h.select(*[F.round(x, 9).alias(x) if x in ("policy_diff", "ttr")
                          else F.col(x) for x in cols])

    p, c = run(PLAIN), run(ChunkedScan(5))
    assert p.exceptAll(c).count() == 0 and c.exceptAll(p).count() == 0


def test_choose_scan(spark):
    df = history(spark)
    assert choose_scan([df], ["k"]) is PLAIN
    assert choose_scan([df], ["k"], 100) is not PLAIN
