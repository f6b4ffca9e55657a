"""Queries that write driver tables to the shared folder in each format and
read them back, and the small column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions import columns as fc
from trajspark.operators import relational as rel
from trajspark.plans import sqltext as q
from trajspark.plans.catalog import V, VISIT, query
from trajspark.session import shared_folder
from trajspark.sources import tables as tb


def folder(spark: SparkSession) -> str:
    """A new folder for one round trip."""
    return f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"


def customers(spark, sf) -> DataFrame:
    return tb.read_table(spark, f"{sf}/customer.parquet")


CUSTOMER = "c_custkey:l c_nationkey:l c_mktsegment:s"
CUSTOMER_SQL = "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"


@query("partitioned_table", CUSTOMER, CUSTOMER_SQL)
def _(spark, sf):
    path = folder(spark)
    tb.write_table(customers(spark, sf), path, ["c_mktsegment"])
    return tb.read_table(spark, path)


@query("csv_table", CUSTOMER, CUSTOMER_SQL)
def _(spark, sf):
    path = folder(spark)
    df = customers(spark, sf).select("c_custkey", "c_nationkey", "c_mktsegment")
    tb.write_csv(df, path)
    schema = "key long, c_nationkey long, c_mktsegment string"
    return tb.read_csv(spark, path, T.StructType.fromDDL(schema),
                       {"key": "c_custkey"})


@query("id_list", "subjid:l", "SELECT c_custkey AS subjid FROM customer")
def _(spark, sf):
    path = folder(spark)
    ids = customers(spark, sf).select(F.format_string("%.6e", F.col(
        "c_custkey").cast("double")).alias("value"))
    blank = ids.limit(1).select(F.lit(" ").alias("value"))
    ids.unionAll(blank).write.text(path)
    return tb.read_ids(spark, path)


METRICS = """SELECT c_mktsegment AS metric, CAST(count(*) AS DOUBLE) AS value
 FROM customer GROUP BY 1"""


@query("metrics_file", "metric:s value:d", METRICS)
def _(spark, sf):
    path = folder(spark)
    tb.write_metrics(customers(spark, sf).groupBy(
        F.col("c_mktsegment").alias("metric")).agg(
        F.count(F.lit(1)).cast("double").alias("value")), path)
    return tb.read_metrics(spark, path)


@query("metrics_object", "metric:s value:d", METRICS)
def _(spark, sf):
    path = folder(spark)
    counts = customers(spark, sf).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    # One object for each name, as runs write them.
    counts.select(F.to_json(F.create_map("c_mktsegment", "n"))).write.text(path)
    return tb.read_metrics(spark, path)


@query("raw_export", VISIT, q.W_V + "SELECT * FROM v")
def _(spark, sf):
    """Visits as an export has them: text in bytes with blanks, numbers as
    doubles, NaN for missing."""
    path = folder(spark)
    v = V(spark, sf)
    text = [f.name for f in v.schema if f.dataType == T.StringType()]
    raw = v.select(*[
        F.encode(F.concat(F.lit(" "), c, F.lit("  ")), "UTF-8").alias(c)
        if c in text else F.coalesce(F.col(c).cast("double"),
                                     F.lit(float("nan"))).alias(c)
        for c in v.columns])
    tb.write_table(raw, path)
    return tb.ingest_raw(tb.read_table(spark, path), tb.VISITS)


@query("audit_copies", VISIT, q.W_V + "SELECT * FROM v WHERE value_type = 'Y'")
def _(spark, sf):
    @tb.auditable("visits", "rest")
    def observed(v):
        return v.filter("value_type = 'Y'"), v.filter("value_type <> 'Y'")

    return observed(V(spark, sf), audit_path=folder(spark))[0]


@query("materialised", VISIT, q.W_V + "SELECT * FROM v")
def _(spark, sf):
    return tb.materialise(V(spark, sf), folder(spark))


@query("run_logs", "run:s training_iteration:l metric:d", """
SELECT c_mktsegment AS run, c_nationkey AS training_iteration,
 CAST(count(*) AS DOUBLE) AS metric FROM customer GROUP BY 1, 2""")
def _(spark, sf):
    path = folder(spark)
    logs = customers(spark, sf).groupBy("c_mktsegment", F.col(
        "c_nationkey").alias("training_iteration")).agg(
        F.count(F.lit(1)).cast("double").alias("metric"))
    logs.write.partitionBy("c_mktsegment").json(path)
    runs = tb.read_runs(spark, f"{path}/*/*.json",
                        "training_iteration long, metric double")
    return runs.withColumn("run", F.element_at(F.split("run", "="), -1))


@query("transition_export", "k:l option:l s0:d s1:d n0:d n1:d reward:d "
       "not_done:d sample_prob:d", q.W_V + """
SELECT seq AS k, seq % 7 AS option, CAST(value AS FLOAT) AS s0,
 CAST(dose AS FLOAT) AS s1, CAST(value AS FLOAT) AS n0,
 CAST(dose AS FLOAT) AS n1, CAST(interrupt_flag AS FLOAT) AS reward,
 CAST(1 - interrupt_flag AS FLOAT) AS not_done,
 CAST(0.5 AS DOUBLE) AS sample_prob FROM v""")
def _(spark, sf):
    path = folder(spark)
    rows = V(spark, sf).select(
        F.col("seq").alias("k"), (F.col("seq") % 7).alias("option"), "value",
        "dose", F.col("value").alias("next_value"),
        F.col("dose").alias("next_dose"),
        F.col("interrupt_flag").alias("reward"),
        (1 - F.col("interrupt_flag")).alias("not_done"),
        F.lit(0.5).alias("sample_prob"))
    tb.export_transitions(rows, path, ["value", "dose"],
                          ["next_value", "next_dose"])
    return tb.read_table(spark, path).select(
        "k", "option", *[F.col(a)[i].alias(f"{a[0]}{i}")
                         for a in ("state", "next_state") for i in (0, 1)],
        "reward", "not_done", "sample_prob")


@query("cast_columns", "subjid:l text:s study_day:d",
       q.W_V + """SELECT subjid, CAST(CAST(study_day AS BIGINT) AS VARCHAR) AS text,
 CAST(study_day AS DOUBLE) AS study_day FROM v""")
def _(spark, sf):
    v = V(spark, sf).withColumn("text", F.col("study_day"))
    return rel.cast_cols(v, {"text": "string", "study_day": "double"})


@query("reordered", "subjid:l trial:s study_day:l first_column:s", q.W_V + """
SELECT subjid, trial, study_day, 'subjid' AS first_column FROM v""")
def _(spark, sf):
    v = rel.keys_first(V(spark, sf), ["subjid", "trial"])
    return v.withColumn("first_column", F.lit(v.columns[0]))


@query("columns_by_name", "o_orderkey:l o_custkey:l", """
SELECT o_orderkey, o_custkey FROM orders""")
def _(spark, sf):
    o = tb.read_table(spark, f"{sf}/orders.parquet")
    return o.select(*rel.select_like(o, "key"))


@query("ordered", "place:l c_custkey:l", """
SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS place,
 c_custkey FROM customer""")
def _(spark, sf):
    """A sorted table read back in the order in which it was written."""
    path = folder(spark)
    (customers(spark, sf).orderBy(F.desc("c_nationkey"), "c_custkey")
     .select("c_custkey").write.parquet(path))
    back = tb.read_table(spark, path).select(
        "c_custkey", "_metadata.file_name", "_metadata.row_index")
    # One row for each file.
    up_to = Window.orderBy("file_name").rowsBetween(
        Window.unboundedPreceding, -1)
    before = back.groupBy("file_name").count().select(
        "file_name", F.coalesce(F.sum("count").over(up_to),
                                F.lit(0)).alias("before"))
    return back.join(before, "file_name").select(
        (F.col("before") + F.col("row_index") + 1).alias("place"), "c_custkey")


@query("formatted", "c_mktsegment:s mean_sd:s share:s", """
SELECT c_mktsegment, printf('%.1f (%.1f)', m, s) AS mean_sd,
 printf('%.1f', p * 100) AS share FROM (
 SELECT c_mktsegment, avg(CAST(c_custkey % 97 AS DOUBLE)) AS m,
  stddev_samp(CAST(c_custkey % 97 AS DOUBLE)) AS s,
  count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS p
 FROM customer GROUP BY 1)""")
def _(spark, sf):
    c = customers(spark, sf)
    x = (F.col("c_custkey") % 97).cast("double")
    total = c.agg(F.count(F.lit(1)).cast("double")).scalar()
    return c.groupBy("c_mktsegment").agg(
        F.avg(x).alias("m"), F.stddev_samp(x).alias("s"),
        F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / total).select(
        "c_mktsegment", fc.fmt_mean_sd("m", "s").alias("mean_sd"),
        fc.fmt_pct("p").alias("share"))
