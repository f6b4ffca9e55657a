"""Visits, events and baseline derived from the TPC-H-like driver tables.

Orders are visits of a customer, their keys fix values, doses and flags by
integer arithmetic, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                              "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k, seg = F.col("o_orderkey"), F.col("c_mktsegment")
    unit = F.when(seg.isin("BUILDING", "MACHINERY", "HOUSEHOLD"), 0.5) \
        .otherwise(2.5)
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.when(seg == "BUILDING", "ENGAGE")
        .when(seg == "MACHINERY", "ROCKET_AF")
        .when(seg == "HOUSEHOLD", "RELY").otherwise("ARISTOTLE")
        .alias("trial"),
        F.col("o_custkey").alias("subjid"),
        F.floor(days / F.lit(3.0)).cast("int").alias("study_day"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 31 == 0, 0.0)
        .otherwise((8 + (k * 37) % 43).cast("double") / 10).alias("value"),
        F.when(k % 11 == 0, F.lit(None)).when((k % 13).isin(0, 1), 0.0)
        .when(k % 997 == 0, 150.0).when(k % 401 == 0, 99.0)
        .otherwise(unit * (4 + (k * 17) % 16).cast("double")).alias("dose"),
        F.when(k % 19 == 0, "N").otherwise("Y").alias("value_type"),
        F.when(k % 29 == 0, 1.0).otherwise(0.0).alias("interrupt_flag"),
        k.alias("seq"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visits(spark, sf_dir).select("trial", "subjid", "study_day", "seq")
    s = F.col("seq")
    r = s % 7
    return v.filter(s % 6 == 0).select(
        "trial", "subjid",
        F.when(r == 0, "All Cause Death").when(r == 1, "Ischemic Stroke")
        .when(r == 2, "Major Bleeding").when(r == 3, "Minor Bleeding")
        .when(r == 4, "Hemorrhagic Stroke").when(r == 5, "Hospitalization")
        .otherwise("Systemic Embolism").alias("event_name"),
        F.when(s % 31 != 0, (F.col("study_day") + (s * 7) % 120).cast("int"))
        .alias("event_day"),
        F.when(s % 4 == 0, (s % 5).cast("double")).alias("rankin"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    return (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                k.alias("subjid"), (k % 2).cast("int").alias("sex"),
                F.when(k % 29 == 0, ">89")
                .otherwise((40 + k % 50).cast("string")).alias("age"),
                F.when(k % 41 != 0, (45 + k % 80).cast("double"))
                .alias("weight"),
                F.col("r_name").alias("region"),
                F.col("n_name").alias("country"),
                F.when(k % 3 == 0, "NEVER").when(k % 3 == 1, "FORMER SMOKER")
                .otherwise("CURRENT SMOKER").alias("smoke"),
                F.when(k % 4 == 0, "Y").otherwise("N").alias("diabetes")))
