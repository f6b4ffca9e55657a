"""Reading and writing tables, metrics, logs and step outputs."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions.columns import decode_text, nan_to_null
from trajspark.operators.relational import require_columns

VISITS = T.StructType([
    T.StructField("trial", T.StringType()),
    T.StructField("subjid", T.LongType()),
    T.StructField("study_day", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("dose", T.DoubleType()),
    T.StructField("value_type", T.StringType()),
    T.StructField("interrupt_flag", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])
EVENTS = T.StructType([
    T.StructField("trial", T.StringType()),
    T.StructField("subjid", T.LongType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_day", T.IntegerType()),
    T.StructField("rankin", T.DoubleType()),
])
MEDICATIONS = T.StructType([
    T.StructField("subjid", T.LongType()),
    T.StructField("beta_blocker", T.IntegerType()),
    T.StructField("asa", T.IntegerType()),
    T.StructField("ace", T.IntegerType()),
    T.StructField("statin", T.IntegerType()),
])


def read_table(spark: SparkSession, path: str,
               schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by=None,
                mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             rename: dict | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True, schema=schema)
    return df.withColumnsRenamed(rename) if rename else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def read_jdbc(spark: SparkSession, url: str, query: str,
              props: dict | None = None) -> DataFrame:
    """A projection or alias query runs in the database, not here."""
    return (spark.read.format("jdbc").option("url", url)
            .option("query", query).options(**(props or {})).load())


def read_ids(spark: SparkSession, path: str, name: str = "subjid") -> DataFrame:
    """A text file of ids, one a line, also in floating notation."""
    return (spark.read.text(path)
            .select(F.trim("value").try_cast("double").cast("long")
                    .alias(name)).filter(F.col(name).isNotNull()))


def write_metrics(df: DataFrame, path: str) -> None:
    """A (metric, value) table as JSON lines."""
    df.select("metric", "value").write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics from JSON lines of {metric, value} or from one JSON object
    that maps names to numbers."""
    raw = spark.read.text(path, wholetext=False)
    one = F.from_json("value", "metric string, value double")
    many = F.from_json("value", "map<string,double>")
    pairs = raw.select(one.alias("o"), many.alias("m"))
    lines = pairs.filter("o.metric is not null").select("o.*")
    objects = (pairs.filter("o.metric is null and m is not null")
               .select(F.explode("m").alias("metric", "value")))
    return lines.unionByName(objects)


def ingest_raw(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exported raw table to the declared schema: text decoded and trimmed,
    numbers cast, NaN turned to NULL."""
    require_columns(df, schema.names)
    cols = []
    for f in schema.fields:
        source = df.schema[f.name].dataType
        c = F.col(f.name)
        if isinstance(source, (T.BinaryType, T.StringType)):
            c = decode_text(c)
        elif isinstance(source, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        if source != f.dataType:
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def audited(df: DataFrame, step: str, path: str | None = None,
            subject: str = "subjid") -> DataFrame:
    """Keep a copy of a step's output and go on from the copy.

    Without a path only row and subject counts are observed while the plan
    runs; read them with `observation(df)`.
    """
    if path is not None:
        target = f"{path}/{step}"
        write_table(df, target)
        return df.sparkSession.read.parquet(target)
    obs = Observation(step)
    out = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                     F.approx_count_distinct(subject).alias("subjects"))
    out.observation = obs
    return out


def auditable(*names: str):
    """Decorator: a step called with `audit_path=` keeps its outputs there,
    under the name of the function and, for several frames, their names."""
    def wrap(fn):
        @wraps(fn)
        def step(*args, audit_path: str | None = None, **kwargs):
            out = fn(*args, **kwargs)
            if audit_path is None:
                return out
            if isinstance(out, DataFrame):
                return audited(out, fn.__name__, audit_path)
            return tuple(audited(d, f"{fn.__name__}_{n}", audit_path)
                         for d, n in zip(out, names))
        return step
    return wrap


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a derived table once and read it back."""
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


def read_runs(spark: SparkSession, glob: str,
              schema: T.StructType | str) -> DataFrame:
    """Logs of many runs as one table; a run is named by its folder."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return (spark.read.schema(schema).json(glob)
            .select(folder.alias("run"), "*"))


def export_transitions(df: DataFrame, path: str, state, next_state) -> None:
    """Transitions with states as float arrays, ready for a trainer."""
    as_array = lambda cols: F.array(*[F.col(c).cast("float") for c in cols])
    (df.select("k", as_array(state).alias("state"),
               F.col("option").cast("int"),
               as_array(next_state).alias("next_state"),
               F.col("reward").cast("float"), F.col("not_done").cast("float"),
               "sample_prob")
     .write.mode("overwrite").parquet(path))
