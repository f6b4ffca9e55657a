"""Exact deduplication: a stream of arrivals against keyed state on disk, full bytes compared on hits.

Every document arrives as (digest, identifier, locator). A streaming aggregation keeps, per digest and for ever (no
watermark, no expiry), the identifier and the locator of the document that stays and the number of arrivals; the state
lives in RocksDB and its checkpoint. Documents whose digest has other arrivals are hits: their whole texts are compared
with the text at the holder's locator. Only DataFrame operations run on the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.common import kept, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOCATOR = ["__file", "__row"]


def located(docs: DataFrame) -> DataFrame:
    """`docs` with a locator: file and row within it. What doesn't come straight from files is written first."""
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select("*", meta["file_path"].alias("__file"), meta["row_index"].alias("__row"))
    except AnalysisException:
        return located(kept(docs, "landed"))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def holders(arrivals: DataFrame) -> DataFrame:
    """Per digest the arrival with the largest identifier and the number of arrivals; also for streams."""
    return arrivals.groupBy("digest").agg(F.max(F.struct("id", *LOCATOR)).alias("holder"),
                                          F.count(F.lit(1)).alias("n"))


def keyed_state(spark: SparkSession, path: str, schema, folder: str) -> DataFrame:
    """Runs the arrivals at `path` through `holders` as a stream until none is left, and reads the state.

    A second run with the same `folder` goes on from the state of the first.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Many small stores: no disk set aside for logs that stay short, none kept open after the run.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    stream = holders(session.readStream.schema(schema).parquet(path))
    run = (stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", folder)
           .trigger(availableNow=True).start())
    run.awaitTermination()
    state = spark.read.format("statestore").load(folder)
    value = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.{value[0]}").alias("holder"),
                        F.col(f"value.{value[1]}").alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of `docs`: id, digest, keep_id, group_size, kept, and the locator.

    Of rows with equal bytes the one with the largest id stays (null is the smallest; between rows with the same id,
    the last by locator), so each group keeps exactly one row, also with repeated rows. Null texts count as empty and
    are equal to empty ones. An empty table gives an empty one. Only id and text are read; other columns may have any
    name. A digest that two texts share splits no group and joins none: rows that differ from their holder in bytes
    are grouped by their full text. A hot digest is counted before the shuffle, and its rows, joined with one holder,
    can be split by adaptive execution.
    """
    return _groups(located(docs.select(id_col, text_col)), id_col, text_col, digest)


def _groups(rows: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), *LOCATOR)
    rows = rows.withColumn("digest", digest(F.col("text")))
    folder = f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    feed = rows.select("digest", "id", *LOCATOR)
    feed.write.parquet(f"{folder}/arrivals")
    arrivals = spark.read.schema(feed.schema).parquet(f"{folder}/arrivals")
    state = kept(keyed_state(spark, f"{folder}/arrivals", feed.schema, f"{folder}/state"), "holders")
    hits = kept(rows.join(state.where("n > 1").drop("n"), "digest"), "hits")
    at_holder = (F.col("__file") == F.col("holder.__file")) & (F.col("__row") == F.col("holder.__row"))
    held = hits.where(at_holder).select("digest", F.col("text").alias("held"))
    odd = kept(hits.join(held, "digest").where("text <> held").select("digest", "text", "id", *LOCATOR), "odd")
    members = arrivals.join(state, "digest")
    if not odd.isEmpty():  # texts that share a digest
        classes = odd.groupBy("digest", "text").agg(F.max(F.struct("id", *LOCATOR)).alias("own"),
                                                    F.count(F.lit(1)).alias("own_n"))
        own = odd.join(classes, ["digest", "text"]).select(*LOCATOR, "own", "own_n")
        members = (members.join(odd.groupBy("digest").agg(F.count(F.lit(1)).alias("n_odd")), "digest", "left")
                   .join(own, LOCATOR, "left")
                   .withColumns({"holder": F.coalesce("own", "holder"),
                                 "n": F.coalesce("own_n", F.col("n") - F.coalesce("n_odd", F.lit(0)))}))
    return members.select(F.col("id").alias(id_col), "digest", F.col("holder.id").alias("keep_id"),
                          F.col("n").alias("group_size"), at_holder.alias("kept"), *LOCATOR)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_groups` drops; all columns."""
    rows = located(docs)
    stay = _groups(rows, id_col, text_col).where("kept").select(*LOCATOR)
    return rows.join(stay, LOCATOR, "left_semi").drop(*LOCATOR)
