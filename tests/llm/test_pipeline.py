import random

import corpus_pipeline
from pyspark.sql import Window
from pyspark.sql import functions as F

from trajspark.llm import mixing
from trajspark.llm.common import kept
from trajspark.llm.exact import located

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact", "jaccard", "mixing", "packing"]
    ids = [{r[0] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, SF), name)
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if name != "packing":
            assert docs.columns == columns and docs.count() == len(ids[-1])
    assert len(ids[1] & toxic) < 0.3 * len(toxic) and len(ids[0]) - len(ids[1]) < 2 * len(toxic) * len(ids[0]) / 87
    assert ids[3] == ids[4] == ids[5]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_sequences_follow_the_mixture(spark):
    """Sequences come in the order of the schedule, whose sources follow the weights, wherever the documents are stored."""
    small, n = 100, 500  # two sources, weights 10 and 20; texts of one length, and three for a sequence
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("the "), 620), F.lit("end")).alias("text"),
        F.when(F.col("id") < small, "a").otherwise("b").alias("source"))
    packed = []
    for parts in (3, 7):
        stored = kept(docs.repartition(parts, F.xxhash64(F.lit(parts), "doc_id")), "stored")
        mixed = kept(corpus_pipeline.mix_sources(spark, stored, SF), "mixed")
        out = corpus_pipeline.pack_sequences(spark, mixed, SF).select("doc_id", "piece", "sequence_id", "offset").collect()
        packed.append(sorted((r["sequence_id"], r["offset"], r["doc_id"], r["piece"]) for r in out))
    assert packed[0] == packed[1] and len(packed[0]) == n
    numbers = sorted({x[0] for x in packed[0]})
    assert numbers == list(range(len(numbers)))
    rows = located(stored)
    at = {r["doc_id"]: r["position"] for r in mixing.placed(rows).join(rows, ["__file", "__row"]).collect()}
    assert len(set(at.values())) == n
    order = [doc for _, _, doc, _ in packed[0]]
    assert order == sorted(at, key=at.get)
    seen, ends = 0, max(order.index(d) for d in range(small))
    for t, doc in enumerate(order[:ends], 1):  # weights of 10 and 20, to less than a block and what is begun of one
        seen += doc < small
        assert abs(seen - t / 3) < 2 * mixing.BLOCK


def test_drop_toxic_learns_from_all_labels(spark, tmp_path):
    """Toxic documents with a word that only labels behind the first 1000 by hash have are dropped as well."""
    r = random.Random(12)
    data = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(4, 9))), "en", "s", i % 2) for i in range(2800)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, toxic int")
    turn = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id")))
    df = kept(df.withColumn("text", F.when(F.col("toxic") == 0, F.col("text")).otherwise(
        F.concat("text", F.when(turn > 1000, " vile").otherwise(" awful")))), "rows")
    df.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.drop_toxic(spark, df.drop("toxic"), str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source"]
    left = [r["doc_id"] for r in out.collect()]
    assert sum(i % 2 == 0 for i in left) > 1330 and sum(i % 2 for i in left) < 70
