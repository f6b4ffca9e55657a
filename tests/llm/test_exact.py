import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from trajspark.llm import exact


def test_groups(docs, rows):
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[t or ""].append(i)
    got = {r["doc_id"]: r for r in exact.exact_groups(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows.items():
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(g), len(g), i == max(g))
        assert bytes(got[i]["digest"]) == hashlib.sha256((t or "").encode()).digest()


def test_shared_digests_are_told_apart(docs, rows):
    """With a digest of a few values nearly every document is a hit, and bytes decide."""
    weak = exact.exact_groups(docs, digest=lambda t: F.unhex(F.substring(F.sha2(F.encode(t, "UTF-8"), 256), 1, 2)))
    strong = exact.exact_groups(docs)
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(tuple, weak.select(cols).collect())) == sorted(map(tuple, strong.select(cols).collect()))


def test_repeated_rows_and_null_ids(odd):
    got = exact.exact_groups(odd)
    assert got.count() == 8 and got.where("kept").count() == 4
    assert got.where("group_size = 4").count() == 4 and got.where("keep_id = 5 AND kept").count() == 2
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 4


def test_empty(empty):
    assert exact.exact_groups(empty).count() == 0 and exact.drop_copies(empty).columns == empty.columns


def test_state_goes_on(spark, tmp_path):
    """A second batch of arrivals meets the state of the first."""
    schema = "digest binary, id long, __file string, __row long"
    for n, ids in enumerate([(1, 2), (9, 3)]):
        spark.createDataFrame([(b"d", i, "f", i) for i in ids], schema).write.mode("append").parquet(f"{tmp_path}/in")
        state = exact.keyed_state(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema,
                                  f"{tmp_path}/state").first()
        assert (state["holder"]["id"], state["n"]) == [(2, 2), (9, 4)][n]
