"""What operators hold in the driver when tables outgrow their bounds."""

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import suffix_dedup as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 16_000_000])
def test_suffix_dedup_broadcasts_within_its_bound(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_BYTES", most)
    units = spark.createDataFrame([(i, i, "x" * i) for i in range(9)], "id long, digest long, text string")
    found = spark.createDataFrame([(3, 3, [b"abcd"])], "id long, digest long, places array<binary>")
    for how, rows in (("inner", 1), ("left", 9)):
        got = D._with_texts(units, found, "places", how)
        assert ("BroadcastHashJoin [id" in plan(got)) == (most > 0) and got.count() == rows
        assert [r["id"] for r in got.collect() if r["places"]] == [3]
    rows = units.select("id", "digest", (F.col("id") % 3).alias("head"), F.col("text").cast("binary").alias("at"))
    got = D._of_heads(rows, spark.createDataFrame([(0,), (2,)], "head long"))
    assert ("BroadcastHashJoin" in plan(got)) == (most > 0) and sorted(r["id"] for r in got.collect()) == [0, 2, 3, 5, 6, 8]


def test_suffix_dedup_alike_with_and_without_broadcasts(spark, monkeypatch):
    part = lambda k, n: "".join(chr(97 + (k * 7919 + i * i * (k + 3)) % 26) for i in range(n))
    docs = spark.createDataFrame([(i, part(i % 5, 450 + i) + part(i, 200) + part(i % 3, 420)) for i in range(24)] + [(30, None)], "doc_id long, text string")
    few = sorted(D.dedup(docs).collect())
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert sorted(D.dedup(docs).collect()) == few and sum(r["n_removed"] for r in few) > 0


def test_suffix_dedup_shuffles_texts_in_question_only(spark):
    units = spark.range(40_000).select("id", F.xxhash64("id").alias("digest"), F.lit("x").alias("text"))
    few = units.where("id % 50 = 0")
    got = D._marked(units, few, 800).where("in_").select("id").collect()
    ids = {r["id"] for r in got}
    assert ids >= set(range(0, 40_000, 50)) and len(ids) < 6_000
