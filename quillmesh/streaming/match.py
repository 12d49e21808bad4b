"""Streaming: a query stream against a fixed pool, and windowed counts of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import normalize as N


def exact_stream(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """A stream-static join: (query_id, ts, query_text, company_id) by equal normalised text, null where there is none."""
    n = N.normalize(queries, "raw_text")
    n = n.withColumn("query_text", N.matching_text(F.col("core_text"), F.col("ascii_text"))).select(*queries.columns, "query_text")
    one = pool.groupBy("normalized_alias").agg(F.min("company_id").alias("company_id"), F.count_distinct("company_id").alias("owners")).where("owners = 1")
    return n.join(one, n.query_text == one.normalized_alias, "left").select(*queries.columns, "query_text", "company_id")


def decisions_per_window(matched: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of matched and open queries in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return matched.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("queries"), F.count("company_id").alias("matched"))


def match_batches(queries: DataFrame, match, sink, checkpoint: str):
    """Runs the whole batch matcher on every micro-batch: ``sink(match(batch), epoch)``."""
    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: sink(match(df), epoch)).start()
