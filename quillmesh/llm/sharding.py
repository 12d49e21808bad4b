"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on a ring of 2^64; every shard has ``vnodes`` places. A key belongs to the first virtual
node clockwise; when that shard is full the key continues clockwise to the next node of a shard that is not. The
capacities add up to the number of rows and are at most one apart, so the balance is guaranteed (law ``rows``),
and only keys of overfull arcs move off their own shard.

Only a histogram of the arcs (at most ``shards * vnodes * SPLITS`` counts, whatever the input) reaches the driver,
which plays the overflow on counts; rows are then placed by their rank within their arc, without another shuffle.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmesh.llm.common import materialize, need

#: Parts into which every arc is split for ranking, so that a repeated key that holds a third of all rows is ranked by many tasks.
SPLITS = 32


def _place(shard: int, replica: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{shard}:{replica}".encode()).digest()[:8], "big") - (1 << 63)


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The virtual nodes as (place, shard), clockwise. A shard's places don't depend on the number of shards."""
    return sorted((_place(s, v), s) for s in range(shards) for v in range(vnodes))


def play(counts: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc the ranges (first rank, end rank, shard) of its keys, by rank.

    In each round every batch of keys stands before a virtual node; shards take from the batches in ring order until
    they are full, and what a full shard can't take goes on to the next node.
    """
    n, room = len(owners), list(capacity)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    waiting = [(a, a, 0, c) for a, c in enumerate(counts) if c]
    while waiting:
        on = []
        for arc, node, first, end in waiting:
            take = min(room[owners[node]], end - first)
            if take:
                room[owners[node]] -= take
                out[arc].append((first, first + take, owners[node]))
            if first + take < end:
                nxt = (node + 1) % n
                while room[owners[nxt]] == 0:
                    nxt = (nxt + 1) % n
                on.append((arc, nxt, first + take, end))
        waiting = on
    return out


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 128, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row into one of ``shards`` shards.

    Returns (key, size, text_crc32, home_shard, shard, slot). Null texts count as empty (size 1, crc 0); null keys
    share one place on the ring; repeated rows each get a slot of their own; an empty table gives no rows.
    Of equal keys, which row overflows is decided once, when the keys are written, and holds from then on.
    """
    nodes = ring(shards, vnodes)
    places, owners = [p for p, _ in nodes], [s for _, s in nodes]
    body = F.coalesce(F.col(text), F.lit(""))
    h = F.xxhash64(F.col(key))
    keys = (
        need(docs, key, text)
        .select(
            F.col(key),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            h.alias("place"),
            F.pmod(F.monotonically_increasing_id(), F.lit(SPLITS)).cast("int").alias("part"),
        )
    )
    keys = materialize(keys, "ring-keys")
    arcs = _with_arc(keys, places)
    hist = arcs.groupBy("arc", "part").count().collect()  # at most shards * vnodes * SPLITS rows
    size: dict[tuple[int, int], int] = {(r["arc"], r["part"]): r["count"] for r in hist}
    counts, base = [0] * len(nodes), {}
    for (a, p), c in sorted(size.items()):
        base[a, p] = counts[a]
        counts[a] += c
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    ranges = play(counts, owners, capacity)
    offset: dict[tuple[int, int], int] = {}
    for a, parts in enumerate(ranges):
        for first, end, s in parts:
            offset[a, first] = filled[s]
            filled[s] += end - first
    table = [(a, owners[a], [base.get((a, p), 0) for p in range(SPLITS)], [(f, e, s, offset[a, f]) for f, e, s in ranges[a]]) for a in range(len(nodes)) if counts[a]]
    spark = docs.sparkSession
    schema = "arc int, home_shard int, base array<long>, ranges array<struct<first: long, end: long, shard: int, slot: long>>"
    lookup = spark.createDataFrame(table, schema)  # a row for each virtual node
    w = Window.partitionBy("arc", "part").orderBy("place", F.col(key), "text_crc32", "size")
    ranked = arcs.withColumn("rank", F.row_number().over(w).cast("long") - 1)
    placed = ranked.join(F.broadcast(lookup), "arc").withColumn("rank", F.col("rank") + F.col("base")[F.col("part")])
    hit = F.filter("ranges", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["end"]))[0]
    return placed.withColumn("hit", hit).select(
        key, "size", "text_crc32", "home_shard", F.col("hit.shard").alias("shard"), (F.col("hit.slot") + F.col("rank") - F.col("hit.first")).alias("slot")
    )


def _with_arc(keys: DataFrame, places: list[int]) -> DataFrame:
    """Adds the index of the first node clockwise, by a join on the place's leading bits (the table is as small as the ring)."""
    bits = max(8, min(16, len(places).bit_length() + 2))
    rows = []
    for cell in range(1 << bits):
        lo = (cell << (64 - bits)) - (1 << 63)
        hi = lo + (1 << (64 - bits))
        i, j = bisect.bisect_left(places, lo), bisect.bisect_left(places, hi)
        rows.append((cell, i, places[i:j]))
    lookup = keys.sparkSession.createDataFrame(rows, T.StructType([T.StructField("cell", T.LongType()), T.StructField("lowest", T.IntegerType()), T.StructField("inside", T.ArrayType(T.LongType()))]))
    cell = F.shiftright(F.col("place"), 64 - bits) + F.lit(1 << (bits - 1))
    arc = F.col("lowest") + F.size(F.filter("inside", lambda x: x < F.col("place")))
    return keys.withColumn("cell", cell).join(F.broadcast(lookup), "cell").withColumn("arc", F.pmod(arc, F.lit(len(places))).cast("int")).drop("cell", "lowest", "inside")


def op7_ring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
