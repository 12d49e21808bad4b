"""N-gram Jaccard self-join by a blocked sparse matrix product of the document by n-gram incidence.

The incidence is dealt in blocks of n-grams, to which each task sends an n-gram once with its count; the documents of an
n-gram stay where they are, so a frequent one doesn't bring them to one task. Multiplying a block by its transpose pairs
the documents of each n-gram; bounds that follow from the set sizes alone decide before the product what can't reach the threshold t:

* J(x, y) >= t needs at least ceil(t |x|) of x's n-grams in y. In any global order of n-grams, such a pair shares l of them
  within the first |x| - ceil(t |x|) + l of x and likewise of y.
* First pass, order by hash, l = |x| / 5: a document with too few n-grams in that prefix that any other document has in
  its own is out.
* Second pass over the rest, with exact frequencies: a document with fewer than ceil(t |x|) n-grams that others have
  is out; of the others only the rarest |x| - ceil(t |x|) + 1 n-grams are multiplied (l = 1).

Equal sets are one class beforehand. Within the product, frequent columns are not expanded into pairs: every row of a
column is first paired with the most central document of the column, overlaps are counted, the links' components are
contracted, and only rows of different components in one column are paired further, again through the most central ones
first and in full at the end. So every pair is linked, proven to be no link, or already connected; nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, need, parallelism, release, slices, space_words
from quillmesh.llm.components import components
from quillmesh.llm.exchange import SCHEMA, Share, totals

N = 5
NUM, DEN = 80, 100
BLOCK_POSTINGS = 500_000
#: N-grams of an origin: a frequent one reaches its block once for so many.
ORIGIN_POSTINGS = 1_000_000
#: Pairs of one set from which on they are split over SALTS tasks.
HOT_PAIRS, SALTS = 2_000, 64
#: Most ids that are broadcast, counted before; beyond it the join shuffles.
BROADCAST_IDS = 500_000


def grams(texts: list, n: int = N) -> list[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of each text; fewer than n words are one n-gram, no words none."""
    words = [space_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.uint64)] * len(texts)
    flat = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    of = np.array([xxhash.xxh3_64_intdigest(x) for x in flat.dictionary.to_pylist()], np.uint64)
    h = of[flat.indices.to_numpy(zero_copy_only=False)]
    mix = np.uint64(0x9E3779B97F4A7C15)
    run = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        run = (run ^ (run >> np.uint64(31))) * mix + h[k : k + len(run)]
    run ^= run >> np.uint64(29)
    run *= np.uint64(0xBF58476D1CE4E5B9)
    run ^= run >> np.uint64(32)
    out, at = [], 0
    for w, size in zip(words, sizes.tolist()):
        if size >= n:
            out.append(np.unique(run[at : at + size - n + 1]))
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\0%d " % size + b" ".join(w))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def common_least(n):
    """ceil(t n): the fewest n-grams that a set of n shares with one it is linked to."""
    return -(-NUM * n // DEN)


def prefix_length(n):
    return np.minimum(n, n - common_least(n) + n // 5 + 1)


def prefix_least(n):
    """The fewest n-grams of the prefix that a linked document of any admissible size has in its own."""
    return common_least(n) // 5 + 1


def _frequent(docs: DataFrame, blocks: int) -> DataFrame:
    """(digest) of the sets with enough n-grams in their prefix that others have in theirs; equal sets of a task count once."""

    def deal(batches):
        seen: set[bytes] = set()
        held: list = []
        size = 0

        def flush():
            share = Share(np.concatenate([g for g, _, _ in held])[:, None], blocks, short=True)
            sizes = np.array([(n, len(g)) for g, n, _ in held], np.int64)
            member = len(held).to_bytes(8, "little") + b"".join(k for _, _, k in held) + sizes.tobytes() + share.number.astype(np.int32).tobytes()
            held.clear()
            return share.batch(member)

        for b in slices(batches, 256):
            for i, g in zip(b.column(0).to_pylist(), grams(b.column(1).to_pylist())):
                if i is None or not len(g):
                    continue
                key = _digest(g)
                if key in seen:
                    continue
                seen.add(key)
                part = g[: int(prefix_length(np.int64(len(g))))]
                held.append((part, len(g), key))
                size += len(part)
            if size > ORIGIN_POSTINGS:
                yield flush()
                size = 0
        if held:
            yield flush()

    def home(member, found):
        n = int.from_bytes(member[:8], "little")
        keys = [member[8 + 16 * k : 24 + 16 * k] for k in range(n)]
        sizes = np.frombuffer(member, np.int64, 2 * n, 8 + 16 * n).reshape(n, 2)
        number = np.frombuffer(member, np.int32, offset=8 + 16 * n + sizes.nbytes)
        shared = np.add.reduceat(found[number] > 1, np.cumsum(sizes[:, 1]) - sizes[:, 1], dtype=np.int64)
        return pd.DataFrame({"digest": [k for k, ok in zip(keys, shared >= prefix_least(sizes[:, 0])) if ok]})

    return totals(docs.mapInArrow(deal, SCHEMA), 0, home, "digest binary", "prefixes")


def _columns(rows: DataFrame, blocks: int) -> DataFrame:
    """(gram, doc_id, n, rank, central): of each set the rarest n-grams that a linked one must share, if enough are shared at all."""

    def deal(batches):
        held: list = []
        size = 0

        def flush():
            share = Share(np.concatenate([g for _, g in held])[:, None], blocks, short=True)
            docs = np.array([(i, len(g)) for i, g in held], np.int64)
            member = len(held).to_bytes(8, "little") + len(share.keys).to_bytes(8, "little") + docs.tobytes() + share.keys.tobytes() + share.number.astype(np.int32).tobytes()
            held.clear()
            return share.batch(member)

        for b in slices(batches, 1024):
            for i, g in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                held.append((i, np.frombuffer(g, np.uint64)))
                size += len(held[-1][1])
            if size > ORIGIN_POSTINGS:
                yield flush()
                size = 0
        if held:
            yield flush()

    def home(member, found):
        n, m = (int.from_bytes(member[k : k + 8], "little") for k in (0, 8))
        docs = np.frombuffer(member, np.int64, 2 * n, 16).reshape(n, 2)
        keys = np.frombuffer(member, np.uint64, m, 16 + docs.nbytes)
        number = np.frombuffer(member, np.int32, offset=16 + docs.nbytes + keys.nbytes)
        at = np.repeat(np.arange(n), docs[:, 1])
        keep = found[number] > 1
        h, f, at = keys[number][keep], found[number][keep], at[keep]
        order = np.lexsort((h, f, at))
        h, at = h[order], at[order]
        shared = np.bincount(at, minlength=n)
        size = docs[:, 1]
        take = np.where(shared >= common_least(size), np.minimum(shared, shared - common_least(size) + 1), 0)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(shared) - shared, shared)
        keep = pos < take[at]
        rank = pos + (size - shared)[at]  # n-grams that no other document has come first
        central = (shared * 1_000_000 // np.maximum(1, size))[at]
        return pd.DataFrame({"gram": h[keep].view(np.int64), "doc_id": docs[at[keep], 0], "n": size[at[keep]], "rank": rank[keep], "central": central[keep]})

    return totals(rows.mapInArrow(deal, SCHEMA), 0, home, "gram long, doc_id long, n long, rank long, central long", "postings")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest binary, v long): digest identifies the set, v is its first half; null for an empty one."""

    def run(batches):
        for b in slices(batches, 256):
            sets = grams(b.column(1).to_pylist())
            keys = [_digest(g) for g in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(g) for g in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([_vertex(k) for k in keys], pa.int64())], ["doc_id", "n_shingles", "digest", "v"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, v long")


def _digest(g: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None


def _vertex(digest: bytes | None) -> int | None:
    return digest and int.from_bytes(digest[:8], "little", signed=True)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ``ids``, which are broadcast if they are few, with the digest looked for."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id").select("digest", "text")


def links(docs: DataFrame, every: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between classes, by v, whose components are those of all links."""
    spark = docs.sparkSession
    total = every.agg(F.sum(F.least("n_shingles", (F.col("n_shingles") * 2 / 5).cast("long") + 2)), F.sum("n_shingles")).first()
    blocks = max(parallelism(spark), -(-(total[0] or 0) // BLOCK_POSTINGS))

    near = _frequent(docs, int(blocks))
    picked = materialize(reps.join(near.distinct(), "digest").select(F.col("rep").alias("doc_id"), "digest"), "picked")

    def sets(batches):
        for b in slices(batches, 256):
            got = [g for d, g in zip(b.column(0).to_pylist(), grams(b.column(1).to_pylist())) if _digest(g) == d]
            yield pa.RecordBatch.from_arrays([pa.array([_vertex(_digest(g)) for g in got], pa.int64()), pa.array([len(g) for g in got], pa.int64()), pa.array([g.tobytes() for g in got], pa.binary())], ["doc_id", "n", "grams"])

    rows = _only(docs, picked).mapInArrow(sets, "doc_id long, n long, grams binary")
    if not every.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id"])  # rows that repeat as a whole
    rows = materialize(rows, "sets")
    size = rows.agg(F.sum("n")).first()[0] or 0
    blocks = int(max(parallelism(spark), -(-size // BLOCK_POSTINGS)))
    return _product(_columns(rows, blocks), rows)


def _beside(pairs: DataFrame, rows: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """The pairs with the set of ``key``; those of a set in very many pairs are split, and the set is sent to each part."""
    many = materialize(pairs.groupBy(key).count().where(F.col("count") >= HOT_PAIRS).select(key, F.lit(True).alias("hot")), "hot")
    few = many.count() <= BROADCAST_IDS
    hot = F.broadcast(many) if few else many
    dealt = pairs.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    sets = rows.select(F.col("doc_id").alias(key), F.col("grams").alias(name)).join(hot, key, "left")
    sets = sets.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return dealt.join(sets, [key, "salt"]).drop("salt")


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by counting their common n-grams."""

    def run(batches):
        for t in slices(batches, 1024):
            ok = []
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = _beside(_beside(pairs, rows, "a", "b", "x"), rows, "b", "a", "y")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _product(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between rows of common columns; see the module's text."""

    def fits(n, i, m, j):
        """Sizes n and m may reach the threshold if the first common n-gram has ranks i and j: at most min(n - i, m - j) are common."""
        both = NUM * (n + m)
        return (n * DEN >= m * NUM) & (m * DEN >= n * NUM) & ((n - i) * (NUM + DEN) >= both) & ((m - j) * (NUM + DEN) >= both)

    c = F.col
    labelled = columns.withColumn("component", F.col("doc_id"))
    tested = found = None
    stage = "centre"
    while True:
        best = F.max(F.struct("central", "n", "doc_id", "rank"))
        spent = []
        if stage == "centre":
            # of each component of a column the most central row, paired with the most central of the column
            own = labelled.groupBy("gram", "component").agg(best.alias("own"))
            own = materialize(own.select("gram", F.pmod(F.xxhash64("component"), F.lit(16)).alias("salt"), "component", "own"), "own")
            top = own.groupBy("gram").agg(F.max(F.struct("own", "component")).alias("top"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
            top = materialize(top.select("gram", "top", F.explode(F.array([F.lit(k).cast("long") for k in range(16)])).alias("salt")), "top")
            spent = [own, top]
            pairs = own.join(top, ["gram", "salt"]).where((c("component") != c("top.component")) & fits(c("own.n"), c("own.rank"), c("top.own.n"), c("top.own.rank")))
            pairs = pairs.select(c("own.doc_id").alias("d"), c("top.own.doc_id").alias("e"))
        else:
            # rows that could reach the threshold with the smallest row of their column, in columns of several components
            span = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least")]
            side = labelled
            for _ in range(3):
                mixed = materialize(side.groupBy("gram").agg(*span).where("lo < hi").select("gram", "least"), "mixed")
                other = F.greatest("least", F.ceil(c("n") * NUM / DEN))
                spent.append(mixed)
                side = materialize(side.drop("least").join(mixed, "gram").where((c("n") - c("rank")) * (NUM + DEN) >= NUM * (c("n") + other)), "side")
                spent.append(side)
            mixed = side.groupBy("gram").agg(*span).where("lo < hi").select("gram")
            side = materialize(side.join(mixed, "gram", "left_semi"), "side")
            spent.append(side)
            one = side.select("gram", c("doc_id").alias("d"), "n", c("rank").alias("i"), "component")
            two = side.select("gram", c("doc_id").alias("e"), c("n").alias("m"), c("rank").alias("j"), c("component").alias("other"))
            pairs = one.join(two, "gram").where((c("component") < c("other")) & fits(c("n"), c("i"), c("m"), c("j"))).select("d", "e")
        pairs = pairs.select(F.least("d", "e").alias("a"), F.greatest("d", "e").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        new = _verified(pairs, rows)
        release(*spent)
        tested = pairs if tested is None else tested.unionAll(pairs)
        none = new.isEmpty()
        found = new if found is None else found.unionAll(new)
        if stage == "all" or none and columns.isEmpty():
            return found
        if none:
            stage = "all"  # the centres have nothing more to give
        else:
            label = components(found).select(F.col("v").alias("doc_id"), "component")
            labelled = materialize(columns.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "labelled")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the smallest doc_id reachable by links, itself included.

    Null and empty texts have no n-grams and are linked with nothing. Rows of one doc_id are one vertex. A null doc_id
    takes no part and has a null component_id. An empty table gives no rows.
    """
    docs = need(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = materialize(classes(docs), "classes")
    reps = materialize(every.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest", "v").agg(F.min("doc_id").alias("rep")), "reps")
    # rows of one doc_id with different sets tie their classes together
    same = every.where("digest IS NOT NULL").groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("hi")).where("a < hi").select("doc_id", "a")
    same = every.join(same, "doc_id").select("a", F.col("v").alias("b"))
    label = components(links(docs, every, reps).unionAll(same)).withColumnRenamed("v", "at")
    whole = materialize(reps.join(label, reps.v == label["at"], "left").select("digest", "rep", F.coalesce("component", reps.v).alias("component")), "whole")
    least = whole.groupBy("component").agg(F.min("rep").alias("class_component"))
    of = materialize(whole.join(least, "component").select("digest", "class_component"), "of")
    out = every.join(of, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id"))


def op4_blocked_product(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""
