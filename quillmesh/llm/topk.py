"""Exact top-k search: best-first search over M-trees whose pages are rows of a table.

A bounded sample is clustered into roots; every vector goes to the tree of its nearest root, and a root with more than
TREE_ROWS vectors gets several trees. A tree's node that doesn't fit a page is split by clustering: seeds drawn by
distance, refined, of which the nearest vectors are promoted; clusters too small for a page join others. Routing pages hold the promoted vectors with covering radii and
distances to the parent, leaf pages the different vectors, with the rows that hold them, and distances to the parent.

Queries first search a tree of their own root, best-first; an entry whose stored distances already prove by the triangle
inequality that it can't reach the k-th best is left without computing its distance. What they found bounds the search
of all other trees, which meet the queries in blocks of about QUERY_BLOCK by joins: neither passes through the driver.

Inner products become a metric by one more coordinate: x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x with M the largest norm in the tree. Bounds are floats with a slack that errs on the
side of visiting; scores themselves are exact.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.llm.common import materialize, need, trim

#: Entries of a page, and the share of it that a cluster needs for a page of its own while others can take its points.
PAGE, FILL = 64, 4
#: Vectors of a tree, about; vectors to a root, while there are at most MAX_ROOTS of a dimension.
TREE_ROWS, ROOT_ROWS, MAX_ROOTS = 16384, 1024, 4096
#: Most vectors, those of the smallest hashes, that the roots are clustered from, and most dimensions that get roots of their own.
ROOT_SAMPLE, MAX_DIMENSIONS = 20_000, 1000
QUERY_BLOCK = 8192
SLACK = 1e-6
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def promote(points: np.ndarray, fan: int, rounds: int = 2) -> np.ndarray:
    """Numbers of at most ``fan`` points that stand for clusters: seeds drawn by their squared distance from those before, refined by means, then the nearest points."""
    draw = np.random.default_rng(len(points))
    near = ((points - points.mean(0)) ** 2).sum(1)
    seeds = [int(near.argmin())]
    near = ((points - points[seeds[0]]) ** 2).sum(1)
    while len(seeds) < fan and near.max() > 0:
        seeds.append(int(draw.choice(len(points), p=near / near.sum())))
        near = np.minimum(near, ((points - points[seeds[-1]]) ** 2).sum(1))
    picked = np.array(seeds)
    for _ in range(rounds):
        of = _distances(points, points[picked]).argmin(1)
        size = np.bincount(of, minlength=len(picked))
        total = np.zeros((len(picked), points.shape[1]))
        np.add.at(total, of, points)
        better = np.unique(_distances(total[size > 0] / size[size > 0][:, None], points).argmin(1))
        if len(better) < 2:
            break
        picked = better
    return picked


def exact(vectors: np.ndarray, query: np.ndarray, most: float | None = None) -> np.ndarray:
    """Inner products of vectors of whole numbers: exact, clipped to what a long holds. ``most``: a bound of each product's sum, if known."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    if most is None:
        most = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query))
    if most < 2**53:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([min(MOST, max(LEAST, sum(int(x) * y for x, y in zip(v, q)))) for v in vectors], np.int64)


PAGES = "tree long, page int, bound2 double, has_parent boolean, vectors binary, to_parent binary, radii binary, children binary, ids binary, rows binary, sizes binary"


def build_tree(tree: int, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, page: int = PAGE) -> list[tuple]:
    """The pages of an M-tree, the root first. Equal vectors are one entry with all their rows, ascending by id."""
    different, of = np.unique(vectors, axis=0, return_inverse=True) if vectors.shape[1] else (vectors[:1], np.zeros(len(vectors), int))
    of = of.ravel()
    order = np.lexsort((rows, ids, of))
    ids, rows = ids[order], rows[order]
    size = np.bincount(of, minlength=len(different))
    begin = np.cumsum(size) - size
    norm2 = (different * different).sum(1)
    bound2 = float(norm2.max()) if len(different) else 0.0
    points = np.column_stack([different, np.sqrt(np.maximum(0, bound2 - norm2))])
    out: list = [None]
    todo: list[tuple[int, np.ndarray, int | None]] = [(0, np.arange(len(different)), None)]
    while todo:
        at, own, pivot = todo.pop()
        away = lambda k: np.zeros(len(k)) if pivot is None else np.sqrt(((points[k] - points[pivot]) ** 2).sum(1))  # noqa: E731, B023
        if len(own) <= page:
            held = np.concatenate([np.arange(begin[k], begin[k] + size[k]) for k in own]) if len(own) else np.zeros(0, int)
            out[at] = (tree, at, bound2, pivot is not None, different[own].tobytes(), away(own).tobytes(), None, None, ids[held].astype(np.int64).tobytes(), rows[held].astype(np.int64).tobytes(), size[own].astype(np.int64).tobytes())
            continue
        fan = min(page, max(2, -(-len(own) // page)))
        some = own if len(own) <= 4096 else own[np.random.default_rng(at).choice(len(own), 4096, replace=False)]
        seeds = some[promote(points[some], fan)]
        d = _distances(points[own], points[seeds])
        nearest = d.argmin(1)
        if np.bincount(nearest, minlength=len(seeds)).max() == len(own):  # too close to be told apart: any split will do
            nearest = np.arange(len(own)) % len(seeds) if len(seeds) > 1 else np.arange(len(own)) % 2
            seeds = seeds if len(seeds) > 1 else own[:2]
            d = _distances(points[own], points[seeds])
        count = np.bincount(nearest, minlength=len(seeds))
        filled = np.flatnonzero(count >= page // FILL)
        if 1 < len(filled) < len(seeds):  # the rest would be pages of a few entries
            seeds, d = seeds[filled], d[:, filled]
            nearest = d.argmin(1)
        elif len(filled) == 1:  # one cluster draws nearly all: it shares with the next in equal parts
            two = np.argsort(-count, kind="stable")[:2]
            seeds, d = seeds[two], d[:, two]
            nearest = np.ones(len(own), int)
            nearest[np.argsort(d[:, 0] - d[:, 1], kind="stable")[: len(own) // 2]] = 0
        kept = [j for j in range(len(seeds)) if (nearest == j).any()]
        radii = np.array([d[nearest == j, j].max() for j in kept])
        children = np.arange(len(out), len(out) + len(kept), dtype=np.int64)
        out += [None] * len(kept)
        routing = seeds[kept]
        out[at] = (tree, at, bound2, pivot is not None, different[routing].tobytes(), away(routing).tobytes(), radii.tobytes(), children.tobytes(), None, None, None)
        todo += [(int(c), own[nearest == j], int(seeds[j])) for c, j in zip(children, kept)]
    return out


class Tree:
    """A tree as read from its pages."""

    def __init__(self, pages, dim: int):
        self.pages: dict[int, tuple] = {}
        self.bound2 = 0.0
        for r in pages:
            floats = lambda x: None if x is None else np.frombuffer(x, np.float64)
            whole = lambda x: None if x is None else np.frombuffer(x, np.int64)
            _, page, self.bound2, has_parent, vectors, to_parent, radii, children, ids, rows, sizes = r
            vectors, to_parent, sizes = floats(vectors), floats(to_parent), whole(sizes)
            begin = None if sizes is None else np.cumsum(sizes) - sizes
            self.pages[int(page)] = (has_parent, vectors.reshape(len(to_parent), dim), to_parent, floats(radii), whole(children), whole(ids), whole(rows), sizes, begin, float(np.abs(vectors).max(initial=0)))

    def search(self, query: np.ndarray, k: int, own: int | None = None, floor: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
        """(the k best as (score, id, row), ties to the smaller id, and how many distances were computed).

        The row ``own`` takes no part; with ``floor``, entries of a lower score are left out.
        """
        q2 = float(query @ query)
        slack2, slack = SLACK * (1 + self.bound2 + q2), SLACK * (1 + np.sqrt(self.bound2) + np.sqrt(q2))
        away = lambda s: float(np.sqrt(max(0.0, q2 + self.bound2 - 2.0 * s) + slack2))
        floor = LEAST if floor is None else floor
        reach = float("inf") if floor == LEAST else away(floor)
        q_most = float(np.abs(query).max(initial=0)) * max(1, len(query))
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row): the worst stands first
        computed = 0
        heap: list[tuple[float, int, float]] = [(0.0, 0, 0.0)] if 0 in self.pages else []
        while heap:
            low, at, to_pivot = heapq.heappop(heap)
            if low > reach:
                break
            has_parent, vectors, to_parent, radii, children, ids, rows, sizes, begin, widest = self.pages[at]
            keep = None  # all
            if has_parent and reach < float("inf"):
                near = np.abs(to_pivot - to_parent) - (0 if radii is None else radii) <= reach + slack
                if not near.all():
                    keep = np.flatnonzero(near)
                    vectors = vectors[keep]
            if not len(vectors):
                continue
            computed += len(vectors)
            if children is None:
                scores = exact(vectors, query, widest * q_most)
                least = max(floor, best[0][0]) if len(best) == k else floor
                some = np.flatnonzero(scores >= least)
                scores = scores[some]
                for s, j in zip(scores.tolist(), (some if keep is None else keep[some]).tolist()):
                    first = begin[j]
                    for i, r in zip(ids[first : first + min(sizes[j], k + 1)].tolist(), rows[first : first + min(sizes[j], k + 1)].tolist()):
                        if r == own:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (s, -i, -r))
                        elif (s, -i, -r) > best[0]:
                            heapq.heapreplace(best, (s, -i, -r))
                if len(best) == k and best[0][0] != LEAST:
                    reach = min(reach, away(best[0][0]))
            else:
                d = np.sqrt(np.maximum(0, q2 + self.bound2 - 2 * (vectors @ query)))
                ahead = np.maximum(low, d - (radii if keep is None else radii[keep]) - slack)
                for low_, child, dist in zip(ahead.tolist(), (children if keep is None else children[keep]).tolist(), d.tolist()):
                    if low_ <= reach:
                        heapq.heappush(heap, (low_, child, dist))
        return sorted(((s, -i, -r) for s, i, r in best), key=lambda x: (-x[0], x[1], x[2])), computed


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>): each component as the whole number floor(1024 x); rows with a null id, a null vector or a null or non-finite component are left out."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x):
        y = x.cast("double") * 1024
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # beyond it there are only whole numbers

    return need(vectors, vec_id, embedding).where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, whole).alias("v"))


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column as (row numbers, matrix), by dimension."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    start = np.concatenate([[0], np.cumsum(sizes)])
    return [(at := np.flatnonzero(sizes == d), flat[(start[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)) for d in np.unique(sizes)]


def _with_root(vectors: DataFrame, roots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``dim`` and the number of the nearest root of that dimension."""
    sent = vectors.sparkSession.sparkContext.broadcast(roots)  # at most MAX_ROOTS vectors of a dimension, ROOT_SAMPLE in all
    at = vectors.columns.index("v")

    def run(batches):
        for b in batches:
            dim, root = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for rows, m in _matrices(b.column(at)) if b.num_rows else []:
                dim[rows] = m.shape[1]
                if len(known := sent.value.get(m.shape[1], ())) > 1:
                    root[rows] = _distances(m, known).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dim), pa.array(root)], [*b.schema.names, "dim", "root"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{schema}, dim int, root int")


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under names of their own, for a cogroup with what shares their source."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


@dataclass
class Index:
    """``pages``: the trees; ``rows``: (vec_id, v, row, dim, root) of every indexed vector; ``roots`` by dimension."""

    pages: DataFrame
    rows: DataFrame
    roots: dict[int, np.ndarray]


def _tree_number(salt) -> "F.Column":
    return F.shiftleft(F.col("dim").cast("long"), 40) + F.shiftleft(F.col("root").cast("long"), 24) + salt


def build(vectors: DataFrame) -> Index:
    """Indexes every row of ``vectors``, which come as from usable(). Equal rows stay rows of their own."""
    counts = {r["dim"]: r["count"] for r in vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(MAX_DIMENSIONS).collect()}
    roots = {}
    if any(n >= 2 * ROOT_ROWS for n in counts.values()):
        sample = vectors.orderBy(F.xxhash64("v"), "vec_id").limit(ROOT_SAMPLE).select("v").collect()  # a top-k of hashes
        for dim, n in counts.items():
            m = np.array([r["v"] for r in sample if len(r["v"]) == dim], float).reshape(-1, dim)
            fan = min(MAX_ROOTS, n // ROOT_ROWS, len(m))
            if fan > 1 and dim:
                roots[dim] = m[promote(m, fan)]
    rows = materialize(_with_root(vectors.withColumn("row", F.monotonically_increasing_id()), roots), "vectors")
    sizes = rows.groupBy("dim", "root").count().withColumn("salts", F.ceil(F.col("count") / TREE_ROWS))
    split = rows.join(sizes.drop("count"), ["dim", "root"]).withColumn("tree", _tree_number(F.pmod(F.xxhash64("row"), F.col("salts"))))

    def plant(key, pdf):
        m = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        out = pd.DataFrame(build_tree(int(key[0]), pdf["vec_id"].to_numpy(), pdf["row"].to_numpy(), m), columns=[f.split()[0] for f in PAGES.split(", ")])
        trim()
        return out

    pages = split.select("tree", "vec_id", "row", "v").groupBy("tree").applyInPandas(plant, PAGES)
    return Index(materialize(pages, "pages"), rows, roots)


FOUND = "query long, vec_id long, row long, score long"


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best of the index for each query: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    ``queries``: (vec_id, v), as from usable(), or rows of the index, which take no part in their own search. Each row is a query of its own, also when ids repeat. A query meets the vectors of its own dimension; one
    without any gives no rows; fewer than k vectors give all of them. Scores that a long can't hold are clipped and tie.
    """
    if "row" in queries.columns:
        q = queries.select("vec_id", "v", "dim", "root", F.col("row").alias("own"), F.col("row").alias("query"))
    else:
        q = _with_root(queries.select("vec_id", "v"), index.roots).withColumn("own", F.lit(None).cast("long"))
        q = materialize(q.withColumn("query", F.monotonically_increasing_id()), "queries")
    q = q.withColumn("tree", _tree_number(F.lit(0)))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    q = q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    names = [f.split()[0] for f in PAGES.split(", ")]

    def found(tree: Tree, rows) -> pd.DataFrame:
        got = [(n, i, r, s) for n, own, floor, v in rows for s, i, r in tree.search(v, k, own, floor)[0]]
        trim()
        return pd.DataFrame(got, columns=["query", "vec_id", "row", "score"])

    def at_home(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "vec_id": [], "row": [], "score": []})
        rows = [(n, None if pd.isna(o) else int(o), None, np.array(v, float)) for n, o, v in zip(left["query"], left["own"], left["v"])]
        return found(Tree(right[names].itertuples(index=False, name=None), len(rows[0][3])), rows)

    home = q.select("tree", "block", "query", "own", "v").groupBy("tree", "block")
    wanted = index.pages.join(q.select("tree", "block").distinct(), "tree")
    first = materialize(home.cogroup(_apart(wanted).groupBy("tree", "block")).applyInPandas(at_home, FOUND), "near")

    floors = first.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    packed = q.join(floors, "query", "left").select("dim", "block", "query", "own", "tree", "floor", "v")

    def pack(pdf):
        plain = lambda c, none: pdf[c].astype("Int64").fillna(none).to_numpy(np.int64).tobytes()
        m = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        return pd.DataFrame([(int(pdf["dim"].iloc[0]), int(pdf["block"].iloc[0]), plain("query", 0), plain("own", -1), plain("tree", 0), plain("floor", LEAST), m.tobytes())], columns=PACKED)

    packed = materialize(packed.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, query binary, own binary, home binary, floor binary, v binary"), "blocks")
    trees = index.pages.where("page = 0").select("tree", F.shiftright("tree", 40).cast("int").alias("dim"))

    def elsewhere(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "vec_id": [], "row": [], "score": []})
        r = left.iloc[0]
        n, own, home, floor = (np.frombuffer(r[c], np.int64) for c in ("query", "own", "home", "floor"))
        m = np.frombuffer(r["v"], np.float64).reshape(len(n), -1)
        rows = ((int(n[j]), int(own[j]), int(floor[j]), m[j]) for j in np.flatnonzero(home != r["tree"]).tolist())
        return found(Tree(right[names].itertuples(index=False, name=None), m.shape[1]), rows)

    meet = packed.join(trees, "dim")
    pages = index.pages.withColumn("dim", F.shiftright("tree", 40).cast("int")).join(packed.select("dim", "block"), "dim").drop("dim")
    rest = meet.groupBy("tree", "block").cogroup(_apart(pages).groupBy("tree", "block")).applyInPandas(elsewhere, FOUND)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    best = first.unionAll(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(q.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


PACKED = ["dim", "block", "query", "own", "home", "floor", "v"]


def op8_mtree(spark, sf_dir: str) -> DataFrame:
    index = build(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    return search(index, index.rows.where(F.col("vec_id") % 100 == 0))


SQL_OP8 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id, c.r AS r, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
