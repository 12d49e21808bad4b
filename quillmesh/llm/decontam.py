"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: every task turns its documents into segments of at most ``SEGMENT_WORDS`` words
(a longer document is a segment of its own) and writes, for each term of a segment, the sorted places at which it
stands. A frequent term is thus spread over all segments, and no posting list is longer than a segment.

A phrase is looked up in a segment by intersecting the lists of its terms, each shifted by the term's offset in the
phrase, from the rarest term of that segment on; one gap place between documents keeps matches within a document.
A phrase with a term that the segment lacks ends at once. ``proximity_matches`` widens the intersection to a window.

The test phrases reach the tasks in blocks of at most ``BLOCK_WORDS`` words, whatever the size of the benchmark.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import alnum_words, materialize, need, slices

SEGMENT_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000
WINDOW = 13

INDEX = "segment string, n_docs long, doc_ids array<long>, lengths array<int>, terms binary, counts binary, places binary"


def _segment(ids: list, words: list[list[bytes]]) -> tuple:
    lengths = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(words) else lengths
    flat = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(int(lengths.sum()))
    codes = flat.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")  # radix sort; places stay ascending within a term
    counts = np.bincount(codes, minlength=len(flat.dictionary)).astype(np.int32)
    terms = b"\0".join(flat.dictionary.to_pylist())
    sorted_places = place[order].astype(np.int32)
    steps = np.diff(sorted_places, prepend=np.int32(0))
    pack = lambda a: zlib.compress(a.tobytes(), 1)
    return uuid.uuid4().hex, len(ids), ids, lengths.tolist(), pack(np.frombuffer(terms, np.uint8)), pack(counts), pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T))


class Segment:
    """A segment as read from the index."""

    def __init__(self, row: dict):
        self.ids, self.lengths = row["doc_ids"], np.array(row["lengths"], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        raw = zlib.decompress(row["terms"])
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.int32)
        self.end = np.cumsum(counts, dtype=np.int64)
        self.term = {t: i for i, t in enumerate(raw.split(b"\0"))} if len(counts) else {}
        steps = np.frombuffer(zlib.decompress(row["places"]), np.uint8).reshape(4, -1).T
        self.places = np.cumsum(np.ascontiguousarray(steps).view(np.int32).ravel(), dtype=np.int32)

    def postings(self, term: bytes) -> np.ndarray:
        i = self.term.get(term)
        return self.places[:0] if i is None else self.places[(self.end[i - 1] if i else 0) : self.end[i]]

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Places at which the phrase begins."""
        codes = [self.term.get(t) for t in terms]
        if None in codes:
            return self.places[:0]
        lists = sorted(((self.postings(t), k) for k, t in enumerate(terms)), key=lambda x: len(x[0]))
        starts = lists[0][0] - np.int32(lists[0][1])
        for p, k in lists[1:]:
            at = np.searchsorted(p, starts + np.int32(k))
            starts = starts[p[np.minimum(at, len(p) - 1)] == starts + np.int32(k)]
            if not len(starts):
                break
        return starts

    def near(self, terms: list[bytes], width: int) -> list[tuple[int, int]]:
        """(doc number, place within it) of each occurrence of the rarest term with all others in one window of ``width`` words around or beside it."""
        need_n = {t: terms.count(t) for t in terms}
        lists = sorted(((self.postings(t), t) for t in need_n), key=lambda x: len(x[0]))
        out = []
        for s in lists[0][0].tolist():
            doc = int(np.searchsorted(self.begin, s, "right")) - 1
            lo, hi = int(self.begin[doc]), int(self.begin[doc] + self.lengths[doc])
            for first in range(max(lo, s - width + 1), min(s, hi - 1) + 1):
                last = min(first + width, hi)
                if all(np.searchsorted(p, last) - np.searchsorted(p, first) >= need_n[t] for p, t in lists):
                    out.append((doc, s - lo))
                    break
        return out


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Writes the index of whole texts into the shared folder. Null and empty texts stand in it with no words."""

    def run(batches):
        ids: list = []
        words: list = []
        held = 0
        names = [f.split()[0] for f in INDEX.split(", ")]
        types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_segment(ids, words), types)], names)
        for b in slices(batches, 256):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = alnum_words(t)
                if ids and held + len(w) > segment_words:
                    yield row()
                    ids, words, held = [], [], 0
                ids.append(i)
                words.append(w)
                held += len(w)
        if ids:
            yield row()

    return materialize(need(docs, doc_id, text).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, INDEX), "postings")


def windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``width`` words; the whole as one if it has fewer, but not none."""
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int):
    """The benchmark in blocks of bounded size, one at a time: [(item_id as string, words)]."""
    block, held = [], 0
    for r in need(items, item_id, text).select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        w = alnum_words(r["t"])
        if w and r["i"] is not None:
            block.append((r["i"], w))
            held += len(w)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def _spans(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in np.unique(starts).tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + width)
        else:
            out.append([s, s + width])
    return [(a, b) for a, b in out]


MATCHES = "segment string, doc int, doc_id long, n_words long, item_id string, first array<int>, last array<int>"


def phrase_matches(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Exact matches of the items' windows: for each document and matching item the covered word spans [first, last).

    A document without matches has one row with a null item_id. Null items, and items without words, match nothing.
    """
    spark = index.sparkSession
    out = None
    for block in [*_blocks(items, item_id, text, block_words)] or [[]]:
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            by_window: dict[tuple, list[str]] = {}
            for i, words in held.value:
                for w in dict.fromkeys(windows(words, width)):
                    by_window.setdefault(w, []).append(i)
            for b in slices(batches, 1):
                row = b.to_pylist()[0]
                s = Segment(row)
                hits: dict[tuple[int, str], list] = {}
                for w, owners in by_window.items():
                    starts = s.phrase(w)
                    if len(starts):
                        docs = np.searchsorted(s.begin, starts, "right") - 1
                        for d in np.unique(docs).tolist():
                            spans = _spans(starts[docs == d] - s.begin[d], len(w))
                            for i in owners:
                                hits.setdefault((d, i), []).extend(spans)
                bare = set(range(len(s.ids))) - {d for d, _ in hits}
                rows = [(d, i, _merge(v)) for (d, i), v in hits.items()] + [(d, None, []) for d in bare]
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([row["segment"]] * len(rows), pa.string()), "doc": pa.array([r[0] for r in rows], pa.int32()),
                    "doc_id": pa.array([s.ids[r[0]] for r in rows], pa.int64()), "n_words": pa.array([int(s.lengths[r[0]]) for r in rows], pa.int64()),
                    "item_id": pa.array([r[1] for r in rows], pa.string()), "first": pa.array([[a for a, _ in r[2]] for r in rows], pa.list_(pa.int32())), "last": pa.array([[z for _, z in r[2]] for r in rows], pa.list_(pa.int32())),
                })

        part = index.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionAll(part)
    return out


def _merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def proximity_matches(index: DataFrame, items: DataFrame, slop: int = 5, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, place): where all of an item's words stand, in any order, within its length plus ``slop`` words."""
    spark = index.sparkSession
    out = None
    for block in [*_blocks(items, item_id, text, block_words)] or [[]]:
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for b in slices(batches, 1):
                s = Segment(b.to_pylist()[0])
                rows = [(s.ids[d], i, at) for i, w in held.value for d, at in s.near(w, len(w) + slop)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32()))], ["doc_id", "item_id", "place"])

        part = index.mapInArrow(run, "doc_id long, item_id string, place int")
        out = part if out is None else out.unionAll(part)
    return out


def judge(matches: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit (words within any match), n_items, items_sha256, contaminated (n_hit > 0 and 20 n_hit >= n_words).

    Documents are told apart by their place in the index, so repeated rows stay apart. The spans of a document are
    united by folding the sorted spans; a document holds at most one span for every word.
    """
    spans = F.flatten(F.collect_list(F.arrays_zip("first", "last")))
    g = matches.groupBy("segment", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.collect_set("item_id")).alias("items"), F.array_sort(spans).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    hit = F.aggregate(
        "spans", zero,
        lambda a, x: F.struct(F.greatest(a["end"], x["last"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["end"], x["first"]))).alias("hit")),
        lambda a: a["hit"].cast("long"),
    )
    g = g.withColumn("n_hit", hit)
    return g.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents' verdicts; see judge()."""
    return judge(phrase_matches(build_index(docs), items))


def op2_postings(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_OP2 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT a.doc_id, a.i, win.n, win.item_id FROM places a JOIN lens ON a.i + lens.n - 1 <= len(a.w)
  JOIN win ON win.n = lens.n AND win.s = array_to_string(a.w[a.i:a.i + lens.n - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
