"""Removal of repeated substrings by a distributed suffix sort that merges front-coded runs with loser trees.

A byte goes when a string of SPAN bytes over it also starts anywhere else. Any two equal strings of SPAN bytes hold the
same least K-byte hash (leftmost on ties) at the same place, so only suffixes at such anchors, one in about SPAN / 2
bytes, need sorting; anchors whose K bytes occur once in the corpus are left out after a first exchange of hashes.

The suffix at an anchor is cut at SPAN bytes and followed by the SPAN - K bytes before it, reversed. Every task sorts its
suffixes, collapses equal ones and sends, for each range of the order, one front-coded run (common prefix with the one
before, and the rest). A range merges its runs with a loser tree whose players remember their common prefix with the
last output, so no known prefix is compared again, and which yields the common prefixes of neighbours: they say which
contexts are repeated as a whole and how far the others match. One of each context that is still open, or that may be
the partner of one, goes into runs of a second order, with the two parts the other way round, straight out of the first
merge; its merge settles the rest but for what different partners trade left against right. That remainder is
settled by the windows themselves.

Ranges are cut by the whole key, and each run brings one suffix beyond either end of its range, so neighbours across
ranges are seen and no group of equal K bytes has to meet in one task. A context that a third of all rows hold reaches
its range once a run.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, need, parallelism, release, slices, trim
from quillmesh.llm.exchange import SCHEMA, Share, totals

SPAN, K = 400, 32
LEFT = SPAN - K
WINDOW = SPAN - K + 1
KEY = SPAN + LEFT
NONE = -(1 << 63)
BUFFER = 1_000_000
#: Different suffixes of a run over all its ranges: more when there are many ranges, so that each keeps several.
ORIGIN_ENTRIES, MOST_ORIGIN_ENTRIES = 25_000, 200_000
#: Suffixes of a range. Beyond PART_ENTRIES * MAX_PARTS (2e9 of them, over 0.3 TB of repeated text) ranges grow instead of their number.
PART_ENTRIES, MAX_PARTS = 40_000, 50_000
#: The residual lookup by anchor hash splits each hash in so many parts, since one may hold a third of all rows.
SALTS = 64
#: Most bytes of anchors, spans or heads that are broadcast, counted before as rows of the driver's hash table; beyond it both sides are shuffled.
BROADCAST_BYTES, ROW_BYTES = 1_000_000, 144
#: Bits, at most, of the map by which texts that nothing belongs to stay out of a shuffle: 16 MB in the driver.
MOST_BITS = 27
#: One up, so that a zero ends a suffix before any byte; no UTF-8 text has a byte 255.
_UP = bytes(min(255, b + 1) for b in range(256))


def _kmers(buffer: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes at each place of a buffer that ends with K spare bytes."""
    n = len(buffer) - K
    words = [np.ndarray((n,), "<u8", buffer.data, 8 * i, (1,)) for i in range(K // 8)]
    h = np.zeros(n, np.uint64)
    for w in words:
        h ^= w
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the anchors of all windows of SPAN bytes within the texts."""
    out: list = [[], [], []]
    group: list[int] = []
    size = 0

    def flush():
        raw = np.frombuffer(b"".join(texts[i] for i in group) + bytes(K), np.uint8)
        h = _kmers(raw)
        n = len(h)
        lengths = np.array([len(texts[i]) for i in group])
        begin = np.concatenate([[0], np.cumsum(lengths)])
        rows = -(-n // WINDOW) + 1
        key = np.full(rows * WINDOW, np.iinfo(np.uint64).max, np.uint64)
        bits = np.uint64((1 << 30) - 1)
        key[:n] = (h & ~bits) | np.arange(n, dtype=np.uint64)  # a buffer is shorter than 2^30
        grid = key.reshape(rows, WINDOW)
        forth = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = np.maximum(0, lengths - SPAN + 1)
        starts = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(int(count.sum()))
        least = np.minimum(back[starts], forth[starts + WINDOW - 1]) & bits
        at = np.unique(least[np.flatnonzero(np.diff(least, prepend=bits + np.uint64(1)))]).astype(np.int64)
        which = np.searchsorted(begin, at, "right") - 1
        out[0].append(np.array(group)[which])
        out[1].append(at - begin[which])
        out[2].append(h[at])
        group.clear()

    for i, t in enumerate(texts):
        if len(t) >= SPAN:
            group.append(i)
            size += len(t)
            if size >= BUFFER:
                flush()
                size = 0
    if group:
        flush()
    kinds = (np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column(2).to_pylist()]


def repeated_anchors(units: DataFrame, blocks: int) -> DataFrame:
    """(id, digest, places binary): the int32 places of the anchors whose K bytes occur at several places."""

    def deal(batches):
        for b in slices(batches, 2048):
            ids, digests, texts = _rows(b)
            which, place, h = anchors(texts)
            if not len(h):
                continue
            share = Share(h[:, None], blocks, short=True)
            begin = np.flatnonzero(np.diff(which, prepend=-1))
            docs = np.column_stack([ids[which[begin]], digests[which[begin]], np.diff(np.append(begin, len(which)))]).astype(np.int64)
            member = len(docs).to_bytes(8, "little") + docs.tobytes() + np.stack([share.number, place]).astype(np.int32).tobytes()
            yield share.batch(member)

    def home(member, found):
        n = int.from_bytes(member[:8], "little")
        docs = np.frombuffer(member, np.int64, 3 * n, 8).reshape(n, 3)
        number, place = np.frombuffer(member, np.int32, offset=8 + docs.nbytes).reshape(2, -1)
        keep = found[number] > 1
        end = np.cumsum(docs[:, 2])
        places = [place[a:z][keep[a:z]].tobytes() for a, z in zip(end - docs[:, 2], end)]
        out = pd.DataFrame({"id": docs[:, 0], "digest": docs[:, 1], "places": places})
        return out[[bool(p) for p in places]]

    return totals(units.mapInArrow(deal, SCHEMA), 0, home, "id long, digest long, places binary", "dealt")


def _merged(parts: DataFrame, column: str) -> DataFrame:
    """One row for each text; a set, since rows that repeat as a whole say the same again."""
    return parts.groupBy("id", "digest").agg(F.collect_set(column).alias(column))


def _small(rows: DataFrame, size: int) -> DataFrame:
    """A side of a join: broadcast if its counted bytes allow, else never, whatever Spark takes its size for."""
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows.hint("shuffle_hash")


def _marked(units: DataFrame, other: DataFrame, n: int) -> DataFrame:
    """Adds ``in_``: whether a text may be one of the ``n`` of ``other``, by a map of bits; never false for one that is."""
    size = min(MOST_BITS, max(15, (16 * n).bit_length()))
    at = lambda d: F.pmod(F.xxhash64(d), F.lit(1 << size))
    bits = other.select(at("digest").alias("p")).groupBy(F.shiftright("p", 15).alias("b_")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits_"))
    some = units.withColumn("p_", at("digest")).withColumn("b_", F.shiftright("p_", 15)).join(F.broadcast(bits), "b_", "left")
    byte = F.expr("cast(conv(hex(substring(bits_, cast((p_ & 32767) div 8 as int) + 1, 1)), 16, 10) as int)")
    return some.withColumn("in_", F.coalesce(F.expr("shiftleft(1, cast(p_ & 7 as int))").bitwiseAND(byte) != 0, F.lit(False))).drop("p_", "b_", "bits_")


def _with_texts(units: DataFrame, other: DataFrame, column: str, how: str) -> DataFrame:
    """Texts with what belongs to them; ``other`` is broadcast if its counted bytes allow, else both are shuffled, of the texts only those in question."""
    n, size = other.agg(F.count("*"), F.sum(F.lit(ROW_BYTES) + F.aggregate(F.transform(column, lambda x: F.octet_length(x)), F.lit(0), lambda a, x: a + x))).first()
    if (size or 0) <= BROADCAST_BYTES:
        return units.join(F.broadcast(other), ["id", "digest"], how).select("id", "digest", "text", column)
    units = _marked(units, other, n)
    out = units.where("in_").join(_small(other, size), ["id", "digest"], how).select("id", "digest", "text", column)
    return out if how == "inner" else out.unionAll(units.where("NOT in_").select("id", "digest", "text", F.lit(None).cast(other.schema[column].dataType).alias(column)))


def _of_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows whose ``head`` is one of ``heads``; where these are shuffled, each is dealt in SALTS parts, since one may hold a third of all rows."""
    size = ROW_BYTES * heads.count()
    if size > BROADCAST_BYTES:
        heads = heads.select("head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "digest", "at"), F.lit(SALTS)).cast("int"))
    return rows.join(_small(heads, size), heads.columns, "left_semi")


def _contexts(text: bytes, places: list[int]):
    """(place, right part, left part reversed) of anchors, ready to sort."""
    up = text.translate(_UP)
    back, n = up[::-1], len(up)
    for p in places:
        yield p, up[p : p + SPAN], back[n - p : n - p + LEFT]


def _key(one: bytes, first: int, two: bytes, second: int) -> bytes:
    return one.ljust(first, b"\0") + two.ljust(second, b"\0")


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix of two keys, known to be at least ``start``."""
    n = min(len(a), len(b))
    step = 16
    while start < n:
        if a[start : start + step] == b[start : start + step]:
            start += step
            step *= 2
        elif step == 1:
            return start
        else:
            n, step = min(n, start + step), max(1, step // 4)
    return n


class LoserTree:
    """Merges sorted runs. A player is (its common prefix with the last output, key, item); ties go to the earlier run."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(1, (len(runs) - 1).bit_length())
        self.heads: list = [next(r, None) for r in self.runs] + [None] * (self.size - len(runs))
        self.known = [0] * self.size  # common prefix of each head with what it lost to, or with the last output
        self.losers = [-1] * self.size
        self.winner = self._start(1)

    def _start(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._start(2 * node), self._start(2 * node + 1)
        win, lose = self._play(a, b)
        self.losers[node] = lose
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Both know their prefix with the same earlier key: the longer one wins unseen; equal ones are compared from there on."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        ka, kb = self.known[a], self.known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        c = common(x[0], y[0], ka)
        first = c >= len(x[0]) or c < len(y[0]) and x[0][c] < y[0][c]
        if c >= len(x[0]) and c >= len(y[0]):
            first = a < b
        win, lose = (a, b) if first else (b, a)
        self.known[lose] = c
        return win, lose

    def __iter__(self):
        """(common prefix with the one before, key, item)."""
        while (head := self.heads[self.winner]) is not None:
            w = self.winner
            yield self.known[w], head[0], head[1]
            after = next(self.runs[w], None)
            self.heads[w] = after
            if after is not None:
                self.known[w] = after[2]  # the run's own front coding
            node, cur = (w + self.size) // 2, w
            while node:
                cur, self.losers[node] = self._play(cur, self.losers[node])
                node //= 2
            self.winner = cur


#: What a run says of a suffix: where it stands, the lengths of its parts, SEVERAL | BORDER | WANT, and its match to the right.
ENTRY = np.dtype([("id", "<i8"), ("digest", "<i8"), ("place", "<i4"), ("right", "<u2"), ("left", "<u2"), ("flags", "<u2"), ("r1", "<u2"), ("l1", "<u2")])
ID, DIGEST, PLACE, RIGHT, LEFT_, FLAGS, R1, L1 = range(8)
SEVERAL, BORDER, WANT = 1, 2, 4
RUNS = "part int, payload binary, info binary"


def _coded(keys: list[bytes], items: list[tuple], splitters: list[bytes]):
    """The sorted suffixes as front-coded runs (part, payload, info), one for each range, with the next suffix beyond either end."""
    cut = [0, *(bisect_left(keys, s) for s in splitters), len(keys)]
    info = np.array(items, ENTRY)
    press = zstandard.ZstdCompressor(level=3)
    for part in range(len(cut) - 1):
        a, z = max(0, cut[part] - 1), min(len(keys), cut[part + 1] + 1)
        if a >= z:
            continue
        lcps = [0, *(common(keys[k - 1], keys[k]) for k in range(a + 1, z))]
        rest = b"".join(keys[k][c:] for k, c in zip(range(a, z), lcps))
        own = info[a:z].copy()
        own["flags"][: cut[part] - a] |= BORDER
        own["flags"][cut[part + 1] - a :] |= BORDER
        yield part, press.compress(np.array(lcps, np.uint16).tobytes() + rest), own.tobytes()


def _read_run(payload: bytes, info: bytes):
    raw = zstandard.ZstdDecompressor().decompress(payload)
    items = np.frombuffer(info, ENTRY).tolist()
    at, key = 2 * len(items), b""
    for c, f in zip(np.frombuffer(raw, np.uint16, len(items)).tolist(), items):
        end = at + KEY - c
        key = key[:c] + raw[at:end]
        at = end
        yield key, f, c


def _runs(rows, splitters: list[bytes], spread: int, limit: int):
    """The runs of a task, each from about ``limit`` different suffixes; equal ones are collapsed.

    What a run holds several times is settled there: all its places go out at once, in packets of negative parts.
    """
    entries: dict[bytes, list] = {}
    whole: set[tuple] = set()

    def flush():
        keys = sorted(entries)
        if whole:
            got = np.array(sorted(whole), PLACES)
            yield -1 - zlib.crc32(got.tobytes()) % spread, got.tobytes(), None
        yield from _coded(keys, [tuple(entries[k]) for k in keys], splitters)
        entries.clear()
        whole.clear()

    for i, d, text, places in rows:
        for p, right, left in _contexts(text, places):
            key = _key(right, SPAN, left, LEFT)
            e = entries.get(key)
            if e is None:
                entries[key] = [i, d, p, len(right), len(left), 0, 0, 0]
            else:
                e[FLAGS] = SEVERAL
                whole.update(((e[ID], e[DIGEST], e[PLACE]), (i, d, p)))
        if len(entries) >= limit or len(whole) >= 8 * limit:
            yield from flush()
    if entries:
        yield from flush()


PLACES = np.dtype([("id", "<i8"), ("digest", "<i8"), ("place", "<i4")])


def merge_right(runs: list[tuple[bytes, bytes]]) -> tuple[list[tuple], list[tuple[bytes, tuple]]]:
    """Merges one range by (right, left): ((id, digest, start, end) stretches, or end -1 for a whole context; the suffixes for the other order).

    Equal suffixes are repeated as a whole. Of others, the neighbours give the longest match to the right, r1, and its
    match to the left, l1; [place - l1, place + r1) is all that is repeated if l1 can't be longer. Only one of each
    suffix goes on, and only where another shares its K bytes and one of those is still open.
    """
    stretches: list[tuple] = []
    on: list[tuple[bytes, tuple]] = []
    near: list[tuple[bytes, tuple]] = []  # of one group of equal K bytes
    open_ = border = False

    def match(c: int, key: bytes, f: tuple, other: bytes, g: tuple) -> tuple[int, int]:
        right, left = min(c, f[RIGHT], g[RIGHT]), min(f[LEFT_], g[LEFT_])
        if right + left < SPAN:
            return right, 0
        return right, min(left, c - SPAN if c >= SPAN else common(key[SPAN:], other[SPAN:]))

    def close(cur: list, after: tuple[int, int], c: int) -> None:
        nonlocal near, open_, border
        key, f, members, n, several, before = cur
        if not members:
            border = True
        else:
            f = members[0]
            if n > 1 or several:
                r1, l1, want = f[RIGHT], f[LEFT_], False
                stretches.extend((m[ID], m[DIGEST], m[PLACE], -1) for m in members if not m[FLAGS] & SEVERAL)
            else:
                r1, l1 = max(before, after)
                want = r1 + f[LEFT_] >= SPAN
                if want and r1 + l1 >= SPAN and l1 == f[LEFT_]:
                    want = False
                    stretches.append((f[ID], f[DIGEST], f[PLACE] - l1, f[PLACE] + r1))
            if r1 + f[LEFT_] >= SPAN:
                near.append((key, (*f[:FLAGS], WANT * want, r1, l1)))
                open_ |= want
        if c < K:
            if border or open_ and len(near) > 1:
                on.extend(near)
            near, open_, border = [], False, False

    cur = None
    for c, key, f in LoserTree([_read_run(*r) for r in runs]):
        if cur is not None and c == KEY:
            cur[3] += 1
        else:
            m = (0, 0)
            if cur is not None:
                m = match(c, key, f, cur[0], cur[1])
                close(cur, m, c)
            cur = [key, f, [], 1, 0, m]
        cur[4] |= f[FLAGS] & SEVERAL
        if not f[FLAGS] & BORDER:
            cur[2].append(f)
    if cur is not None:
        close(cur, (0, 0), 0)
    return stretches, on


def merge_left(runs: list[tuple[bytes, bytes]]) -> tuple[list[tuple], list[tuple]]:
    """Merges one range by (left, right): (stretches, windows (head, id, digest, first, last, open)).

    The neighbours give the longest match to the left, l2, and its match to the right, r2. If both matches have SPAN
    bytes, or one does and reaches as far both ways, exactly the bytes from l2 before the anchor to r1 after it are
    repeated there; if r1 + l2 < SPAN, none are. Where different partners trade left against right, it is open.
    """
    stretches: list[tuple] = []
    windows: list[tuple] = []

    def match(c: int, key: bytes, f: tuple, other: bytes, g: tuple) -> tuple[int, int]:
        left, right = min(c, f[LEFT_], g[LEFT_]), min(f[RIGHT], g[RIGHT])
        if left + right < SPAN:
            return left, 0
        return left, min(right, c - LEFT if c >= LEFT else common(key[LEFT:], other[LEFT:]))

    def close(key: bytes, f: tuple, best: tuple[int, int]) -> None:
        if f[FLAGS] & BORDER:
            return
        i, d, p, r1, l1 = f[ID], f[DIGEST], f[PLACE], f[R1], f[L1]
        l2, unsure = f[LEFT_], False
        if f[FLAGS] & WANT:
            l2, r2 = best
            q1, q2 = r1 + l1 >= SPAN, r2 + l2 >= SPAN
            if q1 and q2 or q1 and l1 == l2 or q2 and r1 == r2:
                stretches.append((i, d, p - l2, p + r1))
            else:
                unsure = r1 + l2 >= SPAN
                if q1:
                    stretches.append((i, d, p - l1, p + r1))
                elif q2:
                    stretches.append((i, d, p - l2, p + r2))
        if r1 + l2 >= SPAN:
            windows.append((xxhash.xxh3_64_intdigest(key[LEFT : LEFT + K]) - (1 << 63), i, d, p - l2, p + r1 - SPAN, unsure))

    cur = None
    for c, key, f in LoserTree([_read_run(*r) for r in runs]):
        m = (0, 0)
        if cur is not None:
            m = match(c, key, f, cur[0], cur[1])
            close(cur[0], cur[1], max(cur[2], m))
        cur = (key, f, m)
    if cur is not None:
        close(*cur)
    return stretches, windows


def _by_text(stretches: list[tuple]) -> dict[str, list]:
    """Columns (id, digest, spans): int32 pairs of each text."""
    by: dict[tuple, list] = {}
    for i, d, a, z in stretches:
        by.setdefault((i, d), []).append((a, z))
    return {"id": [i for i, _ in by], "digest": [d for _, d in by], "spans": [np.array(sorted(set(v)), np.int32).tobytes() for v in by.values()]}


def spans(units: DataFrame) -> DataFrame:
    """(id, digest, spans array<binary>): the repeated stretches as int32 pairs [start, end), not yet united; (place, -1) for a repeated context."""
    spark = units.sparkSession
    size = units.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(4 * parallelism(spark), size // 200_000_000))
    raw = repeated_anchors(units, blocks)
    found = materialize(_merged(raw, "places"), "places")
    release(raw)
    total = (found.agg(F.sum(F.aggregate("places", F.lit(0), lambda a, x: a + F.octet_length(x)))).first()[0] or 0) // 4
    parts = int(min(MAX_PARTS, max(parallelism(spark), total // PART_ENTRIES)))
    limit = int(min(MOST_ORIGIN_ENTRIES, max(ORIGIN_ENTRIES, 4 * parts)))
    texts = _with_texts(units, found, "places", "inner")

    def unpack(batches):
        for b in slices(batches, 64):
            ids, digests, raw = _rows(b)
            for i, d, t, ps in zip(ids.tolist(), digests.tolist(), raw, b.column(3).to_pylist()):
                yield i, d, t, np.frombuffer(b"".join(ps), np.int32).tolist()

    every = max(1, int(total // (8 * parts)))

    def choose(batches):
        for b in slices(batches, 4096):
            out = []
            for i, d, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = np.frombuffer(b"".join(ps), np.int32)
                at = at[[(i * 2654435761 + p * 40503) % 1000003 % every == 0 for p in at.tolist()]]
                if len(at):
                    out.append((i, d, [at.tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.binary())))], ["id", "digest", "places"])

    def sample(batches):
        for b in slices(batches, 64):
            got = [(_key(r, SPAN, le, LEFT), _key(le, LEFT, r, SPAN)) for _, _, t, ps in unpack([b]) for _, r, le in _contexts(t, ps)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.binary()) for k in (0, 1)], ["a", "b"])

    chosen = materialize(found.mapInArrow(choose, found.schema), "chosen")  # about 8 for each range
    keys = _with_texts(units, chosen, "places", "inner").mapInArrow(sample, "a binary, b binary").collect()
    release(chosen)
    cuts = [sorted(bytes(r[s]) for r in keys) for s in (0, 1)]
    cuts = [sorted({c[k * len(c) // parts] for k in range(1, parts)}) if c else [] for c in cuts]
    sent = spark.sparkContext.broadcast(cuts)

    def run(batches):
        held = []
        for row in _runs(unpack(batches), sent.value[0], parts, limit):
            held.append(row)
            if len(held) >= 64:
                yield _packets(held)
                held = []
        if held:
            yield _packets(held)

    def first(pdf):
        if pdf["part"].iloc[0] < 0:
            places = np.unique(np.concatenate([np.frombuffer(x, PLACES) for x in pdf["payload"]]))
            out = pd.DataFrame({**_by_text([(i, d, p, -1) for i, d, p in places.tolist()]), "part": -1, "payload": None, "info": None})
        else:
            stretches, on = merge_right(list(zip(pdf["payload"], pdf["info"])))
            out = pd.DataFrame({**_by_text(stretches), "part": -1, "payload": None, "info": None})
            turned = sorted(((k[SPAN:] + k[:SPAN], f) for k, f in on), key=lambda x: x[0])
            if turned:
                more = pd.DataFrame(list(_coded([k for k, _ in turned], [f for _, f in turned], sent.value[1])), columns=["part", "payload", "info"])
                out = pd.concat([out, more.assign(id=0, digest=0, spans=None)])
        trim()
        return out[FIRST]

    def second(pdf):
        stretches, windows = merge_left(list(zip(pdf["payload"], pdf["info"])))
        by = _by_text(stretches)
        n, m = len(by["id"]), len(windows)
        w = list(zip(*windows)) if m else [()] * 6
        trim()
        return pd.DataFrame({
            "id": [*by["id"], *w[1]], "digest": [*by["digest"], *w[2]], "spans": [*by["spans"], *[None] * m], "head": pd.array([*[None] * n, *w[0]], "Int64"),
            "first": [*[0] * n, *w[3]], "last": [*[0] * n, *w[4]], "unsure": [*[False] * n, *w[5]],
        })

    one = materialize(texts.mapInArrow(run, RUNS).groupBy("part").applyInPandas(first, "id long, digest long, spans binary, part int, payload binary, info binary"), "merged")
    two = one.where("part >= 0").select("part", "payload", "info").groupBy("part").applyInPandas(second, "id long, digest long, spans binary, head long, first int, last int, unsure boolean")
    two = materialize(two, "settled")
    release(found)
    out = one.where("part < 0").select("id", "digest", "spans").unionAll(two.where("spans IS NOT NULL").select("id", "digest", "spans"))
    if not two.where("unsure").isEmpty():
        out = out.unionAll(_windows(units, two.where("head IS NOT NULL"), blocks))
    return _merged(out, "spans")


FIRST = ["id", "digest", "spans", "part", "payload", "info"]


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "payload", "info"])


def _union(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Overlapping and touching stretches as one: int32 pairs [start, end), ascending."""
    keep = z > a
    a, z = a[keep], z[keep]
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order]) if len(order) else z
    new = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]])) if len(a) else np.zeros(0, int)
    return np.column_stack([a[new], np.append(z[new[1:] - 1], z[-1:]) if len(a) else z]).astype(np.int32)


def _windows(units: DataFrame, settled: DataFrame, blocks: int) -> DataFrame:
    """Stretches (id, digest, spans) of the repeated windows among those that the merges leave open.

    A window is repeated only within [first, last] of its anchor, and so is its partner within that of its own anchor,
    whose K bytes are the same. Windows are known by 128-bit digests, and exchanged as the anchors are.
    """
    open_ = materialize(settled.where("unsure").select("head").distinct(), "heads")
    rows = settled.select("head", "id", "digest", F.concat(*(F.lpad(F.hex(c), 8, "0") for c in ("first", "last", F.col("unsure").cast("int")))).alias("at"))
    wanted = materialize(_merged(_of_heads(rows.withColumn("at", F.unhex("at")), open_), "at"), "open")
    texts = _with_texts(units, wanted, "at", "inner")

    def deal(batches):
        for b in slices(batches, 512):
            ids, digests, raw = _rows(b)
            digest, who, where, own = [], [], [], []
            for k, (t, at) in enumerate(zip(raw, b.column(3).to_pylist())):
                starts: dict[int, bool] = {}
                for first, last, is_open in np.frombuffer(b"".join(at), ">i4").reshape(-1, 3).tolist():
                    for s in range(max(0, first), min(len(t) - SPAN, last) + 1):
                        starts[s] = starts.get(s, False) or bool(is_open)
                digest += [xxhash.xxh3_128_digest(t[s : s + SPAN]) for s in starts]
                who += [k] * len(starts)
                where += starts
                own += starts.values()
            if not digest:
                continue
            share = Share(np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2), blocks)
            keep = np.array(own, bool)
            who = np.array(who, np.int64)[keep]
            member = np.column_stack([ids[who], digests[who], np.array(where, np.int64)[keep], share.number[keep]]).astype(np.int64)
            yield share.batch(member.tobytes())

    def home(member, found):
        i, d, a, number = np.frombuffer(member, np.int64).reshape(-1, 4).T
        keep = found[number] > 1
        i, d, a = i[keep], d[keep], a[keep]
        order = np.lexsort((a, d, i))
        i, d, a = i[order], d[order], a[order]
        begin = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1])])) if len(i) else np.zeros(0, int)
        end = np.append(begin[1:], len(i))
        return pd.DataFrame({"id": i[begin], "digest": d[begin], "spans": [_union(a[x:z], a[x:z] + SPAN).tobytes() for x, z in zip(begin, end)]})

    return totals(texts.mapInArrow(deal, SCHEMA), 2, home, "id long, digest long, spans binary", "windows")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row, and the kept text with ``keep_text``.

    Spans end at bytes: what is left of a character that a span cuts is replaced in the kept text, not in its hash.

    Null texts are empty. Equal rows count as occurrences of each other. Texts shorter than SPAN bytes lose nothing.
    """
    units = need(docs, doc_id, text).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NONE)).alias("id"), F.xxhash64(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = materialize(spans(units.where(F.octet_length("text") >= SPAN)), "spans")
    rows = _with_texts(units, found, "spans", "left")

    def run(batches):
        for b in slices(batches, 256):
            ids, _, texts = _rows(b)
            out = []
            for i, t, s in zip(ids.tolist(), texts, b.column(3).to_pylist()):
                pairs = np.frombuffer(b"".join(s or []), np.int32).reshape(-1, 2).astype(np.int64)
                whole = pairs[:, 1] < 0  # an anchor whose context is repeated: as far as keys reach, if that is a window
                a = np.where(whole, np.maximum(0, pairs[:, 0] - LEFT), pairs[:, 0])
                z = np.where(whole, np.minimum(len(t), pairs[:, 0] + SPAN), pairs[:, 1])
                joined = _union(a, np.where(z - a >= SPAN, z, a)).tolist()
                kept, at = [], 0
                for a, z in joined:
                    kept.append(t[at:a])
                    at = z
                rest = b"".join(kept) + t[at:]
                out.append((None if i == NONE else i, len(t), len(t) - len(rest), len(joined), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    got = rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return got if keep_text else got.drop("kept_text")


def op6_loser_trees(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=True)
