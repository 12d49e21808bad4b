"""Best-fit packing of documents into sequences of bounded length by bin completion.

Lengths are whole numbers up to the capacity, so the packing problem is its histogram, of a size that doesn't grow with
the input. The driver solves it over counts and gets patterns (lengths of one sequence, how often it is made); pieces
get their places by their rank among the pieces of their length, so no group of equal lengths meets in one task.

The solver: best-fit decreasing gives the first incumbent. Bin completion then takes the largest length left,
enumerates all undominated fillings of the rest of its sequence, least waste first, one at a time, and branches on each
and on how often it is made: as often as counts allow, half of that, down to once. A branch ends when its sequences plus
the bound on what is left reach the incumbent, or where the same lengths were left before after as few sequences. The
search stops at a proven optimum, which a tree searched to its end is too, after ``NODES`` nodes, or after ``STEPS``
steps of the search for fillings, with the best solution so far, which always holds every piece.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.llm.common import materialize, need, slices

CAPACITY = 1024
END_ID = 2
BUCKETS = 64
NODES = 20_000
STEPS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"


class Encoder:
    """The ids of the public byte-level BPE vocabulary.

    Both files hold one vocabulary and give the same ids; the rank file is read by the faster library. Texts that hold a
    special token's string, and texts so long that the regular expression could run deep, go to the JSON file's library.
    """

    def __init__(self):
        import public_tokenizers as P
        import tiktoken

        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.full = P.path("byte_bpe_50k.json"), None

    def __call__(self, text: str) -> list[int]:
        if len(text) < 400_000 and "<|endoftext|>" not in text:
            return self.fast.encode_ordinary(text)
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return self.full.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole if it fits, else full pieces after a first piece that takes the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises whole texts (null: empty), adds ``end_id`` and cuts what is longer than a sequence."""

    def run(batches):
        encode = Encoder()
        turn = (TaskContext.get().partitionId() * 17) if TaskContext.get() else 0
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in slices(batches, 256):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array(encode(t or "") + [end_id], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), turn % BUCKETS))
                    turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return need(docs, doc_id, text).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit over groups of equal sequences: each length goes, from the longest on, into the fullest that still takes it."""
    groups: list[tuple[int, tuple[int, ...], int]] = []  # (room, pattern, times), by room
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(groups, (length,))
            if at == len(groups):
                per = capacity // length
                if left >= per:
                    insort(groups, (capacity - per * length, (length,) * per, left // per))
                if left % per:
                    insort(groups, (capacity - left % per * length, (length,) * (left % per), 1))
                break
            room, pattern, times = groups.pop(at)
            per = room // length
            used = min(times, left // per)
            if used:
                insort(groups, (room - per * length, pattern + (length,) * per, used))
            elif left:
                insort(groups, (room - left * length, pattern + (length,) * left, 1))
                used, left = 1, 0
            if times > used:
                insort(groups, (room, pattern, times - used))
            left -= used * per if left else 0
    return [(p, t) for _, p, t in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of total/capacity and, over thresholds t, lengths above capacity - t alone plus what the rest needs."""
    total = sum(k * c for k, c in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for t in [0] + [s for s in sizes if s <= capacity // 2]:
        large = sum(c for k, c in counts.items() if k > capacity - t)
        middle = sum(c for k, c in counts.items() if capacity // 2 < k <= capacity - t)
        room = sum(c * (capacity - k) for k, c in counts.items() if capacity // 2 < k <= capacity - t)
        small = sum(k * c for k, c in counts.items() if t <= k <= capacity // 2)
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def fillings(sizes: list[int], counts: dict[int, int], room: int, waste: int, after: tuple | None = None) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """(left, pieces) of the undominated fillings of ``room`` that waste at most ``waste``, least waste and fewest pieces first.

    A filling is dominated when a longer piece, or one piece for two of its pieces, fits in place of what it has. Each
    step of the search that gives none is a None. With ``after``, one of the fillings, only those that follow it come.
    """
    sizes_in = sizes[: bisect_right(sizes, room)]
    reach = [1]  # sums of at most room that sizes[:i] can make, as bits
    for s in sizes_in:
        sums, n, step = reach[-1], min(counts[s], room // s), 1
        while n:
            sums |= sums << min(step, n) * s & (1 << room + 1) - 1
            n, step = n - min(step, n), 2 * step
        reach.append(sums)

    def exact(left: int, chosen: tuple[int, ...], upto: int, total: int, pieces: int, behind: tuple[int, ...] | None):
        """Adds ``pieces`` from sizes[:upto] of exactly this total to the chosen, those after ``behind``; as deep as lengths differ."""
        if not pieces:
            if not total and behind is None:
                yield None if _dominated(chosen, left, sizes, counts) else (left, chosen)
            return
        yield None
        for at in range(bisect_left(sizes, behind[0] if behind else -(-total // pieces)), min(upto, bisect_right(sizes, total))):
            s = sizes[at]
            free = at + 1
            while free < len(sizes) and sizes[free] <= s + left and counts[sizes[free]] <= chosen.count(sizes[free]):
                free += 1
            if free == len(sizes) or sizes[free] > s + left:  # else it fits in place of s
                for n in range(behind.count(s) if behind else 1, min(counts[s], total // s, pieces) + 1):
                    if reach[at] >> total - n * s & 1:
                        yield from exact(left, chosen + (s,) * n, at, total - n * s, pieces - n, behind[n:] if behind else None)
                    behind = None
            behind = None

    for left in range(after[0] if after else 0, min(waste, room) + 1):
        total = room - left
        if reach[-1] >> total & 1:
            behind = after[1] if after and left == after[0] else None
            for pieces in range(len(behind) if behind is not None else 0, total // sizes_in[0] + 1 if sizes_in else 1):
                if pieces * sizes_in[-1] >= total if pieces else not total:
                    yield from exact(left, (), len(sizes_in), total, pieces, behind)
                behind = None


def _dominated(chosen: tuple[int, ...], left: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Whether a longer piece, or one piece for two of its pieces, fits in place of what the filling has."""

    def free(lo: int, hi: int) -> bool:
        i = bisect_left(sizes, lo)
        return i < len(sizes) and sizes[i] <= hi and counts[sizes[i]] > chosen.count(sizes[i])

    if left and any(free(s + 1, s + left) for s in set(chosen)):
        return True
    return any(free(a + b, a + b + left) for i, a in enumerate(chosen[:4]) for b in chosen[i + 1 : 5])


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(patterns with times, lower bound); the bound is met where the search proved the optimum."""
    counts = {k: c for k, c in counts.items() if c}
    full = counts.pop(capacity, 0)
    best = best_fit_decreasing(counts, capacity)
    bound = lower_bound(counts, capacity)
    bins = sum(t for _, t in best)
    state = dict(counts)
    sizes = sorted(state)
    mass = sum(k * c for k, c in state.items())
    trail: list[list] = []  # [filling last tried, how often it may still be made, the (pattern, times) made]
    seen: dict[bytes, int] = {}  # what was left, by digest: fewest sequences it was reached with
    used = 0

    def advance(node: list) -> None:
        """The node's next undominated filling, if any fits the waste bound and the steps left, with its times."""
        nonlocal steps
        waste = (bins - 1 - used) * capacity - mass
        if waste < 0:
            return
        largest = sizes[-1]
        state[largest] -= 1
        rest = sizes if state[largest] else sizes[:-1]
        found = None
        for found in fillings(rest, state, capacity - largest, waste, node[0]):
            steps -= 1
            if found or steps <= 0:
                break
        state[largest] += 1
        if found:
            node[0] = found
            times = min(state[s] // n for s, n in Counter((largest, *found[1])).items())
            times = min(times, waste // found[0]) if found[0] else times
            while times:  # once is among them, so every number of repeats can be made
                node[1].append(times)
                times //= 2

    while bins > bound and nodes > 0 and steps > 0:
        if sizes:
            key = hashlib.blake2b(np.fromiter(state.values(), np.int64, len(state)).tobytes(), digest_size=16).digest()
            if used < seen.get(key, bins):
                seen[key] = used
                trail.append([None, [], None])
        elif used < bins:
            bins, best = used, [made for *_, made in trail]
            if bins <= bound:
                break
        while trail:  # undo the last choice, and those before it that have no other filling
            node = trail[-1]
            if made := node[2]:
                _take(state, sizes, made, -1)
                used, mass = used - made[1], mass + sum(made[0]) * made[1]
                node[2] = None
            if not node[1]:
                advance(node)
            if node[1] or steps <= 0:
                break
            trail.pop()
        if steps <= 0:
            break
        if not trail:  # the whole tree is searched
            bound = bins
            break
        nodes -= 1
        made = ((sizes[-1], *node[0][1]), node[1].pop(0))
        _take(state, sizes, made, 1)
        used, mass = used + made[1], mass - sum(made[0]) * made[1]
        node[2] = made
    return ([((capacity,), full)] if full else []) + best, bound + full


def _take(state: dict[int, int], sizes: list[int], made: tuple, sign: int) -> None:
    pattern, times = made
    for s, n in Counter(pattern).items():
        before = state[s]
        state[s] = before - sign * n * times
        if state[s] == 0:
            sizes.pop(bisect_left(sizes, s))
        elif before == 0:
            insort(sizes, s)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null and empty texts are a piece of one id. Repeated rows are packed each. An empty table gives no rows.
    """
    held = materialize(pieces(docs, capacity, end_id, doc_id, text), "pieces")
    hist = held.groupBy("bucket", "length").count().collect()  # at most BUCKETS * capacity rows
    counts: Counter = Counter()
    base = np.zeros((BUCKETS, capacity + 1), np.int64)
    for b, n, c in sorted((r["bucket"], r["length"], r["count"]) for r in hist):
        base[b, n] = counts[n]
        counts[n] += c
    patterns, _ = bin_completion(dict(counts), capacity)
    slots: dict[int, list] = {}
    taken: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        places: dict[int, list[int]] = {}
        at = 0
        for s in pattern:
            places.setdefault(s, []).append(at)
            at += s
        for s, offsets in places.items():
            slots.setdefault(s, []).append((taken[s], len(offsets), sequence, offsets))
            taken[s] += times * len(offsets)
        sequence += times
    table = {s: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v]), [np.array(x[3]) for x in v]) for s, v in slots.items()}
    sent = docs.sparkSession.sparkContext.broadcast((base, table))  # as bounded as the histogram
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)

    def place(batches):
        base, table = sent.value
        for b in batches:
            length, bucket, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "bucket", "rank"))
            rank = rank + base[bucket, length]
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length).tolist():
                first, per, start, offsets = table[s]
                rows = np.flatnonzero(length == s)
                at = np.searchsorted(first, rank[rows], "right") - 1
                k = rank[rows] - first[at]
                seq[rows] = start[at] + k // per[at]
                off[rows] = [offsets[a][r] for a, r in zip(at.tolist(), (k % per[at]).tolist())]
            keep = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_bin_completion(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
