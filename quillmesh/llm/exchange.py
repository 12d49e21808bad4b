"""How often a key occurs in the whole corpus, told to every holder, without bringing a key's holders to one task.

Rows are held by origins (slices of a task). An origin sends each of its different keys once, with its own count, to the
key's block, which adds the counts up and answers with the totals; what belongs to the keys stays with the origin.
So a key that a third of all rows hold reaches its block once an origin.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, release, trim

SCHEMA = "block int, origin string, keys binary, counts binary, member binary"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(tuple(keys[:, w] for w in reversed(range(keys.shape[1]))))


def _starts(keys: np.ndarray) -> np.ndarray:
    """Whether each of the sorted rows differs from the one before."""
    return np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, bool)


class Share:
    """An origin's different keys (rows of uint64), dealt into blocks; ``number`` is each given row's place among them.

    With ``short``, 32 bits of a key are told apart within a block: of very few keys the total is then too high, the same
    for all of their holders.
    """

    def __init__(self, rows: np.ndarray, blocks: int, short: bool = False):
        order = _order(rows)
        new = _starts(rows[order])
        number = np.empty(len(rows), np.int64)
        number[order] = np.cumsum(new) - 1
        keys = rows[order][new]
        # least hashes are small numbers, so blocks aren't cut by the keys themselves
        mixed = (keys[:, 0] ^ (keys[:, 0] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        at = ((mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.number = back[number]
        self.keys, self._at = np.ascontiguousarray(keys[order]), at[order]
        self._sent = mixed.astype(np.uint32)[order] if short else self.keys
        self._counts = np.bincount(self.number, minlength=len(keys)).astype(np.int32)

    def batch(self, member: bytes) -> pa.RecordBatch:
        """The rows to send; ``member`` stays with the origin."""
        cut = np.flatnonzero(np.diff(self._at, prepend=-1))
        ends = np.append(cut[1:], len(self._at))
        col = lambda a: [None, *(a[b:e].tobytes() for b, e in zip(cut, ends))]
        columns = ([-1, *self._at[cut].tolist()], [uuid.uuid4().hex] * (len(cut) + 1), col(self._sent), col(self._counts), [member, *[None] * len(cut)])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), *[pa.binary()] * 3))], _NAMES)


def totals(dealt: DataFrame, words: int, home, schema: str, name: str) -> DataFrame:
    """home(member, the totals of the origin's keys in their order) for each origin: a written table of ``schema``.

    ``dealt`` as from Share.batch(), keys of ``words`` words, or short ones (0). It is written first, since origins are
    named at random.
    """
    dealt = materialize(dealt, name)

    def judge(pdf):
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64 if words else np.uint32).reshape(-1, max(1, words))
        counts = np.frombuffer(b"".join(pdf["counts"]), np.int32)
        order = _order(keys)
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(_starts(keys[order])) - 1
        total = np.minimum(np.bincount(group, counts), np.iinfo(np.int32).max).astype(np.int32)[group]
        end = np.cumsum([len(x) // 4 for x in pdf["counts"]])
        trim()
        return pd.DataFrame({"origin": pdf["origin"], "block": pdf["block"], "totals": [total[a:z].tobytes() for a, z in zip(np.append(0, end[:-1]), end)]})

    def back(pdf):
        own = pdf["block"] < 0
        member = pdf[own].iloc[0]["member"]
        out = home(member, np.frombuffer(b"".join(pdf[~own].sort_values("block")["totals"]), np.int32))
        trim()
        return out

    judged = dealt.where("block >= 0").select("block", "origin", "keys", "counts").groupBy("block").applyInPandas(judge, "origin string, block int, totals binary")
    both = dealt.where("block < 0").select("origin", "block", F.lit(None).cast("binary").alias("totals"), "member").unionAll(judged.select("origin", "block", "totals", F.lit(None).cast("binary").alias("member")))
    out = materialize(both.groupBy("origin").applyInPandas(back, schema), f"{name}-home")
    release(dealt)
    return out
