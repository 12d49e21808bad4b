"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(theta_k - w.x). Grades here: 0 toxic, 1 poor, 2 good. The expected grade ranks documents and
the tail probability P(grade >= 2) selects them. Features are the presence of hashed words and word beginnings and of
bucketed shapes of the whole text (share of capitals, of words with trailing marks, of repeated words, ...), so no prefix decides.

The model is fitted in numpy on at most SAMPLE_ROWS rated documents, taken evenly by a hash; scoring is one pass
without a shuffle, with the weights (2^BITS floats) broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import need, slices

BITS = 18
SAMPLE_ROWS = 20_000
GRADES = 3
EPOCHS, BATCH, RATE, L2 = 16, 64, 0.05, 3e-3
KEEP = 0.5

_TRAIL = re.compile(r"[^\w\s]{2,}(?=\s|$)")


def grade(quality: str = "quality", toxic: str = "toxic"):
    """The rating of a row of labels as a grade; a null toxic counts as 0, a null quality gives no grade."""
    return F.when(F.coalesce(F.col(toxic), F.lit(0)) > 0, 0).when(F.col(quality) > 0, 2).when(F.col(quality).isNotNull(), 1)


class Features:
    """Hashed feature numbers of a text; words are looked up in a bounded cache."""

    def __init__(self, bits: int = BITS):
        self.mask, self.cache = (1 << bits) - 1, {}

    def number(self, feature: str) -> int:
        n = self.cache.get(feature)
        if n is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            n = self.cache[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) & self.mask
        return n

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        tally = Counter(words)
        lower = {w.lower().strip(".,;:!?\"'()[]&%$#*|") for w in tally}
        found = {self.number(w) for w in lower}
        found |= {self.number("\1" + p) for p in {w[:k] for w in lower for k in (4, 5) if len(w) >= k}}  # stems of inflected words
        n = max(1, len(words))
        marks = len(_TRAIL.findall(text)) if text else 0
        characters = Counter(text or "")
        letters = max(1, sum(c for x, c in characters.items() if x.isalpha()))
        caps = sum(c for x, c in characters.items() if x.isupper())
        once = sum(c == 1 for c in tally.values())
        bare = sum(c for w, c in tally.items() if not w[:1].isalnum() and not w[-1:].isalnum())
        size = sum(len(w) * c for w, c in tally.items()) / n
        for name, x in (("caps", caps / letters), ("marks", marks / n), ("bare", bare / n), ("distinct", len(tally) / n), ("once", once / n)):
            for k in range(int(min(1.0, x) * 10) + 1):  # thermometer code: a share also has the marks of all lower ones
                found.add(self.number(f"\0{name}{k}"))
        found.add(self.number(f"\0long{min(20, int(size))}"))
        found.add(self.number(f"\0log{len(words).bit_length()}"))
        if not words:
            found.add(self.number("\0empty"))
        return np.fromiter(found, np.int32, len(found))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """Cumulative-link regression: shared weights, thresholds kept in order by positive steps."""

    def __init__(self, bits: int = BITS, grades: int = GRADES):
        self.w = np.zeros(1 << bits)
        self.first, self.steps = -2.0, np.zeros(grades - 2)  # theta_0, log of the steps to the next

    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0], np.cumsum(np.exp(self.steps))])

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, at = np.concatenate(rows) if rows else np.zeros(0, int), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return np.bincount(at, self.w[flat], len(rows))

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the last grade."""
        return _sigmoid(s[:, None] - self.thresholds()[None])

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> "Ordinal":
        rng = np.random.default_rng(seed)
        seen, seen_t = np.full(len(self.w), 1e-8), np.full(1 + len(self.steps), 1e-8)
        weight = np.array([len(y) / max(1, (y == g).sum()) for g in range(len(self.steps) + 2)]) ** 0.25
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for b in range(0, len(y), BATCH):
                pick = order[b : b + BATCH]
                x, t = [rows[i] for i in pick], y[pick]
                s, theta = self.score(x), self.thresholds()
                upper = np.where(t < len(theta), _sigmoid(np.append(theta, 0)[np.minimum(t, len(theta))] - s), 1.0)
                lower = np.where(t > 0, _sigmoid(theta[np.maximum(t - 1, 0)] - s), 0.0)
                p = np.maximum(upper - lower, 1e-9)
                du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
                g = weight[t] / len(pick)
                gs = (du - dl) * g  # of the negative log likelihood by the score
                gt = np.zeros(len(theta))
                np.add.at(gt, np.minimum(t, len(theta) - 1), -np.where(t < len(theta), du, 0) * g)
                np.add.at(gt, np.maximum(t - 1, 0), np.where(t > 0, dl, 0) * g)
                gp = np.concatenate([[gt.sum()], [gt[k + 1 :].sum() * np.exp(self.steps[k]) for k in range(len(self.steps))]])
                flat = np.concatenate(x)
                at, inverse = np.unique(flat, return_inverse=True)
                gw = np.bincount(inverse, np.repeat(gs, [len(r) for r in x])) + L2 * self.w[at]
                seen[at] += gw**2
                self.w[at] -= RATE * gw / np.sqrt(seen[at])
                seen_t += gp**2
                step = RATE * gp / np.sqrt(seen_t)
                self.first -= step[0]
                self.steps -= step[1:]
        return self


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> Ordinal:
    """Fits on at most ``sample_rows`` rated documents. Ratings of absent documents, and those without a grade, are left out."""
    rated = need(labels, doc_id, "quality", "toxic").select(doc_id, grade().alias("grade")).where("grade IS NOT NULL")
    picked = rated.orderBy(F.xxhash64(doc_id), doc_id, "grade").limit(sample_rows)  # a top-k: no row more reaches one task
    rows = need(docs, doc_id, text).join(F.broadcast(picked), doc_id).select(doc_id, "grade", text)  # bounded by sample_rows

    def run(batches):
        number = Features()
        for b in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([number(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "grade", "x"])

    got = rows.select(F.col(doc_id).cast("long"), "grade", text).mapInArrow(run, "doc_id long, grade int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["grade"], bytes(r["x"])))
    return Ordinal().fit([np.frombuffer(r["x"], np.int32) for r in got], np.array([r["grade"] for r in got], int))


def score(docs: DataFrame, model: Ordinal, keep: float = KEEP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) for every row.

    Null and empty texts are scored by the features of an empty text and never kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.first, model.steps))

    def run(batches):
        m, number = Ordinal(1), Features()
        m.w, m.first, m.steps = sent.value
        for b in slices(batches, 512):
            texts = b.column(1).to_pylist()
            tails = m.tails(m.score([number(t) for t in texts]))
            words = np.array([bool(t and not t.isspace()) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array((tails[:, -1] >= keep) & words)], ["doc_id", "expected_grade", "tail_probability", "keep"])

    return need(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, keep boolean")


def select(docs: DataFrame, model: Ordinal, keep: float = KEEP, text: str = "text") -> DataFrame:
    """The kept rows, with the columns they came with; one pass, no join."""
    sent = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.first, model.steps))
    at = docs.columns.index(text)

    def run(batches):
        m, number = Ordinal(1), Features()
        m.w, m.first, m.steps = sent.value
        for b in slices(batches, 512):
            texts = b.column(at).to_pylist()
            tails = m.tails(m.score([number(t) for t in texts]))[:, -1]
            yield b.filter(pa.array([bool(t and not t.isspace() and p >= keep) for t, p in zip(texts, tails.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_ordinal(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
