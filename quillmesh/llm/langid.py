"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the lower-cased UTF-8 bytes of a text both ways, labels every position with a distribution over the
learned languages, and a document's distribution is the mean over all its positions. Texts are read whole, as windows of
SPAN bytes that fill batches across documents. Training is backpropagation through time with Adam on the driver, on at
most SAMPLE_DOCS documents (drawn per language by a hash, so rare languages are learned) with WINDOWS windows of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import need, slices

HIDDEN = 10
SPAN = 128
SAMPLE_DOCS = 4000
WINDOWS, WINDOW = 3, 48
STEPS, BATCH, RATE = 350, 192, 0.015
PAD = 256


class BiGRU:
    """Both directions side by side: the first axis of every parameter is the direction."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        r = np.random.default_rng(seed)
        h, k = hidden, len(labels)
        self.labels, self.hidden = labels, h
        self.p = {
            "x": r.normal(0, 0.3, (2, PAD + 1, 3 * h)), "u": r.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)), "c": np.zeros((2, 1, 3 * h)),
            "v": r.normal(0, 0.3, (2 * h, k)), "b": np.zeros(k),
        }
        self.p = {n: a.astype(np.float32) for n, a in self.p.items()}

    def states(self, codes: np.ndarray, keep: bool = False):
        """Hidden states (time, batch, 2 hidden) of byte codes (time, batch); with ``keep`` also what backward() needs."""
        t, n = codes.shape
        h, p = self.hidden, self.p
        both = np.stack([codes, codes[::-1]])  # the second direction reads from the end
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((t, 2, n, h), np.float32)
        kept = []
        for i in range(t):
            a = np.stack([p["x"][0][both[0, i]], p["x"][1][both[1, i]]])
            s = np.matmul(state, p["u"])
            s += p["c"]
            g = a[..., : 2 * h] + s[..., : 2 * h]
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5  # the logistic function of update and reset
            m = g[..., h:] * s[..., 2 * h :]
            m += a[..., 2 * h :]
            np.tanh(m, out=m)
            new = state - m
            new *= g[..., :h]
            new += m
            if keep:
                kept.append((state, g, s[..., 2 * h :], m))
            out[i] = state = new
        joined = np.concatenate([out[:, 0], out[::-1, 1]], -1)
        return (joined, out, both, kept) if keep else joined

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        z = states @ self.p["v"] + self.p["b"]
        z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(-1, keepdims=True)
        return z

    def loss(self, codes: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions that aren't padding, and its gradients."""
        t, n = codes.shape
        h, p = self.hidden, self.p
        joined, _, both, kept = self.states(codes, keep=True)
        q = self.probabilities(joined)
        real = (codes != PAD)[..., None]
        count = max(1, int(real.sum()))
        value = -float((np.log(np.maximum(q[:, np.arange(n), y], 1e-9)) * real[..., 0]).sum() / count)
        dz = q.copy()
        dz[:, np.arange(n), y] -= 1
        dz *= real / np.float32(count)
        grad = {k: np.zeros_like(a) for k, a in p.items()}
        grad["v"] = joined.reshape(-1, 2 * h).T @ dz.reshape(-1, dz.shape[-1])
        grad["b"] = dz.sum((0, 1))
        dj = dz @ p["v"].T
        dh = np.stack([dj[..., :h], dj[::-1, :, h:]], 1)  # (time, direction, batch, hidden), each in its own reading order
        carry = np.zeros((2, n, h), np.float32)
        da_all = np.empty((t, 2, n, 3 * h), np.float32)
        for i in range(t - 1, -1, -1):
            state, g, sn, m = kept[i]
            z, r = g[..., :h], g[..., h:]
            d = dh[i] + carry
            dm = d * (1 - z) * (1 - m * m)
            da = da_all[i]
            da[..., :h] = d * (state - m) * z * (1 - z)
            da[..., h : 2 * h] = dm * sn * r * (1 - r)
            da[..., 2 * h :] = dm
            ds = np.concatenate([da[..., : 2 * h], dm * r], -1)
            grad["u"] += np.matmul(state.transpose(0, 2, 1), ds)
            grad["c"] += ds.sum(1, keepdims=True)
            carry = d * z + np.matmul(ds, p["u"].transpose(0, 2, 1))
        for k in range(2):
            flat, rows = both[k].ravel(), da_all[:, k].reshape(-1, 3 * h)
            order = np.argsort(flat, kind="stable")
            at = np.flatnonzero(np.diff(flat[order], prepend=-1))
            grad["x"][k][flat[order][at]] = np.add.reduceat(rows[order], at, axis=0)
        return value, grad

    def fit(self, windows: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 5) -> list[float]:
        r = np.random.default_rng(seed)
        codes = encode(windows, WINDOW)
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        by = [rows for rows in by if len(rows)]
        m1, m2 = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        losses = []
        for s in range(1, steps + 1):
            pick = np.concatenate([r.choice(rows, max(1, batch // len(by))) for rows in by])  # every language as often
            value, grad = self.loss(codes[:, pick], y[pick])
            losses.append(value)
            pace = rate * min(1.0, s / 20) * (0.1 + 0.9 * (1 - s / steps))
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grad.values()))))
            for k, g in grad.items():
                g = g / norm
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                self.p[k] -= (pace * (m1[k] / (1 - 0.9**s)) / (np.sqrt(m2[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        return losses


def encode(windows: list[bytes], span: int) -> np.ndarray:
    """Byte codes (span, windows), padded with PAD."""
    out = np.full((len(windows), span), PAD, np.int16)
    for i, w in enumerate(windows):
        out[i, : len(w)] = np.frombuffer(w, np.uint8)
    return np.ascontiguousarray(out.T)


def has_letter(text: str) -> bool:
    """Whether any character is a letter; numerals such as a half or a Roman eight are none."""
    return any(map(str.isalpha, text))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def pooled(model: BiGRU, texts: list[bytes], rows: int = 512) -> np.ndarray:
    """The mean distribution over all positions of each text (not empty)."""
    total = np.zeros((len(texts), len(model.labels)))
    windows = [(i, t[a : a + SPAN]) for i, t in enumerate(texts) for a in range(0, len(t), SPAN)]
    for a in range(0, len(windows), rows):
        part = windows[a : a + rows]
        codes = encode([w for _, w in part], SPAN)
        q = model.probabilities(model.states(codes))
        q *= (codes != PAD)[..., None]
        np.add.at(total, [i for i, _ in part], q.sum(0))
    return total / np.maximum(1, np.array([len(t) for t in texts]).reshape(-1, 1))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out, and isn't learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> BiGRU:
    """Learns from text and non-null lang of the documents that are not held out.

    The counts of languages cover all of these; of each language about sample_docs / languages documents are drawn.
    """
    known = need(docs, doc_id, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    counts = {r[lang]: r["count"] for r in known.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(sample_docs).collect()}
    each = max(1, sample_docs // max(1, len(counts)))
    if not counts:
        return BiGRU(["und"])
    share = F.create_map(*(x for k, c in counts.items() for x in (F.lit(k), F.lit(min(1_000_000, each * 1_000_000 // c + 1)))))
    drawn = known.where(F.pmod(F.xxhash64(doc_id, F.lit(41)), F.lit(1_000_000)) < share[F.col(lang)])

    def run(batches):
        for b in slices(batches, 256):
            out = []
            for i, t, k in zip(*(c.to_pylist() for c in b.columns)):
                raw = _bytes(t)
                r = np.random.default_rng(abs(int(i)))
                for a in r.integers(0, max(1, len(raw) - WINDOW + 1), WINDOWS).tolist() if raw else []:
                    out.append((k, raw[a : a + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["lang", "window"])

    rows = drawn.select(F.col(doc_id).cast("long"), F.col(text), F.col(lang)).mapInArrow(run, "lang string, window binary").orderBy(F.xxhash64("window", "lang"), "window", "lang").limit(4 * WINDOWS * sample_docs).collect()  # by hash, so the model doesn't depend on the order of tasks
    rows = sorted((r["lang"], bytes(r["window"])) for r in rows)
    labels = sorted({k for k, _ in rows}) or ["und"]
    model = BiGRU(labels)
    if len(labels) > 1:
        at = {k: i for i, k in enumerate(labels)}
        model.fit([w for _, w in rows], np.array([at[k] for k, _ in rows]))
    return model


def predict(docs: DataFrame, model: BiGRU, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; ``und`` with score 0 where the text is null or has no letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

    def run(batches):
        m = sent.value
        for b in slices(batches, 256):
            texts = b.column(2).to_pylist()
            live = [i for i, t in enumerate(texts) if t and has_letter(t)]
            q = pooled(m, [_bytes(texts[i]) for i in live])
            best = q.argmax(1) if live else []
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for i, k, row in zip(live, best, q):
                pred[i], score[i] = m.labels[k], float(min(1.0, max(0.0, row[k])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return need(docs, doc_id, text).select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text)).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_bigru(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
