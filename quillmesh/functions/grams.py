"""Character n-grams of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

SIZES = (2, 3, 4, 5)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _every(texts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram) of every substring of 2 to 5 characters, by length and then by place."""
    split = [t.split() for t in texts]
    parts = [f" {w} " for s in split for w in s] if words else [" ".join(s) for s in split]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split]) if words else np.arange(len(texts))
    size = np.array([len(p) for p in parts], np.int64)
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(owner, size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the end of the part
    h, rows, grams = (code + np.uint64(1)) * _STEP, [], []
    for k in SIZES:
        if len(code) < k:
            break
        h = h[: len(code) - k + 1] ^ (h[: len(code) - k + 1] >> np.uint64(31))
        h = (h * np.uint64(0xBF58476D1CE4E5B9) + code[k - 1 :] + np.uint64(k)) * _STEP
        some = np.flatnonzero(left[: len(h)] >= k)
        rows.append(row[some])
        grams.append((h[some] ^ (h[some] >> np.uint64(29))).view(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(grams)


def _counted(row: np.ndarray, gram: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, gram = row[order], gram[order]
    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[begin], gram[begin], np.diff(np.append(begin, len(row)))


def terms(texts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, how often), ascending: substrings of 2 to 5 characters, of each padded word or of the whole text."""
    row, gram = _every(texts, words)
    return _counted(row, gram, np.lexsort((gram, row)))


class Index:
    """Lists of texts by n-gram, weighted by their frequencies over the texts' norms."""

    def __init__(self, texts: list[str], norms: np.ndarray, words: bool):
        row, gram = _every(texts, words)
        order = np.argsort(gram, kind="stable")  # texts ascend within a length, and so within an n-gram
        row, gram, times = _counted(row, gram, order)
        self.row = row.astype(np.int32)
        self.weight = (1 + np.log(times)) / norms[self.row]
        begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        self.known, self.begin, self.end, self.size = gram[begin], begin, np.append(begin[1:], len(gram)), len(texts)

    def scores(self, grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if not len(self.known):
            return out
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        ok = self.known[at] == grams
        for a, z, x in zip(self.begin[at[ok]].tolist(), self.end[at[ok]].tolist(), factors[ok].tolist()):
            out[self.row[a:z]] += x * self.weight[a:z]
        return out
