"""Edit similarities of very many pairs of texts, and the best of very many texts to a query: exact, side by side in numpy.

Characters are bits: the longest common subsequence of a query with a text takes a few whole-array operations for each
place of the text, for all pairs of a batch at once. Texts or queries beyond WORD characters take the plain functions of
similarity.py. The best of a block are found from bounds: how many characters two texts have in common, and how many pairs
of neighbours of one the other lacks, both as bits of a few words. A pair is computed where its bound reaches the score
asked for, which falls until there are enough; so no text is left out that belongs to the best.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from quillmesh.functions import similarity as S

WORD = 62
ROWS = 512  # pairs whose places are compared side by side
PAIRS = 16_384  # pairs computed at once
STRIDE = 8_192
U = np.uint64
_ONES = U(0xFFFFFFFFFFFFFFFF)
#: The scores asked for in turn, until as many as wanted reach one.
STEPS = (0.95, 0.9, 0.86, 0.83, 0.8, 0.77, 0.74, 0.7, 0.65, 0.6, 0.5, 0.4, 0.3, 0.0)
EPS = 2e-6  # bounds and rounded scores differ by less


def round6(s: np.ndarray) -> np.ndarray:
    """Six decimals, halves up, as DuckDB rounds."""
    return np.floor(np.asarray(s) * 1e6 + 0.5) / 1e6


def _sorted(t: str) -> str:
    return " ".join(sorted(t.split()))


def _different(t: str) -> str:
    return " ".join(sorted(set(t.split())))


def _flat(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Texts:
    """Texts as rows of the numbers their characters have in an alphabet; 0 is the end. Rows hold the first 64 characters."""

    def __init__(self, texts: list[str], letters: np.ndarray | None = None):
        self.texts, flat = texts, _flat(texts)
        self.letters = np.unique(flat) if letters is None else letters
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = np.zeros((len(texts), min(64, int(self.size.max(initial=0)))), np.uint8 if len(self.letters) < 255 else np.uint32)
        end = np.cumsum(self.size)
        for i in range(0, len(texts), STRIDE):
            size = self.size[i : i + STRIDE]
            part = flat[end[i] - size[0] : end[i + len(size) - 1]]
            row = np.repeat(np.arange(i, i + len(size)), size)
            col = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
            ok = col < 64
            self.codes[row[ok], col[ok]] = np.searchsorted(self.letters, part[ok]) + 1
        self._at: np.ndarray | None = None

    @property
    def at(self) -> np.ndarray:
        """For each text and character the bits of its places."""
        if self._at is None:
            self._at = np.zeros((len(self.texts), len(self.letters) + 1), U)
            rows = np.arange(len(self.texts))
            for j in range(min(WORD, self.codes.shape[1])):
                self._at[rows, self.codes[:, j]] |= U(1) << U(j)
            self._at[:, 0] = 0
        return self._at

    def alone(self, q: str) -> Pairs:
        return Pairs([q], self.texts)

    def ratio(self, q: str) -> np.ndarray:
        """2 LCS / (sum of lengths) of the query with every text."""
        return self.alone(q).ratio(*_all(self.texts))

    def partial(self, q: str, rows: np.ndarray) -> np.ndarray:
        """partial_ratio_of the query with some of the texts."""
        return self.alone(q).partial(np.zeros(len(rows), np.int64), rows)

    def jaro_winkler(self, q: str) -> np.ndarray:
        """jaro_winkler_of the query with every text."""
        return self.alone(q).jaro_winkler(*_all(self.texts))


def _all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(len(texts), np.int64), np.arange(len(texts))


class Pairs:
    """Scores of pairs (number of a query, number of a text), each as the plain function of the same name gives it."""

    FORMS = (lambda t: t, _sorted, _different)

    def __init__(self, queries: list[str], texts: list[str], forms: list[Texts] | None = None, letters: np.ndarray | None = None):
        if letters is None:
            letters = np.unique(np.concatenate([_flat(queries), _flat(texts), _flat([" "])]))
        self.queries, self.letters = queries, letters
        self.q = [Texts([f(x) for x in queries], letters) for f in self.FORMS]
        self.t = forms or [Texts([f(x) for x in texts], letters) for f in self.FORMS]
        self.texts = texts
        self.qwords = [frozenset(x.split()) for x in queries]
        self._twords: dict[int, frozenset] = {}
        self.shared: np.ndarray | None = None  # for each query and text whether they share a word, where that is known

    def twords(self, i: int) -> frozenset:
        if i not in self._twords:
            self._twords[i] = frozenset(self.texts[i].split())
        return self._twords[i]

    def _plain(self, qi: np.ndarray, ti: np.ndarray, most: int = WORD) -> np.ndarray:
        """Which pairs are too long for bits."""
        return (self.q[0].size[qi] > most) | (self.t[0].size[ti] > most)

    def _split(self, qi, ti, fast, slow, most: int = WORD) -> np.ndarray:
        out, long = np.zeros(len(qi)), self._plain(qi, ti, most)
        for k in np.flatnonzero(long).tolist():
            out[k] = slow(self.queries[qi[k]], self.texts[ti[k]])
        rest = np.flatnonzero(~long)
        for i in range(0, len(rest), PAIRS):
            some = rest[i : i + PAIRS]
            out[some] = fast(qi[some], ti[some])
        return out

    def _ratio(self, qi: np.ndarray, ti: np.ndarray, form: int = 0) -> np.ndarray:
        q, t = self.q[form], self.t[form]
        m, n = q.size[qi], t.size[ti]
        order = np.argsort(-n, kind="stable")
        base, codes, n_ = qi[order] * q.at.shape[1], t.codes[ti[order]], n[order]
        full = (U(1) << m[order].astype(U)) - U(1)
        at, s = q.at.ravel(), full.copy()
        for j in range(int(n_[0]) if len(n_) else 0):
            k = int(np.searchsorted(-n_, -j, "left"))  # those longer than j
            u = s[:k] & at[base[:k] + codes[:k, j]]
            s[:k] = (s[:k] + u | s[:k] - u) & full[:k]
        common = np.zeros(len(qi), np.int64)
        common[order] = m[order] - np.bitwise_count(s).astype(np.int64)
        return np.where(m + n > 0, 2 * common / np.maximum(1, m + n), 1.0)

    def ratio(self, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
        return self._split(qi, ti, self._ratio, S.ratio_of)

    def _partial(self, qi: np.ndarray, ti: np.ndarray, form: int = 0) -> np.ndarray:
        q, t = self.q[form], self.t[form]
        m, n = q.size[qi], t.size[ti]
        out = np.zeros(len(qi))
        order = np.lexsort((n, m))
        order = order[(m[order] > 0) & (n[order] > 0)]
        for group in np.split(order, np.flatnonzero(np.diff(m[order])) + 1):
            for i in range(0, len(group), ROWS):
                some = group[i : i + ROWS]
                size, length = n[some], int(m[some[0]])
                bits = q.at[qi[some][:, None], t.codes[ti[some], : int(size.max())]]
                short, long = size <= length, size >= length
                if short.any():
                    out[some[short]] = _text_along(bits[short], size[short], length)
                if long.any():
                    out[some[long]] = np.maximum(out[some[long]], _query_along(bits[long], size[long], length))
        return out

    def partial(self, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
        return self._split(qi, ti, self._partial, S.partial_ratio_of)

    def common_word(self, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
        if self.shared is not None:
            return self.shared[qi, ti]
        return np.fromiter((not self.qwords[a].isdisjoint(self.twords(b)) for a, b in zip(qi.tolist(), ti.tolist())), bool, len(qi))

    def _token_set(self, qi: np.ndarray, ti: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.zeros(len(qi))
        rest = np.flatnonzero(~common)
        out[rest] = self._ratio(qi[rest], ti[rest], 2)
        out[(self.q[2].size[qi] == 0) | (self.t[2].size[ti] == 0)] = 0.0
        for k in np.flatnonzero(common).tolist():
            x, y = self.qwords[qi[k]], self.twords(ti[k])
            both, p, r = x & y, sorted(x - y), sorted(y - x)
            if not p or not r:
                out[k] = 1.0
                continue
            # the texts begin with the words they share, so these and the space behind belong to the longest subsequence
            b, p, r = sum(map(len, both)) + len(both) - 1, " ".join(p), " ".join(r)
            m, n = b + 1 + len(p), b + 1 + len(r)
            out[k] = max(2 * b / (b + min(m, n)), 2 * (b + 1 + S._common(p, r)) / (m + n))
        return out

    def token_set(self, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
        return self._split(qi, ti, lambda a, b: self._token_set(a, b, self.common_word(a, b)), S.token_set_ratio_of)

    def _repeats(self, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
        """Which pairs have a text with a word more than once; to the others their different words are their sorted words."""
        return np.flatnonzero((self.q[1].size[qi] != self.q[2].size[qi]) | (self.t[1].size[ti] != self.t[2].size[ti]))

    def _wratio(self, qi, ti, known: dict | None = None) -> np.ndarray:
        m, n = self.q[0].size[qi], self.t[0].size[ti]
        common = self.common_word(qi, ti)
        some = (m > 0) & (n > 0)
        long = np.maximum(m, n) / np.maximum(1, np.minimum(m, n))
        score = np.where(some, known["ratio"] if known else self._ratio(qi, ti), 0.0)
        near = np.flatnonzero(some & (long < 1.5))
        a, b = qi[near], ti[near]
        words = known["token_set"][near] if known else self._token_set(a, b, common[near])
        score[near] = np.maximum(score[near], 0.95 * np.maximum(self._ratio(a, b, 1), words))
        far = np.flatnonzero(some & (long >= 1.5))
        scale = np.where(long[far] <= 8, 0.9, 0.6)
        score[far] = np.maximum(score[far], scale * (known["partial"][far] if known else self._partial(qi[far], ti[far])))
        words, apart = np.ones(len(far)), np.flatnonzero(~common[far])
        a, b = qi[far[apart]], ti[far[apart]]
        of_words, some = self._partial(a, b, 1), self._repeats(a, b)
        of_words[some] = np.maximum(of_words[some], self._partial(a[some], b[some], 2))
        words[apart] = of_words
        score[far] = np.maximum(score[far], 0.95 * scale * words)
        return score

    def wratio(self, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
        return self._split(qi, ti, self._wratio, S.wratio_of)

    def _jaro_winkler(self, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
        q, t = self.q[0], self.t[0]
        order = np.argsort(-q.size[qi], kind="stable")
        m, n, a = q.size[qi[order]], t.size[ti[order]], q.codes[qi[order]]
        b = t.codes[ti[order]]
        b = np.ascontiguousarray(np.pad(b, ((0, 0), (0, -b.shape[1] % 64 if b.shape[1] else 64))))
        reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
        inside = np.where(n >= 64, _ONES, (U(1) << np.minimum(n, 63).astype(U)) - U(1))
        used, found = np.zeros(len(m), U), []
        for i in range(int(m[0]) if len(m) else 0):
            k = int(np.searchsorted(-m, -i, "left"))
            lo, hi = np.maximum(0, i - reach[:k]), np.minimum(63, i + reach[:k])  # both ends belong to it
            window = (_ONES >> (63 - hi).astype(U)) & (_ONES << np.minimum(63, lo).astype(U)) & inside[:k]
            places = np.packbits(b[:k] == a[:k, i, None], axis=1, bitorder="little").view(U)[:, 0]
            free = places & window & ~used[:k]
            one = free & (~free + U(1))
            used[:k] |= one
            found.append((places, one != 0))
        k_ = np.bitwise_count(used).astype(np.int64)
        left, wrong = used.copy(), np.zeros(len(m), np.int64)
        for places, ok in found:
            k = len(ok)
            one = np.where(ok, left[:k] & (~left[:k] + U(1)), U(0))
            wrong[:k] += ok & ((places & one) == 0)
            left[:k] &= ~one
        kk = np.maximum(1, k_)
        s = np.where(k_ > 0, (k_ / np.maximum(1, m) + k_ / np.maximum(1, n) + (k_ - wrong // 2) / kk) / 3, 0.0)
        same, still = np.zeros(len(m), np.int64), np.ones(len(m), bool)
        for i in range(min(4, a.shape[1], b.shape[1])):
            still &= (a[:, i] == b[:, i]) & (a[:, i] > 0)
            same += still
        out = np.zeros(len(m))
        out[order] = np.minimum(1.0, np.where(s > 0.7, s + 0.1 * same * (1 - s), s))
        return out

    def jaro_winkler(self, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
        return self._split(qi, ti, self._jaro_winkler, S.jaro_winkler_of, 64)

    def every(self, qi: np.ndarray, ti: np.ndarray) -> dict[str, np.ndarray]:
        """All similarities; 0 where a text is empty."""
        out = {"jaro_winkler": self.jaro_winkler(qi, ti), "ratio": self.ratio(qi, ti), "partial": self.partial(qi, ti), "token_set": self.token_set(qi, ti), "wratio": np.zeros(len(qi))}
        long = self._plain(qi, ti)
        for k in np.flatnonzero(long).tolist():
            out["wratio"][k] = S.wratio_of(self.queries[qi[k]], self.texts[ti[k]])
        rest = np.flatnonzero(~long)
        for i in range(0, len(rest), PAIRS):
            k = rest[i : i + PAIRS]
            out["wratio"][k] = self._wratio(qi[k], ti[k], {x: out[x][k] for x in ("ratio", "partial", "token_set")})
        some = (self.q[0].size[qi] > 0) & (self.t[0].size[ti] > 0)
        return {k: np.where(some, v, 0.0) for k, v in out.items()}


def _text_along(bits: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """The best ratio of each text, as long as the query at most, with a stretch of the query; all places side by side."""
    most, full = int(n.max()), (1 << m) - 1
    stretch = np.array([[((1 << k) - 1 << i if i >= 0 else (1 << k) - 1 >> -i) & full for i in range(1 - most, m)] for k in range(most + 1)], U)[n]
    s = stretch.copy()
    for j in range(most):
        u = s & bits[:, j, None]
        s = (s + u | s - u) & stretch
    w = np.bitwise_count(stretch).astype(np.int64)
    got = w - np.bitwise_count(s).astype(np.int64)
    return np.where(w > 0, 2 * got / (n[:, None] + np.maximum(1, w)), 0.0).max(1)


def _query_along(bits: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """The best ratio of the query with a stretch of each text, as long as the query at least."""
    most, full = int(n.max()), U((1 << m) - 1)
    bits = np.pad(bits[:, :most], ((0, 0), (m - 1, m - 1)))
    first = np.arange(1 - m, most)
    s = np.full((len(n), len(first)), full, U)
    for j in range(m):
        u = s & bits[:, j : j + len(first)]
        s = (s + u | s - u) & full
    w = np.minimum(n[:, None], first + m) - np.maximum(0, first)
    got = m - np.bitwise_count(s).astype(np.int64)
    return np.where(w > 0, 2 * got / (m + np.maximum(1, w)), 0.0).max(1)


class Bags:
    """How many characters texts have in common at most: a bit for each of the first so many of a character, in BITS bits."""

    BINS, BITS = 32, 128

    def __init__(self, letters: np.ndarray, texts: list[str]):
        self.letters = letters
        flat = np.searchsorted(letters, _flat(texts))
        often = np.argsort(-np.bincount(flat, minlength=len(letters)), kind="stable")
        self.bin = np.full(len(letters), self.BINS - 1)
        self.bin[often[: self.BINS - 1]] = np.arange(min(len(often), self.BINS - 1))
        counts = self._counts(texts)
        top = int(counts.max(initial=1))
        share = np.array([[(counts[:, b] >= k).mean() if len(counts) else 0.0 for k in range(1, min(top, 16) + 1)] for b in range(self.BINS)])
        chosen = np.argsort(-share.ravel(), kind="stable")[: self.BITS]
        chosen = chosen[share.ravel()[chosen] > 0]
        self.levels = np.bincount(chosen // share.shape[1], minlength=self.BINS)
        self.of = self.bits(counts)

    def _counts(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._some(texts[i : i + STRIDE]) for i in range(0, max(1, len(texts)), STRIDE)])

    def _some(self, texts: list[str]) -> np.ndarray:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts)), size)
        place = np.minimum(np.searchsorted(self.letters, flat := _flat(texts)), max(0, len(self.letters) - 1))
        ok = self.letters[place] == flat if len(flat) else np.zeros(0, bool)
        return np.bincount(row[ok] * self.BINS + self.bin[place[ok]], minlength=len(texts) * self.BINS).reshape(-1, self.BINS).astype(np.uint32)

    def bits(self, counts: np.ndarray) -> np.ndarray:
        out, at = np.zeros((2, len(counts)), U), 0
        for b, n in enumerate(self.levels.tolist()):
            for k in range(1, n + 1):
                out[at // 64] |= (counts[:, b] >= k).astype(U) << U(at % 64)
                at += 1
        return out

    def asked(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of queries, and how many of their characters have none."""
        counts = self._counts(queries)
        return self.bits(counts), np.maximum(0, counts.astype(np.int64) - self.levels).sum(1)


def _neighbours(texts: list[str], padded: bool) -> np.ndarray:
    """Bits of the pairs of neighbouring characters, hashed; words stand between spaces where padded."""
    if len(texts) > STRIDE:
        return np.concatenate([_neighbours(texts[i : i + STRIDE], padded) for i in range(0, len(texts), STRIDE)], axis=1)
    if padded:
        texts = [f" {t} " for t in texts]
    flat, size = _flat(texts).astype(np.uint64), np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), size)
    out = np.zeros((2, len(texts)), U)
    if len(flat) < 2:
        return out
    h = (flat[:-1] * U(0x9E3779B97F4A7C15) + flat[1:]) * U(0xC2B2AE3D27D4EB4F) >> U(57)
    ok = row[:-1] == row[1:]
    key = np.unique(row[:-1][ok] * 128 + h[ok].astype(np.int64))
    for k in (0, 1):
        mine = key[(key % 128) // 64 == k]
        if len(mine):
            first = np.flatnonzero(np.diff(mine // 128, prepend=-1))
            out[k, mine[first] // 128] = np.bitwise_or.reduceat(U(1) << (mine % 64).astype(U), first)
    return out


def _shared(bits: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many bits texts share with a query, in strides that stay in the cache."""
    out = np.empty(bits.shape[1], np.uint8)
    for i in range(0, len(out), STRIDE):
        a, b = bits[:, i : i + STRIDE]
        np.add(np.bitwise_count(a & q[0]), np.bitwise_count(b & q[1]), out=out[i : i + STRIDE])
    return out


def _lacking(a: np.ndarray, least: float) -> np.ndarray:
    """How many pairs of neighbours of a text of length ``a`` may be missing in a stretch of partial ratio ``least``; -1: none reaches it.

    Of d characters left out each ends two pairs, each of i <= d others between them one; the ratio is 2 (a - d) / (2 a - d + i).
    """
    if least > 1:
        return np.full(len(a), -1)
    i, a = np.arange(int(a.max(initial=0)) + 1), a[:, None]
    d = np.floor(np.minimum(a, (2 * a - least * (2 * a + i)) / (2 - least)) + 1e-9)
    return np.where((d >= i) & (d >= 0), 2 * d + i, -1).max(1)


class Block:
    """A block of texts, ready for the best of them by wratio() and jaro_winkler()."""

    def __init__(self, texts: list[str]):
        self.texts, self.plain = texts, Texts(texts)
        self._near: _ByLength | None = None
        self._first: _ByPrefix | None = None

    def jaro_winkler(self, q: str, n: int) -> list[tuple[int, float]]:
        return self.best("jaro_winkler", [q], n)[0]

    def wratio(self, q: str, n: int) -> list[tuple[int, float]]:
        return self.best("wratio", [q], n)[0]

    def best(self, channel: str, queries: list[str], n: int, floors: list[float] | None = None) -> list[list[tuple[int, float]]]:
        """For each query the n best (number, score of six decimals), ties to the smaller number; below its floor, if there are any, texts may lack."""
        if channel == "wratio":
            self._near = self._near or _ByLength(self.texts)
            side = self._near
        else:
            self._first = self._first or _ByPrefix(self.texts)
            side = self._first
        out: list[list[tuple[int, float]]] = [[] for _ in queries]
        order = sorted(range(len(queries)), key=lambda i: (len(queries[i]), queries[i]))
        for i in range(0, len(order), side.BATCH):
            some = order[i : i + side.BATCH]
            for k, found in zip(some, side.best([queries[k] for k in some], n, floors and [floors[k] for k in some])):
                out[k] = found
        return out

    def reaching(self, queries: list[str], least: list[float], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the numbers of the texts whose weighted similarities (SHARES) add up to ``least``, which is above 0, and which of them are not among the n best by wratio().

        Others that lack EPS at most may be among them; where that of wratio() isn't plain from the words in common it stays open.
        """
        side = _Reach(self.texts)
        out = [(_NONE, np.zeros(0, bool)) for _ in queries]
        order = sorted(range(len(queries)), key=lambda i: (len(queries[i]), queries[i]))
        for i in range(0, len(order), side.BATCH):
            some = order[i : i + side.BATCH]
            for k, found in zip(some, side.reaching([queries[k] for k in some], [least[k] for k in some], n)):
                out[k] = found
        return out


def best(score: np.ndarray, n: int) -> list[tuple[int, float]]:
    """The n highest, ties to the smaller number."""
    return best_of(np.arange(len(score)), score, np.arange(len(score)), n)


class _Side:
    """Texts in an order of their own; ``number`` is their place in the block."""

    def __init__(self, texts: list[str], order: list[int]):
        self.number = np.array(order, np.int64)
        self.texts = [texts[i] for i in order]
        self.n = np.fromiter(map(len, self.texts), np.int64, len(texts))
        self.letters = np.unique(np.concatenate([_flat(self.texts), _flat([" "])]))
        self.bags = Bags(self.letters, self.texts)

    def _pairs(self, queries: list[str]) -> Pairs:
        letters = np.unique(np.concatenate([self.letters, _flat(queries)]))
        if len(letters) > len(self.letters):
            self.letters, self.forms = letters, None
        self.forms = getattr(self, "forms", None) or [Texts([f(t) for t in self.texts], letters) for f in Pairs.FORMS[: self.FORMS]]
        return Pairs(queries, self.texts, self.forms, letters)

    def best(self, queries: list[str], n: int, floors: list[float] | None = None) -> list[list[tuple[int, float]]]:
        pairs, n = self._pairs(queries), min(n, len(self.texts))
        self.prepare(queries)
        asked = [self.ask(pairs, k, n) for k in range(len(queries))] if n else []
        for a, floor in zip(asked, floors or ()):
            a.floor = floor
        open_ = [k for k, a in enumerate(asked) if not a.done(n)]
        if self.CHANNEL == "wratio" and open_:
            pairs.shared = np.array([a.shares for a in asked])
        while open_:
            new = [asked[k].more(n) for k in open_]
            qi, ti = np.repeat(open_, list(map(len, new))), np.concatenate(new)
            score, at = round6(getattr(pairs, self.CHANNEL)(qi, ti)), 0
            for k, x in zip(open_, new):
                asked[k].learn(x, score[at : at + len(x)])
                at += len(x)
            open_ = [k for k in open_ if not asked[k].done(n)]
        return [best_of(a.at, a.score, self.number, n) for a in asked] if n else [[] for _ in queries]


def best_of(at: np.ndarray, score: np.ndarray, number: np.ndarray, n: int) -> list[tuple[int, float]]:
    if len(score) > n:
        some = score >= np.partition(score, len(score) - n)[len(score) - n]
        at, score = at[some], score[some]
    ids = number[at]
    order = np.lexsort((ids, -score))[:n]
    return list(zip(ids[order].tolist(), score[order].tolist()))


class _Asked:
    """What is known of a query: scores of texts, and the score for which all texts that could reach it were computed.

    ``low`` are scores that the texts ``at`` have at least, and exactly where nothing else of theirs reaches what is asked.
    """

    def __init__(self, size: int, may, at: np.ndarray, low: np.ndarray):
        self.may, self.asked, self.floor = may, 2.0, 0.0
        self.seen = np.zeros(size, bool)  # computed
        self._at, self._score, self._low_at, self._low = np.zeros(0, np.int64), np.zeros(0), at, low
        self.shares = np.zeros(size, bool)  # a word with the query
        self.shares[at] = True
        self._join()

    def _join(self) -> None:
        rest = ~self.seen[self._low_at]
        self.at, self.score = np.concatenate([self._at, self._low_at[rest]]), np.concatenate([self._score, self._low[rest]])

    def _nth(self, n: int) -> float:
        return np.partition(self.score, len(self.score) - n)[len(self.score) - n] if len(self.score) >= n else -1.0

    def done(self, n: int) -> bool:
        return self.asked <= self.floor or self._nth(n) >= self.asked

    def more(self, n: int) -> np.ndarray:
        """The texts to be computed next."""
        self.asked = max(self._nth(n), self.floor, next(s for s in STEPS if s < self.asked))
        at = np.flatnonzero(self.may(self.asked - EPS) & ~self.seen) if self.asked > 0 else np.flatnonzero(~self.seen)
        self.seen[at] = True
        return at

    def learn(self, at: np.ndarray, score: np.ndarray) -> None:
        self._at, self._score = np.concatenate([self._at, at]), np.concatenate([self._score, score])
        self._join()


_NONE = np.zeros(0, np.int64)


class _ByPrefix(_Side):
    """Texts as they sort, for Jaro-Winkler: those of a prefix lie together."""

    CHANNEL, FORMS, BATCH = "jaro_winkler", 1, 64  # queries whose pairs are computed together

    def __init__(self, texts: list[str]):
        super().__init__(texts, sorted(range(len(texts)), key=texts.__getitem__))
        self.n32, self.longest = self.n.astype(np.int32), int(self.n.max(initial=0))

    def prepare(self, queries: list[str]) -> None:
        self.q, self.over = self.bags.asked(queries)

    def ask(self, pairs: Pairs, k: int, n: int) -> _Asked:
        q = pairs.queries[k]
        ranges = [(0, len(self.n))]
        for p in range(1, min(4, len(q)) + 1):
            lo = bisect_left(self.texts, q[:p], *ranges[-1])
            hi = bisect_left(self.texts, True, lo, ranges[-1][1], key=lambda t: t[:p] > q[:p])  # noqa: B023
            ranges.append((lo, hi))
        # the highest score by shared characters (rows) and length (columns), for a prefix of each length
        lengths, m = np.arange(self.longest + 1), len(q)
        c = np.minimum(np.arange(Bags.BITS + 1)[:, None] + int(self.over[k]), np.minimum(lengths, m))
        jaro = np.where(c > 0, (c / max(1, m) + c / np.maximum(1, lengths) + 1) / 3, 0.0)
        high = np.empty(len(self.n), np.float32)
        for p, (lo, hi) in enumerate(ranges):
            table = np.where(jaro > 0.7, jaro + 0.1 * p * (1 - jaro), jaro).astype(np.float32).ravel()
            for i in range(lo, hi, STRIDE):
                j = min(hi, i + STRIDE)
                table.take(_shared(self.bags.of[:, i:j], self.q[:, k]) * np.int32(len(lengths)) + self.n32[i:j], out=high[i:j], mode="clip")
        may = lambda least: high >= least

        return _Asked(len(self.n), may if q else lambda least: np.zeros(len(self.n), bool), _NONE, np.zeros(0))


class _ByLength(_Side):
    """Texts by their length, for WRatio: near ones, those much longer and those much shorter lie together."""

    CHANNEL, FORMS, BATCH = "wratio", 3, 12

    def __init__(self, texts: list[str]):
        super().__init__(texts, sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i])))
        self.bits = _neighbours(self.texts, True)
        self.held = np.bitwise_count(self.bits).sum(0).astype(np.int16)
        self.begin = np.searchsorted(self.n, np.arange(int(self.n.max(initial=0)) + 2))  # where each length begins
        self.different = np.fromiter((len(_different(t)) for t in self.texts), np.int64, len(texts))
        self.repeated = (self.n - self.different).astype(np.int16)
        self.odd = np.flatnonzero([t != " ".join(t.split()) for t in self.texts])  # bounds are those of words between single spaces
        words = [set(t.split()) for t in self.texts]
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for x in words for w in x), np.int64)
        self.words = np.fromiter(map(len, words), np.int64, len(texts))
        row, order = np.repeat(np.arange(len(texts)), self.words), np.argsort(which, kind="stable")
        self.word, self.holders, self.word_begin = number, row[order], np.searchsorted(which[order], np.arange(len(number) + 1))

    def prepare(self, queries: list[str]) -> None:
        self.q, self.over = self.bags.asked(queries)
        self.q_bits = _neighbours(queries, True)
        self.q_inner = [_neighbours([f(q) for q in queries], False) for f in Pairs.FORMS]

    def _known(self, pairs: Pairs, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What the words shared with a query give: (texts, scores)."""
        found = []
        for w in pairs.qwords[k]:
            i = self.word.get(w)
            if i is not None:
                found.append((self.holders[self.word_begin[i] : self.word_begin[i + 1]], len(w) + 1))
        if not found:
            return _NONE, np.zeros(0)
        m, dm, words = len(pairs.queries[k]), pairs.q[2].size[k], len(pairs.qwords[k])
        at, which = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True)
        b = np.bincount(which, np.repeat([s for _, s in found], [len(a) for a, _ in found])) - 1
        same = np.bincount(which)
        n, dn = self.n[at], self.different[at]
        long = np.maximum(m, n) / np.minimum(m, n)
        set_ = np.where((same == words) | (same == self.words[at]), 1.0, 2 * b / (b + np.minimum(dm, dn)))
        return at, round6(np.where(long < 1.5, 0.95 * set_, 0.95 * np.where(long <= 8, 0.9, 0.6)))

    def ask(self, pairs: Pairs, k: int, n: int) -> _Asked:
        q, size = pairs.queries[k], len(self.n)
        if not q:
            return _Asked(size, lambda least: np.zeros(size, bool), _NONE, np.zeros(0))
        if q != " ".join(q.split()):
            out = _Asked(size, lambda least: np.ones(size, bool), _NONE, np.zeros(0))
            out.shares[self._known(pairs, k)[0]] = True
            return out
        m, dm = len(q), int(pairs.q[2].size[k])
        common = _shared(self.bags.of, self.q[:, k]) + np.int16(min(self.over[k], 1000))
        both = _shared(self.bits, self.q_bits[:, k])
        mine = int(np.bitwise_count(self.q_bits[:, k]).sum())
        lo = int(np.searchsorted(3 * self.n, 2 * m, "right"))  # n > m / 1.5
        hi = int(np.searchsorted(2 * self.n, 3 * m, "left"))  # n < 1.5 m
        lo8 = int(np.searchsorted(8 * self.n, m, "left"))  # n >= m / 8
        hi8 = int(np.searchsorted(self.n, 8 * m, "right"))  # n <= 8 m
        forms = [(0, 1.0)] + [(f, 0.95) for f in (1, 2) if pairs.q[f].texts[k] != pairs.q[f - 1].texts[k]]
        gap: list = []

        def may(least: float) -> np.ndarray:
            out = np.zeros(size, bool)
            # ratios: of the characters left out each ends at most two pairs of neighbours of its text and one of the other
            first, last = (lo, hi) if least > 0.8 else (int(np.searchsorted((2 - least) * self.n, least * m - 1e-6)), int(np.searchsorted(least * self.n, (2 - least) * m + 1e-6, "right")))
            if first < last:
                if not gap or gap[0][0] > first or gap[0][1] < last:
                    gap[:] = [(first, last), self.held[first:last] - 2 * both[first:last].astype(np.int16), 2 * common[first:last] + self.repeated[first:last]]
                for n in range(int(self.n[first]), int(self.n[last - 1]) + 1):
                    a, z = max(first, int(self.begin[n])), min(last, int(self.begin[n + 1]))
                    left = int((1 - least) * (m + n) + 1e-9)
                    x, y = a - gap[0][0], z - gap[0][0]
                    out[a:z] = (gap[1][x:y] <= 3 * left - mine) & (gap[2][x:y] >= dm + n - left)
            # stretches of longer texts; of the pairs of a word with spaces around it those at the ends belong to no stretch
            for a, z, scale in ((hi, hi8, 0.9), (hi8, size, 0.6)):
                a = max(a, hi)
                if a >= z:
                    continue
                wants = [(f, least / scale / weight, int(pairs.q[f].size[k])) for f, weight in forms]
                wants = [(f, want, length, int(_lacking(np.array([length]), want)[0])) for f, want, length in wants]
                some = max(x[3] for x in wants)
                if some < 0:
                    continue
                at = a + np.flatnonzero(both[a:z] >= mine - some - 2)
                for f, want, length, lacks in wants:
                    if lacks >= 0:
                        inner = self.q_inner[f][:, k]
                        ok = common[at] * (2 - want) >= want * length - 1e-6
                        mine_too = at[ok]
                        out[mine_too[int(np.bitwise_count(inner).sum()) - _shared(self.bits[:, mine_too], inner).astype(np.int16) <= lacks]] = True
            # shorter texts along the query; of the pairs of a word with spaces around it those at the ends may be missing
            for a, z, scale in ((lo8, lo, 0.9), (0, lo8, 0.6)):
                z = min(z, lo)
                if a < z:
                    for length, weight in ((self.n[a:z], 1.0), (self.different[a:z], 0.95)):
                        want = least / scale / weight
                        each = _lacking(np.arange(int(length.max()) + 1), want)[length]
                        out[a:z] |= (each >= 0) & (self.held[a:z] - both[a:z].astype(np.int16) <= each + 2) & (common[a:z] * (2 - want) >= want * self.different[a:z] - 1e-6)
            out[self.odd] = True
            return out

        return _Asked(size, may, *self._known(pairs, k))


class _Reach(_ByLength):
    """Texts by their length, for the weighted sum of all similarities: bounds from the characters and words in common first."""

    BATCH, CACHED, MANY = 64, 4_000_000, 4_096  # queries at once, texts that prefixes are kept of, texts of a query that don't wait for others

    def __init__(self, texts: list[str]):
        super().__init__(texts)
        self.n32, self.longest = self.n.astype(np.int32), int(self.n.max(initial=0))
        self.first = np.array([ord(t[0]) if t else 0 for t in self.texts], np.uint32)
        self.rare = np.union1d(self.odd, np.flatnonzero(self.repeated))  # their bounds are not those of their lengths
        order = np.array(sorted(range(len(self.word)), key=list(self.word).__getitem__), np.int64)
        self.sorted = sorted(self.word)
        self.sorted_n, self.held_by = np.fromiter(map(len, self.sorted), np.int64, len(order)), np.diff(self.word_begin)[order]
        begin = np.cumsum(self.held_by) - self.held_by
        self.sorted_holders = self.holders[np.repeat(self.word_begin[order] - begin, self.held_by) + np.arange(int(self.held_by.sum()))]
        self.sorted_begin = np.append(begin, len(self.sorted_holders))
        self.tables: dict[tuple[int, int], np.ndarray] = {}
        self.prefixes: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.cached = 0
        self.most = _most_partial(self.longest)

    def prepare(self, queries: list[str]) -> None:
        super().prepare(queries)
        self.q_first = [ord(q[0]) if q else 0 for q in queries]

    def _prefix(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(texts, the best prefix_of() the word and theirs), those above 0."""
        if word not in self.prefixes:
            m, ranges = len(word), []  # of words as they sort those that begin alike lie together
            for p in range(min(2, m), m + 1):
                lo = bisect_left(self.sorted, word[:p], *(ranges[-1] if ranges else (0, len(self.sorted))))
                ranges.append((lo, bisect_left(self.sorted, True, lo, ranges[-1][1] if ranges else len(self.sorted), key=lambda t: t[:p] > word[:p])))  # noqa: B023
            first, last = ranges[0]
            n, same = self.sorted_n[first:last], np.zeros(last - first, np.int64)
            for p, (lo, hi) in enumerate(ranges, min(2, m)):
                same[lo - first : hi - first] = p
            least, most = np.minimum(m, n), np.maximum(m, n)
            score = np.where(same == least, np.minimum(1.0, 0.70 + 0.30 * least / most), np.where(same >= 2, np.minimum(0.55, 0.55 * same / most), 0.0))
            score = np.where((same == m) & (n == m), 1.0, np.where(least < 3, 0.0, score))
            best = np.zeros(len(self.n))
            best_ = self.sorted_holders[self.sorted_begin[first] : self.sorted_begin[last]]
            each = np.repeat(score, self.held_by[first:last])
            order = np.argsort(each, kind="stable")
            best[best_[order]] = each[order]  # the last one stays
            at = np.flatnonzero(best).astype(np.int32)
            if self.cached > self.CACHED:
                self.prefixes, self.cached = {}, 0
            self.prefixes[word], self.cached = (at, best[at]), self.cached + len(at)
        return self.prefixes[word]

    def token_prefix(self, q: str) -> np.ndarray:
        """token_prefix_score() with every text."""
        out, all_ = np.zeros(len(self.n)), 0.0
        for w in q.split():
            weight = float(max(1, min(8, len(w))))
            at, s = self._prefix(w)
            out[at] += weight * s
            all_ += weight
        return out / max(1.0, all_)

    def _table(self, m: int, dm: int) -> np.ndarray:
        """The highest sums by shared characters (rows) and length (columns) of texts that share no word, without prefixes."""
        if (m, dm) not in self.tables:
            n = np.arange(self.longest + 1)
            self.tables[m, dm] = _highest_sum(np.arange(m + 1)[:, None], m, dm, n, n, 0.0, False).astype(np.float32).ravel()
        return self.tables[m, dm]

    def reaching(self, queries: list[str], least: list[float], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        pairs = self._pairs(queries)
        self.prepare(queries)
        pairs.shared = np.zeros((len(queries), len(self.n)), bool)
        found, sums, limits, lows = [], [], ([], [], []), []
        for k, q in enumerate(queries):
            m, dm = len(q), int(pairs.q[2].size[k])
            prefix = SHARES["token_prefix"] * self.token_prefix(q)
            base, at = self._sets(pairs, k)
            pairs.shared[k, at] = True
            lows.append((_NONE, _NONE))
            if q != " ".join(q.split()):
                found.append(np.arange(len(self.n)) if q else _NONE)
                sums.append(prefix[found[-1]])
                for x in limits:
                    x.append(np.full(len(found[-1]), ANY))
                continue
            if len(at) >= n:
                long = np.maximum(m, self.n[at]) / np.minimum(m, self.n[at])
                lows[-1] = at, round6(np.where(long < 1.5, 0.95 * base, 0.95 * np.where(long <= 8, 0.9, 0.6)))
            common = np.minimum(_shared(self.bags.of, self.q[:, k]).astype(np.int32) + np.int32(min(self.over[k], 1000)), np.int32(m))
            high = self._table(m, dm).take(common * np.int32(self.longest + 1) + self.n32)
            rare = self.rare
            high[rare] = _highest_sum(common[rare], m, dm, self.n[rare], self.different[rare], 0.0, False)
            high[at] = _highest_sum(common[at], m, dm, self.n[at], self.different[at], base, True)
            high[self.first == self.q_first[k]] += SHARES["jaro_winkler"] * 0.4 * 0.3  # a prefix adds .1 of what lacks, beyond .7, for each of four characters
            high[self.odd] = ANY
            some = np.flatnonzero(high + prefix >= least[k] - 1e-5)
            high, *known = self._closer(some, common, base, at, k, m, dm)
            ok = high + prefix[some] >= least[k] - 1e-5
            some, known = some[ok], [y[ok] for y in known]
            if len(some) > self.MANY:
                passed = [np.zeros(0, np.int64)]
                for i in range(0, len(some), PAIRS):
                    part = slice(i, i + PAIRS)
                    passed.append(i + self._pass(pairs, np.full(len(some[part]), k), some[part], least[k] - EPS - prefix[some[part]], *(x[part] for x in known))[0])
                passed = np.concatenate(passed)
                some, known = some[passed], [y[passed] for y in known]
            for x, y in zip(limits, known):
                x.append(y)
            found.append(some)
            sums.append(prefix[some])
        qi, (ti, sums, *limits_) = np.repeat(np.arange(len(queries)), list(map(len, found))), map(np.concatenate, (found, sums, *limits))
        wanted, ok, wratio = np.asarray(least)[qi] - EPS - sums, np.zeros(len(qi), bool), np.zeros(len(qi))
        for i in range(0, len(qi), PAIRS):
            part = slice(i, i + PAIRS)
            some, score = self._pass(pairs, qi[part], ti[part], wanted[part], *(x[part] for x in limits_))
            ok[i + some], wratio[i + some] = True, round6(score)
        out, end = [], np.cumsum(np.bincount(qi[ok], minlength=len(queries)))[:-1]
        for t, score, (at, low) in zip(np.split(self.number[ti[ok]], end), np.split(wratio[ok], end), lows):
            before = (low > score[:, None]) | ((low == score[:, None]) & (self.number[at] < t[:, None])) if len(at) else np.zeros((len(t), 0), bool)
            out.append((t, before.sum(1) >= n))
        return out

    def _pass(self, pairs: Pairs, qi: np.ndarray, ti: np.ndarray, want: np.ndarray, partial: np.ndarray, sets: np.ndarray, jaro: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs reach what is wanted, and their wratio(): the cheap scores first, of the rest the bounds are known."""
        plain = pairs._plain(qi, ti)
        at = np.flatnonzero(~plain)
        a, b, partial, sets, jaro = qi[at], ti[at], partial[at], sets[at], jaro[at]
        m, n, shares = pairs.q[0].size[a], pairs.t[0].size[b], pairs.shared[a, b]
        long = np.maximum(m, n) / np.maximum(1, np.minimum(m, n))
        scale, near = np.where(long <= 8, 0.9, 0.6), long < 1.5
        ratio, words = pairs._ratio(a, b), pairs._ratio(a, b, 1)
        different, some = words.copy(), pairs._repeats(a, b)
        different[some] = pairs._ratio(a[some], b[some], 2)
        sets = np.where(shares, sets, different)  # shared words come first there, and the order decides
        near_, far_ = np.maximum(ratio, 0.95 * np.maximum(words, sets)), np.maximum(ratio, scale * np.where(shares, 0.95, 0.95 * partial))

        def reach(k: np.ndarray, jaro: np.ndarray, partial: np.ndarray) -> np.ndarray:
            wratio = np.where(near[k], near_[k], np.maximum(far_[k], scale[k] * partial))
            return SHARES["wratio"] * wratio + SHARES["partial"] * partial + SHARES["token_set"] * sets[k] + SHARES["jaro_winkler"] * jaro >= want[at[k]]

        k = np.arange(len(at))
        k = k[reach(k, jaro, partial)]
        exact = pairs._jaro_winkler(a[k], b[k])
        ok = reach(k, exact, partial[k])
        k, exact = k[ok], exact[ok]
        k = k[reach(k, exact, np.minimum(partial[k], pairs._partial(a[k], b[k])))]
        rest = np.sort(np.concatenate([at[k], np.flatnonzero(plain)]))
        scores = pairs.every(qi[rest], ti[rest])
        ok = sum(w * scores[x] for x, w in SHARES.items() if x in scores) >= want[rest]
        return rest[ok], scores["wratio"][ok]

    def _closer(self, some: np.ndarray, common: np.ndarray, base: np.ndarray, at: np.ndarray, k: int, m: int, dm: int) -> tuple[np.ndarray, ...]:
        """The highest sums of some texts by their pairs of neighbours too, and the highest partial, token_set and Jaro-Winkler."""
        place = np.minimum(np.searchsorted(at, some), max(0, len(at) - 1))
        shares = at[place] == some if len(at) else np.zeros(len(some), bool)
        sets = np.where(shares, base[place], 0.0) if len(at) else np.zeros(len(some))
        mine, q = int(np.bitwise_count(self.q_bits[:, k]).sum()), self.q_bits[:, k]
        both = _shared(self.bits[:, some], q).astype(np.int32)
        held, n = self.held[some].astype(np.int32), self.n[some]
        # of the characters left out each ends at most two pairs of neighbours of its text and one of the other
        ratio = 1 - np.maximum(0, held + mine - 2 * both) / 3 / np.maximum(1, m + n)
        size = np.minimum(m, n)
        lacks = np.where(m <= n, mine, held) - both - 2  # those at the ends may belong to no stretch
        partial = self.most[size, np.clip(lacks, 0, self.most.shape[1] - 1)]
        alike = (dm == m) & (self.repeated[some] == 0)
        partial = np.where(alike & (m != n), partial, 1.0)
        args = common[some], m, dm, n, self.different[some], sets
        out, (_, partial, sets) = _highest_sum(*args, shares, ratio, partial), _limits(*args, ratio, partial)
        out[self.first[some] == self.q_first[k]] += SHARES["jaro_winkler"] * 0.4 * 0.3
        jaro = _highest_jaro(common[some], m, n)
        jaro[self.first[some] == self.q_first[k]] += 0.4 * 0.3
        for x in (out, partial, sets, jaro):
            x[np.isin(some, self.odd)] = ANY
        return out, partial, sets, jaro

    def _sets(self, pairs: Pairs, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(what shared words alone give as token_set, texts that share a word with a query)."""
        found = [(self.holders[self.word_begin[i] : self.word_begin[i + 1]], len(w) + 1) for w in pairs.qwords[k] if (i := self.word.get(w)) is not None]
        if not found:
            return np.zeros(0), _NONE
        both, same = np.zeros(len(self.n), np.int32), np.zeros(len(self.n), np.int16)
        for h, size in found:
            both[h] += size
            same[h] += 1
        at = np.flatnonzero(same)
        b, same = both[at] - 1, same[at]
        return np.where((same == len(pairs.qwords[k])) | (same == self.words[at]), 1.0, 2 * b / (b + np.minimum(int(pairs.q[2].size[k]), self.different[at]))), at


#: The parts of the hybrid score that edit similarities have, and words.
SHARES = {"wratio": 0.20, "partial": 0.10, "token_set": 0.10, "jaro_winkler": 0.10, "token_prefix": 0.10}


ANY = 9.0  # no bound


def _limits(c, m: int, dm: int, n, dn, base, ratio=1.0, partial=1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The highest ratios of any order of the words, partial ratios and token_sets of a query and texts of ``c`` characters in common.

    ``dm``, ``dn`` are the lengths of their different words, ``base`` is what shared words alone give as token_set; ``ratio`` and ``partial`` are
    bounds that are known. A common subsequence has c characters at most, and so has the stretch that a partial ratio is highest with.
    """
    k = np.minimum(dm, dn)
    words = np.minimum(ratio, 2 * np.minimum(c, k) / np.maximum(1, dm + dn))
    return np.minimum(ratio, 2 * c / np.maximum(1, m + n)), np.minimum(partial, 2 * c / np.maximum(1, k + np.minimum(c, k))), np.minimum(1.0, np.maximum(base, words))


def _highest_sum(c, m: int, dm: int, n, dn, base, shares, ratio=1.0, partial=1.0) -> np.ndarray:
    """The highest SHARES of them, without prefixes; ``shares``: whether they have a word in common."""
    ratio, partial, sets = _limits(c, m, dm, n, dn, base, ratio, partial)
    long = np.maximum(m, n) / np.maximum(1, np.minimum(m, n))
    near, far = np.maximum(ratio, 0.95 * sets), np.maximum(ratio, np.where(long <= 8, 0.9, 0.6) * np.maximum(partial, np.where(shares, 0.95, 0.0)))
    return SHARES["wratio"] * np.where(long < 1.5, near, far) + SHARES["partial"] * partial + SHARES["token_set"] * sets + SHARES["jaro_winkler"] * _highest_jaro(c, m, n)


def _highest_jaro(c, m: int, n) -> np.ndarray:
    """The highest Jaro similarities by the characters in common."""
    return np.where(c > 0, (np.minimum(1.0, c / max(1, m)) + np.minimum(1.0, c / np.maximum(1, n)) + 1) / 3, 0.0)


def _most_partial(longest: int, lacks: int = 129) -> np.ndarray:
    """By the length of the shorter text and the number of its pairs of neighbours that the other lacks, the highest partial ratio; see _lacking()."""
    out = np.zeros((longest + 1, lacks))
    for a in range(1, longest + 1):
        d = np.arange(a + 1)[:, None]
        i = np.arange(a + 1)[None, :]
        ok = i <= d
        most = np.zeros(3 * a + 1)
        np.maximum.at(most, (2 * d + i)[ok], (2 * (a - d) / np.maximum(1, 2 * a - d + i))[ok])
        most = np.maximum.accumulate(most[::-1])[::-1]
        out[a, : min(lacks, len(most))] = most[:lacks]
    return out
