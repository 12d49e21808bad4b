"""Similarities of names and the weights that fuse them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Weights of the hybrid score, with and without embeddings.
WITH_EMBEDDING = {"char_tfidf": 0.20, "wratio": 0.15, "partial_ratio": 0.08, "token_set_ratio": 0.07, "jaro_winkler": 0.12, "token_prefix": 0.08, "embedding": 0.20, "identifier": 0.10}
WITHOUT_EMBEDDING = {"char_tfidf": 0.30, "wratio": 0.20, "partial_ratio": 0.10, "token_set_ratio": 0.10, "jaro_winkler": 0.10, "token_prefix": 0.10, "identifier": 0.10}


def clamp(c: Column) -> Column:
    """Within [0, 1]; null, NaN and infinities are 0."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(0.0)


def total(weights: dict[str, float], there=lambda name: True) -> Column:
    """The weighted sum, in the order of the weights."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w) * (clamp(F.col(name).cast("double")) if there(name) else F.lit(0.0))
    return out


def hybrid(df_columns: set[str] | None = None, embedding: bool = False) -> Column:
    return clamp(total(WITH_EMBEDDING if embedding else WITHOUT_EMBEDDING, lambda name: df_columns is None or name in df_columns))


def prefix_score(q: Column, c: Column) -> Column:
    """1 if equal; a full prefix of at least three characters .70 + .30 of the length ratio; else by the common prefix, at most .55."""
    lo, hi = F.least(F.length(q), F.length(c)), F.greatest(F.length(q), F.length(c))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(lo, F.lit(1))), F.lit(0), lambda a, i: F.when((a == i - 1) & (F.substr(q, i, F.lit(1)) == F.substr(c, i, F.lit(1))), i).otherwise(a))
    return (
        F.when(q == c, 1.0)
        .when(lo < 3, 0.0)
        .when(same == lo, F.least(F.lit(1.0), F.lit(0.70) + F.lit(0.30) * lo / hi))
        .when(same >= 2, F.least(F.lit(0.55), F.lit(0.55) * same / hi))
        .otherwise(0.0)
    )


def token_prefix_score(query: Column, candidate: Column) -> Column:
    """Per query word the best of all candidate words, weighted by min(length, 8)."""
    q, c = F.filter(F.split(query, r"\s+"), lambda x: x != ""), F.filter(F.split(candidate, r"\s+"), lambda x: x != "")
    weight = lambda x: F.greatest(F.lit(1), F.least(F.lit(8), F.length(x))).cast("double")
    top = F.aggregate(q, F.lit(0.0), lambda a, x: a + weight(x) * F.coalesce(F.array_max(F.transform(c, lambda y: prefix_score(x, y))), F.lit(0.0)))
    all_ = F.aggregate(q, F.lit(0.0), lambda a, x: a + weight(x))
    return F.when(all_ > 0, top / all_).otherwise(0.0)


def prefix_of(q: str, c: str) -> float:
    """prefix_score() of two words."""
    if q == c:
        return 1.0
    lo, hi, same = min(len(q), len(c)), max(len(q), len(c)), 0
    if lo < 3:
        return 0.0
    while same < lo and q[same] == c[same]:
        same += 1
    return min(1.0, 0.70 + 0.30 * lo / hi) if same == lo else min(0.55, 0.55 * same / hi) if same >= 2 else 0.0


def token_prefixes(queries: list[str], texts: list[str], qi, ti) -> list[float]:
    """token_prefix_score() of pairs, as numbers of queries and texts; two words are compared once."""
    words = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    asked, known = [words(q) for q in queries], [words(t) for t in texts]
    weights = [[float(max(1, min(8, len(x)))) for x in q] for q in asked]
    best, out = {}, []
    for i, j in zip(qi.tolist(), ti.tolist()):
        all_ = top = 0.0
        for x, w in zip(asked[i], weights[i]):
            most = 0.0
            for y in known[j]:
                s = best.get((x, y))
                if s is None:
                    s = best[x, y] = prefix_of(x, y)
                if s > most:
                    most = s
            top, all_ = top + w * most, all_ + w
        out.append(top / all_ if all_ > 0 else 0.0)
    return out


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    m, other = len(hits), [y for y, u in zip(b, used) if u]
    half = sum(x != y for x, y in zip(hits, other)) // 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler_of(a: str | None, b: str | None) -> float:
    """Jaro-Winkler with prefix weight .1 above .7; empty or null is 0."""
    if not a or not b:
        return 0.0
    s = _jaro(a, b)
    if s > 0.7:
        same = 0
        while same < min(4, len(a), len(b)) and a[same] == b[same]:
            same += 1
        s += 0.1 * same * (1 - s)
    return min(1.0, s)


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, bit by bit in one whole number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & at.get(y, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer, windows over its ends included."""
    if not a or not b:
        return 0.0
    ways = [(a, b), (b, a)] if len(a) == len(b) else [(a, b) if len(a) < len(b) else (b, a)]
    return max(ratio_of(s, w[max(0, i) : i + len(s)]) for s, w in ways for i in range(1 - len(s), len(w)) if w[max(0, i) : i + len(s)])


def token_set_ratio_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, p, q = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not p or not q):
        return 1.0
    base = " ".join(both)
    one, two = (" ".join([*both, *p]), " ".join([*both, *q]))
    return max(ratio_of(one, two), *((ratio_of(base, one), ratio_of(base, two)) if both else (0.0,)))


def wratio_of(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    sort = lambda s: " ".join(sorted(s.split()))
    base, long = ratio_of(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if long < 1.5:
        return max(base, 0.95 * max(ratio_of(sort(a), sort(b)), token_set_ratio_of(a, b)))
    s = 0.9 if long <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 1.0 if x & y else max(partial_ratio_of(sort(a), sort(b)), partial_ratio_of(" ".join(sorted(x)), " ".join(sorted(y))))
    return max(base, s * partial_ratio_of(a, b), 0.95 * s * words)


def _pairs(f):
    @F.pandas_udf(DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if not x or not y else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return udf


jaro_winkler, ratio, partial_ratio, token_set_ratio, wratio = map(_pairs, (jaro_winkler_of, ratio_of, partial_ratio_of, token_set_ratio_of, wratio_of))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def retrieval_decision(unique: Column, ambiguous: Column, score: Column, margin: Column) -> Column:
    return F.when(score.isNull(), "UNKNOWN").when(unique, "AUTO_MATCH").when(ambiguous, "MANUAL_REVIEW").when((score >= 0.90) & (margin >= 0.08), "AUTO_MATCH").when(score >= 0.58, "MANUAL_REVIEW").otherwise("UNKNOWN")


def base_rerank_weight(length: Column, tokens: Column, gap: Column) -> Column:
    w = F.when(length <= 5, 0.15).when((tokens == 1) & (length <= 10), 0.20).when(tokens == 1, 0.25).when(length <= 12, 0.30).otherwise(0.40)
    return F.least(w, F.when(gap < 0.03, 0.15).when(gap < 0.06, 0.25).otherwise(1.0))


#: Scores that count as evidence from the name itself.
LEXICAL = ("char_wb_tfidf", "raw_char_tfidf", "char_tfidf", "ratio", "wratio", "jaro_winkler", "token_prefix")


def lexical_evidence(columns: list[str]) -> Column:
    """The best of the lexical scores that there are, each within [0, 1]."""
    return F.greatest(F.lit(0.0), F.lit(0.0), *(clamp(F.col(c).cast("double")) for c in LEXICAL if c in columns))


def adjusted_rerank_score(score: Column, evidence: Column) -> Column:
    evidence = clamp(evidence)
    return F.least(clamp(score), F.when(evidence < 0.20, 0.35).when(evidence < 0.30, 0.50).when(evidence < 0.40, 0.65).otherwise(1.0))


def candidate_rerank_weight(base: Column, evidence: Column, identifier: Column, ambiguous: Column) -> Column:
    evidence = clamp(evidence)
    cap = F.when(evidence < 0.20, 0.0).when(evidence < 0.30, 0.10).when(evidence < 0.40, 0.20).otherwise(0.50)
    return F.greatest(F.lit(0.0), F.least(base, cap, F.when(identifier, 0.10).otherwise(0.50), F.when(ambiguous, 0.20).otherwise(0.50)))


def final_decision(unique: Column, ambiguous: Column, final: Column, retrieval: Column, adjusted: Column, evidence: Column, margin: Column) -> Column:
    auto = (final >= 0.90) & (retrieval >= 0.70) & (adjusted >= 0.70) & (clamp(evidence) >= 0.55) & (margin >= 0.08)
    return F.when(final.isNull(), "UNKNOWN").when(unique, "AUTO_MATCH").when(ambiguous, "MANUAL_REVIEW").when(auto, "AUTO_MATCH").when(final >= 0.58, "MANUAL_REVIEW").otherwise("UNKNOWN")
