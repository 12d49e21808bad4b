"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base spans follow fixed patterns and checks and always stay. The patterns alone lose what stands side by side (two card
numbers with a space between are one run of 32 digits, which fails its check) or is written around a rule ("x at y dot
com", a number without its plus). Generators therefore propose many overlapping spans; boosted trees, trained here on
a bounded sample with the base spans, and what these look like in forms that the patterns don't find, as positives and
with proposals that contradict every check, or cut into a positive, as negatives, score them; per kind, the lowest
calibrated probability that kept the wanted precision on held-out proposals selects spans, best first, which are added
where they overlap no span so far.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.boosting import Boosted, platt
from quillmesh.llm.common import need, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Most documents, and proposals of these, that the classifier is trained on.
SAMPLE_DOCS, SAMPLE_SPANS = 6000, 60_000
PRECISION = 0.995
MIN_PROBABILITY = 0.9

_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]|[(\[ ]dot[)\] ]", re.I)
_AT = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{2,63}){1,4}"
    r"|[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,4}",
    re.I,
)
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
_RUN = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
_GROUP = re.compile(r"[0-9]+")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[\x20.-]*(?=[(0-9])")
_DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)[0-9]{2})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def valid(kind: str, span: str) -> bool:
    """The check that a base match must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in span.split("."))
    digits = re.sub("[^0-9]", "", span)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind that pass their check, as (start, kind order, end, kind) sorted by start and kind."""
    out = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Overlapping (kind order, start, end): all that could be of a kind."""
    out = [(0, m.start(), m.end()) for m in _AT.finditer(text)]
    out += [(1, m.start(), m.end()) for m in _QUAD.finditer(text)]
    for run in _RUN.finditer(text):
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in _GROUP.finditer(run.group())]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                lead = groups[i][0]
                while lead > run.start() and text[lead - 1] in "+(":
                    lead -= 1
                if 10 <= digits <= 15:
                    out.append((3, lead, groups[j][1]))
                if 13 <= digits and not re.search(r"[().]", text[groups[i][0] : groups[j][1]]):
                    out.append((2, groups[i][0], groups[j][1]))
    return out


_WORDS = [re.compile(w, re.I) for w in ("tel|phone|call|fax|mobile", "card|visa|credit|amex", r"\bip\b|host|server|addr", "mail|contact", "version|license|licence|v\\.|release", "token|key|hash|id|sha")]


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    groups = [len(g) for g in _GROUP.findall(span)] or [0]
    digits = re.sub("[^0-9]", "", span)
    side = lambda c: 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isdigit() else 3.0 if c.isalpha() else 5.0 if c in "+-" else 4.0
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    octets = [int(g) for g in _GROUP.findall(span)[:4] if len(g) <= 9] or [0]
    return [
        float(kind), float(len(digits)), float(bool(digits) and luhn(digits)), float(len(groups)), float(groups[0]), float(groups[-1]), float(min(groups)), float(max(groups)),
        float(span[:1] == "+"), float("(" in span), float(span.count(".")), float(span.count("-")), float(span.count(" ")), float(max(octets)), float("@" in span),
        float(len(span)), float(len(span.rsplit(".", 1)[-1])), side(before[-1:]), side(after[:1]), side(after[1:2]),
        float(before[-1:] == " " and before[-2:-1].isdigit()), float(after[:1] == " " and after[1:2].isdigit()), *(float(bool(w.search(before))) for w in _WORDS),
    ]


def labelled(text: str) -> list[tuple[list[float], int]]:
    """Proposals that the patterns judge beyond doubt: base spans are positive; what cuts into one, or fails every check of its kind, is negative.

    Each base span is also judged in the forms of _rewritten(), where it stands.
    """
    base = base_spans(text)
    exact = {(k, s, e) for s, k, e, _ in base}
    out = []
    for k, s, e in proposals(text):
        if (k, s, e) in exact:
            out.append((features(text, k, s, e), 1))
        elif any(s < b and a < e for a, _, b, _ in base) or not _plausible(k, text, s, e):
            out.append((features(text, k, s, e), 0))
    for a, k, b, kind in base:
        for form, first, last in _rewritten(kind, text[a:b]):
            near = text[max(0, a - 80) : a] + form + text[b : b + 80]
            at = min(a, 80)
            want = {(k, at, at + first), (k, at + last, at + len(form))}
            for f in proposals(near):
                if f[1] < at + len(form) and at < f[2]:
                    out.append((features(near, *f), int(f in want)))
    return out


def _rewritten(kind: str, span: str) -> list[tuple[str, int, int]]:
    """A base span as people also write it and the patterns don't find it: (form, end of the first, start of the last of its spans)."""
    found = []
    if kind == "phone":  # without its plus, and without its country code where enough digits are left
        found.append(span[1:])
        if (m := _COUNTRY.match(span)) and valid("phone", span[m.end() :]):
            found.append(span[m.end() :])
    elif kind == "email":
        name, host = span.split("@")
        found += [f"{name} (at) {host}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}(at){host.replace('.', '(dot)')}", f"{name} at {host.replace('.', ' dot ')}"]
    elif kind == "card":  # two side by side are one run of digits, which is no card
        other = span[:-2] + span[-1] + span[-2] if luhn(re.sub("[^0-9]", "", span[:-2] + span[-1] + span[-2])) else span
        return [(f"{span} {other}", len(span), len(span) + 1)]
    return [(f, len(f), 0) for f in found]


def _plausible(kind: int, text: str, start: int, end: int) -> bool:
    span = text[start:end]
    if kind == 0:
        return True
    if kind == 3:
        return valid("phone", span) and (span[:1] == "+" or _written(text, start, end))
    return valid(KINDS[kind], span)


def _written(text: str, start: int, end: int) -> bool:
    """Whether digits without a plus stand as a phone number may: apart from letters, and in groups or after a word for it, not as a date."""
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() or _DATE.search(text[start:end]):
        return False
    return len(_GROUP.findall(text[start:end])) > 1 or bool(_WORDS[0].search(text[max(0, start - 24) : start]))


class Model:
    """The trees, the calibration and each kind's threshold."""

    def __init__(self, rows: list[tuple[list[float], int]]):
        x = np.array([r[0] for r in rows], float) if rows else np.zeros((0, len(features("", 0, 0, 0))))
        y = np.array([r[1] for r in rows], float)
        held = np.arange(len(y)) % 3 == 0
        self.trees = Boosted().fit(x[~held], y[~held])
        self.a, self.b = platt(self.trees.raw(x[held]), y[held]) if held.any() else (1.0, 0.0)
        self.threshold = {}
        p = self.probability(x[held]) if held.any() else np.zeros(0)
        for k in range(len(KINDS)):
            at = x[held][:, 0] == k if held.any() else np.zeros(0, bool)
            order = np.argsort(-p[at], kind="stable")
            right = y[held][at][order].cumsum() / np.arange(1, int(at.sum()) + 1)
            fine = np.flatnonzero(right >= PRECISION)
            least = p[at][order][fine[-1]] if len(fine) and y[held][at].sum() >= 5 else 2.0
            self.threshold[k] = max(MIN_PROBABILITY, float(least))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.trees.raw(x) + self.b, -40, 40)))


def select(text: str, base: list, found: list, p: np.ndarray, threshold: dict) -> list[tuple[int, int, int, str]]:
    """Base spans and the proposals above their thresholds, best first, that overlap no span so far."""
    taken: list[tuple[int, int]] = []  # disjoint: base spans of several kinds may overlap each other
    for s, e in sorted((s, e) for s, _, e, _ in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = list(base)
    for i in sorted(np.flatnonzero(p >= min(threshold.values())).tolist(), key=lambda i: (-p[i], found[i][1], -found[i][2])):
        k, s, e = found[i]
        if p[i] < threshold[k]:
            continue
        at = bisect_left(taken, (s, e))
        if at < len(taken) and taken[at][0] < e or at and taken[at - 1][1] > s:
            continue
        taken.insert(at, (s, e))
        out.append((s, k, e, KINDS[k]))
    return sorted(out)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Trains on at most SAMPLE_DOCS different texts, those of the smallest hashes, and SAMPLE_SPANS of their proposals, again by hash."""
    hashed = need(docs, text).where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]  # a top-k of hashes

    def run(batches):
        for b in slices(batches, 256):
            rows = [(h, k, *r) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if _ANY.search(t) for k, r in enumerate(labelled(t))]
            types = (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["h", "k", "x", "y"])

    picked = hashed.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("text").alias("text"))  # copies meet as one before the shuffle
    found = picked.mapInArrow(run, "h long, k int, x array<double>, y int")
    rows = found.orderBy(F.xxhash64("h", "k"), "h", "k").limit(SAMPLE_SPANS).select("x", "y").collect()
    rows.sort(key=lambda r: (r["x"], r["y"]))  # the same rows give the same model, in whichever order they came
    mixed = np.random.default_rng(7).permutation(len(rows))
    return Model([(list(rows[i]["x"]), rows[i]["y"]) for i in mixed])


def _digest(spans: list) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def detect(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """Counts and spans of every whole text (null: empty); with ``redact`` also the text with every span as ``[KIND]``, null for null.

    Offsets are code points, ends exclusive. Repeated rows give one row each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

    def run(batches):
        m = sent.value
        names = [f.split()[0] for f in RESULT.split(", ")]
        for b in slices(batches, 512):
            texts = b.column(1).to_pylist()
            base = [base_spans(t) if t and _ANY.search(t) else [] for t in texts]
            found = [proposals(t) if t and _ANY.search(t) else [] for t in texts]
            x = [features(t, *f) for t, fs in zip(texts, found) for f in fs]
            p = m.probability(np.array(x)) if x else np.zeros(0)
            out, at = [], 0
            for i, t, bs, fs in zip(b.column(0).to_pylist(), texts, base, found):
                spans = select(t, bs, fs, p[at : at + len(fs)], m.threshold) if fs else bs
                at += len(fs)
                kinds = [s[3] for s in bs]
                out.append((i, *(kinds.count(k) for k in KINDS), hashlib.sha256(_digest(bs).encode()).hexdigest(), _digest(spans), _redact(t, spans) if redact else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*out))], names)

    return need(docs, doc_id, text).select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, RESULT)


def _redact(text: str | None, spans: list) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s, _, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def op10_boosted(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return detect(docs, train(docs)).drop("redacted")


def scrub(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows with every span replaced by ``[KIND]``; the count of characters, if there is such a column, follows the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    count = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def run(batches):
        m = sent.value
        for b in slices(batches, 512):
            texts = b.column(at).to_pylist()
            base = [base_spans(t) if t and _ANY.search(t) else [] for t in texts]
            found = [proposals(t) if t and _ANY.search(t) else [] for t in texts]
            x = [features(t, *f) for t, fs in zip(texts, found) for f in fs]
            p = m.probability(np.array(x)) if x else np.zeros(0)
            out, begin = [], 0
            for t, bs, fs in zip(texts, base, found):
                out.append(_redact(t, select(t, bs, fs, p[begin : begin + len(fs)], m.threshold) if fs else bs))
                begin += len(fs)
            columns = list(b.columns)
            columns[at] = pa.array(out, b.column(at).type)
            if count is not None:
                columns[count] = pa.array([n if o == t else len(o) for n, o, t in zip(columns[count].to_pylist(), out, texts)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
