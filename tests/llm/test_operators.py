"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import decontam, html_extract, langid, ngram_join, packing, pii, quality, sharding, suffix_dedup, topk

SF = "/root/testdata/sf0.001"


def texts():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    base = [" ".join(word() for _ in range(r.randint(3, 160))) for _ in range(20)]
    out = [None, "", "   ", "one two", "One\ttwo", "x" * 5000]
    for b in base:
        out += [b, b]
        w = b.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 40)):
                v[r.randrange(len(v))] = word()
            out.append(" ".join(v))
    out.append(" ".join(base))
    out += [base[0] + " " + base[1], "zz " + base[1], base[2][:450] + " " + base[3][-450:]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i}", None) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("rank", df.doc_id).withColumn("digest", df.text).repartition(3)  # names that operators use themselves


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_sharding(spark, docs):
    rows = sharding.assign(docs, 5, 16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    n = [len(v) for v in by.values()]
    assert max(n) - min(n) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    t = dict(enumerate(texts()))
    assert all(r["size"] == len((t[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t[r["doc_id"]] or "").encode()) for r in rows)
    assert sharding.assign(empty(spark), 5, 16).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_topk(spark, monkeypatch, small):
    if small:  # several roots, trees and blocks
        for name, n in (("ROOT_ROWS", 40), ("TREE_ROWS", 50), ("QUERY_BLOCK", 9), ("PAGE", 8)):
            monkeypatch.setattr(topk, name, n)
    r = np.random.default_rng(0)
    v = [[float(x) for x in r.normal(size=8)] for _ in range(300)]
    v[5] = v[6] = v[7]
    ids = list(range(300))
    ids[17] = 20  # repeated ids, and a repeated row
    v.append(v[30])
    ids.append(30)
    v += [[3e38] * 8, [3e38] * 7 + [-3e38], [1.0, 2.0]]
    ids += [310, 311, 320]
    rows = [(i, x, 0) for i, x in zip(ids, v)] + [(900, None, 0), (901, [1.0, None] * 4, 0), (902, [float("nan")] * 8, 0), (None, [1.0] * 8, 0)]
    u = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)).withColumn("row", F.lit(1)).repartition(3), "vec_id", "embedding")
    index = topk.build(u)
    got = defaultdict(list)
    for x in topk.search(index, index.rows.where("vec_id % 10 = 0"), 10).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    w = [[int(np.floor(np.float64(np.float32(x)) * 1024)) for x in y] for y in v]
    score = lambda a, b: min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(w[a], w[b]))))
    want = defaultdict(list)
    for q, i in enumerate(ids):
        if i % 10 == 0 and len(w[q]) == 8:
            best = sorted((-score(q, c), j) for c, j in enumerate(ids) if c != q and len(w[c]) == 8)[:10]
            want[i] += [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    outside = topk.search(index, u.where("vec_id = 3"), 2).collect()  # not a row of the index: all rows take part
    assert sorted((x["rank"], x["vec_id"]) for x in outside) == [(k + 1, j) for k, (_, j) in enumerate(sorted((-score(3, c), j) for c, j in enumerate(ids) if len(w[c]) == 8)[:2])]
    none = topk.build(u.where("false"))
    assert topk.search(none, none.rows).count() == 0 and topk.search(none, u).count() == 0


def test_mtree_prunes_clusters():
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 16)) * 300
    m = np.floor(centres[r.integers(0, 30, 4000)] + r.normal(size=(4000, 16)) * 10)
    tree = topk.Tree(topk.build_tree(0, np.arange(4000), np.arange(4000), m), 16)
    for q in range(0, 4000, 400):
        best, computed = tree.search(m[q], 10, q)
        s = (m @ m[q]).astype(int)
        assert [(x, i) for x, i, _ in best] == [(int(s[i]), i) for i in sorted((i for i in range(4000) if i != q), key=lambda i: (-s[i], i))[:10]]
        assert computed < 2000


def test_decontamination(spark, docs):
    t = texts()
    items = [(1, " ".join(t[6].split()[:20])), (2, "one TWO"), (3, None), (10, ""), (11, "one, two")]
    got = {r["doc_id"]: r for r in decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda s: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    for i, s in enumerate(t):
        w, hit, found = split(s), set(), set()
        for k, x in items:
            for win in decontam.windows(split(x)):
                for a in range(len(w) - len(win) + 1):
                    if tuple(w[a : a + len(win)]) == win:
                        hit |= set(range(a, a + len(win)))
                        found.add(str(k))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    near = decontam.proximity_matches(decontam.build_index(docs), spark.createDataFrame([(2, "two one")], "item_id long, text string"), 1).collect()
    assert {r["doc_id"] for r in near} == {3, 4}


def test_packing(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows, t = packing.pack(docs).collect(), texts()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, s in enumerate(t):
        ids = np.array(tok.encode(s or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == packing.cut(len(ids), 1024)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(empty(spark)).count() == 0


def test_bin_completion_is_optimal_on_small_cases():
    r = random.Random(4)

    def best(items, bins=()):
        if not items:
            return len(bins)
        out = len(items) + len(bins)
        for k in {b: j for j, b in enumerate(bins) if b + items[0] <= 20}.values():
            out = min(out, best(items[1:], (*bins[:k], bins[k] + items[0], *bins[k + 1 :])))
        return min(out, best(items[1:], (*bins, items[0])))

    for _ in range(25):
        items = sorted((r.randint(3, 15) for _ in range(8)), reverse=True)
        got, bound = packing.bin_completion(dict(Counter(items)), 20)
        assert sum(n for _, n in got) == best(items) >= bound
        assert Counter(x for p, n in got for x in p * n) == Counter(items)


def test_bin_completion_tries_all_undominated_fillings():
    items = [460, 450, 440, 430, 420, 350, 340, 330, 320, 310] + [254] * 5
    got, bound = packing.bin_completion(dict(Counter(items)), 1024)
    assert sum(n for _, n in got) == 5 == bound
    assert Counter(x for p, n in got for x in p * n) == Counter(items)
    counts = {2: 3, 3: 2, 5: 1, 7: 1}
    every = [f for f in packing.fillings(sorted(counts), counts, 12, 2) if f]
    ways = ((7,) * a + (5,) * b + (3,) * c + (2,) * d for a in range(2) for b in range(2) for c in range(3) for d in range(4))
    want = {(12 - sum(f), f) for f in ways if 10 <= sum(f) <= 12 and not packing._dominated(f, 12 - sum(f), sorted(counts), counts)}
    assert len(every) == len(want) and set(every) == want
    assert all([x for x in packing.fillings(sorted(counts), counts, 12, 2, f) if x] == every[i + 1 :] for i, f in enumerate(every))


def test_encoder():
    e = packing.Encoder()
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(e.path)
    for s in ("", " a  b\n\n c", "x<|endoftext|>y", "d'été 1234 ßß", " 　 z", "a" * 3000):
        assert e(s) == full.encode(s, add_special_tokens=False).ids


def test_ngram_join(spark, docs):
    t = texts()
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def shingles(s):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(s) for s in t]
    root = list(range(len(t)))
    for _ in t:
        for a in range(len(t)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(t))}
    assert ngram_join.join(empty(spark)).count() == 0


def test_suffix_dedup(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_ENTRIES", 7)  # several ranges
    t = [(s or "").encode() for s in texts()]
    seen = Counter(b[a : a + 400] for b in t for a in range(len(b) - 399))
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs).collect()}
    for i, b in enumerate(t):
        gone = {p for a in range(len(b) - 399) if seen[b[a : a + 400]] > 1 for p in range(a, a + 400)}
        rest = bytes(x for p, x in enumerate(b) if p not in gone)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), len(gone), sum(p - 1 not in gone for p in gone)), i
        assert r["kept_sha256"] == hashlib.sha256(rest).hexdigest()
    assert suffix_dedup.dedup(empty(spark)).count() == 0


def test_loser_tree():
    r = random.Random(2)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randint(0, 9))) for _ in range(5)]
    coded = [[(k, (n, j), suffix_dedup.common(run[j - 1], k) if j else 0) for j, k in enumerate(run)] for n, run in enumerate(runs)]
    got = list(suffix_dedup.LoserTree(coded))
    assert [k for _, k, _ in got] == sorted(k for run in runs for k in run)
    assert all(c == suffix_dedup.common(a[1], k) for a, (c, k, _) in zip(got, got[1:]))


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain text", "plain text"),
    ("<body><nav><a href=x>Menu</a></nav><div class='content'><h1>T &amp; U</h1><p>One, two,\n three.<p>Four <b>bold</b><br>five.<script>x('</p>')</script></div><div id=comments><p>Nice, very nice, indeed.</p></div><footer>f</footer></body>", "T & U\nOne, two, three.\nFour bold five."),
    ("<article><p>A, b.</p><aside><p>Not, this, one.</p></aside><form>no</form><ul><li>x<li>y</ul></article>", "A, b.\nx\ny"),
])
def test_html(page, want):
    assert html_extract.extract(page) == want


def test_html_scores_containers_far_above_paragraphs():
    texts = [f"Paragraph number {i}, of a page, whose container stands far above it." for i in range(40)]
    page = "<body><div>" + "".join("<div>" * 5 + f"<p>{t}</p>" + "</div>" * 5 for t in texts) + "</div></body>"
    assert html_extract.extract(page) == "\n".join(texts)


def test_pii_base_and_added():
    card, other = "4111111111111111", "5500005555555559"
    s = f"a.b@c.de x 1.2.3.4 y 1.2.3.999 or {card} and +1 (487) 555-7209."
    assert [(k, s[a:e]) for a, _, e, k in pii.base_spans(s)] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", card), ("phone", "+1 (487) 555-7209")]
    side = f"pay {card} {other} now"
    assert pii.base_spans(side) == []  # one run of 32 digits
    found = {side[s:e] for k, s, e in pii.proposals(side) if k == 2}
    assert {card, other} <= found
    assert pii._redact("x a@b.c y", pii.base_spans("x a@b.c y")) == "x [EMAIL] y"


def test_pii_proposals_are_whole():
    assert all(pii._ANY.search(s) and pii.proposals(s) for s in ("mail jane.doe (at) example.com now", "mail jane.doe [AT] example.com now"))
    card, other = (" ".join(c) for c in ("4111111111111111", "5500005555555559"))
    pairs = "12 34 56 78 90 12 34 56 78 9"
    s = f"{card} {other} and {pairs}."
    assert {card, other, pairs} <= {s[a:e] for k, a, e in pii.proposals(s) if k == 2}


def test_pii_adds_phones_without_plus():
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows = []
    for _ in range(150):
        rows += pii.labelled(f"call us at +1 ({digits(3)}) {digits(3)}-{digits(4)} or write, id a{digits(11)}b on 2024-{digits(2)}-{digits(2)} {digits(4)}.")
    model = pii.Model([rows[i] for i in np.random.default_rng(7).permutation(len(rows))])
    for phone in ("(487) 555-7209", "1 (487) 555-7209"):
        s = f"so call us at {phone} today, key x12345678901y."
        found = pii.proposals(s)
        p = model.probability(np.array([pii.features(s, *f) for f in found]))
        assert [(k, s[a:e]) for a, _, e, k in pii.select(s, pii.base_spans(s), found, p, model.threshold)] == [("phone", phone)]


def test_pii_sample_is_bounded_and_has_each_text_once(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 40)
    monkeypatch.setattr(pii, "SAMPLE_SPANS", 50)
    seen = []
    monkeypatch.setattr(pii, "Model", seen.append)
    copies = ["token a12345678901b c12345678901d " * 20] * 100
    others = [f"mail user{i}@example.com" for i in range(60)]
    for n in (1, 5):
        pii.train(spark.createDataFrame([(t,) for t in copies + others], "text string").repartition(n))
    assert sorted(seen[0]) == sorted(seen[1])
    assert len(seen[0]) <= 50 and sum(y for _, y in seen[0]) >= 5
    monkeypatch.setattr(pii, "SAMPLE_SPANS", 60_000)
    pii.train(spark.createDataFrame([(t,) for t in copies + others], "text string"))
    assert 39 * 5 <= sum(y for _, y in seen[2]) <= 40 * 5  # each address as it stands and in four other forms


def test_pii_query(spark, docs):
    model = pii.train(docs)
    rows = pii.detect(docs, model).collect()
    assert len(rows) == len(texts()) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.scrub(docs, model).columns == docs.columns and pii.detect(empty(spark), model).count() == 0


def test_quality(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(d, labels)
    theta = m.thresholds()
    assert (np.diff(theta) > 0).all()
    got = {r["doc_id"]: r for r in quality.score(d, m).collect()}
    want = labels.select("doc_id", quality.grade().alias("g")).collect()
    assert np.mean([got[r["doc_id"]]["keep"] == (r["g"] == 2) for r in want if r["doc_id"] in got]) > 0.9
    assert quality.score(empty(spark), m).count() == 0
    assert not quality.score(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), m).where("keep").count()


def test_quality_counts_capitals_of_whole_texts():
    number = quality.Features()
    for n in (100, 4000, 50_000):  # every stride over the text meets capitals only, or small letters only
        found = set(number("Ab" * n).tolist())
        assert number.number("\0caps5") in found and number.number("\0caps6") not in found


def test_ordinal_gradient_reduces_loss():
    r = np.random.default_rng(0)
    x = [r.choice(64, 8, replace=False).astype(np.int32) for _ in range(400)]
    y = np.array([min(2, int((a < 20).sum()) // 2) for a in x])
    m = quality.Ordinal(6).fit(x, y, epochs=30)
    s = m.score(x)
    assert (np.searchsorted(m.thresholds(), s) == y).mean() > 0.8


def test_bigru_gradient():
    m = langid.BiGRU(["a", "b"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    codes, y = langid.encode([b"abc", b"bd", b"caab"], 5), np.array([0, 1, 1])
    _, grad = m.loss(codes, y)
    for k in ("u", "v", "c", "b", "x"):
        flat, g = m.p[k].reshape(-1), grad[k].reshape(-1)
        for at in (np.argsort(-np.abs(g))[:3]).tolist():
            old = flat[at]
            flat[at] = old + 1e-3
            up = m.loss(codes, y)[0]
            flat[at] = old - 1e-3
            down = m.loss(codes, y)[0]
            flat[at] = old
            assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_langid(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.train(d)
    got = langid.predict(d, m).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.selectExpr("count(*)", "count_if(lang = lang_pred)").first()
    assert right / n > 0.97
    odd = langid.predict(spark.createDataFrame([(1, None), (2, "12 !")], "doc_id long, text string"), m).collect()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in odd)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in P.STAGES[:-1]:
        after = P.materialize(stage(spark, docs, SF), name)
        assert after.columns == docs.columns and after.count() <= n
        if name == "near_duplicates":
            g = ngram_join.join(docs).collect()
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in g}
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontam.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect()} - bad
        docs, n = after, after.count()
    assert P.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == n
