"""Hot groups, repeated rows, very long texts, empty tables, and the brute-force versions that test_operators.py lacks."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import common, decontam, exchange, html_extract, langid, ngram_join, packing, pii, quality, sharding, suffix_dedup, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(parts)


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, getConf = "spark://host:7077", staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(Session)


@pytest.mark.parametrize("words", [0, 1, 2])
def test_exchange_totals(spark, words):
    """Totals of keys over all origins, one key in every origin many times."""
    r = random.Random(3)
    origins = [[tuple(r.randrange(50) for _ in range(max(1, words))) for _ in range(r.randint(0, 40))] + [(7,) * max(1, words)] * 30 for _ in range(12)]
    want = Counter(k for o in origins for k in o)

    def deal(batches):
        for b in batches:
            for n in b.column(0).to_pylist():
                share = exchange.Share(np.array(origins[n], np.uint64).reshape(-1, max(1, words)), 5, short=not words)
                yield share.batch(n.to_bytes(8, "little") + share.number.astype(np.int64).tobytes())

    def home(member, found):
        n, number = int.from_bytes(member[:8], "little"), np.frombuffer(member, np.int64, offset=8)
        return pd.DataFrame({"origin": n, "totals": [found[number].tolist()]})

    dealt = spark.range(12, numPartitions=4).mapInArrow(deal, exchange.SCHEMA)
    got = exchange.totals(dealt, words, home, "origin long, totals array<long>", "test").collect()
    assert len(got) == 12 and all(list(x["totals"]) == [want[k] for k in origins[x["origin"]]] for x in got)


def brute_removed(texts):
    seen = Counter(b[a : a + 400] for b in texts for a in range(len(b) - 399))
    return [sorted({p for a in range(len(b) - 399) if seen[b[a : a + 400]] > 1 for p in range(a, a + 400)}) for b in texts]


def test_suffix_dedup_trades_left_against_right(spark, monkeypatch):
    """Pieces of one stock text, cut at random, so that a context's partners differ to either side; several runs, ranges and copies of a row."""
    monkeypatch.setattr(suffix_dedup, "PART_ENTRIES", 9)
    monkeypatch.setattr(suffix_dedup, "ORIGIN_ENTRIES", 30)
    opened = []
    windows = suffix_dedup._windows
    monkeypatch.setattr(suffix_dedup, "_windows", lambda *a: opened.append(1) or windows(*a))
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    stock = noise(1500)
    rows = [(1, stock), (1, stock), (None, stock[100:700]), (3, None), (4, "")]
    for i in range(40):
        a = r.randrange(1000)
        rows.append((10 + i, noise(r.randrange(300)) + stock[a : a + r.randint(150, 700)] + noise(r.randrange(300))))
    rows += [(100 + i, "y" * 900) for i in range(3)] + [(200, "ab" * 700)]
    texts = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), b, gone in zip(rows, texts, brute_removed(texts)):
        rest = bytes(x for p, x in enumerate(b) if p not in set(gone))
        want[i, len(b), len(gone), sum(p - 1 not in set(gone) for p in gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")] += 1
    got = suffix_dedup.dedup(frame(spark, rows, 5), keep_text=True).collect()
    assert Counter(map(tuple, got)) == want and opened


def test_ngram_join_with_frequent_ngrams_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(ngram_join, "ORIGIN_POSTINGS", 100)
    monkeypatch.setattr(ngram_join, "HOT_PAIRS", 3)
    r = random.Random(2)
    line = "this line stands in very many of the texts"
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    base = [f"{line} " + " ".join(word() for _ in range(60)) for _ in range(6)]
    rows = [(i, f"{line} " + " ".join(word() for _ in range(r.randint(4, 40)))) for i in range(60)]
    for k, b in enumerate(base):
        w = b.split()
        for j in range(8):
            v = list(w)
            v[r.randrange(9, len(v))] = word()
            rows.append((100 + 10 * k + j, " ".join(v)))
    rows += [(100, base[1]), (100, base[1]), (7, None), (None, base[0]), (300, ""), (301, line)]
    grams = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set()
    sets = [grams(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for (a, _), x in zip(rows, sets):
            for (b, _), y in zip(rows, sets):
                if a is not None and b is not None and x and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.join(frame(spark, rows, 4)).collect())
    assert got == Counter((i, len(s), None if i is None else root[i]) for (i, _), s in zip(rows, sets))


PAGES = [
    # commas and length decide between two plain containers
    ("<body><div><p>Home</p><p>About</p></div><div><p>The river rose, slowly at first, then fast, and by noon the bridge was gone.</p><p>Nobody was hurt, the mayor said, but the mill is lost, and the road.</p></div></body>",
     "The river rose, slowly at first, then fast, and by noon the bridge was gone.\nNobody was hurt, the mayor said, but the mill is lost, and the road."),
    # a list of links with many commas is discounted
    ("<body><div>" + "".join(f"<p><a href=x>Offer {i}, cheap, new, big, red, and much more</a></p>" for i in range(9)) + "</div><div><p>A short story, told once, of a cat.</p><p>It slept, it ate, it slept again.</p></div></body>",
     "A short story, told once, of a cat.\nIt slept, it ate, it slept again."),
    # paragraphs in wrappers of their own: the container above them
    ("<body><div id=x><div><p>One thing, and another, came to pass in the town.</p></div><div><p>Then, as ever, it rained, and we went home.</p></div></div><div><p>Imprint</p></div></body>",
     "One thing, and another, came to pass in the town.\nThen, as ever, it rained, and we went home."),
    # a sibling that scores well is kept, a poor one isn't
    ("<body><section><p>" + "Long, rich, full text of the story, with commas, goes on here. " * 3 + "</p></section><section><p>" + "Its second half, no less long, and as rich, follows here. " * 3 + "</p></section><section><p>Tags</p></section></body>",
     ("Long, rich, full text of the story, with commas, goes on here. " * 3).strip() + "\n" + ("Its second half, no less long, and as rich, follows here. " * 3).strip()),
    # table cells
    ("<table><tr><td>Menu<td><p>In the old style, the text stands in a cell, beside the menu, as this one does.<p>And so, it goes on, for a while.</table>",
     "In the old style, the text stands in a cell, beside the menu, as this one does.\nAnd so, it goes on, for a while."),
    # bare text in a div
    ("<body><div>Read more</div><div>Some writers, long ago, put all their text into a div, without any paragraph.</div></body>",
     "Some writers, long ago, put all their text into a div, without any paragraph."),
    # an advert left open within the story
    ("<body><div><p>First, the news of the day, in short.<p class=advert>Buy, buy, buy now<p>Then, the weather, which is fine, and warm.</div><div><p>Login</p></div></body>",
     "First, the news of the day, in short.\nThen, the weather, which is fine, and warm."),
    # list items, one of them an advert left open
    ("<body><div><ul><li>Apples, pears, and plums, all fresh<li class=promo>Click here<li>Bread, butter, and cheese, as ever</ul></div><div>x</div></body>",
     "Apples, pears, and plums, all fresh\nBread, butter, and cheese, as ever"),
    # comments below the story are taken out though they score
    ("<body><div class=post><p>A calm, short, and plain report, on roads, was read.</p></div><div class=comments>" + "<p>Well, I, for one, do not, ever, agree, at all, you know.</p>" * 8 + "</div></body>",
     "A calm, short, and plain report, on roads, was read."),
    # quotes are part of the story
    ("<body><div><p>She spoke, at last, in a low voice.</p><blockquote>It was late, so late, that nobody, not one, was left.</blockquote><p>Then, quietly, she left.</p></div><aside><p>Most read, today, and ever, and always, and more</p></aside></body>",
     "She spoke, at last, in a low voice.\nIt was late, so late, that nobody, not one, was left.\nThen, quietly, she left."),
    # an open menu ends with its parent
    ("<body><div><nav><a href=x>Menu</a></div><div><p>The text, after an open menu, is still there.</p></div></body>", "The text, after an open menu, is still there."),
]


def test_html_points_decide(spark):
    rows = [(i, f"u{i}", h, 1) for i, (h, _) in enumerate(PAGES)] + [(50, None, None, 1), (50, "", "", 1), (None, "x", "<p>plain</p>", 1)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long").repartition(2)).collect()
    found = {x["page_id"]: (x["url"], x["text"], x["n_chars"]) for x in got}
    assert len(got) == len(rows)
    for i, (_, want) in enumerate(PAGES):
        assert found[i] == (f"u{i}", want, len(want))
    assert found[None][1] == "plain" and found[50][1:] == ("", 0)
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("tag", ["div", "b", "li", "blockquote", "p"])
def test_html_is_linear_in_depth(tag):
    took = []
    for n in (10_000, 80_000):
        t = time.process_time()
        html_extract.extract(f"<{tag}>some text, of a length that counts" * n)
        took.append(time.process_time() - t)
    assert took[1] < 30 * took[0] + 1


def test_packing_reaches_the_optimum_and_keeps_long_texts(spark):
    sizes = Counter([216, 217, 356, 250, 568, 379, 291, 317, 325, 209, 216, 502])
    got, _ = packing.bin_completion(dict(sizes), 1000)
    assert sum(n for _, n in got) == 4 and Counter(x for p, n in got for x in p * n) == sizes
    long = "alpha beta, gamma 12345 " * 17_000  # over 400,000 characters
    e = packing.Encoder()
    assert len(long) > 400_000 and e(long)[:1000] == e(long[:20_000])[:1000]
    rows = packing.pack(frame(spark, [(1, long), (1, long), (2, None), (None, "x")])).collect()
    ids = len(e(long)) + 1
    by = [x for x in rows if x["doc_id"] == 1]
    assert sum(x["length"] for x in by) == 2 * ids and Counter(x["piece"] for x in by) == {k: 2 for k in range(len(packing.cut(ids, 1024)))}
    bins = {}
    for x in rows:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    assert all(sum(n for _, n in b) <= 1024 and all(a == sum(n for _, n in sorted(b)[:k]) for k, (a, _) in enumerate(sorted(b))) for b in bins.values())


def test_langid_numerals_are_no_letters(spark):
    model = langid.BiGRU(["a", "b"], hidden=2)
    rows = [(1, "½"), (2, "² Ⅷ"), (3, None), (4, ""), (5, "é"), (5, "é"), (None, "ж" * 500)]
    got = sorted((x["doc_id"] or 0, x["lang_pred"]) for x in langid.predict(frame(spark, rows), model).collect())
    assert [p == "und" for _, p in got] == [False, True, True, True, True, False, False]
    assert langid.predict(frame(spark, [(1, "x")]).where("false"), model).count() == 0


def test_langid_pools_all_positions():
    """The mean over every position of the whole text, window by window."""
    m = langid.BiGRU(["a", "b", "c"], hidden=3)
    texts = [b"abc", bytes(range(97, 123)) * 23, b"z" * 129]
    got = langid.pooled(m, texts)
    for t, row in zip(texts, got):
        q = np.concatenate([m.probabilities(m.states(langid.encode([w], langid.SPAN)))[: len(w), 0] for w in (t[a : a + langid.SPAN] for a in range(0, len(t), langid.SPAN))])
        assert np.allclose(q.mean(0), row, atol=1e-5)


def personal(r):
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))

    def card():
        body = r.choice("45") + digits(14)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    mail = f"{word()}.{word()}@{word()}.com"
    return word, {"email": mail, "ip": ".".join(str(r.randrange(256)) for _ in range(4)), "card": card(), "phone": f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"}, card


def test_pii_recall_of_planted_spans(spark):
    """Trained on documents with plain data, looked for in others in forms that the patterns don't find; nothing is added to clean ones."""
    r = random.Random(6)
    rows = []
    for i in range(500):
        word, data, _ = personal(r)
        rows.append((i, f"{' '.join(word() for _ in range(r.randint(5, 20)))} {data[r.choice(list(data))]} {' '.join(word() for _ in range(5))} item {r.randrange(10**6)} of {r.randrange(2000, 2030)}-10-{r.randrange(10, 29)}"))
    model = pii.train(frame(spark, rows))
    planted, clean = [], []
    for i in range(120):
        word, data, card = personal(r)
        mail = data["email"]
        form = [("email", mail.replace("@", " (at) ")), ("email", mail.replace("@", " at ").replace(".com", " dot com")), ("phone", data["phone"][1:]), ("phone", data["phone"][3:]), ("card", data["card"])][i % 5]
        extra = f" {card()}" if form[0] == "card" else ""
        before = " ".join(word() for _ in range(6)) + " "
        planted.append((i, before + form[1] + extra + " " + word(), form[0], len(before), len(before) + len(form[1])))
        clean.append((i, " ".join(word() for _ in range(20)) + f" {r.randrange(10**9)} and {r.randrange(1900, 2030)}-12-01, at noon, version {r.randrange(9)}.{r.randrange(99)}"))
    got = {x["doc_id"]: x["spans"].split(",") for x in pii.detect(frame(spark, [x[:2] for x in planted]), model).collect()}
    by = Counter(k for _, _, k, _, _ in planted)
    caught = Counter(k for i, _, k, a, z in planted if any(s.split(":")[0] == k and int(s.split(":")[1]) <= a + 12 and int(s.split(":")[2]) >= z for s in got[i] if s))
    assert all(caught[k] >= 0.9 * by[k] for k in by), (caught, by)
    assert not [x for x in pii.detect(frame(spark, clean), model).collect() if x["spans"]]


def test_pii_base_spans_against_the_patterns_alone(spark):
    """Every document of the small tables: the contract's patterns one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = pii.Model([])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub(r"\D", "", s)) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
    ]
    n = 0
    for d, x in zip(docs.orderBy("doc_id").collect(), pii.detect(docs, model).orderBy("doc_id").collect()):
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, d["text"] or "") if ok(m[0]))
        text = ",".join(f"{name}:{a}:{z}" for a, _, z, name in spans)
        assert x["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) == tuple(sum(s[3] == k for s in spans) for k in pii.KINDS)
        n += len(spans)
    assert n > 10


def test_pii_added_spans_overlap_none():
    text = "a.1.1.1.1.2.2.2.2.3.3.3.3.4.4.4.4.5.5.5.5.6.6.6.6@x.example"
    base = pii.base_spans(text)
    found = [(3, 3, 12), (3, 0, len(text))]
    assert pii.select(text, base, found, np.ones(2), {k: 0.9 for k in range(4)}) == base


def test_ring_against_a_walk_key_by_key(spark):
    rows = [(r % 7 if r < 60 else r, f"t{r}") for r in range(150)] + [(None, None), (None, "x")]
    docs = frame(spark, rows)
    got = sharding.assign(docs, 4, 3).collect()
    place = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    nodes = sharding.ring(4, 3)
    first = lambda h: next((k for k, (p, _) in enumerate(nodes) if p >= h), 0)
    assert all(x["home_shard"] == nodes[first(place[x["doc_id"]])][1] for x in got)
    n = len(rows)
    room = [n // 4 + (s < n % 4) for s in range(4)]
    waiting = Counter(first(place[i]) for i, _ in rows)
    waiting = {(a, a): c for a, c in waiting.items()}  # (arc, node it stands before): keys
    want = Counter()
    while waiting:
        on = Counter()
        for (arc, node), c in sorted(waiting.items()):
            for _ in range(c):
                s = nodes[node][1]
                if room[s]:
                    room[s] -= 1
                    want[arc, s] += 1
                else:
                    k = (node + 1) % len(nodes)
                    while not room[nodes[k][1]]:
                        k = (k + 1) % len(nodes)
                    on[arc, k] += 1
        waiting = on
    assert Counter((first(place[x["doc_id"]]), x["shard"]) for x in got) == want


def test_quality_scores_by_hand(spark):
    """expected_grade and tail_probability from the weights, for every row of a small table with repeated and empty rows."""
    r = np.random.default_rng(4)
    rows = [(1, "Good words, all of them."), (1, "Good words, all of them."), (2, None), (3, ""), (4, "x" * 100_000), (None, "BAD!!!")]
    m = quality.Ordinal()
    m.w = r.normal(size=len(m.w)).astype(np.float32).astype(float)
    m.first, m.steps = -0.5, np.array([0.2])
    number = quality.Features()
    features = {t: number(t) for _, t in rows}
    got = sorted((x["doc_id"] or 0, round(x["expected_grade"], 6), round(x["tail_probability"], 6), x["keep"]) for x in quality.score(frame(spark, rows), m).collect())
    want = []
    for i, t in rows:
        s = sum(m.w[k] for k in features[t].tolist())
        tails = [1 / (1 + np.exp(-(s - th))) for th in (-0.5, -0.5 + np.exp(0.2))]
        want.append((i or 0, round(sum(tails), 6), round(tails[1], 6), bool(tails[1] >= quality.KEEP and t and t.strip())))
    assert [(a, k) for a, _, _, k in got] == [(a, k) for a, _, _, k in sorted(want)] and np.allclose([x[1:3] for x in got], [x[1:3] for x in sorted(want)], atol=1e-5)


def test_repeated_rows_and_empty_tables(spark):
    docs = frame(spark, [(1, "one two three four five six"), (1, "one two three four five six"), (1, "other"), (None, None)])
    none = docs.where("false")
    items = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    got = decontam.decontaminate(docs, items)
    assert sorted((x["n_words"], x["n_hit"]) for x in got.collect()) == [(0, 0), (1, 0), (6, 3), (6, 3)]
    assert decontam.decontaminate(none, items).count() == 0 and decontam.decontaminate(docs, items.where("false")).count() == 4
    assert sharding.assign(docs, 2, 4).count() == 4 and len({(x["shard"], x["slot"]) for x in sharding.assign(docs, 2, 4).collect()}) == 4
    assert pii.detect(docs, pii.Model([])).count() == 4 and suffix_dedup.dedup(docs).count() == 4
    assert topk.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0


def test_pipeline_keeps_different_texts_of_one_id(spark):
    """Rows that repeat an id are one document of the join, and its row of the least text stays, whatever the order of tasks."""
    import corpus_pipeline as P

    docs = frame(spark, [(1, "b b b b b b"), (1, "a a a a a a"), (2, "c d e f g h"), (3, "c d e f g h"), (None, "x"), (None, "x")])
    for parts in (1, 4):
        kept = P.drop_near_duplicates(spark, docs.repartition(parts), SF).collect()
        assert sorted((x["doc_id"] or 0, x["text"]) for x in kept) == [(0, "x"), (0, "x"), (1, "a a a a a a"), (2, "c d e f g h")]
