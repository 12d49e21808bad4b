"""Rows, not pairs: what the matching queries send and keep when names repeat."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import pool_of, queries_of, words

from quillmesh.functions import edit as ED
from quillmesh.functions import grams as G
from quillmesh.functions import similarity as S
from quillmesh.operators import benchmarks as B
from quillmesh.operators import matching as M
from quillmesh.plans import inputs as I


def test_terms_are_the_characters_substrings():
    r = random.Random(2)
    texts = ["", "a", "ab", "ş ığ", " x  yy ", *(words(r, 3, "abcş") for _ in range(40))]
    for flag in (True, False):
        row, gram, n = G.terms(texts, flag)
        want, seen = {}, {}
        for i, t in enumerate(texts):
            for p in [f" {w} " for w in t.split()] if flag else [" ".join(t.split())]:
                for k in (2, 3, 4, 5):
                    for j in range(len(p) - k + 1):
                        want[i, p[j : j + k]] = want.get((i, p[j : j + k]), 0) + 1
        assert len(row) == len(want) and sorted(n.tolist()) == sorted(want.values())
        for i, g in want:
            seen.setdefault(g, set()).add(i)
        by = {}
        for i, g in zip(row.tolist(), gram.tolist()):
            by.setdefault(g, set()).add(i)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, seen.values()))


def test_ngram_channels_look_at_each_text_once(spark, monkeypatch):
    """Forty aliases of one name and twenty equal queries reach the blocks as a text each; the best are those of all aliases."""
    r = random.Random(3)
    names = ["alpha beta gama"] * 40 + [words(r, 3, "abgtel") for _ in range(30)]
    pool = pool_of(spark, [(i, i, n) for i, n in enumerate(names)]).persist()
    q = queries_of(spark, [(i, "alpha beta gama") for i in range(20)] + [(20, "alpha beta")]).persist()
    sent, meet = [], M._meet
    monkeypatch.setattr(M, "_meet", lambda left, *a: sent.append((left.count(), a[2].count())) or meet(left, *a))
    monkeypatch.setattr(M, "GRAM_ALIASES", 9)
    space = M.TfIdf(pool, False)
    got = M.ngram_top(q, [space], 45).collect()
    assert sent[0][0] == 2 and sent[0][1] <= 31
    by = {}
    for x in got:
        by.setdefault(x["query_id"], []).append((-x["score"], x["alias_id"]))
    assert len(by) == 21 and all(by[i] == by[0] for i in range(20))
    assert sorted(by[0])[:40] == [(-1.0, i) for i in range(40)] and 40 < len(by[0]) <= 45
    texts = pool.select("normalized_alias").distinct()
    pairs = q.select("query_text").distinct().crossJoin(texts)
    scores = {(x["query_text"], x["normalized_alias"]): x["s"] for x in M.pair_scores(pairs, [space], [space.query_weights(q)], ("s",)).collect()}
    assert len(scores) == pairs.count() and np.isclose(scores["alpha beta gama", "alpha beta gama"], 1)
    text = {x["alias_id"]: x["normalized_alias"] for x in pool.collect()}
    assert all(abs(scores["alpha beta", text[i]] + s) < 2e-6 for s, i in by[20])


def test_positive_attempts_make_no_rows_for_shared_names(spark):
    """A name of thirty companies collides in all of their attempts, as a row each and without lists."""
    pool = pool_of(spark, [(i, i, "Alpha Beta Gama") for i in range(30)] + [(40, 40, "Delta Epsilon House")]).persist()
    sources = B.source_aliases(pool)
    some, all_ = (B.attempts(sources, pool, named=n) for n in (False, True))
    flags = lambda d: sorted((x["query_id"], x["benchmark_collision"]) for x in d.collect())
    assert flags(some) == flags(all_) and {f for _, f in flags(some)} == {True, False} and "collision_aliases" not in some.columns
    out = lambda d: sorted(B.positives(d).select("company_id", "difficulty", "query_text", "benchmark_valid", "generation_attempts").collect())
    assert out(some) == out(all_)


def odd_words(r, k):
    """Texts of every kind the bounds distinguish: repeated words, other letters, white space, beyond 62 and 64 characters."""
    texts = [words(r, r.randint(1, 6), "abcdeş") for _ in range(k)]
    return [*texts, *(f"{t} {t.split()[0]}" for t in texts[:20]), "a", "ab", "a  b", " ab cd", "b\ta c", "ab " * 30, "x" * 63, "x" * 64, "x" * 65, "ab cd " * 12, "😀 ab", ""]


def test_nearest_by_bounds_is_the_nearest_of_all():
    """The best by WRatio are those of all pairs, rounded, ties to the smaller number; few pairs are computed."""
    r = random.Random(7)
    texts = sorted({*odd_words(r, 400), *(words(r, r.randint(3, 5), "klmnopqrstuv") for _ in range(1500))})
    queries = [*r.sample(texts, 12), *(q[: r.randint(1, 12)] for q in r.sample(texts, 12)), *(q[::2] for q in r.sample(texts, 12)), "zz", "ab  cd", "", "é", "ab cd " * 11]
    block, done = ED.Block(texts), 0
    fast = ED.Pairs.wratio

    def counted(self, qi, ti):
        nonlocal done
        done += len(qi)
        return fast(self, qi, ti)

    for n in (1, 40):
        ED.Pairs.wratio, done = counted, 0
        got = block.best("wratio", queries, n)
        ED.Pairs.wratio = fast
        assert n > 1 or done < len(queries) * len(texts) / 2
        for q, found in zip(queries, got):
            score = ED.round6(np.array([S.wratio_of(q, t) for t in texts]))
            order = np.lexsort((np.arange(len(texts)), -score))[:n]
            assert found == list(zip(order.tolist(), score[order].tolist())), q


def test_jaro_winkler_by_bounds_is_that_of_all_and_ties_are_of_six_decimals():
    """Two texts of 0.85 whose doubles differ in the last bit tie, so the smaller number is first; the rest as of all pairs."""
    assert S.jaro_winkler_of("cadc", "acddc") < S.jaro_winkler_of("cadc", "cbad")
    assert ED.Block(["acddc", "cbad"]).jaro_winkler("cadc", 1) == [(0, 0.85)]
    r = random.Random(8)
    texts = sorted({*odd_words(r, 400), *(words(r, r.randint(3, 5), "klmnopqrstuv") for _ in range(1500))})
    queries = [*r.sample(texts, 12), *(q[: r.randint(1, 12)] for q in r.sample(texts, 12)), *(q[1::2] for q in r.sample(texts, 12)), "zz", "", "é", "ab cd " * 11]
    block = ED.Block(texts)
    for n in (1, 10, 60):
        for q, found in zip(queries, block.best("jaro_winkler", queries, n)):
            score = ED.round6(np.array([S.jaro_winkler_of(q, t) for t in texts]))
            order = np.lexsort((np.arange(len(texts)), -score))[:n]
            assert found == list(zip(order.tolist(), score[order].tolist())), q


def test_edit_scores_of_pairs_are_the_plain_ones_in_one_pass(spark):
    """All edit scores of a pair are those of the plain functions, computed for many pairs at once and not text by text."""
    r = random.Random(9)
    texts = odd_words(r, 60)
    rows = [(i, r.choice(texts), r.choice(texts)) for i in range(900)] + [(900, None, "ab"), (901, "ab", None)]
    df = M.with_edit_scores(spark.createDataFrame(rows, "i int, query_text string, normalized_alias string"))
    assert "ArrowEvalPython" not in (plan := df._jdf.queryExecution().toString()) and "MapInArrow" in plan
    plain = {"jaro_winkler": S.jaro_winkler_of, "ratio": S.ratio_of, "partial_ratio": S.partial_ratio_of, "token_set_ratio": S.token_set_ratio_of, "wratio": S.wratio_of}
    got = {x["i"]: x for x in df.collect()}
    assert len(got) == 902
    for i, a, b in rows:
        for name, f in plain.items():
            assert np.isclose(got[i][name], f(a, b) if a and b else 0.0, atol=1e-12), (name, a, b)


def test_names_are_the_first_words_of_whole_texts(spark):
    texts = [None, "", "a", "one two", "...!\n\nzü b1c d\te f g", " x\n", "ends here 9", "a" * 5000 + " b", "1 2 3", "q\u0130w e\u00e7r tt yy uu", "-" * 5000 + "late words"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for x in df.select("text", I.first_words("text").alias("w"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("all")).collect():
        assert [w for w in x["w"] if w is not None] == (x["all"] or [])[:4]


def test_attempts_in_turn_choose_as_all_attempts_and_list_collisions(spark, monkeypatch):
    """Shared names, single names and names that repeat make refused and repeated attempts; no variant goes on after one that is accepted."""
    r = random.Random(5)
    names = ["Alpha Beta Gama"] * 6 + ["Abc", "Abc De", "Xyz"] * 3 + [words(r, 2, "abgtel") for _ in range(12)]
    pool = pool_of(spark, [(i, i // 2 if i % 3 else i, n) for i, n in enumerate(names)]).persist()
    sources = B.source_aliases(pool).persist()
    made, attempted = [], B._attempted
    monkeypatch.setattr(B, "_attempted", lambda slots, *a: made.append(slots.count()) or attempted(slots, *a))
    got = B.positives_in_turn(sources, pool)
    columns = ["company_id", "variant", "difficulty", "query_text", "normalized_query", "benchmark_collision", "duplicate_generated_query", "benchmark_valid", "generation_attempts"]
    want = B.positives(B.attempts(sources, pool, named=True)).persist()
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
    assert len(made) > 2 and sum(made[:-1]) < made[-1]
    owners, ids = {}, {x["company_id"]: x for x in want.where("benchmark_collision").collect()}
    for x in pool.collect():
        owners.setdefault(x["normalized_alias"], {}).setdefault(str(x["company_id"]), set()).add(x["alias_text"].strip())
    listed, rows = {}, B.with_collisions(got, pool).collect()
    for x in rows:
        if not x["benchmark_collision"]:
            assert (x["collision_owners"], x["collision_company_ids"], x["collision_aliases"]) == (0, "", "")
            continue
        own = owners[x["normalized_query"]]
        assert x["collision_owners"] == len(own)
        if x["collision_company_ids"] is not None:
            assert x["normalized_query"] not in listed
            listed[x["normalized_query"]] = x["company_id"], x["variant"]
            assert x["collision_company_ids"].split("|") == sorted(own) and x["collision_aliases"].split("|") == [f"{c}:{a}" for c in sorted(own) for a in sorted(own[c])]
    assert ids and listed == {t: min((x["company_id"], x["variant"]) for x in rows if x["benchmark_collision"] and x["normalized_query"] == t) for t in {x["normalized_query"] for x in rows if x["benchmark_collision"]}}


def test_pairs_of_texts_hold_the_aliases_of_all_channels(spark, monkeypatch):
    """Aliases that share texts, ids out of the order of companies and blocks of nine texts: each pair of texts is a row, with the aliases that ngram_top() finds."""
    r = random.Random(11)
    names = ["alpha beta gama"] * 40 + ["alpha beta"] * 9 + [words(r, 3, "abgtel") for _ in range(40)]
    pool = pool_of(spark, [((i * 7919) % 1009, i, n) for i, n in enumerate(names)]).persist()
    q = queries_of(spark, [(0, "alpha beta gama"), (1, "alpha beta gama"), (2, "alpha beta"), (3, "gate"), (4, "zzzz")]).persist()
    spaces = [M.TfIdf(pool, True), M.TfIdf(pool, False)]
    weights = [s.query_weights(q).persist() for s in spaces]
    text = {x["query_id"]: x["query_text"] for x in q.collect()}
    for size in (40_000, 9):
        monkeypatch.setattr(M, "GRAM_ALIASES", size)
        got = M.ngram_pairs(q, spaces, 45, weights).collect()
        assert len({(x["query_text"], x["normalized_alias"]) for x in got}) == len(got)
        want = {(text[x["query_id"]], x["alias_id"]) for x in M.ngram_top(q, spaces, 45).collect()}
        assert {(x["query_text"], i) for x in got for i in x["ids"]} == want
        for x in M.pair_scores(spark.createDataFrame([(x["query_text"], x["normalized_alias"]) for x in got], "query_text string, normalized_alias string"), spaces, weights, ("w", "r")).collect():
            (y,) = [y for y in got if (y["query_text"], y["normalized_alias"]) == (x["query_text"], x["normalized_alias"])]
            assert (y["char_wb_tfidf"], y["raw_char_tfidf"]) == (x["w"], x["r"])


def test_matches_of_shared_names_are_those_of_all_pairs_without_a_row_for_each(spark, monkeypatch):
    """Forty companies of one name and thirty equal queries: eleven aliases of the name are rows of one text, and a later one that shares an identifier still wins."""
    names = ["alpha beta gama"] * 39 + ["alpha beta gama 7654321"] + ["alpha beta delta", "gama house"]
    pool = pool_of(spark, [(100 - i, i, n) for i, n in enumerate(names)]).persist()
    q = queries_of(spark, [(i, "alpha beta gama") for i in range(30)] + [(30, "alpha beta gama 7654321")]).persist()
    kept, keep = {}, M.keep
    monkeypatch.setattr(M, "keep", lambda df, name: kept.setdefault(name, keep(df, name)) if name in ("rows", "whole") else keep(df, name))
    got = {}
    for x in M.match(q, pool, limit=10, edits=False).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["company_id"], x["alias_id"]))
    same = pool.where("normalized_alias = 'alpha beta gama'").orderBy("company_id").limit(11).collect()
    first = [x["company_id"] for x in same]
    for i in range(30):
        assert [c for _, c, _ in sorted(got[i])] == first[:10] and sorted(got[i])[0][2] == 100 - first[0]
    assert sorted(got[30])[0][1] == 39
    assert kept["rows"].count() <= 2 * 11 and kept["rows"].groupBy("_q").count().where("count > 11").count() == 0


def test_name_scores_of_pairs_are_the_plain_ones(spark):
    r = random.Random(13)
    texts = ["", "ab", "abc", "abcd abc", *(words(r, r.randint(1, 4), "abc") for _ in range(30))]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "query_text string, normalized_alias string")
    for x in M.with_name_scores(pairs).withColumn("want", S.token_prefix_score(F.col("query_text"), F.col("normalized_alias"))).collect():
        assert x["token_prefix"] == x["want"] and abs(x["jaro_winkler"] - S.jaro_winkler_of(x["query_text"], x["normalized_alias"])) < 1e-12


def test_texts_that_reach_a_sum_of_edit_scores_are_those_of_the_plain_scores():
    """Shared, repeated and short words, words out of order, texts of one word, beyond 62 characters, of odd spaces and empty ones."""
    r = random.Random(17)
    texts = sorted({words(r, r.randint(1, 5), "abcd") for _ in range(150)} | {"ab ab ab", "ab", "a", "", " ab  cd", "cd ab", words(r, 16, "abcd"), "ab cd " * 12} | {f"ab {words(r, 3, 'abcd')}" for _ in range(40)})
    queries = ["ab", "ab cd", "ab ab cd", words(r, 3, "abcd"), words(r, 2, "abcd"), "ab " + words(r, 2, "abcd"), words(r, 14, "abcd"), "cd  ab", "", "abcdab xyzq"]
    plain = {"wratio": S.wratio_of, "partial": S.partial_ratio_of, "token_set": S.token_set_ratio_of, "jaro_winkler": S.jaro_winkler_of}
    for least in (0.2, 0.35, 0.45):
        for q, (at, beaten) in zip(queries, ED.Block(texts).reaching(queries, [least] * len(queries), 20)):
            scores = [{k: f(q, t) if q and t else 0.0 for k, f in plain.items()} for t in texts]
            prefix = S.token_prefixes([q], texts, np.zeros(len(texts), np.int64), np.arange(len(texts)))
            sums = [sum(ED.SHARES[k] * s[k] for k in plain) + ED.SHARES["token_prefix"] * p for s, p in zip(scores, prefix)]
            assert {i for i, s in enumerate(sums) if s >= least} <= set(at.tolist()) <= {i for i, s in enumerate(sums) if s >= least - 1e-5}
            best = {i for i, _ in ED.best(ED.round6(np.array([s["wratio"] for s in scores])), 20)}
            assert not best & set(at[beaten].tolist())


def test_matches_with_edit_channels_are_those_of_all_channels(spark, monkeypatch):
    """Ranks over the pairs of every channel, in one block and in blocks of thirty texts, names that companies share; most pairs of the edit channels get no score."""
    r = random.Random(23)
    names = [words(r, r.randint(1, 4), "abgtel") for _ in range(260)]
    names += [f"alpha {words(r, 2, 'abgtel')}" for _ in range(60)] + names[:40] + names[:20] + ["alpha beta"] * 70
    pool = pool_of(spark, [((i * 7919) % 1009, i, n) for i, n in enumerate(names)]).persist()
    asked = [(i, words(r, r.randint(1, 3), "abgtel")) for i in range(25)] + [(25, "alpha bta"), (26, "alpha beta"), (27, names[3]), (28, "zzzz"), (29, "lpha " + names[4])]
    q = queries_of(spark, asked).persist()
    spaces = [M.TfIdf(pool, True), M.TfIdf(pool, False)]
    pairs = M.candidate_pairs(q, pool, spaces, 5).join(q, "query_id").join(pool, "alias_id").select("query_id", "alias_id", "company_id", "query_text", "normalized_alias").persist()
    cosines = {(x[0], x[1]): 0.55 * x[2] + 0.45 * x[3] for x in M.pair_scores(pairs.select("query_text", "normalized_alias"), spaces, [s.query_weights(q) for s in spaces], ("w", "r")).collect()}
    owners, sums = {}, {}
    for x in pool.collect():
        owners.setdefault(x["normalized_alias"], set()).add(x["company_id"])
    plain = {"wratio": S.wratio_of, "partial_ratio": S.partial_ratio_of, "token_set_ratio": S.token_set_ratio_of, "jaro_winkler": S.jaro_winkler_of}
    by = {}
    for x in pairs.collect():
        a, b = key = x["query_text"], x["normalized_alias"]
        if key not in sums:
            prefix = S.token_prefixes([a], [b], np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
            w = S.WITHOUT_EMBEDDING
            sums[key] = w["char_tfidf"] * round(cosines[key], 6) + sum(w[k] * round(f(a, b), 6) for k, f in plain.items()) + w["token_prefix"] * round(prefix, 6)
        unique = a == b and len(owners[b]) == 1 and len(b) > 2
        s = 1.0 if unique else sums[key]
        best = by.setdefault(x["query_id"], {})
        best[x["company_id"]] = min(best.get(x["company_id"], (0, 9.0)), (-unique, -round(s, 5)))
    kept, keep = [], M.keep
    monkeypatch.setattr(M, "keep", lambda df, name: (d := keep(df, name), kept.append((name, d)))[0])
    for size in (160_000, 30):
        monkeypatch.setattr(M, "BLOCK_ALIASES", size)
        kept.clear()
        got = {}
        for x in M.match(q, pool, limit=5).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["company_id"], x["hybrid_score"]))
        assert set(got) == set(by)
        for i, rows in got.items():
            want = sorted((s, c) for c, s in by[i].items())[:5]
            assert [s for _, _, s in sorted(rows)] == pytest.approx([-s[1] for s, _ in want], abs=2e-5)
            last = want[-1][0][1]
            assert {c for _, c, s in rows if s > 2e-5 - last} == {c for s, c in want if -s[1] > 2e-5 - last}
        assert sum(d.count() for n, d in kept if n == "scores") < pairs.select("query_text", "normalized_alias").distinct().count() * 0.8
