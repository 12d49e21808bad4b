"""The matching engine end to end, its kernels against plain versions, generators, export, training and sources."""

import io
import json
import random
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import corruption as C
from quillmesh.functions import edit as ED
from quillmesh.functions import normalize as N
from quillmesh.functions import similarity as S
from quillmesh.operators import benchmarks as B
from quillmesh.operators import evaluation as E
from quillmesh.operators import export as X
from quillmesh.operators import matching as M
from quillmesh.operators import models as L
from quillmesh.operators import ranking as R
from quillmesh.operators import training as T
from quillmesh.sources import rest
from quillmesh.sources import tables as D


def words(r, n, letters="abcde"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n))


def pool_of(spark, rows):
    """(alias_id, company_id, alias_text) to a pool."""
    df = spark.createDataFrame(rows, "alias_id long, company_id long, alias_text string").withColumn("alias_type", F.lit("LEGAL_NAME"))
    return B.normalized(df, "alias_text", "normalized_alias")


def queries_of(spark, rows):
    df = spark.createDataFrame(rows, "query_id long, raw_text string")
    return B.normalized(df, "raw_text", "query_text")


def test_edit_kernels_against_plain_ones():
    r = random.Random(0)
    texts = [words(r, r.randint(0, 6)) for _ in range(120)] + ["", "x" * 70, "ab " * 30]
    block = ED.Block(texts)
    for k in range(25):
        q = words(r, r.randint(1, 7)) if k < 23 else ["a", "ab cd " * 14][k - 23].strip()
        assert np.allclose(block.plain.jaro_winkler(q), [S.jaro_winkler_of(q, t) for t in texts])
        assert np.allclose(block.plain.ratio(q), [S.ratio_of(q, t) for t in texts])
        assert np.allclose(block.plain.partial(q, np.arange(len(texts))), [S.partial_ratio_of(q, t) for t in texts])
        want = ED.best(np.array([S.wratio_of(q, t) for t in texts]), 10)
        assert np.allclose([s for _, s in block.wratio(q, 10)], [s for _, s in want])


def test_wratio_by_hand():
    assert S.wratio_of("veli abc", "ali veli mehmet demir") == pytest.approx(0.855)  # a shared word: .95 * .9
    assert S.wratio_of("abcd", "abcd") == 1.0 and S.wratio_of("", "x") == 0.0


def test_reranking_turns_the_order(spark):
    """Two candidates of close retrieval scores; the model prefers the second."""
    c = spark.createDataFrame([(1, 1, 0.80, 0.20), (1, 2, 0.76, 0.95)], "query_id long, company_id long, hybrid_score double, s double").withColumns({
        "query_text": F.lit("test"), "rank": F.col("company_id").cast("int"), "unique_exact_match": F.lit(False), "ambiguous_exact_match": F.lit(False), "identifier_overlap": F.lit(False), "jaro_winkler": F.col("hybrid_score"),
    })
    got = {x["company_id"]: x for x in R.rerank(R.from_matches(c.drop("s"), c.select("query_id", "company_id", F.col("s").alias("reranker_score")))).collect()}
    assert (got[2]["final_rank"], got[1]["final_rank"], got[1]["retrieval_rank"]) == (1, 2, 1)
    assert got[1]["final_score"] == pytest.approx(0.71) and got[2]["final_score"] == pytest.approx(0.7885) and got[1]["reranker_gap"] == pytest.approx(0.75)
    alone = {x["company_id"]: x for x in R.rerank(R.from_matches(c.drop("s"))).collect()}
    assert (alone[1]["final_rank"], alone[1]["final_score"], alone[1]["reranker_weight"], alone[1]["adjusted_score"]) == (1, 0.8, 0.0, 0.0)
    first = {x["company_id"]: x for x in R.rerank(R.from_matches(c.drop("s"), c.select("query_id", "company_id", F.col("s").alias("reranker_score"))), limit=1).collect()}
    assert not first[2]["reranked"] and first[2]["final_score"] == 0.76 and first[1]["reranker_gap"] == 1.0


def test_reranker_scores_are_clamped_and_evidence_may_be_missing(spark):
    c = spark.createDataFrame([(1, 1, 1.7, None), (1, 2, 0.9, None)], "query_id long, company_id long, reranker_score double, lexical_evidence double").withColumns({
        "unique_exact_match": F.lit(False), "ambiguous_exact_match": F.lit(False), "identifier_overlap": F.lit(False), "retrieval_score": F.lit(0.8), "query_length": F.lit(30), "query_tokens": F.lit(3),
    })
    for x in R.rerank(c).collect():
        assert x["reranker_gap"] == pytest.approx(0.1) and x["reranker_weight"] == 0.0 and x["final_score"] == 0.8


def test_ambiguous_names_go_to_review(spark):
    """Two companies of one name; an identifier in the text points to the first, but a person decides."""
    pool = pool_of(spark, [(1, 1, "Custody Bank of Japan /123456789"), (2, 2, "Custody Bank of Japan /999999999")])
    q = queries_of(spark, [(1, "CUSTODY BANK OF JAPAN 123456789 ODEME")])
    m = M.match(q, pool, limit=2)
    best = m.where("rank = 1").first()
    assert best["company_id"] == 1 and best["identifier_overlap"] and best["decision"] == "MANUAL_REVIEW"
    assert (best["exact_match"], best["unique_exact_match"], best["ambiguous_exact_match"]) == (True, False, True)
    named = m.withColumn("legal_name", F.col("alias_text")).withColumn("brand_name", F.lit(""))
    scored = L.with_scores(named, "raw_text", lambda: lambda qs, ds: [0.95 if "123456789" in d.split("Candidate normalized")[0] else 0.2 for d in ds])
    top = R.rerank(scored).where("final_rank = 1").first()
    assert top["company_id"] == 1 and top["decision"] == "MANUAL_REVIEW" and top["reranker_score"] == 0.95


def test_all_channels_against_all_pairs(spark):
    """Candidates of match() are those of every channel over all pairs, and scores are the plain ones."""
    r = random.Random(4)
    names = [words(r, 3, "abcdefgh") for _ in range(130)]
    pool = pool_of(spark, [(i, i // 2, n) for i, n in enumerate(names)]).persist()
    q = queries_of(spark, [(i, words(r, 2, "abcdefgh")) for i in range(5)]).persist()
    texts = {x["alias_id"]: x["normalized_alias"] for x in pool.collect()}
    got = M.candidate_pairs(q, pool, [M.TfIdf(pool, True), M.TfIdf(pool, False)], limit=5)
    found = {}
    for x in got.collect():
        found.setdefault(x["query_id"], set()).add(x["alias_id"])
    for x in q.collect():
        for f in (S.jaro_winkler_of, S.wratio_of):
            by = {t: f(x["query_text"], t) for t in set(texts.values())}
            floor = sorted(by.values(), reverse=True)[49]
            assert {i for i, t in texts.items() if by[t] > floor + 1e-9} <= found[x["query_id"]]
    for x in M.match(q, pool, limit=5).collect():
        a, b = x["query_text"], x["normalized_alias"]
        assert x["wratio"] == pytest.approx(S.wratio_of(a, b), abs=1e-6) and x["jaro_winkler"] == pytest.approx(S.jaro_winkler_of(a, b), abs=1e-6)
    near = M.nearest_alias(q, pool).collect()
    for x in near:
        best = max(S.wratio_of(x["query_text"], t) for t in texts.values())
        assert x["closest_similarity"] == pytest.approx(best, abs=1e-6)
        assert x["closest_alias"] == min(t for t in texts.values() if S.wratio_of(x["query_text"], t) > best - 1e-9)


def test_short_names(spark):
    cases = {"Foo Public Limited Company": "Foo", "Bar A.Ş": "Bar", "Baz L.L.C": "Baz", "Acme Holding GmbH Limited": "Acme Holding", "AG Ltd.": "AG Ltd", " Ab, Inc. ": "Ab, Inc", "Société Anonyme": "Société Anonyme", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {x["n"]: x["s"] for x in df.select("n", N.short_name(F.col("n")).alias("s")).collect()} == cases


def test_mutations_keep_their_rules(spark):
    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choice("ABCDEFGHIKLMNOPRSTU") for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 4))) + r.choice(["", " LTD", " ANONIM SIRKETI"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string")
    t, k = F.col("t"), F.col("id")
    made = {"gone": C.delete_characters(t, k), "swapped": C.swap_characters(t, k), "vowel": C.remove_vowel(t, k), "thin": C.drop_vowels(t, k), "cut": C.truncate_tokens(t, k), "mixed": C.shuffle_tokens(t, k), "like": C.confuse(t, k), "initials": C.initialism(t, k), "noise": C.add_noise(t, k)}
    for x in df.select("t", *(c.alias(n) for n, c in made.items())).collect():
        s, w = x["t"], x["t"].split()
        assert len(s) - len(x["gone"]) in ((1, 2) if sum(map(str.isalnum, s)) > 4 else (0,))
        assert sorted(x["swapped"]) == sorted(s) and sorted(x["mixed"].split()) == sorted(w)
        assert len(w) < 2 or x["mixed"] != s or len(set(w)) == 1
        assert len(x["vowel"]) == len(s) - (sum(map(str.isalnum, s)) > 4) and len(x["thin"].split()) == len(w)
        assert all(b.startswith(a) and (len(a) >= 3 or len(b) < 5) for a, b in zip(x["cut"].split(), w)) and (x["cut"] != s or all(len(y) < 5 for y in w))
        assert len(x["like"]) == len(s) and sum(a != b for a, b in zip(x["like"], s)) == 1 or not set(s) & set(C.CONFUSABLE)
        own = [y for y in w if y not in C.LEGAL_TOKENS]
        assert x["initials"].split()[0] == "".join(y[0] for y in own) if len(own) > 1 else x["initials"] == s
        assert s in x["noise"] and any(n in x["noise"] for n in C.NOISE)
    p = df.withColumn("pipeline", C.one_of(list(C.PIPELINES), F.col("id"), "p"))
    one, two = ([x["query_text"] for x in C.mutate(d, "t", "id", "pipeline").orderBy("id").collect()] for d in (p, p.repartition(5)))
    assert one == two and all(one) and one != [s for _, s in rows]


def test_positive_benchmark_rules(spark):
    pool = pool_of(spark, [(1, 1, "Anadolu Insaat Malzemeleri"), (2, 1, "Anadolu Malzeme"), (3, 2, "Bosphorus Trading House"), (4, 3, "Anadolu Insaat Malzemeleri")])
    got = B.positives(B.attempts(B.source_aliases(pool), pool)).collect()
    assert sorted((x["company_id"], x["difficulty"]) for x in got) == sorted((c, d) for c in (1, 2, 3) for d in B.DIFFICULTIES)
    owners = {}
    for x in pool.collect():
        owners.setdefault(x["normalized_alias"], set()).add(x["company_id"])
    for x in got:
        assert x["benchmark_collision"] == bool(owners.get(x["normalized_query"], set()) - {x["company_id"]})
        assert x["benchmark_valid"] == (not x["benchmark_collision"] and not x["duplicate_generated_query"])
        assert x["benchmark_valid"] or x["generation_attempts"] == 8
    assert any(not x["benchmark_valid"] for x in got if x["difficulty"] == "EASY" and x["company_id"] == 3)  # its only name is another's


def test_negatives_are_safe_and_different(spark, tmp_path):
    pool = pool_of(spark, [(1, 1, "Arvena Teknoloji Limited"), (2, 2, "Elektrik Faturasi"), (3, 3, "Mehmet Yilmaz")])
    got = B.negatives(pool, 30, str(tmp_path), similarity=0.8).collect()
    assert sorted(x["benchmark_id"] for x in got) == list(range(1, 31)) and len({x["query_text"].lower() for x in got}) == 30
    assert {k: sum(x["negative_category"] == k for x in got) for k in B.CATEGORY_WEIGHTS} == B.quotas(30)
    aliases = [x["normalized_alias"] for x in pool.collect()]
    for x in got:
        near = max(S.wratio_of(x["normalized_query"], a) for a in aliases)
        assert near <= 0.8 + 1e-6 and x["normalized_query"] not in aliases and x["closest_similarity"] == pytest.approx(near, abs=1e-6)


def test_hard_positives_and_holdout(spark):
    pool = pool_of(spark, [(i, i, n) for i, n in enumerate(("Anadolu Insaat Malzemeleri", "Karadeniz Balik Urunleri", "Ege Zeytin Pazarlama"))])
    sources = pool.select("company_id", F.col("alias_text").alias("source_alias"), "normalized_alias")
    tried = B.hard_attempts(sources, 40).persist()
    assert tried.count() == 40 and tried.where("query_text = ''").count() == 0
    ranks = tried.select("attempt", (F.col("attempt") % 4).cast("int").alias("expected_rank"), F.lit(True).alias("candidates_ok"))
    got = {x["attempt"]: x for x in B.hard_positives(tried, pool, ranks, target=6, per_company=3).collect()}
    seen, per, n = set(), {}, 0
    for k in sorted(got):
        x = got[k]
        q = x["normalized_query"].lower()
        want = "EMPTY" if not q else "UNCHANGED" if q == x["normalized_alias"] else {0: "EXPECTED_MISSING", 1: "TOO_EASY"}.get(k % 4)
        if want is None:
            want = "DUPLICATE" if q in seen else None
            seen.add(q)
            if want is None:
                per[x["company_id"]] = per.get(x["company_id"], 0) + 1
                want = "COMPANY_LIMIT" if per[x["company_id"]] > 3 else None
            if want is None:
                n += 1
                want = "TARGET_REACHED" if n > 6 else None
        assert x["reason"] == want, k
    held = B.holdout_sources(sources, spark.createDataFrame([(1,)], "expected_company_id long"))
    assert {x["company_id"] for x in held.collect()} == {0, 2}


def test_rows_list_candidates(spark):
    c = spark.createDataFrame([(1, 7, 1, 2, 0.9), (1, 8, 2, 1, 0.5)], "query_id long, company_id long, final_rank int, retrieval_rank int, final_score double").withColumns({"retrieval_score": F.col("final_score"), "reranker_score": F.lit(0.1), "decision": F.lit("MANUAL_REVIEW"), "margin": F.lit(0.4), "unique_exact_match": F.lit(False), "ambiguous_exact_match": F.lit(False)})
    got = {x["query_id"]: x for x in E.rows(c, spark.createDataFrame([(1, 8), (2, 9)], "query_id long, expected_company_id long")).collect()}
    assert (got[1]["true_rank"], got[1]["rank_before"], got[1]["reranker_effect"], got[1]["winner_changed"], got[1]["candidate_ids"]) == (2, 1, "HURT", True, "7|8")
    assert [x["company_id"] for x in json.loads(got[1]["top_json"])] == [7, 8]
    assert (got[2]["decision"], got[2]["true_rank"], got[2]["candidate_count"], got[2]["reranker_effect"]) == ("UNKNOWN", None, 0, "EXPECTED_NOT_FOUND")


def test_training_guards_and_importance(spark):
    rows = [(f"g{g}", c, int(c == g % 3), g, c, float(c == g % 3) + 0.1 * c, 1.0) for g in range(30) for c in range(3)]
    c = spark.createDataFrame(rows, "group_id string, company_id long, label int, expected_company_id long, candidate_position int, a double, b double").withColumns({"current_final_rank": F.col("candidate_position") + 1, "dataset_type": F.lit("POSITIVE")})
    model = T.pairwise_model(c, T.check_features(c, ["a", "b"]))
    got = T.importance(c, model, ["a", "b"]).collect()
    assert got[0]["feature"] == "a" and got[0]["importance"] > 0.1 and got[1]["importance"] == pytest.approx(0)
    for bad in (["a", "a"], ["a", "z"]):
        with pytest.raises(ValueError):
            T.check_features(c, bad)
    with pytest.raises(ValueError):
        T.check_features(c, ["a", "b"], ["b", "a"])
    with pytest.raises(ValueError):
        T.check_features(c.withColumn("a", F.when(F.col("company_id") == 1, F.lit(float("nan"))).otherwise(F.col("a"))), ["a"])


def test_models_in_batches(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(11)], "id long, t string").repartition(2)
    got = {x["id"]: x["v"] for x in L.embed(df, "t", ["id"], lambda: lambda ts: [[float(len(t)), 1.0] for t in ts]).collect()}
    assert all(np.linalg.norm(v) == pytest.approx(1) and v[0] == pytest.approx(i / np.hypot(i, 1)) for i, v in got.items())
    with pytest.raises(Exception, match="results"):
        L.embed(df, "t", ["id"], lambda: lambda ts: [[1.0]]).collect()
    assert L.yes_probability(0.0, 0.0) == 0.5 and L.yes_probability(-1000.0, 1000.0) == 1.0


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def test_rest_pages_follow_links_and_wait():
    pages = {"http://u1": {"data": [{"id": 1}, {"id": 2}], "links": {"next": "http://u2"}}, "http://u2": {"data": [{"id": 3}], "links": {"next": {"href": "http://u1"}}}}
    waits, fails = [], [urllib.error.HTTPError("u1", 429, "busy", {"Retry-After": "7"}, None), urllib.error.URLError("down")]

    def answer(request, timeout):
        if fails:
            raise fails.pop(0)
        return Answer(json.dumps(pages[request.full_url]).encode())

    got = [json.loads(x)["id"] for x in rest.records("http://u1", 9, answer, waits.append)]
    assert got == [1, 2, 3] and waits == [7.0, 2.0, rest.PAUSE, rest.PAUSE]
    assert len(list(rest.records("http://u1", 2, answer, waits.append))) == 2

    def down(request, timeout):
        raise urllib.error.URLError("down")

    waits.clear()
    with pytest.raises(urllib.error.URLError):
        list(rest.records("http://u1", 2, down, waits.append))
    assert waits == [1.0, 2.0, 4.0, 8.0]


def test_new_companies_first_come(spark):
    r = random.Random(3)
    rows = [(i, f"L{r.randrange(12)}", f"n{r.randrange(12)}") for i in range(40)]
    existing = spark.createDataFrame([("L0", "n1")], "lei string, normalized_name string")
    leis, names, want = {"L0"}, {"n1"}, []
    for i, lei, n in rows:
        if lei not in leis and n not in names:
            leis.add(lei)
            names.add(n)
            want.append(i)
    got = D.new_companies(existing, spark.createDataFrame(rows, "seq long, lei string, normalized_name string")).collect()
    assert sorted(x["seq"] for x in got) == want


def test_unique_ids_count_on(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string").withColumn("n", F.monotonically_increasing_id())
    first = df.select(N.stable_id(F.lit("a")).alias("x")).first()["x"]
    got = M.with_unique_ids(df, F.col("k"), spark.createDataFrame([(first + 1,)], "company_id long")).collect()
    assert len({x["company_id"] for x in got}) == 3 and sorted(x["company_id"] for x in got if x["k"] == "a") == [first, first + 2]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "çay")], "n int, t string")
    D.write_summary(df, str(tmp_path / "s"))
    assert json.loads("\n".join(x["value"] for x in spark.read.text(str(tmp_path / "s")).collect())) == {"n": 1, "t": "çay"}
    copy = D.backup(spark, str(tmp_path / "s"), "x")
    assert spark.read.text(copy).count() == spark.read.text(str(tmp_path / "s")).count() and D.backup(spark, str(tmp_path / "none"), "x") is None
    assert all(len(x["sha256"]) == 64 for x in D.checksums(spark, str(tmp_path / "s")).collect())
    D.write_union([df, df.withColumn("u", F.lit(2))], str(tmp_path / "u"))
    assert D.read_csv(spark, str(tmp_path / "u")).columns == ["n", "t", "u"]


def test_export_of_ineligible_groups(spark):
    c = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1), (3, 5, 1), (3, 6, 2)], "query_id long, company_id long, final_rank int").withColumns({"reranker_weight": F.lit(0.25), "reranker_gap": F.lit(0.1), "identifier_overlap": F.lit(True)})
    truth = spark.createDataFrame([(1, "POSITIVE", 6), (2, "POSITIVE", 5), (3, "NEGATIVE", None), (4, "POSITIVE", 1)], "query_id long, dataset_type string, expected_company_id long")
    x = X.features(c, truth)
    got = {(r["query_id"], r["company_id"]): r for r in x.collect()}
    assert [got[k]["ranker_eligible"] for k in sorted(got)] == [1, 1, 0, 0, 0] and got[1, 6]["label"] == 1 and got[3, 5]["label"] == 0
    assert got[1, 5]["f_retrieval_weight"] == 0.75 and got[1, 5]["f_embedding"] == 0.0 and got[1, 5]["expected_rank"] == 2
    assert {r["query_id"]: r["ranker_eligible"] for r in X.query_results(truth, x).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
