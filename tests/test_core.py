import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import corruption as C
from quillmesh.functions import normalize as N
from quillmesh.functions import similarity as S
from quillmesh.operators import matching as M
from quillmesh.plans import queries as Q
from quillmesh.sources import tables as D

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text, core, legal, refs", [
    ("TÜPRAŞ A.Ş. İZMİT RAF. FATURA ÖDM. REF:398192", "tupras izmit rafineri", ["ANONIM_SIRKETI"], ["398192"]),
    ("AKDENİZ GIDA LTD. ŞTİ. FATURA BEDELİ", "akdeniz gida", ["LIMITED_SIRKETI"], []),
    ("ABC MUH LTD STI VKN:1234567890 FATURA", "abc muhendislik", ["LIMITED_SIRKETI"], []),
    ("reform enerji", "enerji", [], ["ORM"]),
    ("", "", [], []),
])
def test_normalize(spark, text, core, legal, refs):
    r = N.normalize(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert (r["core_text"], r["legal_types"], r["reference_numbers"]) == (core, legal, refs)


def test_identifiers(spark):
    r = N.normalize(spark.createDataFrame([("TUPRAS ODEME TR12 3456 7890 1234 5678 9012 34",), (None,)], "text string"), "text").collect()
    assert r[0]["identifiers"]["ibans"] == ["TR123456789012345678901234"] and "tr12" not in r[0]["core_text"]
    assert r[1]["core_text"] in (None, "")


def test_match(spark):
    companies = spark.createDataFrame([(1001, "Türkiye Petrol Rafinerileri A.Ş.", "TÜPRAŞ"), (1002, "Türkiye Petrolleri Anonim Ortaklığı", "TPAO"), (1003, "Petrol Ofisi A.Ş.", "Petrol Ofisi")], "company_id long, legal_name string, brand_name string")
    aliases = spark.createDataFrame([(1, 1001, "TUPRAS", "BRAND"), (2, 1001, "TR PETROL RAF", "ABBREVIATION"), (3, 1001, "TUPRAS IZMIT", "OBSERVED_EFT"), (4, 1002, "TPAO", "BRAND"), (5, 1002, "TURKIYE PETROLLERI", "SHORT_NAME"), (6, 1003, "PETROL OFISI", "BRAND"), (7, 1003, "POAS", "ABBREVIATION")], "alias_id long, company_id long, alias_text string, alias_type string")
    q = N.normalize(spark.createDataFrame([(1, "TUPRAS"), (2, "TUPRASS FATURA ODEMESI"), (3, "TR PET RAF IZM ODM"), (4, "PETROL OFS AS FATURA")], "query_id long, raw_text string"), "raw_text")
    q = q.select("query_id", "raw_text", N.matching_text(F.col("core_text"), F.col("ascii_text")).alias("query_text"))
    best = {r["query_id"]: r for r in M.match(q, M.build_pool(companies, aliases), 3).where("rank = 1").collect()}
    assert best[1]["company_id"] == 1001 and best[1]["exact_match"] and best[1]["decision"] == "AUTO_MATCH"
    assert best[2]["company_id"] == 1001 and best[2]["hybrid_score"] > 0.70
    assert best[3]["company_id"] == 1001
    assert best[4]["company_id"] == 1003


def test_kernels():
    con = duckdb.connect()
    for a, b in (("tupras", "tuprass"), ("martha", "marhta"), ("dixon", "dicksonx"), ("abc", "xyz"), ("tupras", "tuzzzz")):
        assert S.jaro_winkler_of(a, b) == pytest.approx(con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0])
    assert S.ratio_of("abcd", "abxd") == 0.75
    assert S.partial_ratio_of("petrol", "turkiye petrol ofisi") == 1.0
    assert S.token_set_ratio_of("petrol ofisi", "ofisi petrol turkiye") == 1.0
    assert S.wratio_of("", "x") == 0.0 and S.wratio_of("abc", "abc") == 1.0


def test_corruption_is_deterministic(spark):
    df = spark.createDataFrame([(i, "Anadolu Insaat Malzemeleri") for i in range(40)], "id long, t string").withColumn("difficulty", F.lit("HARD"))
    one, two = ({x["id"]: (x["query_text"], x["corruption_type"]) for x in C.variants(d, "t", "id").collect()} for d in (df, df.repartition(7)))
    assert one == two and len({k for _, k in one.values()}) > 1 and all(t for t, _ in one.values())


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿company_id,legal_name,brand_name,city,sector,tax_number\n1, A ,b,c,d,\n2,B,,,,\n", encoding="utf-8")
    assert [r["legal_name"] for r in D.read_companies(spark, f"file://{tmp_path}/c.csv").orderBy("company_id").collect()] == ["A", "B"]
    t, s = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    assert sorted(map(tuple, D.upsert(t, s, ["k"], "seq").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    j = spark.createDataFrame([('{"id": "L1", "attributes": {"entity": {"legalName": {"name": " N "}, "legalAddress": {"city": "X", "country": "TR"}, "otherNames": [{"name": "O", "type": "T"}]}}}',)], "value string")
    assert tuple(D.flatten_records(j).first()) == ("L1", "N", "X", "TR", None) and tuple(D.other_names(j).first()) == ("L1", "O", "T")


def test_stream(spark, tmp_path):
    from quillmesh.streaming.match import exact_stream

    spark.createDataFrame([(1, "TPAO ODEME"), (2, "none")], "query_id long, raw_text string").write.parquet(f"file://{tmp_path}/q")
    pool = spark.createDataFrame([(7, "tpao")], "company_id long, normalized_alias string")
    s = exact_stream(spark.readStream.schema("query_id long, raw_text string").parquet(f"file://{tmp_path}/q"), pool)
    w = s.writeStream.format("memory").queryName("matched").option("checkpointLocation", f"{tmp_path}/ck").start()
    w.processAllAvailable()
    w.stop()
    assert {r["query_id"]: r["company_id"] for r in spark.table("matched").collect()} == {1: 7, 2: None}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(Q.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    got = sorted(repr(tuple(r)) for r in Q.QUERIES[name](spark, SF).select(*cols).collect())
    assert got == want
