"""Inputs of the registered queries, made from the given tables: a pool of names, queries on it, ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import normalize as N
from quillmesh.session import load

SUFFIXES = ("A.S.", "LTD. STI.", "LIMITED SIRKETI", "")


_LETTERS, _OTHERS = "[A-Za-z]++", "[^A-Za-z]"
#: The first four words of a text, which ends the search at the fourth.
FIRST_WORDS = f"^{_OTHERS}*+({_LETTERS})" + f"(?:{_OTHERS}++({_LETTERS}))?" * 3


def first_words(text: str) -> Column:
    """The first four runs of letters A to Z, null where there are fewer; null for null."""
    return F.array(*(F.nullif(F.regexp_extract(text, FIRST_WORDS, k), F.lit("")) for k in range(1, 5)))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """A company for each document: the first words of the text with a legal form, the first two as its brand."""
    form = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % 4 + 1).cast("int"))
    d = load(spark, sf, "documents").withColumn("w", first_words("text")).where("w[1] IS NOT NULL")
    return d.select(F.col("doc_id").alias("company_id"), F.trim(F.concat_ws(" ", F.array_join("w", " "), form)).alias("legal_name"), F.array_join(F.slice("w", 1, 2), " ").alias("brand_name"), F.col("lang").alias("city"), F.col("source").alias("sector"))


def typed_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Legal and brand names of all companies as aliases of their kind, with the companies' columns."""
    c = names(spark, sf)
    kinds = F.explode(F.array(F.struct((F.col("company_id") * 2).alias("alias_id"), F.col("legal_name").alias("alias_text"), F.lit("LEGAL_NAME").alias("alias_type")), F.struct((F.col("company_id") * 2 + 1).alias("alias_id"), F.col("brand_name").alias("alias_text"), F.lit("BRAND_NAME").alias("alias_type"))))
    n = N.normalize(c.withColumn("x", kinds).select("company_id", "legal_name", "brand_name", "city", "sector", "x.*"), "alias_text", with_nfkc=False)
    return n.withColumn("normalized_alias", N.matching_text(F.col("core_text"), F.col("ascii_text"))).select("alias_id", "company_id", "alias_text", "alias_type", "normalized_alias", "legal_name", "brand_name", "city", "sector").where("normalized_alias <> ''")


def reranker_scores(ranked: DataFrame) -> DataFrame:
    """A stand-in for a model's scores: three digits from a hash of the pair."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("company_id").cast("string"))), 1, 8), 16, 10).cast("long")
    return ranked.select("query_id", "company_id", (F.pmod(h, F.lit(1000)) / 1000.0).alias("reranker_score"))


def truth(c: DataFrame) -> DataFrame:
    """Queries of candidates() with what is expected, and a stand-in for the outcome of their requests."""
    q = c.groupBy("query_id").agg(F.max("expected_company_id").alias("expected_company_id"), F.max("difficulty").alias("difficulty"))
    kind = F.when(F.col("difficulty") == "F", "POSITIVE").when(F.col("difficulty") == "O", "HARD_POSITIVE").otherwise("NEGATIVE")
    return q.withColumns({"api_success": F.col("query_id") % 50 != 0, "latency_ms": (F.col("query_id") * 7919 % 1000) / 10.0, "dataset_type": kind})


def pool(spark: SparkSession, sf: str) -> DataFrame:
    n = N.normalize(names(spark, sf).select("company_id", F.col("legal_name").alias("alias_text")), "alias_text", with_nfkc=False)
    return n.select(F.col("company_id").alias("alias_id"), "company_id", "alias_text", N.matching_text(F.col("core_text"), F.col("ascii_text")).alias("normalized_alias")).where("normalized_alias <> ''")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """A noisy payment text for each rated document's company: query_id, raw_text, query_text; the truth is the id itself."""
    d = names(spark, sf).join(load(spark, sf, "labels").select("doc_id").distinct(), F.col("company_id") == F.col("doc_id"))
    k = F.col("company_id") % 4
    raw = F.when(k == 0, F.concat(F.col("legal_name"), F.lit(" FATURA ODEMESI"))).when(k == 1, F.concat(F.lit("EFT "), F.col("legal_name"), F.lit(" REF:"), (F.col("company_id") + 100000).cast("string"))).when(k == 2, F.concat(F.substring("legal_name", 1, 9), F.lit(" HAVALE"))).otherwise(F.concat(F.regexp_replace("legal_name", "[aeiou]", ""), F.lit(" odm 12.03.2024")))
    n = N.normalize(d.select(F.col("company_id").alias("query_id"), raw.alias("raw_text")), "raw_text", with_nfkc=False)
    return n.select("query_id", "raw_text", N.matching_text(F.col("core_text"), F.col("ascii_text")).alias("query_text"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked candidates with the scores of retrieval and reranking: a query for each order, a candidate for each of its lines."""
    c = load(spark, sf, "lineitem").join(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return c.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("company_id")).agg(
        F.max((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 1)).alias("unique_exact_match"), F.max((F.col("l_quantity") == 49)).alias("ambiguous_exact_match"), F.max(F.col("l_discount") >= 0.1).alias("identifier_overlap"),
        F.max(F.round(F.col("l_quantity") / 50.0, 6)).alias("retrieval_score"), F.max(F.round(F.col("l_tax") * 12.5, 6)).alias("reranker_score"), F.max(F.least(F.lit(1.0), F.round(F.col("l_discount") * 10, 6))).alias("lexical_evidence"),
        F.max(F.length("o_orderpriority")).alias("query_length"), (1 + F.max("l_orderkey") % 3).cast("int").alias("query_tokens"), F.max("o_orderstatus").alias("difficulty"), (1 + F.max("l_orderkey") % 4).alias("expected_company_id"),
    )


# The same in DuckDB SQL.

_STOP = "[" + ", ".join(f"'{w}'" for w in N.STOPWORDS) + "]"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.ABBREVIATIONS.items()) + "}"


def sql_source(x: str) -> str:
    """The ASCII source; what isn't ASCII becomes a capital Q, which no pattern has but counts as a letter at borders."""
    folded = f"translate(lower(translate(nfc_normalize(trim({x})), 'Iİ', 'ıi')), 'çÇğĞıİöÖşŞüÜ', 'cCgGiIoOsSuU')"
    return rf"regexp_replace({folded}, '[^\x00-\x7F]', 'Q', 'g')"


def sql_removed(x: str) -> str:
    for p in (N.IBAN, N.TAX, N.IDENTITY, N.REFERENCE, N.DATE, N.TIME):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return x


def sql_surface(x: str) -> str:
    x = sql_removed(x)
    for _, p in N.LEGAL_FORMS:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '{N.LONG_NUMBER}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def sql_normalized(table: str, key: str, text: str) -> str:
    """A table expression (key..., core_text, ascii_text, src, surface)."""
    return f"""(SELECT *, array_to_string(list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1]), ' ') AS core_text, trim(regexp_replace(src, '[^a-z0-9]+', ' ', 'g')) AS ascii_text FROM (
  SELECT *, list_filter(list_transform(t, lambda x: coalesce({_MAP}[x], x)), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS f FROM (
  SELECT *, list_filter(string_split(surface, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS t FROM (
  SELECT *, {sql_surface("src")} AS surface FROM (SELECT {key}, {sql_source(text)} AS src FROM {table})))))"""


_NAMES = """names AS (SELECT company_id, trim(concat_ws(' ', array_to_string(w[1:4], ' '), ['A.S.', 'LTD. STI.', 'LIMITED SIRKETI', ''][company_id % 4 + 1])) AS legal_name, array_to_string(w[1:2], ' ') AS brand_name, city, sector
  FROM (SELECT doc_id AS company_id, regexp_extract_all(text, '[A-Za-z]+') AS w, lang AS city, source AS sector FROM documents) WHERE len(w) >= 2)"""
SQL_NAMES = _NAMES
SQL_POOL = f"""{_NAMES}, pool AS MATERIALIZED (SELECT company_id AS alias_id, company_id, alias_text, trim(coalesce(nullif(core_text, ''), ascii_text)) AS normalized_alias FROM {sql_normalized("names", "company_id, legal_name AS alias_text", "legal_name")}
  WHERE trim(coalesce(nullif(core_text, ''), ascii_text)) <> '')"""
SQL_QUERIES = f"""raw AS (SELECT company_id AS query_id, CASE company_id % 4 WHEN 0 THEN legal_name || ' FATURA ODEMESI' WHEN 1 THEN 'EFT ' || legal_name || ' REF:' || CAST(company_id + 100000 AS VARCHAR) WHEN 2 THEN substr(legal_name, 1, 9) || ' HAVALE' ELSE regexp_replace(legal_name, '[aeiou]', '', 'g') || ' odm 12.03.2024' END AS raw_text
  FROM names WHERE company_id IN (SELECT doc_id FROM labels)),
queries AS MATERIALIZED (SELECT query_id, raw_text, trim(coalesce(nullif(core_text, ''), ascii_text)) AS query_text FROM {sql_normalized("raw", "query_id, raw_text", "raw_text")})"""
SQL_CANDIDATES = """cand AS MATERIALIZED (SELECT l_orderkey AS query_id, CAST(l_linenumber AS BIGINT) AS company_id, bool_or(l_quantity = 50 AND l_linenumber = 1) AS unique_exact_match, bool_or(l_quantity = 49) AS ambiguous_exact_match, bool_or(l_discount >= CAST(0.1 AS DOUBLE)) AS identifier_overlap,
  max(round(l_quantity / CAST(50 AS DOUBLE), 6)) AS retrieval_score, max(round(l_tax * CAST(12.5 AS DOUBLE), 6)) AS reranker_score, max(least(CAST(1 AS DOUBLE), round(l_discount * CAST(10 AS DOUBLE), 6))) AS lexical_evidence,
  CAST(max(length(o_orderpriority)) AS INTEGER) AS query_length, CAST(1 + max(l_orderkey) % 3 AS INTEGER) AS query_tokens, max(o_orderstatus) AS difficulty, 1 + max(l_orderkey) % 4 AS expected_company_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber)"""
SQL_RERANK = """
g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY unique_exact_match DESC, retrieval_score DESC, company_id) AS retrieval_rank, count(*) OVER (PARTITION BY query_id) AS n, list_reverse_sort(list(reranker_score) OVER (PARTITION BY query_id)) AS s FROM cand),
g2 AS (SELECT *, CASE WHEN n = 1 THEN CAST(1 AS DOUBLE) ELSE s[1] - s[2] END AS reranker_gap FROM g1),
g3 AS (SELECT *, least(CAST(CASE WHEN query_length <= 5 THEN 0.15 WHEN query_tokens = 1 AND query_length <= 10 THEN 0.20 WHEN query_tokens = 1 THEN 0.25 WHEN query_length <= 12 THEN 0.30 ELSE 0.40 END AS DOUBLE), CAST(CASE WHEN reranker_gap < CAST(0.03 AS DOUBLE) THEN 0.15 WHEN reranker_gap < CAST(0.06 AS DOUBLE) THEN 0.25 ELSE 1 END AS DOUBLE)) AS base_weight,
  CASE WHEN unique_exact_match THEN reranker_score ELSE least(reranker_score, CAST(CASE WHEN lexical_evidence < CAST(0.2 AS DOUBLE) THEN 0.35 WHEN lexical_evidence < CAST(0.3 AS DOUBLE) THEN 0.50 WHEN lexical_evidence < CAST(0.4 AS DOUBLE) THEN 0.65 ELSE 1 END AS DOUBLE)) END AS adjusted_score FROM g2),
g4 AS (SELECT *, CASE WHEN unique_exact_match THEN CAST(0 AS DOUBLE) ELSE least(base_weight, CAST(CASE WHEN lexical_evidence < CAST(0.2 AS DOUBLE) THEN 0 WHEN lexical_evidence < CAST(0.3 AS DOUBLE) THEN 0.10 WHEN lexical_evidence < CAST(0.4 AS DOUBLE) THEN 0.20 ELSE 0.50 END AS DOUBLE), CAST(CASE WHEN identifier_overlap THEN 0.10 ELSE 0.50 END AS DOUBLE), CAST(CASE WHEN ambiguous_exact_match THEN 0.20 ELSE 0.50 END AS DOUBLE)) END AS reranker_weight FROM g3),
g5 AS (SELECT *, CAST(round(CAST(CASE WHEN unique_exact_match THEN CAST(1 AS DOUBLE) ELSE (CAST(1 AS DOUBLE) - reranker_weight) * retrieval_score + reranker_weight * adjusted_score END AS DECIMAL(18, 9)), 6) AS DOUBLE) AS final_score FROM g4),
g6 AS (SELECT *, row_number() OVER w AS final_rank, lead(final_score) OVER w AS nxt FROM g5 WINDOW w AS (PARTITION BY query_id ORDER BY unique_exact_match DESC, final_score DESC, company_id)),
b AS (SELECT query_id, round(final_score - coalesce(nxt, 0), 6) AS margin, CASE WHEN unique_exact_match THEN 'AUTO_MATCH' WHEN ambiguous_exact_match THEN 'MANUAL_REVIEW' WHEN final_score >= CAST(0.9 AS DOUBLE) AND retrieval_score >= CAST(0.7 AS DOUBLE) AND adjusted_score >= CAST(0.7 AS DOUBLE) AND lexical_evidence >= CAST(0.55 AS DOUBLE) AND round(final_score - coalesce(nxt, 0), 6) >= CAST(0.08 AS DOUBLE) THEN 'AUTO_MATCH' WHEN final_score >= CAST(0.58 AS DOUBLE) THEN 'MANUAL_REVIEW' ELSE 'UNKNOWN' END AS decision FROM g6 WHERE final_rank = 1),
reranked AS MATERIALIZED (SELECT g6.*, b.margin, b.decision FROM g6 JOIN b USING (query_id))"""

def sql_rows(reranked: str, truth: str) -> str:
    """A row for each query of ``truth`` (query_id, expected_company_id, ...) from reranked candidates, as rows_."""
    return f"""
r0 AS (SELECT j.query_id, min(CASE WHEN company_id = t.expected_company_id THEN final_rank END) AS true_rank, min(CASE WHEN company_id = t.expected_company_id THEN retrieval_rank END) AS rank_before,
  max(CASE WHEN final_rank = 1 THEN decision END) AS decision, max(CASE WHEN final_rank = 1 THEN final_score END) AS best_score, max(CASE WHEN final_rank = 1 THEN margin END) AS margin,
  max(CASE WHEN final_rank = 1 THEN company_id END) AS predicted_company_id, max(CASE WHEN retrieval_rank = 1 THEN company_id END) AS retrieval_winner_id,
  round(max(CASE WHEN final_rank = 1 THEN retrieval_score END) - max(CASE WHEN company_id = t.expected_company_id THEN retrieval_score END), 6) AS retrieval_gap,
  round(max(CASE WHEN final_rank = 1 THEN final_score END) - max(CASE WHEN company_id = t.expected_company_id THEN final_score END), 6) AS final_gap,
  string_agg(CAST(company_id AS VARCHAR), '|' ORDER BY final_rank) AS candidate_ids, count(*) AS candidate_count
  FROM {reranked} j JOIN {truth} t ON j.query_id = t.query_id GROUP BY j.query_id),
rows_ AS MATERIALIZED (SELECT t.*, r0.true_rank, r0.rank_before, coalesce(r0.decision, 'UNKNOWN') AS decision, r0.best_score, r0.margin, r0.predicted_company_id, r0.retrieval_winner_id, r0.retrieval_gap, r0.final_gap,
  coalesce(r0.candidate_ids, '') AS candidate_ids, coalesce(r0.candidate_count, 0) AS candidate_count, coalesce(r0.predicted_company_id <> r0.retrieval_winner_id, false) AS winner_changed,
  coalesce(true_rank = 1, false) AS top1, coalesce(true_rank <= 5, false) AS top5, coalesce(true_rank <= 10, false) AS top10, coalesce(round(CAST(1 AS DOUBLE) / true_rank, 6), 0) AS reciprocal_rank,
  CASE WHEN true_rank IS NULL THEN 'EXPECTED_NOT_FOUND' WHEN rank_before IS NULL THEN 'BEFORE_RANK_UNAVAILABLE' WHEN true_rank < rank_before THEN 'HELPED' WHEN true_rank > rank_before THEN 'HURT' ELSE 'UNCHANGED' END AS reranker_effect
  FROM {truth} t LEFT JOIN r0 USING (query_id))"""


SQL_TRUTH = """truth AS MATERIALIZED (SELECT query_id, max(expected_company_id) AS expected_company_id, max(difficulty) AS difficulty, query_id % 50 <> 0 AS api_success, CAST(query_id * 7919 % 1000 AS DOUBLE) / 10 AS latency_ms,
  CASE max(difficulty) WHEN 'F' THEN 'POSITIVE' WHEN 'O' THEN 'HARD_POSITIVE' ELSE 'NEGATIVE' END AS dataset_type FROM cand GROUP BY query_id)"""
SQL_RERANKED = SQL_CANDIDATES + "," + SQL_RERANK
SQL_ROWS = SQL_RERANKED + ", " + SQL_TRUTH + "," + sql_rows("reranked", "truth")
SQL_TYPED_POOL = f"""{_NAMES}, typed AS MATERIALIZED (SELECT alias_id, company_id, alias_text, alias_type, trim(coalesce(nullif(core_text, ''), ascii_text)) AS normalized_alias, legal_name, brand_name, city, sector FROM {sql_normalized("(SELECT company_id * 2 AS alias_id, company_id, legal_name AS alias_text, 'LEGAL_NAME' AS alias_type, legal_name, brand_name, city, sector FROM names UNION ALL SELECT company_id * 2 + 1, company_id, brand_name, 'BRAND_NAME', legal_name, brand_name, city, sector FROM names)", "alias_id, company_id, alias_text, alias_type, legal_name, brand_name, city, sector", "alias_text")}
  WHERE trim(coalesce(nullif(core_text, ''), ascii_text)) <> '')"""
