"""Registered queries of the matching engine and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import corruption as C
from quillmesh.functions import normalize as N
from quillmesh.functions import similarity as S
from quillmesh.operators import benchmarks as B
from quillmesh.operators import evaluation as E
from quillmesh.operators import export as X
from quillmesh.operators import matching as M
from quillmesh.operators import ranking as R
from quillmesh.operators import training as T
from quillmesh.plans import inputs as I
from quillmesh.session import keep, load
from quillmesh.sources import tables as D

FLAGSHIP = "match_candidates"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _grams(x: str, words: bool) -> str:
    one = "flatten(list_transform(range(2, 6), lambda k: list_transform(range(1, length({s}) - k + 2), lambda i: substr({s}, i, k))))"
    if words:
        inner = one.format(s="p")
        return f"flatten(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: flatten(list_transform([' ' || w || ' '], lambda p: {inner}))))"
    return one.format(s=x)


def _documents(spark, sf):
    return N.normalize(load(spark, sf, "documents").select("doc_id", "text"), "text")


_DOCS = I.sql_normalized("documents", "doc_id", "text")


@query(f"SELECT doc_id, core_text, ascii_text FROM {_DOCS}")
def normalize_core(spark, sf):
    return _documents(spark, sf).select("doc_id", "core_text", "ascii_text")


_found = lambda p, g: f"list_sort(list_distinct(regexp_extract_all(src, '{p}', {g})))"


@query(f"SELECT doc_id, upper(array_to_string({_found(N.REFERENCE, 1)}, '|')) AS reference_numbers FROM {_DOCS}")
def reference_extract(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join(F.array_sort("reference_numbers"), "|").alias("reference_numbers"))


@query(rf"""SELECT doc_id, upper(regexp_replace(array_to_string({_found(N.IBAN, 0)}, '|'), '\s+', '', 'g')) AS ibans, array_to_string({_found(N.TAX, 1)}, '|') AS tax_numbers, array_to_string({_found(N.IDENTITY, 1)}, '|') AS identity_numbers FROM {_DOCS}""")
def identifiers_extract(spark, sf):
    return _documents(spark, sf).select("doc_id", *(F.array_join(F.array_sort(f"identifiers.{c}"), "|").alias(c) for c in ("ibans", "tax_numbers", "identity_numbers")))


def _legal_sql() -> str:
    x, cases = I.sql_removed("src"), []
    for name, p in N.LEGAL_FORMS:
        cases.append(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{name}' END")
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    return f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct([{', '.join(cases)}])), '|'), '') AS legal_types FROM {_DOCS}"


@query(_legal_sql())
def legal_types(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join(F.array_sort("legal_types"), "|").alias("legal_types"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(upper(text), '[^A-Za-z0-9]+'), lambda x: regexp_full_match(x, '([A-Z]{0,3}[0-9]{6,}|[0-9]{6,}[A-Z]{0,3})')))), '|') AS identifiers FROM documents""")
def identifier_sets(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(N.name_identifiers(F.col("text"))), "|").alias("identifiers"))


@query(f"""WITH {I.SQL_POOL}, {I.SQL_QUERIES}, o AS (SELECT normalized_alias, count(DISTINCT company_id) AS n FROM pool GROUP BY 1)
SELECT query_id, n IS NOT NULL AS exact_match, coalesce(n = 1 AND length(regexp_replace(query_text, '[^a-z0-9]', '', 'g')) >= 3, false) AS unique_exact_match, n IS NOT NULL AND NOT coalesce(n = 1 AND length(regexp_replace(query_text, '[^a-z0-9]', '', 'g')) >= 3, false) AS ambiguous_exact_match
FROM queries LEFT JOIN o ON query_text = normalized_alias""")
def exact_match_flags(spark, sf):
    f = M.exact_flags(I.queries(spark, sf), I.pool(spark, sf))
    return f.select("query_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("exact_match", "unique_exact_match", "ambiguous_exact_match")))


@query(f"WITH {I.SQL_POOL} SELECT normalized_alias, count(DISTINCT company_id) AS n_owners, min(company_id) AS first_owner FROM pool GROUP BY 1 HAVING count(DISTINCT company_id) > 1")
def alias_collisions(spark, sf):
    return M.collisions(I.pool(spark, sf))


@query(f"""WITH {I.SQL_POOL}, x AS (SELECT normalized_alias, count(DISTINCT company_id) AS owners, count(*) AS n FROM pool GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS aliases, count(*) AS distinct_texts, CAST(sum(CASE WHEN owners > 1 THEN 1 ELSE 0 END) AS BIGINT) AS shared_texts, (SELECT count(DISTINCT company_id) FROM pool) AS companies,
  (SELECT count(DISTINCT g) FROM (SELECT unnest({_grams("normalized_alias", True)}) AS g FROM pool)) AS char_wb_features, (SELECT count(DISTINCT g) FROM (SELECT unnest({_grams("normalized_alias", False)}) AS g FROM pool)) AS raw_char_features FROM x""")
def index_stats(spark, sf):
    return M.index_stats(I.pool(spark, sf))


def _ids(table: str) -> str:
    return f"(SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(upper(text), '[^A-Za-z0-9]+'), lambda x: regexp_full_match(x, '([A-Z]{{0,3}}[0-9]{{6,}}|[0-9]{{6,}}[A-Z]{{0,3}})')))) AS i FROM {table})"


@query(f"SELECT DISTINCT a.doc_id AS query_id, b.doc_id AS alias_id FROM {_ids('(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))')} a JOIN {_ids('documents')} b USING (i)")
def identifier_overlap_join(spark, sf):
    d = load(spark, sf, "documents")
    q = d.join(load(spark, sf, "labels").select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("text").alias("raw_text"))
    return M.identifier_pairs(q, d.select(F.col("doc_id").alias("alias_id"), F.col("text").alias("alias_text")))


_PREFIX = """CASE WHEN q = c THEN CAST(1 AS DOUBLE) WHEN least(length(q), length(c)) < 3 THEN 0 WHEN cp = least(length(q), length(c)) THEN least(CAST(1 AS DOUBLE), CAST(0.7 AS DOUBLE) + CAST(0.3 AS DOUBLE) * least(length(q), length(c)) / greatest(length(q), length(c))) WHEN cp >= 2 THEN least(CAST(0.55 AS DOUBLE), CAST(0.55 AS DOUBLE) * cp / greatest(length(q), length(c))) ELSE 0 END"""


@query(f"""WITH {I.SQL_POOL}, {I.SQL_QUERIES}, p AS (SELECT query_id, query_text, normalized_alias FROM queries JOIN pool ON query_id = company_id),
w AS (SELECT query_id, qi, q, unnest(string_split(normalized_alias, ' ')) AS c FROM (SELECT query_id, normalized_alias, unnest(range(1, len(string_split(query_text, ' ')) + 1)) AS qi, unnest(string_split(query_text, ' ')) AS q FROM p) WHERE q <> ''),
s AS (SELECT query_id, qi, q, max({_PREFIX}) AS s FROM (SELECT *, len(list_filter(range(1, least(length(q), length(c)) + 1), lambda i: substr(q, 1, i) = substr(c, 1, i))) AS cp FROM w) GROUP BY 1, 2, 3)
SELECT p.query_id, round(coalesce(sum(s * greatest(1, least(8, length(q)))) / sum(greatest(1, least(8, length(q)))), 0), 6) AS token_prefix FROM p LEFT JOIN s USING (query_id) GROUP BY 1""")
def token_prefix(spark, sf):
    j = I.queries(spark, sf).join(I.pool(spark, sf), F.col("query_id") == F.col("company_id"))
    return j.select("query_id", F.round(S.token_prefix_score(F.col("query_text"), F.col("normalized_alias")), 6).alias("token_prefix"))


@query(f"""WITH {I.SQL_POOL}, {I.SQL_QUERIES} SELECT query_id, round(jaro_winkler_similarity(query_text, normalized_alias), 6) AS jaro_winkler FROM queries JOIN pool ON query_id = company_id""")
def jaro_winkler(spark, sf):
    j = I.queries(spark, sf).join(I.pool(spark, sf), F.col("query_id") == F.col("company_id"))
    return j.select("query_id", F.round(S.jaro_winkler("query_text", "normalized_alias"), 6).alias("jaro_winkler"))


def _tfidf(words: bool) -> str:
    return f"""WITH {I.SQL_POOL}, {I.SQL_QUERIES},
atf AS MATERIALIZED (SELECT alias_id, g, 1 + ln(CAST(count(*) AS DOUBLE)) AS tf FROM (SELECT alias_id, unnest({_grams("normalized_alias", words)}) AS g FROM pool) GROUP BY 1, 2),
idf AS MATERIALIZED (SELECT g, ln((1 + (SELECT count(*) FROM pool)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM atf GROUP BY 1),
aw AS MATERIALIZED (SELECT alias_id, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY alias_id)) AS w FROM atf JOIN idf USING (g)),
qtf AS (SELECT query_id, g, 1 + ln(CAST(count(*) AS DOUBLE)) AS tf FROM (SELECT query_id, unnest({_grams("query_text", words)}) AS g FROM queries) GROUP BY 1, 2),
qw AS MATERIALIZED (SELECT query_id, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS w FROM qtf JOIN idf USING (g)),
s AS (SELECT query_id, alias_id, round(sum(qw.w * aw.w), 6) AS score FROM qw JOIN aw USING (g) GROUP BY 1, 2)
SELECT query_id, alias_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, alias_id) AS rank FROM s) WHERE rank <= 10"""


def _topk(spark, sf, words):
    pool, queries = keep(I.pool(spark, sf), "pool"), keep(I.queries(spark, sf), "queries")
    return M.ngram_top(queries, [M.TfIdf(pool, words)], 10).select("query_id", "alias_id", "score", "rank")


@query(_tfidf(False))
def tfidf_char_topk(spark, sf):
    return _topk(spark, sf, False)


@query(_tfidf(True))
def tfidf_charwb_topk(spark, sf):
    return _topk(spark, sf, True)


@query()
def match_candidates(spark, sf):
    """The whole retrieval: channels, edit scores, hybrid, best alias, top k, decision."""
    m = M.match(I.queries(spark, sf), I.pool(spark, sf), limit=10)
    return m.select("query_id", "company_id", "alias_id", "rank", "hybrid_score", "char_tfidf", "jaro_winkler", "wratio", "partial_ratio", "token_set_ratio", "token_prefix", "identifier_overlap", "exact_match", "unique_exact_match", "ambiguous_exact_match", "margin", "decision")


_reranked = lambda spark, sf: R.rerank(I.candidates(spark, sf))
_RERANK_OUT = ("query_id", "company_id", "reranker_gap", "base_weight", "adjusted_score", "reranker_weight", "final_score", "retrieval_rank", "final_rank", "margin", "decision")


@query(f"WITH {I.SQL_RERANKED} SELECT query_id, company_id, round(reranker_gap, 6) AS reranker_gap, base_weight, adjusted_score, reranker_weight, final_score, CAST(retrieval_rank AS INTEGER) AS retrieval_rank, CAST(final_rank AS INTEGER) AS final_rank, margin, decision FROM reranked")
def rerank_final(spark, sf):
    return _reranked(spark, sf).select(*_RERANK_OUT).withColumn("reranker_gap", F.round("reranker_gap", 6))


_SHADOW = I.SQL_RERANKED + """, s0 AS (SELECT *, round(CAST(0.6 AS DOUBLE) * final_score + CAST(0.4 AS DOUBLE) * lexical_evidence, 6) AS shadow_score FROM reranked),
s1 AS (SELECT *, row_number() OVER w AS shadow_rank, lead(shadow_score) OVER w AS snext, min(shadow_score) OVER g AS lo, max(shadow_score) OVER g AS hi, count(*) OVER g AS cnt FROM s0 WINDOW w AS (PARTITION BY query_id ORDER BY shadow_score DESC, final_rank), g AS (PARTITION BY query_id)),
sh AS MATERIALIZED (SELECT query_id, company_id, shadow_score, final_rank, shadow_rank, expected_company_id, difficulty, snext, round(CASE WHEN cnt = 1 THEN 1 WHEN hi - lo <= CAST(1e-12 AS DOUBLE) THEN CAST(0.5 AS DOUBLE) ELSE (shadow_score - lo) / (hi - lo) END, 6) AS shadow_normalized FROM s1)"""


def _shadowed(spark, sf):
    c = _reranked(spark, sf).withColumn("shadow_score", F.round(F.lit(0.6) * F.col("final_score") + F.lit(0.4) * F.col("lexical_evidence"), 6))
    return R.shadow(c)


@query(f"""WITH {_SHADOW}, t AS (SELECT query_id, max(CASE WHEN shadow_rank = 1 THEN round(shadow_score - coalesce(snext, 0), 6) END) AS shadow_margin, max(CASE WHEN shadow_rank = 1 THEN company_id END) <> max(CASE WHEN final_rank = 1 THEN company_id END) AS winner_changed FROM sh GROUP BY 1)
SELECT query_id, company_id, shadow_score, shadow_normalized, CAST(shadow_rank AS INTEGER) AS shadow_rank, CAST(final_rank - shadow_rank AS INTEGER) AS rank_delta, shadow_margin, winner_changed FROM sh JOIN t USING (query_id)""")
def shadow_rank_delta(spark, sf):
    return _shadowed(spark, sf).select("query_id", "company_id", "shadow_score", "shadow_normalized", "shadow_rank", "rank_delta", "shadow_margin", "winner_changed")


def _rows(spark, sf):
    c = _reranked(spark, sf)
    return E.rows(c.drop("expected_company_id", "difficulty"), I.truth(I.candidates(spark, sf)))


_ROW = "query_id difficulty true_rank rank_before decision best_score margin predicted_company_id retrieval_winner_id retrieval_gap final_gap candidate_ids candidate_count winner_changed top1 top5 top10 reciprocal_rank reranker_effect".split()


@query(f"WITH {I.SQL_ROWS} SELECT * REPLACE (CAST(true_rank AS INTEGER) AS true_rank, CAST(rank_before AS INTEGER) AS rank_before) FROM (SELECT {', '.join(_ROW)} FROM rows_)")
def evaluation_rows(spark, sf):
    return _rows(spark, sf).select(*_ROW)


_LATE = "round(avg(CASE WHEN api_success THEN latency_ms END), 3) AS average_latency_ms, round(quantile_cont(CASE WHEN api_success THEN latency_ms END, 0.5), 3) AS median_latency_ms, round(quantile_cont(CASE WHEN api_success THEN latency_ms END, 0.95), 3) AS p95_latency_ms"
_is = lambda d: f"count_if(api_success AND decision = '{d}')"
_of = lambda a, b="count(*)": f"round({a} / nullif({b}, 0), 6)"
_POSITIVE = f"""count(*) AS total_queries, count_if(api_success)::BIGINT AS successful_queries, count_if(NOT api_success)::BIGINT AS failed_queries, {_of("count_if(api_success)")} AS request_success_rate,
  {_of("count_if(api_success AND top1)")} AS top1_accuracy, {_of("count_if(api_success AND top5)")} AS candidate_recall_at_5, {_of("count_if(api_success AND top10)")} AS candidate_recall_at_10, {_of("sum(CASE WHEN api_success THEN reciprocal_rank ELSE 0 END)")} AS mean_reciprocal_rank,
  {_of("count_if(api_success AND true_rank IS NULL)")} AS candidate_miss_rate, {_is("AUTO_MATCH")}::BIGINT AS auto_match_count, {_of(_is("AUTO_MATCH"))} AS auto_match_coverage, {_of("count_if(api_success AND decision = 'AUTO_MATCH' AND top1)", _is("AUTO_MATCH"))} AS auto_match_precision,
  count_if(api_success AND decision = 'AUTO_MATCH' AND NOT top1)::BIGINT AS false_auto_match_count, {_of("count_if(api_success AND decision = 'AUTO_MATCH' AND NOT top1)")} AS false_match_rate, {_of(_is("MANUAL_REVIEW"))} AS manual_review_rate, {_of(_is("UNKNOWN"))} AS unknown_rate,
  {", ".join(f"count_if(api_success AND reranker_effect = '{e}')::BIGINT AS reranker_{e.lower()}_count" for e in ("HELPED", "HURT", "UNCHANGED"))}, count_if(api_success AND winner_changed)::BIGINT AS reranker_changed_winner_count, {_LATE}"""


@query(f"WITH {I.SQL_ROWS} SELECT {_POSITIVE} FROM rows_")
def benchmark_metrics(spark, sf):
    return E.positive_metrics(_rows(spark, sf), latency="latency_ms")


@query(f"WITH {I.SQL_ROWS} SELECT difficulty, reranker_effect, {_POSITIVE} FROM rows_ GROUP BY difficulty, reranker_effect")
def metrics_by_group(spark, sf):
    return E.positive_metrics(_rows(spark, sf), "difficulty", "reranker_effect", latency="latency_ms")


@query(f"WITH {I.SQL_ROWS} " + " UNION ALL ".join(f"SELECT '{k}' AS key, coalesce(CAST({k} AS VARCHAR), 'UNKNOWN') AS value, count(*) AS total, {_of('count_if(top1)')} AS top1_accuracy FROM rows_ GROUP BY {k}" for k in ("difficulty", "reranker_effect", "decision")))
def metrics_by_each(spark, sf):
    n = F.count("*")
    return E.by_each(_rows(spark, sf), ["difficulty", "reranker_effect", "decision"], n.alias("total"), E.ratio(F.count_if("top1"), n).alias("top1_accuracy"))


_WRONG = "api_success AND decision <> 'UNKNOWN'"
_OK = "count_if(api_success)"
_NEGATIVE = f"""count(*) AS total_queries, {_OK}::BIGINT AS successful_queries, (count(*) - {_OK})::BIGINT AS failed_queries, {_of(_OK)} AS request_success_rate, {_is("UNKNOWN")}::BIGINT AS unknown_count, {_of(_is("UNKNOWN"), _OK)} AS unknown_recall,
  count_if({_WRONG})::BIGINT AS false_match_count, {_of(f"count_if({_WRONG})", _OK)} AS negative_false_match_rate, {_is("AUTO_MATCH")}::BIGINT AS false_auto_match_count, {_of(_is("AUTO_MATCH"), _OK)} AS negative_auto_match_rate,
  {_is("MANUAL_REVIEW")}::BIGINT AS false_manual_review_count, {_of(_is("MANUAL_REVIEW"), _OK)} AS negative_manual_review_rate, count_if(api_success AND candidate_count > 0)::BIGINT AS candidate_exposed_count, {_of("count_if(api_success AND candidate_count > 0)", _OK)} AS candidate_exposure_rate,
  round(avg(CASE WHEN api_success AND predicted_company_id IS NOT NULL THEN best_score END), 6) AS average_best_final_score, round(avg(CASE WHEN {_WRONG} THEN best_score END), 6) AS average_false_match_score, round(max(CASE WHEN {_WRONG} THEN best_score END), 6) AS maximum_false_match_score, {_LATE}"""


@query(f"WITH {I.SQL_ROWS} SELECT difficulty, {_NEGATIVE} FROM rows_ GROUP BY difficulty")
def negative_metrics(spark, sf):
    return E.negative_metrics(_rows(spark, sf), "difficulty", latency="latency_ms")


@query(f"WITH {I.SQL_ROWS} SELECT {_NEGATIVE} FROM rows_")
def negative_metrics_overall(spark, sf):
    return E.negative_metrics(_rows(spark, sf), latency="latency_ms")


_RISK = "CASE decision WHEN 'UNKNOWN' THEN 'CORRECT_REJECTION' WHEN 'AUTO_MATCH' THEN 'CRITICAL_FALSE_AUTO' WHEN 'MANUAL_REVIEW' THEN 'FALSE_REVIEW' ELSE 'OTHER' END AS risk"


@query(f"WITH {I.SQL_ROWS} SELECT query_id, decision <> 'UNKNOWN' AS false_match, {_RISK} FROM rows_")
def negative_row_flags(spark, sf):
    return E.negative_rows(_rows(spark, sf)).select("query_id", "false_match", "risk")


@query(f"WITH {I.SQL_ROWS} SELECT query_id, decision, best_score, margin, {_RISK} FROM rows_ ORDER BY CASE decision WHEN 'AUTO_MATCH' THEN 0 WHEN 'MANUAL_REVIEW' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END, best_score DESC, margin DESC, query_id LIMIT 30")
def riskiest_topk(spark, sf):
    return E.riskiest(_rows(spark, sf)).select("query_id", "decision", "best_score", "margin", E.risk(F.col("decision")).alias("risk"))


_ERROR = "CASE WHEN top1 THEN 'NONE' WHEN decision = 'AUTO_MATCH' THEN 'FALSE_AUTO' WHEN query_id % 7 = 0 THEN 'AMBIGUOUS' WHEN true_rank IS NULL THEN 'NOT_IN_TOP_10' WHEN true_rank = 2 THEN 'NEAR_MISS' ELSE 'RANKING_ERROR' END"


def _errors(spark, sf):
    """No query of these tables is ambiguous by its text, so every seventh stands for one."""
    return _rows(spark, sf).withColumn("error_type", E.error_type(F.col("decision"), F.col("top1"), F.col("query_id") % 7 == 0, F.col("true_rank")))


@query(f"WITH {I.SQL_ROWS} SELECT error_type, count(*) AS n FROM (SELECT {_ERROR} AS error_type FROM rows_) GROUP BY 1")
def error_types(spark, sf):
    return _errors(spark, sf).groupBy("error_type").agg(F.count("*").alias("n"))


@query(f"""WITH {I.SQL_ROWS} SELECT query_id, error_type, best_score, CAST(list_position(['FALSE_AUTO', 'NOT_IN_TOP_10', 'NEAR_MISS', 'RANKING_ERROR', 'AMBIGUOUS'], error_type) - 1 AS INTEGER) AS priority
FROM (SELECT *, {_ERROR} AS error_type FROM rows_) WHERE error_type <> 'NONE' AND decision IN ('MANUAL_REVIEW', 'UNKNOWN') AND difficulty IN ('F', 'O')""")
def error_list(spark, sf):
    return E.error_list(_errors(spark, sf), decision=["MANUAL_REVIEW", "UNKNOWN"], difficulty=["F", "O"], reranker_effect=[]).select("query_id", "error_type", "best_score", "priority")


_RANKS = f"""{_SHADOW}, {I.SQL_TRUTH}, w AS (SELECT query_id, max(CASE WHEN shadow_rank = 1 THEN company_id END) <> max(CASE WHEN final_rank = 1 THEN company_id END) AS winner_changed FROM sh GROUP BY 1),
t AS MATERIALIZED (SELECT truth.query_id, any_value(truth.difficulty) AS difficulty, any_value(dataset_type) AS dataset_type, bool_or(w.winner_changed) AS winner_changed, coalesce(max(CASE WHEN company_id = sh.expected_company_id THEN final_rank END), 0) AS c, coalesce(max(CASE WHEN company_id = sh.expected_company_id THEN shadow_rank END), 0) AS s FROM truth JOIN sh USING (query_id) JOIN w USING (query_id) GROUP BY 1)"""


def _ranked_sql(rows: str, key: str) -> str:
    hist = lambda c, name: f"(SELECT {key}, '{{' || string_agg('\"' || {c} || '\":' || n, ',' ORDER BY {c}) || '}}' AS {name} FROM (SELECT {key}, {c}, count(*) AS n FROM {rows} GROUP BY 1, 2) GROUP BY 1)"
    mean = lambda x: f"avg(CAST({x} AS DOUBLE))"
    rr = lambda x: f"CASE WHEN {x} > 0 THEN CAST(1 AS DOUBLE) / {x} ELSE 0 END"
    gain = lambda x: f"CASE WHEN {x} > 0 THEN 1 / log2({x} + 1) ELSE 0 END"
    parts = []
    for name, f in (("top1", lambda x: f"{x} = 1"), ("recall", lambda x: f"{x} > 0"), ("mrr", rr), ("ndcg", gain)):
        parts += [f"round({mean(f('c'))}, 6) AS current_{name}", f"round({mean(f('s'))}, 6) AS shadow_{name}"]
        if name != "recall":
            parts.append(f"round({mean(f('s'))} - {mean(f('c'))}, 6) AS {name}_lift")
    return f"""SELECT a.*, b.current_ranks, d.shadow_ranks FROM (SELECT {key}, count(*) AS queries, count_if(c = 1)::BIGINT AS current_top1_count, count_if(s = 1)::BIGINT AS shadow_top1_count, {", ".join(parts)},
  count_if(c > 0 AND s > 0 AND s < c)::BIGINT AS improved, count_if(c > 0 AND s > c)::BIGINT AS hurt, count_if(c > 0 AND s = c)::BIGINT AS unchanged, count_if(c <= 0)::BIGINT AS current_missing, count_if(c > 0 AND s <= 0)::BIGINT AS shadow_missing, count_if(winner_changed)::BIGINT AS winner_changed
  FROM {rows} GROUP BY 1) a JOIN {hist("c", "current_ranks")} b USING ({key}) JOIN {hist("s", "shadow_ranks")} d USING ({key})"""


def _ranks(spark, sf):
    c = _shadowed(spark, sf)
    hit = F.col("company_id") == F.col("expected_company_id")
    t = c.groupBy("query_id").agg(F.bool_or("winner_changed").alias("winner_changed"), F.max(F.when(hit, F.col("final_rank"))).alias("current_rank"), F.max(F.when(hit, F.col("shadow_rank"))).alias("shadow_rank"))
    return t.join(I.truth(I.candidates(spark, sf)), "query_id")


@query(f"WITH {_RANKS} {_ranked_sql('t', 'difficulty')}")
def shadow_summary(spark, sf):
    return E.ranked_summary(_ranks(spark, sf), "current_rank", "shadow_rank", "difficulty")


@query(f"WITH {_RANKS}, k AS MATERIALIZED (SELECT *, unnest(CASE dataset_type WHEN 'POSITIVE' THEN ['standard_positive', 'combined_positive'] ELSE ['hard_positive', 'combined_positive'] END) AS part FROM t WHERE dataset_type <> 'NEGATIVE') {_ranked_sql('k', 'part')}")
def shadow_report(spark, sf):
    return E.shadow_report(_ranks(spark, sf).where("dataset_type <> 'NEGATIVE'"))


_DECIDED = "list_sort(list_distinct(list(decision)))"


@query(f"""WITH {I.SQL_ROWS} SELECT count(*) AS queries, count_if(decision = 'UNKNOWN')::BIGINT AS unknown_count, {_of("count_if(decision = 'UNKNOWN')")} AS unknown_recall, count_if(decision = 'MANUAL_REVIEW')::BIGINT AS manual_review_count, {_of("count_if(decision = 'MANUAL_REVIEW')")} AS manual_review_rate,
  count_if(decision = 'AUTO_MATCH')::BIGINT AS false_auto_match_count, {_of("count_if(decision = 'AUTO_MATCH')")} AS false_auto_match_rate, count_if(winner_changed)::BIGINT AS winner_changed_count, {_of("count_if(winner_changed)")} AS winner_changed_rate,
  (SELECT '{{' || string_agg('"' || decision || '":' || n, ',' ORDER BY decision) || '}}' FROM (SELECT decision, count(*) AS n FROM rows_ WHERE dataset_type = 'NEGATIVE' GROUP BY 1)) AS decision_counts FROM rows_ WHERE dataset_type = 'NEGATIVE'""")
def negative_shadow_summary(spark, sf):
    return E.negative_shadow_summary(_rows(spark, sf).where("dataset_type = 'NEGATIVE'"))


@query(f"""WITH {I.SQL_ROWS}, o AS (SELECT *, CASE WHEN candidate_count > 1 THEN 'applied' ELSE 'skipped_single_candidate' END AS status FROM rows_)
SELECT count(*) AS total_queries, {_OK}::BIGINT AS successful_queries, count_if(NOT api_success)::BIGINT AS failed_queries, count_if(api_success AND candidate_count > 1)::BIGINT AS applied_count, {_of("count_if(api_success AND candidate_count > 1)", _OK)} AS applied_rate, count_if(api_success AND winner_changed)::BIGINT AS flag_mismatches,
  round(avg(CASE WHEN api_success THEN latency_ms END), 3) AS average_latency_ms, round(quantile_cont(CASE WHEN api_success THEN latency_ms END, 0.5), 3) AS median_latency_ms,
  (SELECT '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' FROM (SELECT status, count(*) AS n FROM o WHERE api_success GROUP BY 1)) AS status_counts FROM o""")
def shadow_overview(spark, sf):
    """The flag that is compared here is the constant no, so that every changed winner is a mismatch."""
    many = F.col("candidate_count") > 1
    r = _rows(spark, sf).withColumns({"shadow_applied": many, "shadow_status": F.when(many, "applied").otherwise("skipped_single_candidate"), "flag_matches": ~F.col("winner_changed")})
    return E.shadow_overview(r)


@query(f"WITH {I.SQL_CANDIDATES} SELECT query_id AS group_id, count(*) AS candidates, CAST(count_if(company_id = expected_company_id) AS BIGINT) AS positives, count(DISTINCT difficulty) AS types, count(DISTINCT expected_company_id) AS expected FROM cand GROUP BY 1 HAVING count(*) < 2 OR count_if(company_id = expected_company_id) <> 1")
def group_validation(spark, sf):
    c = I.candidates(spark, sf).select(F.col("query_id").alias("group_id"), F.col("difficulty").alias("dataset_type"), "expected_company_id", (F.col("company_id") == F.col("expected_company_id")).cast("long").alias("label"))
    return T.invalid_groups(c)


_SPLIT = """c AS (SELECT o_custkey AS company_id, bool_or(o_orderstatus = 'F') AS hard FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY hard ORDER BY md5(CAST(company_id AS VARCHAR)), company_id) AS k, count(*) OVER (PARTITION BY hard) AS n FROM c)"""


@query(f"WITH {_SPLIT} SELECT o_orderkey AS group_id, o_custkey AS company_id, k.k <= least(greatest(round(n * CAST(0.2 AS DOUBLE)), 1), greatest(n - 1, 0)) AS validation FROM orders JOIN k ON company_id = o_custkey")
def company_disjoint_split(spark, sf):
    g = load(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_custkey").alias("company_id"), (F.col("o_orderstatus") == "F").alias("hard"))
    return T.split(g).select("group_id", "company_id", "validation")


@query("SELECT o_orderkey AS group_id, CASE WHEN o_orderstatus = 'F' THEN CAST(3 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), (1 + o_custkey % 9) - CAST(2 AS DOUBLE)) * CAST(0.15 AS DOUBLE) ELSE 1 END AS weight FROM orders")
def group_weights(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), T.group_weight(F.col("o_orderstatus") == "F", 1 + F.col("o_custkey") % 9).alias("weight"))


@query("SELECT event_type, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS median, round(quantile_cont(value, 0.95), 3) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    return E.latency(load(spark, sf, "events"), "value", "event_type")


@query("""WITH e AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1)
SELECT coalesce(e.user_id, c_custkey) AS user_id, CASE WHEN e.user_id IS NULL THEN c_mktsegment ELSE event_type END AS event_type, CASE WHEN e.user_id IS NULL THEN c_acctbal ELSE value END AS value FROM e FULL JOIN customer ON user_id = c_custkey""")
def upsert_last_wins(spark, sf):
    """Customers' rows, updated by the last event of each user, with rows of users that are no customers."""
    e = load(spark, sf, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    target = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"), F.col("c_acctbal").alias("value"))
    return D.upsert(target, e, ["user_id"], "seq")


@query("SELECT doc_id, 1000000000000 + CAST(('0x' || substr(sha256(source || ':' || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS stable_id FROM documents")
def stable_company_id(spark, sf):
    return load(spark, sf, "documents").select("doc_id", N.stable_id(F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("stable_id"))


@query(f"""WITH {I.SQL_POOL}, b AS (SELECT company_id, brand_name, trim(coalesce(nullif(core_text, ''), ascii_text)) AS n FROM {I.sql_normalized("names", "company_id, brand_name", "brand_name")})
SELECT company_id, brand_name FROM b WHERE n <> '' AND NOT EXISTS (SELECT 1 FROM pool WHERE pool.company_id = b.company_id AND pool.normalized_alias = b.n)""")
def implicit_alias_antijoin(spark, sf):
    c = I.names(spark, sf)
    given = c.select(F.col("company_id").alias("alias_id"), "company_id", F.col("legal_name").alias("alias_text"), F.lit("EXPLICIT").alias("alias_type"))
    p = M.build_pool(c.withColumn("legal_name", F.lit("")), given, with_nfkc=False)
    return p.where("alias_type = 'BRAND_NAME'").select("company_id", F.col("alias_text").alias("brand_name"))


@query("SELECT DISTINCT o_custkey AS company_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def holdout_antijoin(spark, sf):
    o = load(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("company_id")).distinct().join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("company_id")), "company_id", "left_anti")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 100 OFFSET 50")
def paginate(spark, sf):
    return D.page(load(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 100, 50)


@query("SELECT difficulty, reranker_effect, n FROM (SELECT coalesce(o_orderstatus, 'ALL') AS difficulty, coalesce(o_orderpriority, 'ALL') AS reranker_effect, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ()))")
def grouping_sets(spark, sf):
    g = load(spark, sf, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("difficulty"), F.coalesce("o_orderpriority", F.lit("ALL")).alias("reranker_effect"), "n")


@query()
def ltr_train_eval(spark, sf):
    """A pairwise ranking model trained on one side of the split, with the groups' weights, and evaluated on the other."""
    c = _exported(spark, sf).where("ranker_eligible = 1")
    features = ["f_retrieval_score", "f_reranker_score", "f_lexical_evidence", "f_final_score"]
    g = T.groups(c)
    parts = T.split(g.select("group_id", F.col("expected_company_id").alias("company_id"), (F.col("dataset_type") == "HARD_POSITIVE").alias("hard"))).select("group_id", "validation")
    c = T.weighted(c, g).join(parts, "group_id")
    model = T.pairwise_model(c.where("NOT validation"), T.check_features(c, features), "weight")
    return T.slices(T.details(T.predict(model, c.where("validation"), features)))


# retrieval to reranking

_SPACE = lambda name, words: f"""{name}a AS MATERIALIZED (SELECT alias_id, g, 1 + ln(CAST(count(*) AS DOUBLE)) AS tf FROM (SELECT alias_id, unnest({_grams("normalized_alias", words)}) AS g FROM pool) GROUP BY 1, 2),
{name}i AS MATERIALIZED (SELECT g, ln((1 + (SELECT count(*) FROM pool)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM {name}a GROUP BY 1),
{name}w AS MATERIALIZED (SELECT alias_id, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY alias_id)) AS w FROM {name}a JOIN {name}i USING (g)),
{name}q AS MATERIALIZED (SELECT query_id, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS w FROM (SELECT query_id, g, 1 + ln(CAST(count(*) AS DOUBLE)) AS tf FROM (SELECT query_id, unnest({_grams("query_text", words)}) AS g FROM queries) GROUP BY 1, 2) JOIN {name}i USING (g)),
{name}s AS MATERIALIZED (SELECT query_id, alias_id, round(sum({name}q.w * {name}w.w), 6) AS score FROM {name}q JOIN {name}w USING (g) GROUP BY 1, 2)"""  # noqa: E731
_FIND = lambda x: f"list_distinct(list_filter(regexp_split_to_array(upper({x}), '[^A-Za-z0-9]+'), lambda y: regexp_full_match(y, '([A-Z]{{0,3}}[0-9]{{6,}}|[0-9]{{6,}}[A-Z]{{0,3}})')))"
_TOKEN = f"""tw AS (SELECT query_id, alias_id, qi, q, unnest(string_split(normalized_alias, ' ')) AS c FROM (SELECT query_id, alias_id, normalized_alias, unnest(range(1, len(string_split(query_text, ' ')) + 1)) AS qi, unnest(string_split(query_text, ' ')) AS q FROM sc) WHERE q <> ''),
ts AS (SELECT query_id, alias_id, qi, q, max({_PREFIX}) AS s FROM (SELECT *, len(list_filter(range(1, least(length(q), length(c)) + 1), lambda i: substr(q, 1, i) = substr(c, 1, i))) AS cp FROM tw) GROUP BY 1, 2, 3, 4),
tp AS MATERIALIZED (SELECT query_id, alias_id, CAST(round(CAST(sum(s * greatest(1, least(8, length(q)))) / sum(greatest(1, least(8, length(q)))) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS token_prefix FROM ts GROUP BY 1, 2)"""
SQL_CHAIN = f"""WITH {I.SQL_POOL}, {I.SQL_QUERIES}, {_SPACE("b", True)}, {_SPACE("r", False)},
both_ AS MATERIALIZED (SELECT query_id, alias_id, coalesce(bs.score, 0) AS char_wb_tfidf, coalesce(rs.score, 0) AS raw_char_tfidf, CAST(round(CAST(CAST(0.55 AS DOUBLE) * coalesce(bs.score, 0) + CAST(0.45 AS DOUBLE) * coalesce(rs.score, 0) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS char_tfidf FROM bs FULL JOIN rs USING (query_id, alias_id)),
ids AS MATERIALIZED (SELECT DISTINCT query_id, alias_id FROM (SELECT query_id, unnest({_FIND("raw_text")}) AS i FROM queries) a JOIN (SELECT alias_id, unnest({_FIND("alias_text")}) AS i FROM pool) b USING (i)),
pairs AS (SELECT query_id, alias_id FROM (SELECT query_id, alias_id, char_wb_tfidf, raw_char_tfidf, char_tfidf, row_number() OVER (PARTITION BY query_id ORDER BY char_wb_tfidf DESC, alias_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY raw_char_tfidf DESC, alias_id) AS b, row_number() OVER (PARTITION BY query_id ORDER BY char_tfidf DESC, alias_id) AS c FROM both_)
    WHERE a <= 100 AND char_wb_tfidf > 0 OR b <= 100 AND raw_char_tfidf > 0 OR c <= 100 AND char_tfidf > 0 UNION SELECT query_id, alias_id FROM queries JOIN pool ON query_text = normalized_alias UNION SELECT query_id, alias_id FROM ids),
owners AS (SELECT normalized_alias, count(DISTINCT company_id) AS owners FROM pool GROUP BY 1),
sc AS MATERIALIZED (SELECT p.query_id, p.alias_id, company_id, query_text, pool.normalized_alias, coalesce(char_wb_tfidf, 0) AS char_wb_tfidf, coalesce(raw_char_tfidf, 0) AS raw_char_tfidf, coalesce(char_tfidf, 0) AS char_tfidf, ids.query_id IS NOT NULL AS identifier_overlap, query_text = pool.normalized_alias AS exact_match, CAST(round(CAST(jaro_winkler_similarity(query_text, pool.normalized_alias) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS jaro_winkler,
    query_text = pool.normalized_alias AND owners = 1 AND length(regexp_replace(query_text, '[^a-z0-9]', '', 'g')) >= 3 AS unique_exact_match FROM pairs p JOIN queries USING (query_id) JOIN pool USING (alias_id) JOIN owners ON owners.normalized_alias = pool.normalized_alias LEFT JOIN both_ USING (query_id, alias_id) LEFT JOIN ids USING (query_id, alias_id)),
{_TOKEN},
hy AS (SELECT *, exact_match AND NOT unique_exact_match AS ambiguous_exact_match, CAST(round(CAST(CASE WHEN unique_exact_match THEN CAST(1 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) * char_tfidf + CAST(0.1 AS DOUBLE) * jaro_winkler + CAST(0.1 AS DOUBLE) * coalesce(token_prefix, 0) + CAST(0.1 AS DOUBLE) * identifier_overlap::INT END AS DECIMAL(18, 9)), 6) AS DOUBLE) AS hybrid_score FROM sc LEFT JOIN tp USING (query_id, alias_id)),
top_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY unique_exact_match DESC, hybrid_score DESC, company_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, company_id ORDER BY hybrid_score DESC, alias_id) AS r FROM hy) WHERE r = 1),
cand AS MATERIALIZED (SELECT query_id, company_id, alias_id, rank, hybrid_score, unique_exact_match, ambiguous_exact_match, identifier_overlap, hybrid_score AS retrieval_score, CAST(('0x' || substr(md5(query_id || ':' || company_id), 1, 8))::BIGINT % 1000 AS DOUBLE) / 1000 AS reranker_score,
    greatest(char_wb_tfidf, raw_char_tfidf, char_tfidf, jaro_winkler, coalesce(token_prefix, 0)) AS lexical_evidence, length(replace(query_text, ' ', '')) AS query_length, len(list_filter(string_split(query_text, ' '), lambda x: x <> '')) AS query_tokens, query_id AS expected_company_id, query_id % 3 AS difficulty FROM top_ WHERE rank <= 10), {I.SQL_RERANK}"""


def _chain(spark, sf):
    """Retrieval by n-grams, texts and identifiers into reranking, with stand-ins for a model's scores."""
    m = M.match(I.queries(spark, sf), I.pool(spark, sf), limit=10, edits=False)
    return R.rerank(R.from_matches(m, I.reranker_scores(m)))


@query(SQL_CHAIN + " SELECT query_id, company_id, alias_id, CAST(rank AS INTEGER) AS position, hybrid_score, lexical_evidence, query_length::INTEGER AS query_length, query_tokens::INTEGER AS query_tokens, round(reranker_gap, 6) AS reranker_gap, base_weight, adjusted_score, reranker_weight, final_score, CAST(final_rank AS INTEGER) AS final_rank, margin, decision FROM reranked")
def retrieval_to_rerank(spark, sf):
    return _chain(spark, sf).select("query_id", "company_id", "alias_id", "position", "hybrid_score", "lexical_evidence", "query_length", "query_tokens", F.round("reranker_gap", 6).alias("reranker_gap"), "base_weight", "adjusted_score", "reranker_weight", "final_score", "final_rank", "margin", "decision")


@query(SQL_CHAIN + ", truth AS (SELECT query_id, query_id AS expected_company_id, query_id % 50 <> 0 AS api_success, CAST(query_id * 7919 % 1000 AS DOUBLE) / 10 AS latency_ms FROM queries)," + I.sql_rows("reranked", "truth") + f" SELECT {_POSITIVE} FROM rows_")
def chain_metrics(spark, sf):
    q = I.queries(spark, sf)
    return E.positive_metrics(E.rows(_chain(spark, sf), q.select("query_id", F.col("query_id").alias("expected_company_id"), (F.col("query_id") % 50 != 0).alias("api_success"), (F.col("query_id") * 7919 % 1000 / 10.0).alias("latency_ms"))), latency="latency_ms")


@query(f"""WITH {I.SQL_POOL}, {I.SQL_QUERIES} SELECT query_text, normalized_alias, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, normalized_alias) AS rank FROM
  (SELECT query_text, normalized_alias, round(jaro_winkler_similarity(query_text, normalized_alias), 6) AS score FROM (SELECT DISTINCT query_text FROM queries WHERE query_text <> '') CROSS JOIN (SELECT DISTINCT normalized_alias FROM pool))) WHERE rank <= 10""")
def jaro_winkler_topk(spark, sf):
    return M.edit_top(I.queries(spark, sf), I.pool(spark, sf), 10, ("jaro_winkler",)).select("query_text", "normalized_alias", "score", "rank")


@query()
def nearest_aliases(spark, sf):
    """The nearest alias of every query by WRatio."""
    asked = keep(I.queries(spark, sf).select("query_id", "query_text"), "queries")  # two branches read it
    return M.nearest_alias(asked, I.pool(spark, sf)).select("query_id", "query_text", "closest_alias", "closest_similarity")


# texts


@query(rf"""SELECT doc_id, trim(regexp_replace(lower(translate(nfc_normalize(trim(text)), 'Iİ', 'ıi')), '[^\pL\pM\pN_]+', ' ', 'g')) AS normalized_text FROM documents""")
def unicode_surface(spark, sf):
    return _documents(spark, sf).select("doc_id", "normalized_text")


@query(f"SELECT doc_id, len(list_filter(string_split(core_text, ' '), lambda x: x <> ''))::INTEGER AS n_tokens FROM {_DOCS}")
def token_counts(spark, sf):
    return _documents(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"))


@query(f"""WITH {I.SQL_QUERIES.replace("raw AS", f"{I.SQL_NAMES}, raw AS", 1)} SELECT query_id, length(replace(query_text, ' ', ''))::INTEGER AS query_length, len(list_filter(string_split(query_text, ' '), lambda x: x <> ''))::INTEGER AS query_tokens,
  length(replace(query_text, ' ', '')) < 5 OR (strpos(query_text, ' ') = 0 AND length(query_text) <= 4) AS ambiguous, length(regexp_replace(raw_text, '[^A-Za-zÇĞİÖŞÜçğıöşü]', '', 'g')) / length(regexp_replace(raw_text, '[^\\pL\\pN]', '', 'g')) >= CAST(0.6 AS DOUBLE) AS latin FROM queries""")
def query_features(spark, sf):
    return I.queries(spark, sf).select("query_id", N.query_length(F.col("query_text")).alias("query_length"), N.query_tokens(F.col("query_text")).alias("query_tokens"), C.ambiguous(F.col("query_text")).alias("ambiguous"), N.latin_dominant(F.col("raw_text")).alias("latin"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'BLANK_TEXT' WHEN length(text) > 2000 THEN 'TEXT_TOO_LONG' WHEN doc_id % 60 < 1 OR doc_id % 60 > 50 THEN 'LIMIT_OUT_OF_RANGE' END AS error FROM documents")
def request_validation(spark, sf):
    return load(spark, sf, "documents").select("doc_id", N.validate(F.col("text"), F.col("doc_id") % 60).alias("error"))


def _short_sql() -> str:
    ends = "(?:,\\s*|\\s+)(?:" + "|".join(N.NAME_ENDINGS) + ")\\s*$"
    steps = ["SELECT company_id, trim(legal_name, ' ,.-') AS n FROM names"]
    for _ in range(6):  # names of these tables have at most six words
        steps.append(f"SELECT company_id, CASE WHEN length(c) >= 3 THEN c ELSE n END AS n FROM (SELECT *, trim(regexp_replace(n, '{ends}', '', 'i'), ' ,.-') AS c FROM ({steps[-1]}))")
    return f"WITH {I.SQL_NAMES} SELECT company_id, n AS short_name FROM ({steps[-1]})"


@query(_short_sql())
def short_names(spark, sf):
    return I.names(spark, sf).select("company_id", N.short_name(F.col("legal_name")).alias("short_name"))


@query(f"""WITH {I.SQL_TYPED_POOL} SELECT alias_id, 'Official company name: ' || legal_name || ' | Brand: ' || brand_name || ' | Known alias: ' || alias_text || ' | Normalized alias: ' || normalized_alias || ' | City: ' || coalesce(city, '') || ' | Sector: ' || coalesce(sector, '') AS embedding_text,
  concat_ws(' | ', 'Candidate legal name: ' || legal_name, CASE WHEN lower(brand_name) <> lower(legal_name) THEN 'Candidate brand name: ' || brand_name END, CASE WHEN lower(alias_text) NOT IN (lower(legal_name), lower(brand_name)) THEN 'Candidate known alias: ' || alias_text END,
  'Candidate normalized alias: ' || normalized_alias, 'Alias type: ' || alias_type, 'Identifier overlap: ' || CASE WHEN alias_id % 2 = 0 THEN 'yes' ELSE 'no' END, 'Identifier match score: ' || CASE WHEN alias_id % 2 = 0 THEN '1.000' ELSE '0.000' END) AS reranker_text FROM typed""")
def model_texts(spark, sf):
    p = I.typed_pool(spark, sf).withColumn("identifier_overlap", F.col("alias_id") % 2 == 0)
    return p.select("alias_id", M.embedding_document().alias("embedding_text"), R.reranker_document().alias("reranker_text"))


@query(f"WITH {I.SQL_QUERIES.replace('raw AS', f'{I.SQL_NAMES}, raw AS', 1)} SELECT query_id, concat_ws(' | ', CASE WHEN trim(raw_text) <> '' THEN 'Observed entity text: ' || trim(raw_text) END, CASE WHEN query_text <> '' AND lower(query_text) <> lower(trim(raw_text)) THEN 'Normalized entity text: ' || query_text END) AS reranker_query FROM queries")
def reranker_queries(spark, sf):
    return I.queries(spark, sf).select("query_id", R.reranker_query(F.col("raw_text"), F.col("query_text")).alias("reranker_query"))


# benchmarks


@query(f"WITH {I.SQL_TYPED_POOL} SELECT normalized_alias, company_id, array_to_string(list_sort(list_distinct(list(trim(alias_text)))), '|') AS originals FROM typed GROUP BY 1, 2")
def alias_ownership(spark, sf):
    return M.ownership(I.typed_pool(spark, sf)).withColumn("originals", F.array_join("originals", "|"))


_PRIORITY = "CASE alias_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in B.ALIAS_PRIORITY.items()) + " ELSE 100 END"


@query(f"""WITH {I.SQL_TYPED_POOL}, o AS (SELECT *, {_PRIORITY} AS p, row_number() OVER (PARTITION BY company_id, normalized_alias ORDER BY {_PRIORITY}, alias_id) AS r FROM typed WHERE length(trim(alias_text)) >= 3)
SELECT company_id, trim(alias_text) AS source_alias, alias_type AS source_alias_type, CAST(row_number() OVER (PARTITION BY company_id ORDER BY p, abs(length(trim(alias_text)) - 20), alias_id) - 1 AS INTEGER) AS place, count(*) OVER (PARTITION BY company_id) AS n_aliases FROM o WHERE r = 1""")
def source_aliases(spark, sf):
    return B.source_aliases(I.typed_pool(spark, sf))


@query(f"""WITH {I.SQL_POOL}, {I.SQL_QUERIES}, o AS (SELECT normalized_alias, company_id, list_sort(list_distinct(list(trim(alias_text)))) AS t FROM pool GROUP BY 1, 2),
h AS (SELECT query_id, array_to_string(list_sort(list_distinct(list(CAST(o.company_id AS VARCHAR)))), '|') AS ids, array_to_string(list_slice(flatten(list(list_transform(o.t, lambda x: o.company_id || ':' || x) ORDER BY CAST(o.company_id AS VARCHAR))), 1, 20), '|') AS aliases FROM queries JOIN o ON query_text = normalized_alias AND company_id <> query_id GROUP BY 1)
SELECT query_id, ids IS NOT NULL AS has_collision, coalesce(ids, '') AS collision_company_ids, coalesce(aliases, '') AS collision_aliases FROM queries LEFT JOIN h USING (query_id)""")
def query_collisions(spark, sf):
    q = I.queries(spark, sf).select("query_id", F.col("query_text").alias("normalized_query"), F.col("query_id").alias("company_id"))
    return M.query_collisions(q, M.ownership(I.pool(spark, sf))).select("query_id", "has_collision", "collision_company_ids", "collision_aliases")


@query()
def positive_benchmark(spark, sf):
    """Three queries of rising difficulty for every company, with their collisions."""
    p = keep(I.typed_pool(spark, sf), "pool")
    got = keep(B.positives_in_turn(B.source_aliases(p), p, with_nfkc=False), "positives")
    return B.with_collisions(got, p).select("company_id", "difficulty", "source_alias", "query_text", "normalized_query", "corruption_type", "benchmark_valid", "ambiguous_query", "strict_evaluation_eligible", "generation_attempts", "duplicate_generated_query", "benchmark_collision", "collision_reason", "collision_owners", "collision_company_ids", "collision_aliases")


_CHOICE = lambda key, n, salt: f"(CAST(('0x' || substr(md5({key} || ':{salt}:42'), 1, 15)) AS BIGINT) % {n})"
_NEGATIVES = 1000


def _digits_sql(key: str, least: int, most: int, salt: str) -> str:
    parts = " || ".join(f"lpad(CAST({_CHOICE(key, 10**7, f'{salt}-{k}')} AS VARCHAR), 7, '0')" for k in range(-(-most // 7)))
    return f"substr({parts}, 1, {least} + {_CHOICE(key, most - least + 1, f'{salt}-size')})"


def _negative_sql() -> str:
    key = "(slot || ':1')"
    pick = lambda values, salt: f"[{', '.join(repr(v) for v in values)}][{_CHOICE(key, len(values), salt)} + 1]"
    way = lambda *texts: f"[{', '.join(texts)}][{_CHOICE(key, len(texts), 'way')} + 1]"
    join = lambda *x: " || ' ' || ".join(x)
    number, n = _digits_sql(key, 6, 12, "ref"), len(B.COMPANY_ACTIVITIES)
    acts = f"[{', '.join(repr(v) for v in B.COMPANY_ACTIVITIES)}]"
    a = _CHOICE(key, n, "activity")
    activity = f"({acts}[{a} + 1] || CASE WHEN {_CHOICE(key, 3, 'two')} = 2 THEN ' ' || {acts}[({a} + 1 + {_CHOICE(key, n - 1, 'other')}) % {n} + 1] ELSE '' END)"
    head, noise = pick(B.COMPANY_PREFIXES, "prefix"), pick(B.PAYMENT_NOISE, "noise")
    company = join(head, activity, pick(B.COMPANY_SUFFIXES, "suffix"))
    person, reason, generic = join(pick(B.FIRST_NAMES, "first"), pick(B.LAST_NAMES, "last")), pick(B.PERSON_REASONS, "reason"), pick(B.GENERIC_TEXTS, "generic")
    long, second = _digits_sql(key, 8, 16, "long"), _digits_sql(key, 6, 10, "second")
    code = f"upper(substr(md5({key} || ':code'), 1, 5 + {_CHOICE(key, 6, 'code')}))"
    texts = {
        "SYNTHETIC_COMPANY": way(join(company, noise, number), join(head, activity, noise), join(company, "'REF'", number)), "PERSON_PAYMENT": way(join(person, reason), join(person, reason, "'REF'", number), join(reason, person)),
        "GENERIC_PAYMENT": way(generic, join(generic, "'REF'", number), join(number, generic)), "REFERENCE_ONLY": way(join("'EFT REF'", long), join("'HAVALE REF'", long, "'ISLEM'", second), join("'ODEME'", code, long), join("'REF'", long, "'DEKONT'", second), join("'ISLEM NO'", long)),
    }
    at, kinds = 0, []
    for k, q in B.quotas(_NEGATIVES).items():
        kinds.append(f"WHEN slot < {at + q} THEN '{k}'")
        at += q
    cases = " ".join(f"WHEN '{k}' THEN {t}" for k, t in texts.items())
    return f"SELECT slot, negative_category, CASE negative_category {cases} END AS query_text FROM (SELECT range AS slot, CASE {' '.join(kinds)} END AS negative_category FROM range({_NEGATIVES}))"


@query(_negative_sql())
def negative_texts(spark, sf):
    """The first attempts at a thousand negatives."""
    return B.negative_attempts(B.negative_slots(spark, _NEGATIVES), 1, with_nfkc=False).select("slot", "negative_category", "query_text")


@query(f"SELECT negative_category, count(*) AS n FROM ({_negative_sql()}) GROUP BY 1")
def negative_quotas(spark, sf):
    return B.negative_slots(spark, _NEGATIVES).groupBy("negative_category").agg(F.count("*").alias("n"))


@query()
def negative_acceptance(spark, sf):
    """The first round of a thousand negatives against all aliases."""
    return B.accepted(B.negative_attempts(B.negative_slots(spark, _NEGATIVES), 1, with_nfkc=False), I.pool(spark, sf)).select("slot", "negative_category", "query_text", "normalized_query", "closest_alias", "closest_similarity", "ok")


_TOKENS = r"regexp_extract_all(legal_name, '[\pL\pN]+')"
_LEGAL_LIST = "[" + ", ".join(f"'{w}'" for w in C.LEGAL_TOKENS) + "]"


def _mutation_sql() -> str:
    pick = lambda n, salt: _CHOICE("company_id", f"greatest(1, {n})", salt)
    swap = f"list_filter(range(1, length(legal_name) + 1), lambda i: regexp_full_match(substr(legal_name, i, 1), '[A-Za-z0-9]') AND regexp_full_match(substr(legal_name, i + 1, 1), '[A-Za-z0-9]') AND substr(legal_name, i, 1) <> substr(legal_name, i + 1, 1))"
    gone = "list_filter(range(1, length(legal_name) + 1), lambda i: regexp_full_match(substr(legal_name, i, 1), '[A-Za-z0-9]'))"
    return f"""WITH {I.SQL_NAMES}, a AS (SELECT company_id, legal_name, {_TOKENS} AS w, {swap} AS sw, {gone} AS dl FROM names),
b AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: length(w[i]) >= 4 AND NOT list_contains({_LEGAL_LIST}, upper(w[i]))) AS good, list_filter(w, lambda x: NOT list_contains({_LEGAL_LIST}, upper(x))) AS own FROM a),
c AS (SELECT *, CASE WHEN len(good) > 0 THEN good ELSE range(1, len(w) + 1) END AS g, sw[{pick("len(sw)", "t")} + 1] AS p, dl[{pick("len(dl)", "c")} + 1] AS d, {pick("len(w) - 1", "m")} AS k FROM b)
SELECT company_id, coalesce(nullif(array_to_string(own, ' '), ''), legal_name) AS without_legal, CASE WHEN len(w) >= 2 THEN array_to_string(list_filter(w, lambda x, i: i <> g[{pick("len(g)", "d")} + 1]), ' ') ELSE legal_name END AS dropped,
  CASE WHEN len(sw) > 0 THEN substr(legal_name, 1, p - 1) || substr(legal_name, p + 1, 1) || substr(legal_name, p, 1) || substr(legal_name, p + 2) ELSE legal_name END AS transposed, CASE WHEN len(dl) > 4 THEN substr(legal_name, 1, d - 1) || substr(legal_name, d + 1) ELSE legal_name END AS deleted,
  array_to_string(w, '') AS joined, CASE WHEN len(w) >= 2 THEN array_to_string(list_concat(w[1:k], [w[k + 1] || w[k + 2]], w[k + 3:]), ' ') ELSE replace(legal_name, ' ', '') END AS merged,
  array_to_string(list_transform(string_split_regex(legal_name, '\\s+'), lambda x: CASE WHEN length(x) > 4 THEN substr(x, 1, greatest(3, round_even(length(x) * CAST(0.65 AS DOUBLE), 0)::INT)) ELSE x END), ' ') AS abbreviated FROM c"""


@query(_mutation_sql())
def name_mutations(spark, sf):
    t, k = F.col("legal_name"), F.col("company_id")
    made = {"without_legal": C.remove_legal(t), "dropped": C.drop_token(t, k, "d"), "transposed": C.transpose_characters(t, k, "t"), "deleted": C.delete_character(t, k, "c"), "joined": C.join_tokens(t), "merged": C.merge_tokens(t, k, "m"), "abbreviated": C.abbreviate(t)}
    return I.names(spark, sf).select("company_id", *(c.alias(n) for n, c in made.items()))


_TRIED = """SELECT o_orderkey AS attempt, o_custkey AS company_id, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE o_orderpriority || ' ' || o_custkey % 400 END AS normalized_query, '5-LOW ' || o_custkey % 400 AS normalized_alias, o_orderkey % 31 = 0 AS collides, o_orderkey % 89 <> 0 AS candidates_ok, CAST(o_orderkey % 13 AS INTEGER) AS expected_rank FROM orders"""


@query(f"""WITH t AS ({_TRIED}),
a AS (SELECT *, CASE WHEN normalized_query = '' THEN 'EMPTY' WHEN lower(normalized_query) = lower(normalized_alias) THEN 'UNCHANGED' WHEN collides THEN 'ALIAS_COLLISION' WHEN NOT candidates_ok THEN 'INVALID_CANDIDATES' WHEN expected_rank = 0 THEN 'EXPECTED_MISSING' WHEN expected_rank < 2 THEN 'TOO_EASY' WHEN expected_rank > 10 THEN 'RANK_TOO_LOW' END AS reason FROM t),
b AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY lower(normalized_query), reason IS NULL ORDER BY attempt) > 1 THEN 'DUPLICATE' ELSE reason END AS reason) FROM a),
c AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY company_id, reason IS NULL ORDER BY attempt) > 5 THEN 'COMPANY_LIMIT' ELSE reason END AS reason) FROM b),
d AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL ORDER BY attempt) > 200 THEN 'TARGET_REACHED' ELSE reason END AS reason) FROM c)
SELECT coalesce(reason, 'ACCEPTED') AS reason, count(*) AS attempts FROM d GROUP BY 1""")
def rejection_counts(spark, sf):
    """Reasons of attempts at hard positives; orders stand for attempts."""
    k, o = F.col("attempt"), load(spark, sf, "orders")
    number = F.col("company_id") % 400
    t = o.select(F.col("o_orderkey").alias("attempt"), F.col("o_custkey").alias("company_id"), "o_orderpriority").withColumns({
        "normalized_query": F.when(k % 97 == 0, "").otherwise(F.concat_ws(" ", "o_orderpriority", number.cast("string"))), "normalized_alias": F.concat_ws(" ", F.lit("5-LOW"), number.cast("string")),
        "collides": k % 31 == 0, "candidates_ok": k % 89 != 0, "expected_rank": (k % 13).cast("int"),
    })
    return B.counts(B.judged(t))


# export and training


def _exported(spark, sf):
    return X.features(_reranked(spark, sf).drop("expected_company_id"), I.truth(I.candidates(spark, sf)))


SQL_EXPORT = I.SQL_ROWS + """, ex AS MATERIALIZED (SELECT t.dataset_type || ':' || query_id AS group_id, query_id, t.dataset_type, t.expected_company_id, company_id, CAST(company_id = t.expected_company_id AND t.dataset_type <> 'NEGATIVE' AS INTEGER) AS label, CAST(final_rank AS INTEGER) AS candidate_position, count(*) OVER g AS candidate_count,
  sum(CAST(company_id = t.expected_company_id AND t.dataset_type <> 'NEGATIVE' AS INTEGER)) OVER g AS positive_labels, coalesce(max(CASE WHEN company_id = t.expected_company_id AND t.dataset_type <> 'NEGATIVE' THEN final_rank END) OVER g, 0) AS expected_rank, retrieval_score, reranker_score, final_score, CAST(1 AS DOUBLE) - reranker_weight AS retrieval_weight, decision
  FROM reranked j JOIN truth t USING (query_id) WINDOW g AS (PARTITION BY query_id)),
el AS MATERIALIZED (SELECT *, CAST(dataset_type <> 'NEGATIVE' AND candidate_count >= 2 AND positive_labels = 1 AS INTEGER) AS ranker_eligible FROM ex)"""


@query(f"WITH {SQL_EXPORT} SELECT group_id, company_id, label, candidate_position, candidate_count, CAST(positive_labels AS BIGINT) AS positive_labels, CAST(expected_rank AS INTEGER) AS expected_rank, ranker_eligible, retrieval_score AS f_retrieval_score, reranker_score AS f_reranker_score, final_score AS f_final_score, round(retrieval_weight, 6) AS f_retrieval_weight, CAST(0 AS DOUBLE) AS f_embedding FROM el")
def candidate_features(spark, sf):
    return _exported(spark, sf).select("group_id", "company_id", "label", "candidate_position", "candidate_count", "positive_labels", "expected_rank", "ranker_eligible", "f_retrieval_score", "f_reranker_score", "f_final_score", F.round("f_retrieval_weight", 6).alias("f_retrieval_weight"), "f_embedding")


_hist = lambda table, col, where="true": f"(SELECT '{{' || string_agg('\"' || {col} || '\":' || n, ',' ORDER BY {col}) || '}}' FROM (SELECT {col}, count(*) AS n FROM {table} WHERE {where} GROUP BY 1))"


@query(f"""WITH {SQL_EXPORT}, g AS (SELECT query_id, max(positive_labels) AS positive_labels, max(expected_rank) AS expected_rank, max(ranker_eligible) AS ranker_eligible FROM el GROUP BY 1),
q AS MATERIALIZED (SELECT rows_.*, coalesce(g.positive_labels, 0) AS positive_labels, coalesce(g.expected_rank, 0) AS expected_rank, coalesce(g.ranker_eligible, 0) AS ranker_eligible FROM rows_ LEFT JOIN g USING (query_id))
SELECT count(*) AS total_queries, {_OK}::BIGINT AS successful_queries, count_if(NOT api_success)::BIGINT AS failed_queries, count_if(api_success AND ranker_eligible = 1)::BIGINT AS ranker_eligible_groups, ({_OK} - count_if(api_success AND ranker_eligible = 1))::BIGINT AS ranker_ineligible_groups,
  {", ".join(f"count_if(api_success AND dataset_type = '{k}')::BIGINT AS {n}_groups, {_of(f'''count_if(api_success AND dataset_type = '{k}' AND expected_rank > 0)''', f'''count_if(api_success AND dataset_type = '{k}')''')} AS {n}_recall" for k, n in (("POSITIVE", "standard_positive"), ("HARD_POSITIVE", "hard_positive")))},
  count_if(api_success AND dataset_type = 'HARD_POSITIVE' AND winner_changed)::BIGINT AS hard_positive_changed_winner, count_if(api_success AND dataset_type = 'NEGATIVE')::BIGINT AS negative_groups, round(avg(CASE WHEN api_success THEN latency_ms END), 3) AS average_latency_ms, round(quantile_cont(CASE WHEN api_success THEN latency_ms END, 0.5), 3) AS median_latency_ms,
  {_hist("q", "dataset_type")} AS queries_by_dataset, {_hist("el", "dataset_type")} AS candidates_by_dataset, (SELECT count(*) FROM el) AS total_candidate_rows, {_hist("q", "positive_labels", "api_success AND ranker_eligible = 1")} AS eligible_label_counts,
  {_hist("q", "expected_rank", "api_success AND dataset_type = 'HARD_POSITIVE' AND expected_rank > 0")} AS hard_positive_ranks, {_hist("q", "decision", "api_success")} AS decision_counts FROM q""")
def export_summary(spark, sf):
    e = _exported(spark, sf)
    r = _rows(spark, sf).select("query_id", "dataset_type", "api_success", "decision", "winner_changed", "latency_ms")
    return X.summary(X.query_results(r, e), e)


@query(f"WITH {SQL_EXPORT} SELECT group_id, max(CASE WHEN label = 1 THEN dataset_type END) AS dataset_type, max(CASE WHEN label = 1 THEN expected_company_id END) AS expected_company_id, max(CASE WHEN label = 1 THEN candidate_position END) AS expected_rank, count(*) AS candidate_count FROM el WHERE ranker_eligible = 1 GROUP BY 1")
def group_summary(spark, sf):
    return T.groups(_exported(spark, sf).where("ranker_eligible = 1"))


@query(f"WITH {SQL_EXPORT} SELECT expected_company_id, count(DISTINCT group_id) AS groups, bool_or(dataset_type = 'HARD_POSITIVE') AS hard FROM el WHERE ranker_eligible = 1 GROUP BY 1")
def company_groups(spark, sf):
    return T.companies(T.groups(_exported(spark, sf).where("ranker_eligible = 1")))


@query(f"WITH {SQL_EXPORT} SELECT dataset_type, count(DISTINCT group_id) AS groups FROM el GROUP BY 1")
def dataset_groups(spark, sf):
    return T.group_counts(_exported(spark, sf))


@query(f"WITH {SQL_EXPORT}, w AS (SELECT group_id, CASE WHEN max(dataset_type) = 'HARD_POSITIVE' THEN CAST(3 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), max(expected_rank) - CAST(2 AS DOUBLE)) * CAST(0.15 AS DOUBLE) ELSE 1 END AS weight FROM el WHERE ranker_eligible = 1 GROUP BY 1) SELECT group_id, candidate_position, round(weight, 6) AS weight FROM el JOIN w USING (group_id) WHERE ranker_eligible = 1")
def weighted_pool(spark, sf):
    c = _exported(spark, sf).where("ranker_eligible = 1")
    return T.weighted(c, T.groups(c)).select("group_id", "candidate_position", F.round("weight", 6).alias("weight"))


@query(f"WITH {_SPLIT}, s AS (SELECT company_id, k.k <= least(greatest(round(n * CAST(0.2 AS DOUBLE)), 1), greatest(n - 1, 0)) AS validation FROM k) SELECT company_id, count(DISTINCT validation) AS sides FROM s GROUP BY 1 HAVING count(DISTINCT validation) > 1")
def split_overlap(spark, sf):
    """Companies on both sides of the split: there are none."""
    s = company_disjoint_split(spark, sf)
    return T.overlap(s.where("validation"), s.where("NOT validation"))


@query("""SELECT 'valid' AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'strict', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0
UNION ALL SELECT 'eligible', count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus IN ('F', 'O') UNION ALL SELECT 'company', count(DISTINCT o_custkey) FROM orders""")
def export_filters(spark, sf):
    """How many orders pass each filter of the export, with flags as texts, and how many ids are resolved."""
    o = load(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "no").when(F.col("o_orderkey") % 2 == 0, "evet").otherwise("").alias("benchmark_valid"), F.when(F.col("o_orderkey") % 5 == 0, "True").alias("ambiguous_query"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("ranker_eligible"),
        F.when(F.col("o_orderstatus") == "F", "positive ").when(F.col("o_orderstatus") == "O", "HARD_POSITIVE").otherwise("NEGATIVE").alias("dataset_type"), F.lit(" ").alias("expected_company_id"), F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("company_id"),
    )
    n = lambda kind, df, x=F.count("*"): df.agg(x.alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("valid", X.valid_rows(o)).unionAll(n("strict", X.strict_rows(o))).unionAll(n("eligible", X.eligible_rows(o))).unionAll(n("company", o.withColumn("c", X.expected_company_id(o)), F.count_distinct("c")))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT 100")
def seeded_sample(spark, sf):
    return E.sample(load(spark, sf, "customer").select("c_custkey", "c_name"), 100, "c_custkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || ':42'), c_custkey) AS position FROM customer")
def seeded_shuffle(spark, sf):
    return E.shuffled(load(spark, sf, "customer").select("c_custkey"), "c_custkey")


# tables


@query(f"""WITH {I.SQL_TYPED_POOL} SELECT (SELECT count(*) FROM names) AS companies, count(*) AS aliases, count(DISTINCT company_id) AS companies_with_aliases, {_hist("typed", "alias_type")} AS alias_types FROM typed""")
def pool_summary(spark, sf):
    return D.summary(I.names(spark, sf), I.typed_pool(spark, sf))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def key_lookup(spark, sf):
    return D.lookup(load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 42)


@query(f"""WITH {I.SQL_NAMES} SELECT company_id, trim(alias_text) AS alias_text, alias_type FROM (SELECT company_id, 'x' || legal_name AS alias_text, 'EXPLICIT' AS alias_type FROM names UNION ALL SELECT company_id, legal_name, 'LEGAL_NAME' FROM names UNION ALL SELECT company_id, brand_name, 'BRAND_NAME' FROM names) WHERE trim(alias_text) <> ''""")
def load_job_rows(spark, sf):
    c = I.names(spark, sf)
    return D.load_rows(c, c.select(F.col("company_id").alias("alias_id"), "company_id", F.concat(F.lit("x"), "legal_name").alias("alias_text"), F.lit("EXPLICIT").alias("alias_type"))).drop("seq")


@query(f"""WITH {I.SQL_TYPED_POOL} SELECT company_id, normalized_alias, min(alias_id) AS alias_id, arg_max(alias_type, alias_id) AS alias_type, arg_max(alias_text, alias_id) AS alias_text FROM typed GROUP BY 1, 2""")
def upsert_aliases(spark, sf):
    """Legal names are there, brand names come and win where they are written alike."""
    p = I.typed_pool(spark, sf).select("alias_id", "company_id", "normalized_alias", "alias_text", "alias_type")
    return D.upsert_aliases(p.where("alias_type = 'LEGAL_NAME'"), p.where("alias_type = 'BRAND_NAME'").withColumn("seq", F.col("alias_id")))


@query("""SELECT o_custkey AS key, o_orderpriority AS a, CAST(NULL AS VARCHAR) AS b FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus = 'O'""")
def union_of_columns(spark, sf):
    o = load(spark, sf, "orders")
    return D.union_all([o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("a")), o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("b"))])
