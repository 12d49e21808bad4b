"""Evaluation of rankings and rejections: one aggregation per table of metrics.

Rates have six decimals and are null over nothing; latencies have three. Which rows a rate is over is part of its
definition: rates of positive benchmarks are over all queries, failed ones included, those of negative ones over the
successful queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b != 0, a / b), 6)


def effect(after: Column, before: Column) -> Column:
    return F.when(after.isNull(), "EXPECTED_NOT_FOUND").when(before.isNull(), "BEFORE_RANK_UNAVAILABLE").when(after < before, "HELPED").when(after > before, "HURT").otherwise("UNCHANGED")


def rows(candidates: DataFrame, truth: DataFrame, top: int = 3) -> DataFrame:
    """One row per query of ``truth`` (query_id, expected_company_id): ranks of the expected company, hits, decision, effect.

    Also the predicted company and the winner before reranking, how far the expected one is behind, all candidates' ids
    by rank and the first ``top`` as JSON. A query without candidates is a miss. Columns of ``truth`` beyond the two stay.
    """
    j = candidates.join(truth.select("query_id", "expected_company_id"), "query_id")
    hit = F.col("company_id") == F.col("expected_company_id")
    first, before = F.col("final_rank") == 1, F.col("retrieval_rank") == 1
    of = lambda when, c: F.max(F.when(when, F.col(c)))
    shown = F.struct("final_rank", F.struct(F.col("final_rank").alias("rank"), "company_id", "retrieval_score", "reranker_score", "final_score", "unique_exact_match", "ambiguous_exact_match").alias("c"))
    g = j.groupBy("query_id").agg(
        F.min(F.when(hit, F.col("final_rank"))).alias("true_rank"), F.min(F.when(hit, F.col("retrieval_rank"))).alias("rank_before"),
        of(first, "decision").alias("decision"), of(first, "final_score").alias("best_score"), of(first, "margin").alias("margin"),
        of(first, "company_id").alias("predicted_company_id"), of(before, "company_id").alias("retrieval_winner_id"),
        F.round(of(first, "retrieval_score") - of(hit, "retrieval_score"), 6).alias("retrieval_gap"), F.round(of(first, "final_score") - of(hit, "final_score"), 6).alias("final_gap"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("final_rank", "company_id"))), lambda x: x["company_id"].cast("string")), "|").alias("candidate_ids"),
        F.to_json(F.transform(F.sort_array(F.collect_list(F.when(F.col("final_rank") <= top, shown))), lambda x: x["c"])).alias("top_json"), F.count("*").alias("candidate_count"),
    )
    t = F.col("true_rank")
    g = truth.drop("expected_company_id").join(g, "query_id", "left").fillna({"decision": "UNKNOWN", "candidate_count": 0, "candidate_ids": "", "top_json": "[]"})
    changed = F.coalesce(F.col("predicted_company_id") != F.col("retrieval_winner_id"), F.lit(False))
    return g.withColumns({"top1": F.coalesce(t == 1, F.lit(False)), "top5": F.coalesce(t <= 5, F.lit(False)), "top10": F.coalesce(t <= 10, F.lit(False)), "reciprocal_rank": F.coalesce(F.round(1.0 / t, 6), F.lit(0.0)), "reranker_effect": effect(t, F.col("rank_before")), "winner_changed": changed})


def _latency(ok: Column, latency: str | None) -> list[Column]:
    if latency is None:
        return []
    x = F.when(ok, F.col(latency).cast("double"))
    return [F.round(F.avg(x), 3).alias("average_latency_ms"), F.round(F.percentile(x, 0.5), 3).alias("median_latency_ms"), F.round(F.percentile(x, 0.95), 3).alias("p95_latency_ms")]


def _success(r: DataFrame) -> tuple[DataFrame, Column]:
    r = r if "api_success" in r.columns else r.withColumn("api_success", F.lit(True))
    return r, F.coalesce(F.col("api_success"), F.lit(False))


def positive_metrics(r: DataFrame, *keys: str, latency: str | None = None) -> DataFrame:
    """Metrics over all rows, or of each key, UNKNOWN for a missing one.

    ``r`` as from rows(), and optionally api_success and a column of latencies. The precision of automatic matches is
    over these alone; a failed query counts in the rates but has no decision, effect or latency.
    """
    r, ok = _success(r)
    n, c = F.count("*"), lambda x: F.count_if(x)
    is_ = lambda d: ok & (F.col("decision") == d)
    auto = is_("AUTO_MATCH")
    r = r.withColumns({k: F.coalesce(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")), F.lit("UNKNOWN")) for k in keys})
    return r.groupBy(*keys).agg(
        n.alias("total_queries"), c(ok).alias("successful_queries"), c(~ok).alias("failed_queries"), ratio(c(ok), n).alias("request_success_rate"),
        ratio(c(ok & F.col("top1")), n).alias("top1_accuracy"), ratio(c(ok & F.col("top5")), n).alias("candidate_recall_at_5"), ratio(c(ok & F.col("top10")), n).alias("candidate_recall_at_10"), ratio(F.sum(F.when(ok, F.col("reciprocal_rank")).otherwise(0.0)), n).alias("mean_reciprocal_rank"),
        ratio(c(ok & F.col("true_rank").isNull()), n).alias("candidate_miss_rate"), c(auto).alias("auto_match_count"), ratio(c(auto), n).alias("auto_match_coverage"), ratio(c(auto & F.col("top1")), c(auto)).alias("auto_match_precision"),
        c(auto & ~F.col("top1")).alias("false_auto_match_count"), ratio(c(auto & ~F.col("top1")), n).alias("false_match_rate"), ratio(c(is_("MANUAL_REVIEW")), n).alias("manual_review_rate"), ratio(c(is_("UNKNOWN")), n).alias("unknown_rate"),
        *(c(ok & (F.col("reranker_effect") == e)).alias(f"reranker_{e.lower()}_count") for e in ("HELPED", "HURT", "UNCHANGED")), c(ok & F.col("winner_changed")).alias("reranker_changed_winner_count"), *_latency(ok, latency),
    )


def negative_metrics(r: DataFrame, *keys: str, latency: str | None = None) -> DataFrame:
    """Decisions of queries that should be unknown: decision, best_score, predicted_company_id, candidate_count."""
    r, ok = _success(r)
    n, s, c = F.count("*"), F.count_if(ok), lambda x: F.count_if(ok & x)
    is_ = lambda d: c(F.col("decision") == d)
    wrong = ok & (F.col("decision") != "UNKNOWN")
    score = F.coalesce("best_score", F.lit(0.0))
    shown = c(F.col("candidate_count") > 0)
    return r.groupBy(*keys).agg(
        n.alias("total_queries"), s.alias("successful_queries"), (n - s).alias("failed_queries"), ratio(s, n).alias("request_success_rate"), is_("UNKNOWN").alias("unknown_count"), ratio(is_("UNKNOWN"), s).alias("unknown_recall"),
        F.count_if(wrong).alias("false_match_count"), ratio(F.count_if(wrong), s).alias("negative_false_match_rate"), is_("AUTO_MATCH").alias("false_auto_match_count"), ratio(is_("AUTO_MATCH"), s).alias("negative_auto_match_rate"),
        is_("MANUAL_REVIEW").alias("false_manual_review_count"), ratio(is_("MANUAL_REVIEW"), s).alias("negative_manual_review_rate"), shown.alias("candidate_exposed_count"), ratio(shown, s).alias("candidate_exposure_rate"),
        F.round(F.avg(F.when(ok & F.col("predicted_company_id").isNotNull(), score)), 6).alias("average_best_final_score"), F.round(F.avg(F.when(wrong, score)), 6).alias("average_false_match_score"), F.round(F.max(F.when(wrong, score)), 6).alias("maximum_false_match_score"), *_latency(ok, latency),
    )


def negative_rows(r: DataFrame, expected: str = "UNKNOWN") -> DataFrame:
    """Adds false_match (a decision other than the expected one) and the class of risk."""
    return r.withColumn("false_match", F.col("decision") != F.lit(expected)).withColumn("risk", risk(F.col("decision")))


def risk(decision: Column) -> Column:
    return F.when(decision == "UNKNOWN", "CORRECT_REJECTION").when(decision == "AUTO_MATCH", "CRITICAL_FALSE_AUTO").when(decision == "MANUAL_REVIEW", "FALSE_REVIEW").otherwise("OTHER")


def error_type(r_decision: Column, top1: Column, ambiguous: Column, true_rank: Column) -> Column:
    return F.when(top1, "NONE").when(r_decision == "AUTO_MATCH", "FALSE_AUTO").when(ambiguous, "AMBIGUOUS").when(true_rank.isNull(), "NOT_IN_TOP_10").when(true_rank == 2, "NEAR_MISS").otherwise("RANKING_ERROR")


#: Errors, the worst first.
ERROR_ORDER = ("FALSE_AUTO", "NOT_IN_TOP_10", "NEAR_MISS", "RANKING_ERROR", "AMBIGUOUS")


def error_list(r: DataFrame, **only: list[str]) -> DataFrame:
    """The wrong rows in order of their error and score; ``only``: wanted values of columns, an empty list wants all."""
    r = r.where(F.col("error_type") != "NONE")
    for column, values in only.items():
        r = r.where(F.col(column).isin(values)) if values else r
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ERROR_ORDER)), F.col("error_type")), F.lit(0))
    return r.withColumn("priority", F.when(place > 0, place - 1).otherwise(99).cast("int")).orderBy("priority", F.desc("best_score"), "query_id")


def riskiest(r: DataFrame, n: int = 30) -> DataFrame:
    """The n riskiest: automatic matches first, then reviews, by score and margin."""
    p = F.when(F.col("decision") == "AUTO_MATCH", 0).when(F.col("decision") == "MANUAL_REVIEW", 1).when(F.col("decision") == "UNKNOWN", 2).otherwise(3)
    return r.orderBy(p, F.desc("best_score"), F.desc("margin"), "query_id").limit(n)


def ndcg(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / rank).otherwise(0.0)


def rank_change(current: Column, other: Column) -> Column:
    return F.when(current <= 0, "EXPECTED_NOT_IN_CURRENT_CANDIDATES").when(other <= 0, "EXPECTED_NOT_IN_SHADOW_RANKING").when(other < current, "IMPROVED").when(other > current, "HURT").otherwise("UNCHANGED")


def ranked_summary(r: DataFrame, current: str = "current_rank", other: str = "shadow_rank", *keys: str) -> DataFrame:
    """Current against shadow ranks of the expected candidate, null or 0 where it isn't among the candidates.

    Hits, recall, MRR, nDCG and the shadow's lift in each, what became of the ranks, and how often each rank occurs, as a
    JSON object by rank. Optional boolean column: winner_changed.
    """
    r = r if "winner_changed" in r.columns else r.withColumn("winner_changed", F.lit(False))
    c, s = F.coalesce(F.col(current), F.lit(0)), F.coalesce(F.col(other), F.lit(0))
    r = r.withColumn("_c", c.cast("long")).withColumn("_s", s.cast("long")).withColumn("_k", rank_change(c, s))
    mean = lambda x: F.round(F.avg(x.cast("double")), 6)
    lift = lambda a, b: F.round(F.avg(b.cast("double")) - F.avg(a.cast("double")), 6)
    c, s = F.col("_c"), F.col("_s")
    change = lambda k: F.count_if(F.col("_k") == k)
    out = r.groupBy(*keys).agg(
        F.count("*").alias("queries"), F.count_if(c == 1).alias("current_top1_count"), F.count_if(s == 1).alias("shadow_top1_count"), mean(c == 1).alias("current_top1"), mean(s == 1).alias("shadow_top1"), lift(c == 1, s == 1).alias("top1_lift"),
        mean(c > 0).alias("current_recall"), mean(s > 0).alias("shadow_recall"), mean(reciprocal(c)).alias("current_mrr"), mean(reciprocal(s)).alias("shadow_mrr"), lift(reciprocal(c), reciprocal(s)).alias("mrr_lift"),
        mean(ndcg(c)).alias("current_ndcg"), mean(ndcg(s)).alias("shadow_ndcg"), lift(ndcg(c), ndcg(s)).alias("ndcg_lift"), change("IMPROVED").alias("improved"), change("HURT").alias("hurt"), change("UNCHANGED").alias("unchanged"),
        change("EXPECTED_NOT_IN_CURRENT_CANDIDATES").alias("current_missing"), change("EXPECTED_NOT_IN_SHADOW_RANKING").alias("shadow_missing"), F.count_if("winner_changed").alias("winner_changed"),
    )
    for name in ("_c", "_s"):
        out = _beside(out, histogram(r, name, f"{'current' if name == '_c' else 'shadow'}_ranks", *keys), *keys)
    return out


def _beside(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    if not keys:
        return a.crossJoin(b)  # a row each
    renamed = b.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = [a[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return a.join(renamed, on, "left").drop(*(f"_{k}" for k in keys))


def histogram(r: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    """How often each value of a column occurs, as a JSON object in the order of the values; nulls don't count."""
    counts = r.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("_v", "_n"))), lambda x: F.concat(F.lit('"'), x["_v"].cast("string"), F.lit('":'), x["_n"].cast("string")))
    return counts.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias(name))


def negative_shadow_summary(r: DataFrame, *keys: str) -> DataFrame:
    """Decisions and changed winners of queries that should be unknown."""
    n = F.count("*")
    is_ = lambda d: F.count_if(F.col("decision") == d)
    changed = F.count_if("winner_changed")
    out = r.groupBy(*keys).agg(n.alias("queries"), is_("UNKNOWN").alias("unknown_count"), ratio(is_("UNKNOWN"), n).alias("unknown_recall"), is_("MANUAL_REVIEW").alias("manual_review_count"), ratio(is_("MANUAL_REVIEW"), n).alias("manual_review_rate"), is_("AUTO_MATCH").alias("false_auto_match_count"), ratio(is_("AUTO_MATCH"), n).alias("false_auto_match_rate"), changed.alias("winner_changed_count"), ratio(changed, n).alias("winner_changed_rate"))
    return _beside(out, histogram(r, "decision", "decision_counts", *keys), *keys)


def shadow_overview(r: DataFrame) -> DataFrame:
    """One row over all shadow queries: api_success, shadow_status, shadow_applied, flag_matches, latency_ms."""
    r, ok = _success(r)
    done = r.where(ok)
    out = r.agg(
        F.count("*").alias("total_queries"), F.count_if(ok).alias("successful_queries"), F.count_if(~ok).alias("failed_queries"), F.count_if(ok & F.col("shadow_applied")).alias("applied_count"), ratio(F.count_if(ok & F.col("shadow_applied")), F.count_if(ok)).alias("applied_rate"),
        F.count_if(ok & ~F.col("flag_matches")).alias("flag_mismatches"), *_latency(ok, "latency_ms")[:2],
    )
    return out.crossJoin(histogram(done, "shadow_status", "status_counts"))  # a row each


def shadow_report(r: DataFrame) -> DataFrame:
    """ranked_summary() of positive, hard positive and both kinds together, in a column ``part``."""
    kind = F.col("dataset_type")
    names = F.when(kind == "POSITIVE", F.array(F.lit("standard_positive"), F.lit("combined_positive"))).when(kind == "HARD_POSITIVE", F.array(F.lit("hard_positive"), F.lit("combined_positive")))
    return ranked_summary(r.withColumn("part", F.explode(names)), "current_rank", "shadow_rank", "part")


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, median and 95th percentile, exact with linear interpolation."""
    return df.groupBy(*keys).agg(F.round(F.avg(value), 3).alias("mean"), F.round(F.percentile(value, 0.5), 3).alias("median"), F.round(F.percentile(value, 0.95), 3).alias("p95"))


def by_each(r: DataFrame, keys: list[str], *metrics: Column) -> DataFrame:
    """The metrics of each value of each key side by side: (key, value, metrics)."""
    sets = r.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("_g"), *metrics)
    name = F.lit(None).cast("string")
    value = name
    for i, k in enumerate(keys):
        at = F.col("_g") == (2 ** len(keys) - 1) ^ (1 << (len(keys) - 1 - i))
        name, value = F.when(at, F.lit(k)).otherwise(name), F.when(at, F.coalesce(F.col(k).cast("string"), F.lit("UNKNOWN"))).otherwise(value)
    return sets.select(name.alias("key"), value.alias("value"), *[c for c in sets.columns if c not in (*keys, "_g")])


def sample(r: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement in the order of a seeded hash; all rows for n of 0 or less, or as many as there are."""
    return r if n <= 0 else r.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def shuffled(r: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Adds each row's place in a seeded order, numbered within ranges of the hash."""
    from quillmesh.operators.matching import number

    h = r.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))))
    return number(h, ["_h", key], name, F.substring("_h", 1, 3)).drop("_h")


