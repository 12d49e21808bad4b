"""Reranking and the shadow ranking of candidate tables; one window over (group) serves each stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions import normalize as N
from quillmesh.functions import similarity as S


def from_matches(ranked: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """What rerank() needs, from the candidates of match(): evidence, query length and words, the retrieval score.

    ``scores``: (query_id, company_id, reranker_score); without it, or without a row there, a candidate isn't reranked.
    """
    c = ranked.withColumns({
        "retrieval_score": F.round(S.clamp(F.col("hybrid_score")), 6), "lexical_evidence": F.round(S.lexical_evidence(ranked.columns), 6),
        "query_length": N.query_length(F.col("query_text")), "query_tokens": N.query_tokens(F.col("query_text")),
    }).withColumnRenamed("rank", "position").drop("margin", "decision")
    return c.withColumn("reranker_score", F.lit(None).cast("double")) if scores is None else c.join(scores, ["query_id", "company_id"], "left")


def rerank(c: DataFrame, limit: int | None = None) -> DataFrame:
    """Weights, final scores, ranks, margin and decision.

    Needs query_id, company_id, unique_exact_match, ambiguous_exact_match, identifier_overlap, retrieval_score,
    reranker_score, lexical_evidence, query_length and query_tokens. With ``limit`` only the first max(limit, 1) by
    ``position`` are reranked. A candidate without a reranker score, or beyond the limit, keeps its retrieval score.
    """
    g = Window.partitionBy("query_id")
    order = lambda *k: Window.partitionBy("query_id").orderBy(F.desc("unique_exact_match"), *k, "company_id")
    flags = ("unique_exact_match", "ambiguous_exact_match", "identifier_overlap")
    c = c.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}).withColumn("retrieval_score", S.clamp(F.col("retrieval_score")))
    c = c.withColumn("reranked", F.col("reranker_score").isNotNull() & (F.lit(True) if limit is None else F.col("position") <= max(limit, 1)))
    c = c.withColumn("reranker_score", F.when(F.col("reranked"), S.clamp(F.col("reranker_score"))))
    c = c.withColumn("retrieval_rank", F.row_number().over(order(F.desc("retrieval_score"))))
    whole = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("reranker_score")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumn("_n", F.count("reranker_score").over(g)).withColumn("_one", F.max("reranker_score").over(g)).withColumn("_two", F.nth_value("reranker_score", 2).over(whole))
    gap = F.when(F.col("_n") == 0, 0.0).when(F.col("_n") == 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("_one") - F.col("_two")))
    c = c.withColumn("reranker_gap", gap)
    c = c.withColumn("base_weight", S.base_rerank_weight(F.col("query_length"), F.col("query_tokens"), F.col("reranker_gap")))
    s = F.coalesce("reranker_score", F.lit(0.0))
    c = c.withColumn("adjusted_score", F.when(F.col("reranked") & F.col("unique_exact_match"), s).otherwise(S.adjusted_rerank_score(s, F.col("lexical_evidence"))))
    w = S.candidate_rerank_weight(F.col("base_weight"), F.col("lexical_evidence"), F.col("identifier_overlap"), F.col("ambiguous_exact_match"))
    c = c.withColumn("reranker_weight", F.when(F.col("unique_exact_match") | ~F.col("reranked"), 0.0).otherwise(w))
    final = (1.0 - F.col("reranker_weight")) * F.col("retrieval_score") + F.col("reranker_weight") * F.col("adjusted_score")
    c = c.withColumn("final_score", F.round(F.round(F.when(F.col("unique_exact_match") & F.col("reranked"), 1.0).otherwise(S.clamp(final)), 9), 6))
    w = order(F.desc("final_score"))
    c = c.withColumn("final_rank", F.row_number().over(w)).withColumn("_next", F.lead("final_score").over(w))
    c = c.withColumn("_b", F.first(F.struct("unique_exact_match", "ambiguous_exact_match", "final_score", "retrieval_score", "adjusted_score", "lexical_evidence", "_next")).over(w))
    c = c.withColumn("margin", F.round(F.col("_b.final_score") - F.coalesce("_b._next", F.lit(0.0)), 6))
    b = lambda x: F.col(f"_b.{x}")
    return c.withColumn("decision", S.final_decision(b("unique_exact_match"), b("ambiguous_exact_match"), b("final_score"), b("retrieval_score"), b("adjusted_score"), b("lexical_evidence"), F.col("margin"))).drop("_n", "_one", "_two", "_next", "_b")


def reranker_query(raw: Column, normalized: Column) -> Column:
    """The text of a query that a reranking model reads; the normalised form only where it says something else."""
    raw, normalized = F.trim(raw), F.trim(normalized)
    return F.concat_ws(" | ", F.when(raw != "", F.concat(F.lit("Observed entity text: "), raw)), F.when((normalized != "") & (F.lower(normalized) != F.lower(raw)), F.concat(F.lit("Normalized entity text: "), normalized)))


def reranker_document() -> Column:
    """The text of a candidate that a reranking model reads, from its columns; parts that repeat another are left out."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    legal, brand, alias = t("legal_name"), t("brand_name"), t("alias_text")
    part = lambda label, x, *also: F.when((x != "") & (F.lower(x) != "") & ~F.coalesce(F.lower(x).isin(*also) if also else F.lit(False), F.lit(False)), F.concat(F.lit(label), x))
    return F.concat_ws(
        " | ", part("Candidate legal name: ", legal), part("Candidate brand name: ", brand, F.lower(legal)), part("Candidate known alias: ", alias, F.lower(legal), F.lower(brand)),
        part("Candidate normalized alias: ", t("normalized_alias")), part("Alias type: ", t("alias_type")), F.concat(F.lit("Identifier overlap: "), F.when(F.col("identifier_overlap"), "yes").otherwise("no")),
        F.format_string("Identifier match score: %.3f", S.clamp(F.col("identifier_overlap").cast("double"))),
    )


def min_max(score: str, group: str = "query_id"):
    """Per group (x - min) / (max - min); 1 for a single row, .5 where all are equal."""
    g = Window.partitionBy(group)
    lo, hi, n = F.min(score).over(g), F.max(score).over(g), F.count("*").over(g)
    return F.when(n == 1, 1.0).when(hi - lo <= 1e-12, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(score) - lo) / (hi - lo))))


def shadow(c: DataFrame, score: str = "shadow_score", current: str = "final_rank") -> DataFrame:
    """Adds the shadow rank, its change against the current one, the normalised score and the raw margin (second is 0 if none)."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), current)
    c = c.withColumn("shadow_rank", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    top = F.first(F.struct(F.col(score).alias("s"), "_next", "company_id")).over(w)
    c = c.withColumn("_b", top).withColumn("shadow_margin", F.round(F.col("_b.s") - F.coalesce("_b._next", F.lit(0.0)), 6))
    winner = F.first("company_id").over(Window.partitionBy("query_id").orderBy(current))
    c = c.withColumn("shadow_normalized", F.round(min_max(score), 6)).withColumn("rank_delta", F.col(current) - F.col("shadow_rank"))
    return c.withColumn("winner_changed", winner != F.col("_b.company_id")).drop("_b", "_next")
