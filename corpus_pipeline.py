"""A pipeline over the documents: quality, near duplicates, decontamination, personal data, packing.

Each stage gets the documents that the one before kept and returns those that it keeps, with the columns of documents;
the last returns the packed pieces. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import decontam, ngram_join, packing, pii, quality
from quillmesh.llm.common import materialize

#: Most ids of rejected documents that are broadcast, counted before; beyond it both sides are shuffled.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't among the rejected; rows with a null doc_id stay."""
    ids = materialize(rejected.select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is at least one half; those without words go."""
    return quality.select(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links the document of the smallest doc_id; of rows that repeat a doc_id, the one of the least text.

    Rows with a null doc_id stay.
    """
    groups = materialize(ngram_join.join(docs), "groups")
    kept = _without(docs, groups.where("doc_id <> component_id"))
    repeats = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeats.isEmpty():
        return kept
    rest = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    first = kept.join(repeats, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row"))
    return kept.join(repeats, "doc_id", "left_anti").unionAll(first.select("doc_id", "row.*").select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    verdicts = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, verdicts.where("contaminated"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.scrub(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the trained stages and the packing; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
