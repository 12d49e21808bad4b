"""Sources and sinks: checked CSV scans, JSON records, JDBC, upserts, paging, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

COMPANY = ("company_id", "legal_name", "brand_name", "city", "sector", "tax_number")
ALIAS = ("alias_id", "company_id", "alias_text", "alias_type")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as trimmed strings, a byte-order mark taken off the first name; missing required columns are an error."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path}: missing columns {', '.join(missing)}")
    return df.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies with whole ids; a repeated id is an error."""
    df = read_csv(spark, path, COMPANY).select(F.col("company_id").cast("long"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in COMPANY[1:]))
    if not (twice := df.groupBy("company_id").count().where("count > 1")).isEmpty():
        raise ValueError(f"repeated company_id {twice.first()[0]}")
    return df


def read_aliases(spark: SparkSession, path: str, companies: DataFrame, with_nfkc: bool = True) -> DataFrame:
    """Aliases with their normalised text; one of an unknown company or without text is an error, one that normalises to nothing is left out."""
    from quillmesh.functions import normalize as N

    df = read_csv(spark, path, ALIAS).select(F.col("alias_id").cast("long"), F.col("company_id").cast("long"), "alias_text", "alias_type")
    if not df.where("alias_text IS NULL OR alias_text = ''").isEmpty():
        raise ValueError("blank alias_text")
    if not df.join(companies, "company_id", "left_anti").isEmpty():
        raise ValueError("alias of an unknown company")
    n = N.normalize(df, "alias_text", with_nfkc)
    return n.withColumn("normalized_alias", N.matching_text(F.col("core_text"), F.col("ascii_text"))).select(*df.columns, "normalized_alias").where("normalized_alias <> ''")


def read_features(spark: SparkSession, path: str, strings: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """A typed scan for training: strings trimmed, numbers 0 where they can't be read."""
    df = read_csv(spark, path, strings + numbers)
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in strings), *(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in numbers))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int = 16, **options) -> DataFrame:
    """A table of a database, read in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


NAME = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
ADDRESS = T.StructType([T.StructField("city", T.StringType()), T.StructField("country", T.StringType())])
RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("attributes", T.StructType([
        T.StructField("lei", T.StringType()),
        T.StructField("entity", T.StructType([
            T.StructField("legalName", NAME), T.StructField("otherNames", T.ArrayType(NAME)), T.StructField("transliteratedOtherNames", T.ArrayType(NAME)),
            T.StructField("legalAddress", ADDRESS), T.StructField("headquartersAddress", ADDRESS), T.StructField("status", T.StringType()),
        ])),
    ])),
])


def _some(*names: str):
    return F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names))


def flatten_records(json_lines: DataFrame, value: str = "value") -> DataFrame:
    """Registry records as rows: lei, legal name, city (headquarters first), country (legal first), status."""
    r = json_lines.select(F.from_json(value, RECORD).alias("r"))
    e = "r.attributes.entity."
    return r.select(_some("r.attributes.lei", "r.id").alias("lei"), _some(e + "legalName.name").alias("legal_name"), _some(e + "headquartersAddress.city", e + "legalAddress.city").alias("city"), _some(e + "legalAddress.country", e + "headquartersAddress.country").alias("country"), _some(e + "status").alias("entity_status")).where("lei IS NOT NULL")


def other_names(json_lines: DataFrame, value: str = "value") -> DataFrame:
    """(lei, name, type) of all further names, transliterated ones last; types have at most 50 characters."""
    r = json_lines.select(F.from_json(value, RECORD).alias("r"))
    none = F.array().cast(T.ArrayType(NAME))
    e = "r.attributes.entity."
    x = r.select(_some("r.attributes.lei", "r.id").alias("lei"), F.explode(F.concat(F.coalesce(F.col(e + "otherNames"), none), F.coalesce(F.col(e + "transliteratedOtherNames"), none))).alias("x"))
    return x.select("lei", F.trim("x.name").alias("name"), F.substring(F.coalesce("x.type", F.lit("")), 1, 50).alias("type")).where("name <> ''")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of both by key, the last by ``seq`` winning; target rows come before all source rows."""
    both = target.withColumn("_s", F.lit(0)).withColumn(seq, F.lit(None).cast(source.schema[seq].dataType)).unionByName(source.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_s"), F.desc_nulls_last(seq))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_s", seq)


def upsert_aliases(target: DataFrame, source: DataFrame) -> DataFrame:
    """Aliases by (company, normalised text): the last row says text, kind, source and confidence, the first keeps its id."""
    keys = ["company_id", "normalized_alias"]
    both = target.withColumn("seq", F.lit(-1).cast("long")).unionByName(source, allowMissingColumns=True)
    ids = both.groupBy(*keys).agg(F.min_by("alias_id", F.struct("seq", "alias_id")).alias("alias_id"))
    last = upsert(target.drop("alias_id"), source.drop("alias_id"), keys, "seq")
    return last.join(ids, keys).select(*target.columns)


def load_rows(companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """The aliases of a load job in its order (``seq``): explicit ones, then each company's legal and brand name; blank ones are left out.

    Columns: company_id, alias_text, alias_type, seq. Explicit aliases come by alias_id, names by company.
    """
    given = aliases.select("company_id", F.trim("alias_text").alias("alias_text"), "alias_type", F.struct(F.lit(0).alias("part"), F.col("alias_id").alias("id"), F.lit(0).alias("place")).alias("seq"))
    names = [companies.select("company_id", F.trim(c).alias("alias_text"), F.lit(t).alias("alias_type"), F.struct(F.lit(1).alias("part"), F.col("company_id").alias("id"), F.lit(i).alias("place")).alias("seq")) for i, (c, t) in enumerate((("legal_name", "LEGAL_NAME"), ("brand_name", "BRAND_NAME")))]
    return union_all([given, *names]).where("alias_text <> ''")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, as a filter that sources can take."""
    return df.where(F.col(key) == F.lit(value))


def counts(companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: companies, aliases."""
    return companies.agg(F.count("*").alias("companies")).crossJoin(aliases.agg(F.count("*").alias("aliases")))  # a row each


def summary(companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: the counts, companies with aliases, and aliases of each kind as JSON."""
    from quillmesh.operators.evaluation import histogram

    return counts(companies, aliases).crossJoin(aliases.agg(F.count_distinct("company_id").alias("companies_with_aliases"))).crossJoin(histogram(aliases, "alias_type", "alias_types"))  # a row each


def create_tables(spark: SparkSession, database: str) -> None:
    """The two tables of the pool in a database of the catalog, if they aren't there."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.companies (company_id BIGINT NOT NULL, legal_name STRING, brand_name STRING, city STRING, sector STRING, tax_number STRING) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.company_aliases (alias_id BIGINT NOT NULL, company_id BIGINT NOT NULL, alias_text STRING, normalized_alias STRING, alias_type STRING, source STRING, confidence DOUBLE) USING parquet")


def new_companies(existing: DataFrame, arrived: DataFrame, name: str = "normalized_name") -> DataFrame:
    """Arrivals (seq, lei, normalised name) that are new: no LEI or name that exists, and of each only the first to arrive.

    A later arrival is measured against those before it that are new themselves, which the rounds below settle: in each,
    the first of every LEI that is also the first of its name goes in, and its equals go out.
    """
    rest = arrived.where(f"lei IS NOT NULL AND {name} <> ''")
    for key in ("lei", name):
        rest = rest.join(existing.select(key).where(f"{key} <> ''").distinct(), key, "left_anti")
    done = None
    while True:
        ranked = rest
        for key in ("lei", name):
            ranked = ranked.withColumn(f"_{key}", F.row_number().over(Window.partitionBy(key).orderBy("seq")))
        won = ranked.where(f"_lei = 1 AND _{name} = 1").select(*rest.columns)
        done = won if done is None else done.unionByName(won)
        left = rest
        for key in ("lei", name):
            left = left.join(won.select(key).distinct(), key, "left_anti")
        if left.isEmpty():
            return done
        rest = left


def build_report(existing: DataFrame, added: DataFrame, aliases: DataFrame, target: int) -> DataFrame:
    """One row: how many companies there were, came and are, by country, and the aliases."""
    from quillmesh.operators.evaluation import histogram

    n = existing.agg(F.count("*").alias("existing_companies")).crossJoin(added.agg(F.count("*").alias("added_companies"))).crossJoin(aliases.agg(F.count("*").alias("aliases")))  # a row each
    return n.crossJoin(histogram(added, "country", "added_by_country")).withColumn("companies", F.col("existing_companies") + F.col("added_companies")).withColumn("target", F.lit(target))


def page(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_union(frames: list[DataFrame], path: str) -> None:
    """CSV of all rows, with the union of their columns as header."""
    write_csv(union_all(frames), path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all with the union of their columns, in first-seen order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_summary(df: DataFrame, path: str) -> None:
    """A row as a JSON object with an indent of 2, characters as they are."""
    import json

    row = df.first()  # a summary is one row
    text = json.dumps({} if row is None else row.asDict(recursive=True), indent=2, ensure_ascii=False, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def backup(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Copies a file or folder beside itself before it is overwritten; the copy's path, or null if there is nothing."""
    jvm = spark.sparkContext._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{stamp}.bak")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return None
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, fs, to, False, conf)
    return to.toString()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(spark.version, spark.catalog.currentDatabase(), spark.sparkContext.defaultParallelism)], "version string, database string, parallelism int")
