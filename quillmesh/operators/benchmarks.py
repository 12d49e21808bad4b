"""Benchmarks made from a pool: positives of three difficulties, negatives, hard positives, and holdouts of unseen companies.

Texts come from hashes of their keys, so a benchmark depends on its inputs and seed only. Attempts that a rule rejects
are followed by others; what depends on the texts accepted before is decided in the order of the rows' numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions import corruption as C
from quillmesh.functions import normalize as N
from quillmesh.operators import matching as M
from quillmesh.session import keep

# Kinds of aliases, the preferred first.
ALIAS_PRIORITY = {"BRAND_NAME": 0, "GENERATED_SHORT_NAME": 1, "GLEIF_OTHER_NAME": 2, "GLEIF_TRANSLITERATED_NAME": 3, "LEGAL_NAME": 4, "GLEIF_LEGAL_NAME": 5}
COLLISION = "NORMALIZED_QUERY_MATCHES_OTHER_COMPANY_ALIAS"
DIFFICULTIES = (C.EASY, C.MEDIUM, C.HARD)
# Shares of the kinds of negatives.
CATEGORY_WEIGHTS = {"SYNTHETIC_COMPANY": 0.40, "PERSON_PAYMENT": 0.25, "GENERIC_PAYMENT": 0.20, "REFERENCE_ONLY": 0.15}
# Parts of negative queries.
COMPANY_PREFIXES = "ARVENA BELVORA CERANTA DORVEX ELMORA FENRIX GAVENTA HELVARA ILVORA JUNTERA KERVONA LUMERA MERVEX NORDIVA ORVENA PENTORA QUANTERA RAVENTA SELVORA TRENOVA ULMERA VENTARA WELVORA XENTORA YALVENA ZORVEX".split()
COMPANY_ACTIVITIES = "TEKNOLOJI YAZILIM LOJISTIK ENERJI OTOMASYON ROBOTIK DANISMANLIK MIMARLIK GIDA MOBILYA MEDYA ELEKTRONIK MAKINE SAVUNMA HAVACILIK TASARIM URETIM MUHENDISLIK INSAAT TICARET DIGITAL SISTEMLERI".split()
COMPANY_SUFFIXES = ("LIMITED", "LIMITED SIRKETI", "ANONIM SIRKETI", "LLC", "LTD", "GMBH", "SAS", "BV", "INC", "CORPORATION")
PAYMENT_NOISE = ("FATURA ODEMESI", "ODEME", "HAVALE", "EFT", "HIZMET BEDELI", "AVANS ODEMESI", "SIPARIS BEDELI", "MAL BEDELI", "REF")
FIRST_NAMES = "AHMET MEHMET MUSTAFA ALI MURAT EMRE CAN BURAK KEREM ONUR AYSE FATMA ZEYNEP ELIF MERVE ESRA SELIN DERYA DENIZ ECE".split()
LAST_NAMES = "YILMAZ KAYA DEMIR CELIK SAHIN YILDIZ AYDIN OZTURK ARSLAN DOGAN KILIC ASLAN CETIN KOC KURT OZDEMIR AKSOY ERDEM POLAT TEKIN".split()
PERSON_REASONS = ("KIRA", "BORC ODEMESI", "MASRAF IADE", "AVANS", "ORTAK GIDER", "YEMEK BEDELI", "SEYAHAT MASRAFI", "DEPOZITO", "EMANET", "HARCAMA IADE")
GENERIC_TEXTS = (
    "TEMMUZ AYI KIRA ODEMESI", "AGUSTOS AYI AIDAT ODEMESI", "ELEKTRIK FATURASI ODEMESI", "SU FATURASI ODEMESI", "INTERNET FATURASI", "DOGALGAZ FATURASI", "PERSONEL YEMEK BEDELI", "OFIS MASRAF ODEMESI",
    "GENEL GIDER ODEMESI", "DEPOZITO IADE ODEMESI", "KARGO MASRAFI", "SEYAHAT MASRAFI", "ARAC YAKIT GIDERI", "BAKIM ONARIM BEDELI", "VERGI HARCI ODEMESI", "NOTER MASRAFI", "SIGORTA PRIM ODEMESI",
    "ABONELIK BEDELI", "EGITIM KATILIM BEDELI", "TOPLANTI ORGANIZASYON GIDERI",
)


def normalized(df: DataFrame, text: str, name: str, with_nfkc: bool = True) -> DataFrame:
    n = N.normalize(df, text, with_nfkc)
    return n.withColumn(name, F.coalesce(N.matching_text(F.col("core_text"), F.col("ascii_text")), F.lit(""))).select(*df.columns, name)


def source_aliases(pool: DataFrame) -> DataFrame:
    """(company_id, source_alias, source_alias_type, place, n_aliases): of each normalised text of a company one alias, by kind.

    Aliases of at least three characters, in the order of kind and closeness to 20 characters, from place 0.
    """
    priority = F.coalesce(F.create_map(*(F.lit(x) for kv in ALIAS_PRIORITY.items() for x in kv))[F.col("alias_type")], F.lit(100))
    c = pool.where("length(trim(alias_text)) >= 3 AND normalized_alias <> ''").withColumn("_p", priority)
    one = c.withColumn("_r", F.row_number().over(Window.partitionBy("company_id", "normalized_alias").orderBy("_p", "alias_id"))).where("_r = 1")
    order = Window.partitionBy("company_id").orderBy("_p", F.abs(F.length(F.trim("alias_text")) - 20), "alias_id")
    return one.select("company_id", F.trim("alias_text").alias("source_alias"), F.col("alias_type").alias("source_alias_type"), (F.row_number().over(order) - 1).alias("place"), F.count("*").over(Window.partitionBy("company_id")).alias("n_aliases"))


def attempts(sources: DataFrame, pool: DataFrame, difficulties: tuple[str, ...] = DIFFICULTIES, most: int = 8, with_nfkc: bool = True, named: bool = True) -> DataFrame:
    """Every attempt at every variant of every company, with its text and its collisions; aliases take turns.

    With ``named`` collisions are listed too, which takes as many names for each attempt as companies share its text;
    without, with_collisions() lists them for the attempts that are chosen.
    """
    slots = _slots(_by_company(sources), difficulties).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return _attempted(slots, pool, difficulties, with_nfkc, named)


def _by_company(sources: DataFrame) -> DataFrame:
    """(company_id, _sources): the aliases of source_aliases() in their order."""
    return sources.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("place", "source_alias", "source_alias_type"))).alias("_sources"))


def _slots(companies: DataFrame, difficulties: tuple[str, ...]) -> DataFrame:
    return companies.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(len(difficulties) - 1))))


def _attempted(slots: DataFrame, pool: DataFrame, difficulties: tuple[str, ...], with_nfkc: bool, named: bool) -> DataFrame:
    """The texts of attempts (company_id, _sources, variant, attempt) with their collisions."""
    each = slots.withColumn("_s", F.get("_sources", F.pmod(F.col("variant") + F.col("attempt") - 1, F.size("_sources")).cast("int")))
    each = each.select("company_id", "_s.place", "variant", "attempt", "_s.source_alias", "_s.source_alias_type", F.element_at(F.array(*map(F.lit, difficulties)), F.col("variant") + 1).alias("difficulty"))
    each = each.withColumn("key", F.concat_ws(":", "company_id", "difficulty", "attempt"))
    texts = normalized(C.variants(each), "query_text", "normalized_query", with_nfkc).withColumnRenamed("key", "query_id")
    if named:
        found = M.query_collisions(texts, M.ownership(pool)).withColumnRenamed("has_collision", "benchmark_collision")
    else:
        found = M.query_collides(texts, pool.select("normalized_alias", "company_id"), "benchmark_collision")
    return found.withColumn("collision_reason", F.when(F.col("benchmark_collision"), COLLISION).otherwise("")).withColumn("ambiguous_query", C.ambiguous(F.col("normalized_query")))


def positives(tried: DataFrame, difficulties: tuple[str, ...] = DIFFICULTIES) -> DataFrame:
    """Of the attempts at each variant the first that neither collides nor repeats a text of the company, else the last.

    Variants are decided in their order, since a text may repeat that of an earlier one. A company's attempts are one row
    meanwhile, a few dozen at most, so they are read and moved once.
    """
    rest = [c for c in tried.columns if c not in ("company_id", "variant", "attempt")]
    c = tried.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("variant", "attempt", *rest))).alias("_all")).withColumn("_seen0", F.array().cast("array<string>"))
    key = lambda x: F.lower(x["query_text"])
    for v in range(len(difficulties)):
        seen = F.col(f"_seen{v}")
        c = c.withColumn("_part", F.filter("_all", lambda x: x["variant"] == v))
        c = c.withColumn(f"_good{v}", F.get(F.filter("_part", lambda x: ~x["benchmark_collision"] & ~F.array_contains(seen, key(x))), F.lit(0)))
        c = c.withColumn(f"_pick{v}", F.coalesce(f"_good{v}", F.get("_part", F.size("_part") - 1)))
        c = c.withColumn(f"_seen{v + 1}", F.concat(seen, F.array(key(F.col(f"_pick{v}")))))
    picks = (F.struct(F.col(f"_pick{v}").alias("p"), F.array_contains(f"_seen{v}", key(F.col(f"_pick{v}"))).alias("duplicate_generated_query"), F.col(f"_good{v}").isNotNull().alias("benchmark_valid")) for v in range(len(difficulties)))
    out = c.select("company_id", F.explode(F.array(*picks)).alias("_x")).where("_x.p IS NOT NULL").select("company_id", "_x.p.*", "_x.duplicate_generated_query", "_x.benchmark_valid")
    return out.withColumn("strict_evaluation_eligible", F.col("benchmark_valid") & ~F.col("ambiguous_query")).withColumnRenamed("attempt", "generation_attempts")


def positives_in_turn(sources: DataFrame, pool: DataFrame, difficulties: tuple[str, ...] = DIFFICULTIES, most: int = 8, with_nfkc: bool = True) -> DataFrame:
    """positives() of all attempts(), where no attempt is made after one that is accepted; with_collisions() lists collisions.

    The first attempts at all variants come first. A variant whose first is refused gets all of its others, and its company
    is decided anew with all that was tried, since a later variant may repeat what an earlier one has become: after one
    round more than there are variants nothing is open. Rounds are written, so plans stay short.
    """
    companies = keep(_by_company(sources), "sources")
    slots, tried, done = _slots(companies, difficulties).withColumn("attempt", F.lit(1)), None, []
    while True:
        # a fixed number of partitions: these rows are small, but their texts take time
        made = keep(_attempted(slots.repartition(2 * M._parallelism(slots), "company_id", "variant", "attempt"), pool, difficulties, with_nfkc, False), "attempts")
        tried = made if tried is None else tried.unionByName(made)
        got = keep(positives(tried, difficulties), "chosen")
        refused = keep(got.where(~F.col("benchmark_valid") & (F.col("generation_attempts") < most)).select("company_id", "variant"), "refused") if most > 1 else None
        if refused is None or refused.isEmpty():
            return union([*done, got])
        again = refused.select("company_id").distinct()
        done.append(got.join(again, "company_id", "left_anti"))
        tried = tried.join(again, "company_id", "left_semi")
        slots = companies.join(refused, "company_id").withColumn("attempt", F.explode(F.sequence(F.lit(2), F.lit(most))))


def with_collisions(chosen: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds collision_owners, collision_company_ids and collision_aliases: of a text that collides all companies that own it, and all their aliases of it.

    Each text's owners are listed once, on its first row by company and variant, and counted on each of its rows: a list
    on every row would be the square of the companies that share a name. Where nothing collides the lists are empty and
    the count is 0; on the other rows of a listed text they are null, and normalized_query leads to them. A company that
    owns the text itself is among its owners.
    """
    first = chosen.where("benchmark_collision").groupBy("normalized_query").agg(F.min(F.struct("company_id", "variant")).alias("_first"))
    owned = first.join(M.ownership(pool).withColumnRenamed("company_id", "_owner"), F.col("normalized_query") == F.col("normalized_alias"))
    own = F.struct(F.col("_owner").cast("string").alias("id"), F.transform("originals", lambda x: F.concat_ws(":", F.col("_owner").cast("string"), x)).alias("names"))
    lists = keep(owned.groupBy("normalized_query", "_first").agg(F.sort_array(F.collect_list(own)).alias("_o")), "owners")
    count = lists.select("normalized_query", F.size("_o").cast("long").alias("collision_owners"))
    join = lambda x: F.array_join(x, "|")
    listed = lists.select(F.col("_first.company_id"), F.col("_first.variant"), join(F.col("_o.id")).alias("collision_company_ids"), join(F.flatten("_o.names")).alias("collision_aliases"))
    out = chosen.join(count, "normalized_query", "left").join(listed, ["company_id", "variant"], "left")
    none = ~F.col("benchmark_collision")
    return out.withColumns({"collision_owners": F.when(none, F.lit(0)).otherwise(F.col("collision_owners")), **{c: F.when(none, F.lit("")).otherwise(F.col(c)) for c in ("collision_company_ids", "collision_aliases")}})


def quotas(total: int) -> dict[str, int]:
    """How many negatives of each kind: the whole part of each share, the rest to the last."""
    out = {k: int(total * w) for k, w in list(CATEGORY_WEIGHTS.items())[:-1]}
    return out | {list(CATEGORY_WEIGHTS)[-1]: total - sum(out.values())}


def negative_slots(spark, total: int) -> DataFrame:
    """(slot, negative_category): a row for each negative, kinds one after the other."""
    at, kind = 0, F.lit(None).cast("string")
    for name, n in quotas(total).items():
        kind = F.when((F.col("slot") >= at) & (F.col("slot") < at + n), F.lit(name)).otherwise(kind)
        at += n
    return spark.range(total).select(F.col("id").alias("slot")).withColumn("negative_category", kind)


def negative_text(category: Column, key: Column) -> Column:
    """The text of a negative of a kind."""
    pick = lambda values, salt: C.one_of(values, key, salt)
    number, spaced = C.digits(key, 6, 12, "ref"), lambda *x: F.concat_ws(" ", *x)
    way = lambda salt, *texts: F.element_at(F.array(*texts), C.choice(key, len(texts), salt) + 1)
    head, n = pick(COMPANY_PREFIXES, "prefix"), len(COMPANY_ACTIVITIES)
    a = C.choice(key, n, "activity")
    b = F.pmod(a + 1 + C.choice(key, n - 1, "other"), F.lit(n))
    all_ = F.array(*map(F.lit, COMPANY_ACTIVITIES))
    activity = F.when(C.choice(key, 3, "two") == 2, spaced(F.element_at(all_, a + 1), F.element_at(all_, (b + 1).cast("int")))).otherwise(F.element_at(all_, a + 1))
    company, noise = spaced(head, activity, pick(COMPANY_SUFFIXES, "suffix")), pick(PAYMENT_NOISE, "noise")
    synthetic = way("way", spaced(company, noise, number), spaced(head, activity, noise), spaced(company, F.lit("REF"), number))
    person, reason = spaced(pick(FIRST_NAMES, "first"), pick(LAST_NAMES, "last")), pick(PERSON_REASONS, "reason")
    private = way("way", spaced(person, reason), spaced(person, reason, F.lit("REF"), number), spaced(reason, person))
    generic = pick(GENERIC_TEXTS, "generic")
    general = way("way", generic, spaced(generic, F.lit("REF"), number), spaced(number, generic))
    long, second = C.digits(key, 8, 16, "long"), C.digits(key, 6, 10, "second")
    code = F.upper(F.substr(F.md5(F.concat_ws(":", key.cast("string"), F.lit("code"))), F.lit(1), 5 + C.choice(key, 6, "code")))
    bare = way("way", spaced(F.lit("EFT REF"), long), spaced(F.lit("HAVALE REF"), long, F.lit("ISLEM"), second), spaced(F.lit("ODEME"), code, long), spaced(F.lit("REF"), long, F.lit("DEKONT"), second), spaced(F.lit("ISLEM NO"), long))
    return F.when(category == "SYNTHETIC_COMPANY", synthetic).when(category == "PERSON_PAYMENT", private).when(category == "GENERIC_PAYMENT", general).when(category == "REFERENCE_ONLY", bare)


def negative_attempts(slots: DataFrame, attempt: int, with_nfkc: bool = True) -> DataFrame:
    """(slot, negative_category, attempt, query_text, normalized_query) of one round."""
    key = F.concat_ws(":", "slot", F.lit(attempt))
    return normalized(slots.select("slot", "negative_category").withColumn("attempt", F.lit(attempt)).withColumn("query_text", N.squeeze(negative_text(F.col("negative_category"), key))), "query_text", "normalized_query", with_nfkc)


def accepted(tried: DataFrame, pool: DataFrame, before: DataFrame | None = None, similarity: float = 0.72) -> DataFrame:
    """Adds closest_alias, closest_similarity, the aliases' originals and companies, and ``ok``: whether a negative may stay.

    No text of ``before``, of equal texts the smallest slot, no equal alias, and no alias more similar than ``similarity``;
    a reference alone may normalise to nothing.
    """
    own = F.lower("query_text")
    c = tried.withColumn("_first", F.row_number().over(Window.partitionBy(own).orderBy("slot")) == 1)
    if before is not None:
        c = c.join(before.select(own.alias("_text")).distinct(), own == F.col("_text"), "left").withColumn("_first", F.col("_first") & F.col("_text").isNull()).drop("_text")
    c = M.nearest_alias(c.withColumn("query_text_", F.col("query_text")).withColumn("query_text", F.col("normalized_query")), pool).withColumn("query_text", F.col("query_text_")).drop("query_text_")
    known = M.ownership(pool).groupBy("normalized_alias").agg(F.array_join(F.slice(F.sort_array(F.flatten(F.collect_list("originals"))), 1, 10), "|").alias("closest_originals"), F.array_join(F.sort_array(F.collect_set(F.col("company_id").cast("string"))), "|").alias("closest_company_ids"))
    c = c.join(known, F.col("closest_alias") == F.col("normalized_alias"), "left").drop("normalized_alias").fillna({"closest_originals": "", "closest_company_ids": ""})
    same = pool.select(F.col("normalized_alias").alias("_alias")).distinct()
    c = c.join(same, F.col("normalized_query") == F.col("_alias"), "left")
    empty = (F.col("negative_category") == "REFERENCE_ONLY") & (F.col("normalized_query") == "")
    return c.withColumn("ok", F.col("_first") & F.col("_alias").isNull() & ((F.col("closest_similarity") <= similarity) | empty)).drop("_first", "_alias")


def negatives(pool: DataFrame, total: int, folder: str, similarity: float = 0.72, most: int = 50, seed: int = 42, with_nfkc: bool = True) -> DataFrame:
    """``total`` queries that no alias of the pool answers, shuffled; see accepted().

    Slots whose text is rejected try again, all of a round at once, and every round is written below ``folder``, which all
    executors share, so rounds don't lengthen the plan. More than ``most`` rounds are an error.
    """
    from quillmesh.operators.evaluation import shuffled

    spark = pool.sparkSession
    slots, done = negative_slots(spark, total), None
    for attempt in range(1, most + 1):
        path = f"{folder}/round-{attempt}"
        accepted(negative_attempts(slots, attempt, with_nfkc), pool, done, similarity).write.mode("overwrite").parquet(path)
        got = spark.read.parquet(path)
        good = got.where("ok").drop("ok")
        done = good if done is None else done.unionByName(good)
        slots = got.where("NOT ok").select("slot", "negative_category")
        if slots.isEmpty():
            break
    else:
        raise ValueError(f"no safe text for {slots.first()['negative_category']}: raise the similarity or the number of attempts")
    kind = F.col("negative_category")
    flags = {"is_out_of_database": kind == "SYNTHETIC_COMPANY", "is_person_payment": kind == "PERSON_PAYMENT", "is_reference_only": kind == "REFERENCE_ONLY", "expected_decision": F.lit("UNKNOWN"), "benchmark_valid": F.lit(True)}
    return shuffled(done.withColumns(flags), "slot", seed, "benchmark_id")


def rejection(c: DataFrame, lowest: int = 2, highest: int = 10) -> Column:
    """Why an attempt at a hard positive is no such, the first reason that applies, or null.

    Columns: normalized_query, normalized_alias, repeated, collides, candidates_ok, expected_rank (null or 0: not found).
    """
    rank = F.coalesce(F.col("expected_rank"), F.lit(0))
    return (
        F.when(F.coalesce(F.col("normalized_query"), F.lit("")) == "", "EMPTY").when(F.lower("normalized_query") == F.lower("normalized_alias"), "UNCHANGED").when(F.col("repeated"), "DUPLICATE").when(F.col("collides"), "ALIAS_COLLISION")
        .when(~F.col("candidates_ok"), "INVALID_CANDIDATES").when(rank == 0, "EXPECTED_MISSING").when(rank < lowest, "TOO_EASY").when(rank > highest, "RANK_TOO_LOW")
    )


def judged(tried: DataFrame, target: int = 200, per_company: int = 5, lowest: int = 2, highest: int = 10) -> DataFrame:
    """Adds ``reason`` (null: accepted) and ``number`` of the accepted, in the order of ``attempt``.

    A text counts as repeated after an earlier acceptable one; beyond ``per_company`` of a company, and beyond
    ``target`` in all, attempts that would do are COMPANY_LIMIT and TARGET_REACHED.
    """
    c = tried.withColumn("reason", rejection(tried.withColumn("repeated", F.lit(False)), lowest, highest)) if "repeated" in tried.columns else tried.withColumn("repeated", F.lit(False)).withColumn("reason", rejection(tried, lowest, highest))
    good = F.col("reason").isNull()
    first = Window.partitionBy(F.lower("normalized_query")).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("reason", F.when(good & (F.coalesce(F.sum(good.cast("int")).over(first), F.lit(0)) > 0), "DUPLICATE").otherwise(F.col("reason")))
    of = Window.partitionBy("company_id").orderBy("attempt")
    c = c.withColumn("reason", F.when(good & (F.sum(F.when(good, 1).otherwise(0)).over(of) > per_company), "COMPANY_LIMIT").otherwise(F.col("reason")))
    last = c.where(good).select("attempt").orderBy("attempt").limit(target).agg(F.max("attempt").alias("_last"), F.count("*").alias("_n"))  # a top-k
    c = c.crossJoin(F.broadcast(last)).withColumn("reason", F.when(good & (F.col("_n") >= target) & (F.col("attempt") > F.col("_last")), "TARGET_REACHED").otherwise(F.col("reason")))
    return c.drop("_last", "_n", "repeated")


def hard_attempts(sources: DataFrame, n: int, seed: int = 42, with_nfkc: bool = True) -> DataFrame:
    """``n`` attempts (attempt, company_id, source_alias, normalized_alias, pipeline, query_text, normalized_query): source and pipeline by hash.

    ``sources``: (company_id, source_alias, normalized_alias).
    """
    ordered = M.number(sources.withColumn("_h", F.md5(F.concat_ws(":", F.col("company_id").cast("string"), "normalized_alias", F.lit(seed)))), ["_h", "company_id", "source_alias"], "_k", F.substring("_h", 1, 3)).drop("_h")
    size = sources.agg(F.count("*").alias("_size"))  # a row
    tries = sources.sparkSession.range(1, n + 1).select(F.col("id").alias("attempt")).crossJoin(F.broadcast(size)).where("_size > 0")
    tries = tries.withColumn("_k", F.pmod(F.xxhash64("attempt", F.lit(seed)), F.col("_size")) + 1)
    names = list(C.PIPELINES)
    tries = tries.join(ordered, "_k").withColumn("key", F.concat_ws(":", F.lit(seed), "attempt")).withColumn("pipeline", C.one_of(names, F.col("key"), "pipeline"))
    out = C.mutate(tries, "source_alias", "key", "pipeline")
    return normalized(out, "query_text", "normalized_query", with_nfkc).drop("_k", "_size", "key")


def hard_positives(tried: DataFrame, pool: DataFrame, ranks: DataFrame, **limits: int) -> DataFrame:
    """The attempts of hard_attempts() with their reasons. ``ranks``: (attempt, expected_rank, candidates_ok) from matching their texts."""
    owners = pool.groupBy("normalized_alias").agg(F.collect_set("company_id").alias("_owners")).withColumnRenamed("normalized_alias", "_text")
    c = tried.join(owners, F.lower("normalized_query") == F.lower("_text"), "left").drop("_text")
    c = c.withColumn("collides", F.coalesce(F.col("_owners") != F.array("company_id"), F.lit(False))).drop("_owners")
    c = c.join(ranks, "attempt", "left").withColumn("candidates_ok", F.coalesce("candidates_ok", F.lit(True)))
    return judged(c, **limits)


def counts(c: DataFrame, *keys: str) -> DataFrame:
    """How many attempts each reason, or any other column, has; ACCEPTED for none."""
    return c.withColumn("reason", F.coalesce("reason", F.lit("ACCEPTED"))).groupBy("reason", *keys).agg(F.count("*").alias("attempts"))


def holdout_sources(sources: DataFrame, training: DataFrame) -> DataFrame:
    """Sources of companies that no training group expects; with hard_attempts() and judged(target=100, per_company=2) a holdout."""
    from quillmesh.operators.training import unseen

    return unseen(sources, training)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
