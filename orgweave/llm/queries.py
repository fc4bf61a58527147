"""Queries of the training-data problems; the driver entry adds them when this package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions.ids import bare_id
from orgweave.llm import consensus, leakage, lookalike, mixing, quota, readability, variants
from orgweave.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    votes, _ = consensus.consensus(table(spark, d, "label_event"))
    return votes.select(F.col("item").alias("item_id"), "outcome")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Every item with a say: outcome, number of says, share of agreeing pairs, lead over the next outcome."""
    votes, _ = consensus.consensus(table(spark, d, "label_event"), least=1)
    return votes.select(F.col("item").alias("item_id"), "outcome", F.col("says").cast("bigint").alias("says"), "agreement", "margin")


def p3_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, rel = consensus.consensus(table(spark, d, "label_event"))
    return rel.select("annotator", F.round("skill", 6).alias("skill"), F.round("accuracy", 6).alias("accuracy"), "compared")


def _display_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "ror_record").select(bare_id(F.col("id")).alias("id"), F.explode("names").alias("n"))
    return names.where(F.array_contains("n.types", "ror_display") & F.col("n.value").isNotNull()).select("id", F.col("n.value").alias("name")).where("id IS NOT NULL").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    items = lookalike.lookalike_pairs(table(spark, d, "item"), "item_id", "raw_affiliation").select(F.lit("item").alias("kind"), "key_a", "key_b")
    cands = table(spark, d, "proposal").select("item_id", F.explode("candidates").alias("c")).select(bare_id(F.col("c.ror_id")).alias("id"), F.col("item_id").alias("key"), F.col("c.name").alias("text"))
    cands = cands.where("id IS NOT NULL AND key IS NOT NULL AND text IS NOT NULL")
    of = lookalike.lookalikes_of(_display_names(spark, d), cands).select(F.lit("candidate").alias("kind"), "key_a", "key_b")
    return items.unionByName(of)


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct affiliation text and candidate name whose consistent form differs from what was typed."""
    items = table(spark, d, "item").select(F.lit("item").alias("kind"), F.col("raw_affiliation").alias("text"))
    names = table(spark, d, "proposal").select(F.explode("candidates.name").alias("text")).select(F.lit("candidate").alias("kind"), "text")
    rows = items.unionByName(names).where("text IS NOT NULL").distinct()
    return lookalike.normalised(rows, "text").where(F.col("form") != F.col("text")).select("kind", "text", "form")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership: every item whose text has a look-alike, with the consistent form of its class."""
    return lookalike.lookalike_classes(table(spark, d, "item"), "item_id", "raw_affiliation")[1].select(F.col("k").alias("item_id"), "form")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    short = quota.shortfalls(table(spark, d, "item"), table(spark, d, "strata_target"))
    return spark.createDataFrame([(*r["written"], int(r["shortfall"])) for r in short], "stratum string, sub_stratum string, shortfall bigint")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    sample, _ = quota.quota_sample(table(spark, d, "item"), table(spark, d, "strata_target"))
    return sample


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.quota_sample(table(spark, d, "item"), table(spark, d, "strata_target"))
    rows = [(r["stratum"], r["sub_stratum"], int(r["target"]), int(r["floor"]), int(sum(r["draws"].values())), int(r["shortfall"])) for r in report]
    return spark.createDataFrame(rows, "stratum string, sub_stratum string, target bigint, floor bigint, drawn bigint, shortfall bigint")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "eval_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked test item: documents that hold it and the longest passage in words."""
    leaks = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return leaks.groupBy("eval_id").agg(F.count("*").alias("docs"), F.max("matched").alias("longest"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    used, _ = mixing.mix(table(spark, d, "documents"), table(spark, d, "source_weight"))
    return used


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "source_weight"))
    return report


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    names = variants.recorded_names(table(spark, d, "ror_record"), table(spark, d, "proposal"))
    return variants.link_items(table(spark, d, "item"), names)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_levels(table(spark, d, "documents"), table(spark, d, "level_label"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and level."""
    sources = table(spark, d, "documents").select("doc_id", F.coalesce(mixing.source_name(F.col("source")), F.lit("")).alias("source")).groupBy("doc_id").agg(F.min("source").alias("source"))
    return _levels(spark, d).join(sources, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_agreement, p3_reliability, p4_found, p4_forms, p4_classes, p5_found, p5_sample, p5_report, p6_found, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_profile)}


def _category(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g'), '[\\s_\\-]+', '_', 'g')"


def oracle_sql() -> dict[str, str]:
    """Shortfalls in SQL; all else is iterative, fitted or text of many scripts, and tested by brute force."""
    cells = "SELECT DISTINCT stratum, coalesce(sub_stratum, '') sub_stratum, target_rows, " + f"{_category('stratum')} st, coalesce({_category('sub_stratum')}, '') sub FROM strata_target"
    usable = f"SELECT DISTINCT item_id, {_category('stratum')} st, coalesce({_category('sub_stratum')}, '') sub FROM item WHERE item_id IS NOT NULL AND NOT coalesce(demo, false) AND stratum IS NOT NULL"
    return {
        "p5_found": f"WITH c AS ({cells}), u AS ({usable}), n AS (SELECT c.stratum, c.sub_stratum, c.target_rows, count(DISTINCT u.item_id) n FROM c LEFT JOIN u ON u.st = c.st AND (c.sub = '' OR u.sub = c.sub) GROUP BY ALL) SELECT stratum, sub_stratum, (target_rows - n)::BIGINT shortfall FROM n WHERE n < target_rows"
    }
