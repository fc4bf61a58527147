"""Input views of the scoring engine, derived from the stored tables.

``org``, ``edges``, ``says``, ``gold`` and ``assignment`` are what every operator reads; each
is a plain DataFrame, so pruning and pushdown reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orgweave.functions.ids import bare_id, bare_set
from orgweave.session import table

EDGE_TYPES = ("parent", "child", "related", "predecessor", "successor")
SOURCES = ("matcher", "proposer", "ranker")


def latest_records(spark: SparkSession, d: str) -> DataFrame:
    """The newest state of every record, by modification date."""
    rows = table(spark, d, "ror_record").withColumn("rid", bare_id(F.col("id"))).where("rid IS NOT NULL")
    w = Window.partitionBy("rid").orderBy(F.col("admin.last_modified.date").desc_nulls_last(), "status", "established")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def org(spark: SparkSession, d: str) -> DataFrame:
    r = latest_records(spark, d)
    shown = F.filter("names", lambda n: F.array_contains(n["types"], "ror_display"))
    place = F.try_element_at("locations", F.lit(1))["geonames_details"]
    return r.select("rid", "status", "established", F.try_element_at(shown, F.lit(-1))["value"].alias("name"), place["name"].alias("city"), F.coalesce(place["country_name"], place["country_code"]).alias("country"), "types")


def edges_asserted(spark: SparkSession, d: str) -> DataFrame:
    """(src, rel, dst): every typed link, from all three places, in canonical spelling."""
    a = table(spark, d, "org_relationship").select(F.col("org_id").alias("a"), F.col("rel_type").alias("t"), F.col("ror_id").alias("b"))
    sets = F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.col(n).alias("ids")) for n in EDGE_TYPES])).alias("s")
    b = table(spark, d, "relationship_sets").select(F.col("ror_id").alias("a"), sets).select("a", "s.t", F.explode("s.ids").alias("b"))
    c = table(spark, d, "ror_record").select(F.col("id").alias("a"), F.explode("relationships").alias("r")).select("a", F.col("r.type").alias("t"), F.col("r.id").alias("b"))
    e = a.unionByName(b).unionByName(c).select(bare_id(F.col("a")).alias("src"), F.lower(F.trim("t")).alias("rel"), bare_id(F.col("b")).alias("dst"))
    return e.where(F.col("rel").isin(*EDGE_TYPES) & F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def live_labels(spark: SparkSession, d: str) -> DataFrame:
    """An annotator's row with the highest label_id on an item, where it is neither superseded nor skipped."""
    r = table(spark, d, "label_event").where("item_id IS NOT NULL AND annotator IS NOT NULL")
    keyed = r.groupBy("item_id", "annotator").agg(F.max(F.struct("label_id", "decision", "ror_ids", "superseded", "elapsed_ms")).alias("r"))
    return keyed.select("item_id", "annotator", "r.label_id", "r.decision", bare_set(F.col("r.ror_ids")).alias("ids"), "r.superseded", "r.elapsed_ms").where("NOT superseded AND decision <> 'skipped'")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, decision, ids): the newest live label of an item; unresolved decisions carry no ids."""
    newest = live_labels(spark, d).groupBy("item_id").agg(F.max(F.struct("label_id", "decision", "ids")).alias("g"))
    resolved = F.col("g.decision").isin("accepted", "corrected")
    return newest.select("item_id", "g.decision", F.when(resolved, F.col("g.ids")).otherwise(F.array().cast("array<string>")).alias("ids")).where(~F.col("decision").isin("accepted", "corrected") | (F.size("ids") > 0))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each item's newest proposal with their place in the pool from 1."""
    p = table(spark, d, "proposal").where("item_id IS NOT NULL")
    w = Window.partitionBy("item_id").orderBy(F.col("created_at").desc_nulls_last(), "run_id", F.size("candidates").desc())
    newest = p.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    c = newest.select("item_id", F.posexplode("candidates").alias("pos", "c"))
    return c.select("item_id", (F.col("pos") + 1).alias("rank"), bare_id(F.col("c.ror_id")).alias("rid"), "c.name", "c.aliases", "c.acronyms", "c.city", "c.country", "c.org_types", "c.match_score", "c.llm_confidence", "c.llm_justification", "c.llm_proposed").where("rid IS NOT NULL")


def assignment(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, source, rid): what three ways of reading a proposal assign."""
    c = candidates(spark, d)
    a = c.where("match_score >= 0.9").select("item_id", F.lit("matcher").alias("source"), "rid")
    b = c.where("llm_proposed").select("item_id", F.lit("proposer").alias("source"), "rid")
    e = c.where("rank = 1").select("item_id", F.lit("ranker").alias("source"), "rid")
    return a.unionByName(b).unionByName(e).distinct()


def frame(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, source, decision, gold_ids): items with gold and a proposal, once per source."""
    items = table(spark, d, "proposal").where("item_id IS NOT NULL").select("item_id").distinct()
    g = gold(spark, d).join(items, "item_id", "left_semi")
    return g.select("item_id", F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source"), "decision", F.col("ids").alias("gold_ids"))


def strata(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, stratum) in one spelling; unknown where it is missing."""
    s = F.regexp_replace(F.lower(F.trim("stratum")), r"[\s_\-]+", "_")
    return table(spark, d, "item").where("item_id IS NOT NULL").groupBy("item_id").agg(F.coalesce(F.min(s), F.lit("unknown")).alias("stratum"))
