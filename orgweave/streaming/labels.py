"""The label log as a stream: live rows and progress, exactly once per label.

Labels arrive in append-only files.  A repeated label_id inside the watermark is dropped,
state keeps one row per (item, annotator), and each trigger emits the rows that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions.ids import bare_set


def label_stream(spark: SparkSession, path: str, late: str = "60 days") -> DataFrame:
    """Distinct label rows of a growing folder of Parquet files; rows later than ``late`` are dropped."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    timed = rows.withColumn("at", F.col("ingested_at").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["label_id"])


def live_labels(labels: DataFrame) -> DataFrame:
    """The newest row per (item, annotator) with whether it is a say; update or complete mode."""
    keyed = labels.where("item_id IS NOT NULL AND annotator IS NOT NULL").groupBy("item_id", "annotator")
    newest = keyed.agg(F.max(F.struct("label_id", "decision", "ror_ids", "superseded")).alias("r"))
    live = ~F.coalesce("r.superseded", F.lit(False)) & (F.col("r.decision") != "skipped")
    return newest.select("item_id", "annotator", "r.label_id", "r.decision", bare_set(F.col("r.ror_ids")).alias("ids"), live.alias("live"))


def daily_counts(labels: DataFrame) -> DataFrame:
    """Labels per day of arrival and decision in tumbling windows closed by the watermark (append mode)."""
    return labels.groupBy(F.window("at", "1 day").alias("w"), "decision").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "decision", "n")
