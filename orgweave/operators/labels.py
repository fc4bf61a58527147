"""Label log operators: live rows, undo, progress, outcome keys and annotator pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome_key(decision: Column, ids: Column) -> Column:
    """``ambiguous`` / ``no_ror``, else ``ror:`` and the sorted ids; accepted and corrected alike."""
    return F.when(decision.isin("ambiguous", "no_ror"), decision).otherwise(F.concat(F.lit("ror:"), F.array_join(F.array_sort(ids), "|")))


def undone(labels: DataFrame, n: int = 1) -> DataFrame:
    """Live rows after each annotator took back the newest ``n`` rows of theirs.

    A row that was replaced before does not come back: only the newest row of an
    (item, annotator) can be live, and a taken-back one is not.
    """
    # The limit on the rank reaches the map side, so no annotator's rows are sorted in one task.
    newest = Window.partitionBy("annotator").orderBy(F.col("label_id").desc())
    taken = labels.select("annotator", "label_id").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
    return labels.join(taken.drop("_k"), ["annotator", "label_id"], "left_anti")


def annotator_pairs(live: DataFrame) -> DataFrame:
    """(item_id, a, b, x, y): every two annotators of an item, ``a`` before ``b`` by name, and their outcomes.

    A self-join on the item: it holds at most one live label per annotator, so an item gives at
    most as many rows as there are pairs of annotators.
    """
    k = live.select("item_id", "annotator", outcome_key(F.col("decision"), F.col("ids")).alias("o"))
    first, second = k.select("item_id", F.col("annotator").alias("a"), F.col("o").alias("x")), k.select("item_id", F.col("annotator").alias("b"), F.col("o").alias("y"))
    return first.join(second, "item_id").where("a < b").select("item_id", "a", "b", "x", "y")


def progress(labels: DataFrame, strata: DataFrame) -> DataFrame:
    """Rows and mean time per stratum and decision, with the stratum's own mean beside it."""
    j = labels.join(strata, "item_id")
    g = j.groupBy("stratum", "decision").agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("ms"))
    w = Window.partitionBy("stratum")
    return g.select("stratum", "decision", "n", F.round(F.col("ms") / F.col("n"), 4).alias("mean_ms"), F.sum("n").over(w).alias("stratum_n"), F.round(F.sum("ms").over(w) / F.sum("n").over(w), 4).alias("stratum_mean_ms"))


def keyed_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; all other rows stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
