"""Aggregates over scored items: micro sums, rates, agreement, clustering and intervals."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, NULL for an empty denominator."""
    return F.round(a / F.when(b != 0, b), digits)


def micro_counts(scores: DataFrame, *keys: str) -> DataFrame:
    """Sums of tp, fp, fn over the counted rows of each group."""
    c = scores.where("tp IS NOT NULL")
    return c.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("*").alias("items"))


def with_prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def prf_by(scores: DataFrame, level: str, *keys: str) -> DataFrame:
    """Precision, recall and F1 per key and level, and per key over all levels ('all')."""
    c = scores.where("tp IS NOT NULL")
    sums = c.groupingSets([[*keys, level], [*keys]], *keys, level).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("*").alias("items"), F.grouping(level).alias("_all"))
    return with_prf(sums.withColumn(level, F.when(F.col("_all") == 1, "all").otherwise(F.col(level))).drop("_all"))


def coverage(scores: DataFrame) -> DataFrame:
    """Share of scorable items with any assignment, per source."""
    s = scores.where("rule = 'exact' AND outcome NOT IN ('gold_ambiguous', 'gold_no_ror')")
    return s.groupBy("source").agg(F.count("*").alias("scorable"), F.count(F.when(F.col("assigned") > 0, 1)).alias("covered")).withColumn("coverage", ratio(F.col("covered"), F.col("scorable")))


def outcome_rates(scores: DataFrame) -> DataFrame:
    n = scores.groupBy("source", "rule", "outcome").agg(F.count("*").alias("n"))
    return n.withColumn("rate", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("source", "rule"))))


def stale_sensitivity(scores: DataFrame) -> DataFrame:
    """Hit rate as scored, and with stale assignments credited."""
    s = scores.where("outcome NOT IN ('gold_ambiguous', 'gold_no_ror', 'no_assignment')")
    hit, stale = F.count(F.when(F.col("outcome") == "correct", 1)), F.count(F.when(F.col("outcome") == "stale", 1))
    g = s.groupBy("source", "rule").agg(F.count("*").alias("items"), hit.alias("hits"), stale.alias("stale"))
    return g.withColumn("hit_rate", ratio(F.col("hits"), F.col("items"))).withColumn("credited_rate", ratio(F.col("hits") + F.col("stale"), F.col("items")))


def kappa(pairs: DataFrame, *keys: str) -> DataFrame:
    """Cohen's kappa of (x, y) outcome pairs per key; 1 or 0 where chance agreement is certain."""
    n = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("x") == F.col("y")).cast("bigint")).alias("same"))
    mx = pairs.groupBy(*keys, F.col("x").alias("cat")).agg(F.count("*").alias("nx"))
    my = pairs.groupBy(*keys, F.col("y").alias("cat")).agg(F.count("*").alias("ny"))
    e = mx.join(my, [*keys, "cat"]).groupBy(*keys).agg(F.sum(F.col("nx") * F.col("ny")).alias("exy"))
    j = n.join(e, list(keys), "left").withColumn("po", F.col("same") / F.col("n")).withColumn("pe", F.coalesce("exy", F.lit(0)) / (F.col("n") * F.col("n")))
    k = F.when(F.col("pe") == 1, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return j.select(*keys, "n", "same", F.round(k, 6).alias("kappa"))


def clusters(rows: DataFrame) -> DataFrame:
    """Contingency (gold, found, n) of items in a gold and a found cluster, with both sizes."""
    n = rows.groupBy("gold", "found").agg(F.count("*").alias("n"))
    g = rows.groupBy("gold").agg(F.count("*").alias("gn"))
    f = rows.groupBy("found").agg(F.count("*").alias("fn"))
    return n.join(g, "gold").join(f, "found")


def bcubed(c: DataFrame) -> DataFrame:
    t = c.agg(F.sum("n").alias("items"), (F.sum(F.col("n") * F.col("n") / F.col("fn")) / F.sum("n")).alias("p"), (F.sum(F.col("n") * F.col("n") / F.col("gn")) / F.sum("n")).alias("r"))
    return t.select("items", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(2 * F.col("p") * F.col("r") / F.when(F.col("p") + F.col("r") > 0, F.col("p") + F.col("r")), 6).alias("f1"))


def pairwise(c: DataFrame) -> DataFrame:
    """Pair counts from cluster sizes; no pair is ever formed."""
    two = lambda x: x * (x - 1) / 2
    both = c.agg(F.sum(two(F.col("n"))).alias("both"))
    found = c.groupBy("found").agg(F.first("fn").alias("k")).agg(F.sum(two(F.col("k"))).alias("found"))
    gold = c.groupBy("gold").agg(F.first("gn").alias("k")).agg(F.sum(two(F.col("k"))).alias("gold"))
    tagged = both.select(F.col("both").alias("v"), F.lit("b").alias("k")).union(found.select("found", F.lit("f"))).union(gold.select("gold", F.lit("g")))
    one = tagged.agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).cast("bigint").alias(n) for k, n in (("b", "both"), ("f", "found"), ("g", "gold"))])
    return one.select("both", "found", "gold", ratio(F.col("both"), F.col("found")).alias("precision"), ratio(F.col("both"), F.col("gold")).alias("recall"))


def purity(c: DataFrame) -> DataFrame:
    best = c.groupBy("found").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.agg(F.sum("n").cast("bigint").alias("items"), F.sum("m").cast("bigint").alias("majority"), F.round(F.sum("m") / F.sum("n"), 6).alias("purity"))


def split_merge(c: DataFrame) -> DataFrame:
    split = c.groupBy("gold").agg(F.count("*").alias("k")).select(F.lit("split").alias("kind"), F.col("k").alias("parts"))
    merged = c.groupBy("found").agg(F.count("*").alias("k")).select(F.lit("merged").alias("kind"), F.col("k").alias("parts"))
    return split.unionByName(merged).groupBy("kind", "parts").agg(F.count("*").alias("clusters"))


def bca_interval(hits: np.ndarray, items: np.ndarray, seeds: list[int], resamples: int) -> tuple[float, float]:
    """95 % BCa interval of the pooled hit rate, items resampled within each stratum.

    Hits among as many items as a stratum has, drawn from it with replacement, are binomial, so
    each resample is drawn from the counts.  Bias correction counts ties half.  Acceleration
    comes from the leave-one-out rates of each stratum, which take two values, one for its hits
    and one for the rest.
    """
    n = items.sum()
    rate = hits / items
    drawn = np.zeros(resamples, dtype=np.int64)
    for h, m, seed in zip(hits, items, seeds):
        drawn += np.random.default_rng(seed).binomial(m, h / m, resamples)
    below = ((drawn < hits.sum()).sum() + (drawn <= hits.sum()).sum()) / (2 * resamples)
    spread = (hits * (1 - rate) ** 2 + (items - hits) * rate**2).sum()
    if spread == 0 or not 0 < below < 1:  # every resample is alike
        return float(drawn.min() / n), float(drawn.max() / n)
    a = (hits * (1 - rate) ** 3 - (items - hits) * rate**3).sum() / (6 * spread**1.5)
    z0, normal = NormalDist().inv_cdf(below), NormalDist()
    drawn.sort()

    def bound(z: float) -> float:
        k = normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) * (resamples + 1)
        k = math.floor(k) if z < 0 else math.ceil(k)
        return float(drawn[min(max(k, 1), resamples) - 1] / n)

    return bound(normal.inv_cdf(0.025)), bound(normal.inv_cdf(0.975))


def bootstrap(scores: DataFrame, keys: list[str], stratum: str = "stratum", resamples: int = 10_000) -> DataFrame:
    """BCa interval of the hit rate per key, items resampled within ``stratum``.

    Only the counts per key and stratum leave the map side.  The generator of a stratum is
    seeded by the key and the stratum, so runs agree.
    """
    s = scores.where("outcome NOT IN ('gold_ambiguous', 'gold_no_ror')")
    counts = s.groupBy(*keys, stratum).agg(F.sum((F.col("outcome") == "correct").cast("bigint")).alias("hits"), F.count("*").alias("items"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(stratum)
        names = ["|".join(str(v) for v in row) for row in b[[*keys, stratum]].itertuples(index=False)]
        seeds = [int(hashlib.sha256(x.encode()).hexdigest()[:16], 16) for x in names]
        low, high = bca_interval(b["hits"].to_numpy(), b["items"].to_numpy(), seeds, resamples)
        return b[keys].head(1).assign(low=round(low, 6), high=round(high, 6), resamples=resamples)

    schema = ", ".join(f"{k} {scores.schema[k].dataType.simpleString()}" for k in keys)
    return counts.groupBy(*keys).applyInPandas(run, f"{schema}, low double, high double, resamples bigint")
