"""Graph operators on typed links: symmetrisation, succession, ancestry and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.session import cut


def symmetrise(edges: DataFrame) -> DataFrame:
    """(a, rel, b) with rel parent (b is a's parent), successor (b succeeds a) or related.

    A link stated at either end, or at both, is one row; related links go both ways.
    """
    back = F.col("rel").isin("child", "predecessor")
    rel = F.when(F.col("rel").isin("parent", "child"), "parent").when(F.col("rel").isin("successor", "predecessor"), "successor").otherwise("related")
    one = edges.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("a"), rel.alias("rel"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("b"))
    mirrored = one.where("rel = 'related'").select(F.col("b").alias("a"), "rel", F.col("a").alias("b"))
    return one.unionByName(mirrored).distinct()


def succession_steps(sym: DataFrame, cut_every: int = 4) -> DataFrame:
    """(old, new, steps): shortest chain of successor links, never from a record to itself.

    Frontier joins with a seen set: each level extends the newest pairs by one link and
    keeps the pairs not reached before, so cycles end.  The loop ends at an empty frontier.
    """
    succ = cut(sym.where("rel = 'successor' AND a <> b").select(F.col("a").alias("mid"), F.col("b").alias("next")).distinct())
    front = succ.select(F.col("mid").alias("old"), F.col("next").alias("new"), F.lit(1).alias("steps"))
    seen = front
    while not front.isEmpty():
        step = front.join(succ, front["new"] == succ["mid"]).where("old <> next").select("old", F.col("next").alias("new"), (F.col("steps") + 1).alias("steps")).distinct()
        front = cut(step.join(seen.select("old", "new"), ["old", "new"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def ancestry(sym: DataFrame, max_depth: int = 5) -> DataFrame:
    """(low, high, depth): ancestors over at most ``max_depth`` parent links, shortest way."""
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    up = sym.where("rel = 'parent'").select(F.col("a").alias("mid"), F.col("b").alias("next")).distinct()
    level = up.select(F.col("mid").alias("low"), F.col("next").alias("high"), F.lit(1).alias("depth"))
    every = level
    for depth in range(2, max_depth + 1):
        level = level.join(up, level["high"] == up["mid"]).select("low", F.col("next").alias("high"), F.lit(depth).alias("depth")).distinct()
        every = every.unionByName(level)
    return every.where("depth <= " + str(max_depth)).groupBy("low", "high").agg(F.min("depth").alias("depth"))


def active_successors(sym: DataFrame, org: DataFrame) -> DataFrame:
    """(rid, active, passed, outside): level-wise walk from each dead record along successors.

    A branch stops at the first active record; records passed through and successors without
    a record are listed apart, all three sorted.  The seen set bounds cycles.
    """
    status = cut(org.select("rid", "status"))
    succ = cut(sym.where("rel = 'successor'").select(F.col("a").alias("mid"), F.col("b").alias("next")).distinct())
    starts = status.where("status <> 'active'").select(F.col("rid").alias("start"))
    front = starts.select("start", F.col("start").alias("at"))
    seen = front
    reached: DataFrame | None = None
    while True:
        step = front.join(succ, front["at"] == succ["mid"]).select("start", F.col("next").alias("at")).distinct().join(seen, ["start", "at"], "left_anti")
        step = cut(step.join(status.select(F.col("rid").alias("at"), "status"), "at", "left").select("start", "at", "status"))
        if step.isEmpty():
            break
        reached = step if reached is None else reached.unionByName(step)
        seen = cut(seen.unionByName(step.select("start", "at")))
        front = step.where("status IS NOT NULL AND status <> 'active'").select("start", "at")
    if reached is None:
        return starts.select(F.col("start").alias("rid"), *[F.lit("").alias(c) for c in ("active", "passed", "outside")]).limit(0)
    kind = F.when(F.col("status") == "active", "active").when(F.col("status").isNull(), "outside").otherwise("passed")
    listed = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(kind == k, F.col("at")))), "|").alias(k)
    return reached.groupBy(F.col("start").alias("rid")).agg(listed("active"), listed("passed"), listed("outside"))


def superseded(edges: DataFrame, org: DataFrame) -> DataFrame:
    """Records that are not active and themselves state a successor."""
    own = edges.where("rel = 'successor'").select(F.col("src").alias("rid")).distinct()
    return org.where("status <> 'active'").join(own, "rid", "left_semi").select("rid", "status")


def crosswalk(records: DataFrame) -> DataFrame:
    """(scheme, value, rids, n): every external id, preferred ones included, with its records."""
    e = records.select("rid", F.explode("external_ids").alias("e")).where("e IS NOT NULL")
    ids = F.array_distinct(F.filter(F.concat(F.coalesce("e.all", F.array().cast("array<string>")), F.array("e.preferred")), lambda x: x.isNotNull()))
    rows = e.select(F.col("e.type").alias("scheme"), F.explode(ids).alias("value"), "rid").where("scheme IS NOT NULL").distinct()
    return rows.groupBy("scheme", "value").agg(F.array_join(F.array_sort(F.collect_list("rid")), "|").alias("rids"), F.count("*").alias("n"))
