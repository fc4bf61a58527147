"""Set-against-set scoring: pair relations, rules, maximum matching, outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The relations that satisfy each rule.
RULES = {
    "exact": ("exact",),
    "parent_child": ("exact", "parent_of_gold", "child_of_gold"),
    "any_relationship": ("exact", "parent_of_gold", "child_of_gold", "related"),
}


def pair_relations(pairs: DataFrame, sym: DataFrame, chain: DataFrame, org: DataFrame) -> DataFrame:
    """Add the relation of each (assigned, gold) pair, the first that holds in a fixed order.

    All lookups are left joins from the pairs, so an id without a record may still carry an
    edge that the other end states.
    """
    e = lambda rel, x, y, name: sym.where(F.col("rel") == rel).select(F.col("a").alias(x), F.col("b").alias(y), F.lit(True).alias(name)).distinct()
    out = pairs.join(e("parent", "gold", "assigned", "is_parent"), ["assigned", "gold"], "left")
    out = out.join(e("parent", "assigned", "gold", "is_child"), ["assigned", "gold"], "left")
    out = out.join(chain.select(F.col("old").alias("assigned"), F.col("new").alias("gold"), F.lit(True).alias("is_old")), ["assigned", "gold"], "left")
    out = out.join(chain.select(F.col("old").alias("gold"), F.col("new").alias("assigned"), F.lit(True).alias("is_new")), ["assigned", "gold"], "left")
    out = out.join(e("related", "assigned", "gold", "is_related"), ["assigned", "gold"], "left")
    out = out.join(org.select(F.col("rid").alias("assigned"), F.col("status").alias("assigned_status")), "assigned", "left")
    relation = (
        F.when(F.col("assigned") == F.col("gold"), "exact").when(F.col("is_parent"), "parent_of_gold").when(F.col("is_child"), "child_of_gold").when(F.col("is_old"), "predecessor_of_gold")
        .when(F.col("is_new"), "successor_of_gold").when(F.col("is_related"), "related").when(F.col("assigned_status").isNull(), "not_in_dump").otherwise("none")
    )
    return out.select(*pairs.columns, relation.alias("relation"), F.coalesce(F.col("assigned_status") == "active", F.lit(False)).alias("active"), F.coalesce("is_old", F.lit(False)).alias("chained"))


def matching_size(masks: Column) -> Column:
    """Maximum bipartite matching of up to 12 left nodes, given each one's bit mask of partners.

    By the deficiency formula: left nodes plus the least of |N(S)| - |S| over all subsets S.
    """
    n = F.size(masks)

    def deficiency(s: Column) -> Column:
        seen = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("bigint"), lambda acc, i: F.when(F.get(F.array(*[F.lit(1 << k) for k in range(12)]), i).bitwiseAND(s) != 0, acc.bitwiseOR(F.get(masks, i))).otherwise(acc))
        return F.bit_count(seen) - F.bit_count(s)

    subsets = F.sequence(F.lit(0), (F.pow(F.lit(2), n) - 1).cast("int"))
    return F.when(n == 0, 0).otherwise(n + F.array_min(F.transform(subsets, deficiency))).cast("int")


def _augment(partners: list[list[int]]) -> int:
    """Augmenting paths breadth first, for sides beyond the subset formula."""
    left_of: dict[int, int] = {}
    size = 0
    for start in range(len(partners)):
        came: dict[int, int] = {}  # right node -> left node from which it was reached
        frontier, end = [start], None
        while frontier and end is None:
            reached = []
            for a in frontier:
                for g in partners[a]:
                    if g not in came:
                        came[g] = a
                        if g not in left_of:
                            end = g
                            break
                        reached.append(left_of[g])
                if end is not None:
                    break
            frontier = reached
        held = {a: g for g, a in left_of.items()}
        while end is not None:
            a = came[end]
            left_of[end], end = a, held.get(a)
            size += end is None
    return size


def with_matching(df: DataFrame, partners: str, out: str) -> DataFrame:
    """Add the matching size of ``partners``: per left node the places of its right nodes, from 0.

    Up to 12 left nodes with places below 63 take the formula on bit masks; all others, of any size, go through
    Arrow batches.
    """
    p = F.col(partners)
    fits = (F.size(p) <= 12) & (F.coalesce(F.array_max(F.flatten(p)), F.lit(0)) < 63)
    masks = F.transform(p, lambda one: F.aggregate(one, F.lit(0).cast("bigint"), lambda acc, g: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), g))))
    small = df.where(fits).withColumn("_masks", masks).withColumn(out, matching_size(F.col("_masks"))).drop("_masks")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [_augment([[int(g) for g in one] for one in x]) for x in b[partners]]})

    return small.unionByName(df.where(~fits).mapInPandas(run, schema))


def score_sets(sides: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per (item, source, rule) with outcome and element counts.

    ``sides`` (item_id, source, decision, gold_ids, assigned_ids), ``relations`` as from
    :func:`pair_relations` with columns item_id, source.  Sets may have any size; nothing here reads
    the source but to keep rows apart.
    """
    resolved = sides.where(F.col("decision").isin("accepted", "corrected"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.array(*[F.lit(x) for x in rel]).alias("accepts")) for r, rel in RULES.items()])).alias("k")
    joined = relations.join(resolved.select("item_id", "source", "gold_ids"), ["item_id", "source"]).withColumn("place", (F.array_position("gold_ids", F.col("gold")) - 1).cast("int"))
    per_pair = joined.select("item_id", "source", "assigned", "active", "chained", "relation", "place", rules)
    ok = F.col("active") & F.array_contains(F.col("k.accepts"), F.col("relation"))
    per_left = per_pair.groupBy("item_id", "source", F.col("k.rule").alias("rule"), "assigned").agg(
        F.collect_set(F.when(ok, F.col("place"))).alias("partners"), F.bool_or(~F.col("active") & F.col("chained")).alias("stale")
    )
    sets = per_left.groupBy("item_id", "source", "rule").agg(F.collect_list("partners").alias("partners"), F.sum((F.size("partners") == 0).cast("int")).alias("ungrounded"), F.bool_and(F.col("stale")).alias("all_stale"))
    sized = with_matching(sets, "partners", "m")
    every = sides.withColumn("k", F.explode(F.array(*[F.lit(r) for r in RULES]))).select("item_id", "source", F.col("k").alias("rule"), "decision", F.size("gold_ids").alias("g"), F.size("assigned_ids").alias("a"))
    j = every.join(sized.select("item_id", "source", "rule", "m", "ungrounded", "all_stale"), ["item_id", "source", "rule"], "left")
    outcome = (
        F.when(F.col("decision") == "ambiguous", "gold_ambiguous").when(F.col("decision") == "no_ror", "gold_no_ror").when(F.col("a") == 0, "no_assignment")
        .when((F.col("ungrounded") == 0) & (F.col("m") < F.col("g")), "collapsed").when((F.col("ungrounded") == 0) & (F.col("a") > F.col("g")), "over_assigned").when(F.col("ungrounded") == 0, "correct")
        .when((F.col("m") == 0) & F.col("all_stale"), "stale").when(F.col("m") > 0, "partial").otherwise("wrong")
    )
    no_ror = (F.col("decision") == "no_ror") & (F.col("a") > 0)
    counted = ~F.col("decision").isin("ambiguous", "no_ror") & (F.col("a") > 0)
    count = lambda v, z: F.when(counted, v).when(no_ror, z).cast("bigint")
    return j.select(
        "item_id", "source", "rule", outcome.alias("outcome"), count(F.col("m"), F.lit(0)).alias("tp"), count(F.col("a") - F.col("m"), F.col("a")).alias("fp"), count(F.col("g") - F.col("m"), F.lit(0)).alias("fn"),
        F.col("a").cast("bigint").alias("assigned"), F.col("g").cast("bigint").alias("gold"),
    )
