"""Consensus from several annotators' labels by the triplet moment method.

Pairwise agreement rates, corrected for chance, factor into the two annotators' skills:
c_ab = s_a s_b.  Three annotators therefore fix each other: s_a^2 = c_ab c_ac / c_bc.  The
accuracies that follow weight the votes by their log-odds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions.ids import bare_set
from orgweave.session import cut

UNRESOLVED = ("ambiguous", "no_ror")


def outcome_text(decision: Column, ids: Column) -> Column:
    """``ambiguous``, ``no_ror`` or ``ror:`` and the sorted bare ids; NULL for no usable say."""
    bare = bare_set(ids)
    return F.when(decision.isin(*UNRESOLVED), decision).when(decision.isin("accepted", "corrected") & (F.size(bare) > 0), F.concat(F.lit("ror:"), F.array_join(bare, "|")))


def current_says(labels: DataFrame) -> DataFrame:
    """(item, annotator, outcome): each annotator's row with the highest label_id on an item.

    A pair whose highest row is superseded, skipped or holds no identifier has no say.  Rows
    without item, annotator or label_id drop out; repeated rows count once; NULL superseded
    counts as live.  The maximum is taken map-side first, so a hot item or annotator costs
    no more than its share of the input.
    """
    decision = F.lower(F.trim("decision"))
    live = F.when(~F.coalesce("superseded", F.lit(False)), outcome_text(decision, F.col("ror_ids")))
    rows = labels.where("item_id IS NOT NULL AND annotator IS NOT NULL AND label_id IS NOT NULL")
    rows = rows.select(F.col("item_id").alias("item"), "annotator", F.struct(F.col("label_id"), live.alias("outcome")).alias("say"))
    return rows.groupBy("item", "annotator").agg(F.max("say").alias("say")).select("item", "annotator", F.col("say.outcome").alias("outcome")).where("outcome IS NOT NULL")


def _pairs(says: DataFrame) -> DataFrame:
    """(a, b, same) for every two says on one item, ``a`` before ``b``.

    An annotator has one say on an item, so a list holds at most as many as there are annotators;
    pairs are formed within a task and summed up there before any is shuffled.
    """
    per_item = says.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("annotator", F.xxhash64("outcome").alias("o")))).alias("r")).where(F.size("r") > 1)
    two = F.expr("flatten(transform(r, (x, i) -> transform(slice(r, i + 2, size(r)), y -> struct(x.annotator AS a, y.annotator AS b, CAST(x.o = y.o AS bigint) AS same))))")
    return per_item.select(F.explode(two).alias("p")).select("p.*")


def pair_agreement(says: DataFrame) -> DataFrame:
    """(a, b, n, same, c, e): agreement of each pair of annotators, its chance-corrected rate and the chance.

    Chance agreement is Cohen's: the product of the two annotators' own outcome shares,
    summed over all outcomes; an outcome meets only the annotators who ever gave it.
    """
    counted = _pairs(says).groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("same").alias("same"))
    held = says.groupBy("annotator", "outcome").agg(F.count("*").alias("k"))
    totals = held.groupBy("annotator").agg(F.sum("k").alias("of"))
    shares = held.join(totals, "annotator").select("annotator", F.xxhash64("outcome").alias("o"), (F.col("k") / F.col("of")).alias("share"))
    per_outcome = shares.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("annotator", "share"))).alias("r")).where(F.size("r") > 1)
    two = F.expr("flatten(transform(r, (x, i) -> transform(slice(r, i + 2, size(r)), y -> struct(x.annotator AS a, y.annotator AS b, x.share * y.share AS e))))")
    chance = per_outcome.select(F.explode(two).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.e").alias("e"))
    e = F.least(F.coalesce("e", F.lit(0.0)), F.lit(0.99))
    return counted.join(chance, ["a", "b"], "left").select("a", "b", "n", "same", ((F.col("same") / F.col("n") - e) / (1 - e)).alias("c"), e.alias("e"))


def reliability(pairs: DataFrame, floor: float = 0.02, ceiling: float = 0.995) -> DataFrame:
    """(annotator, skill, accuracy, compared) by triplets.

    An annotator's partners, in the order of their shared says, are taken two by two round
    the ring; each such triplet adds c_ab c_ac to the numerator and c_bc to the denominator,
    weighted by its smallest count.  The ratio of the sums is the squared skill.  Annotators
    without a usable triplet get the root of their mean corrected rate.  Triplets grow with the pairs.

    ``skill`` is the chance-corrected rate; ``accuracy`` is the probability of a right say that
    follows from it, skill + (1 - skill) * chance, with the annotator's mean chance agreement.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "n", "c", "e").union(pairs.select("b", "a", "n", "c", "e"))
    w = Window.partitionBy("x").orderBy(F.col("n").desc(), "y")
    around = both.withColumn("y2", F.coalesce(F.lead("y").over(w), F.first("y").over(w))).withColumn("n2", F.coalesce(F.lead("n").over(w), F.first("n").over(w)))
    around = around.withColumn("c2", F.coalesce(F.lead("c").over(w), F.first("c").over(w))).where("y <> y2")
    third = both.select(F.col("x").alias("y"), F.col("y").alias("y2"), F.col("n").alias("n3"), F.col("c").alias("c3"))
    weight = F.least("n", "n2", "n3")
    trip = around.join(third, ["y", "y2"]).groupBy("x").agg(F.sum(weight * F.col("c") * F.col("c2")).alias("num"), F.sum(weight * F.col("c3")).alias("den"))
    total = both.groupBy("x").agg(F.sum("n").alias("compared"), (F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("mean_c"), (F.sum(F.col("n") * F.col("e")) / F.sum("n")).alias("chance"))
    sq = F.when((F.col("den") > 0) & (F.col("num") > 0), F.col("num") / F.col("den")).when(F.col("den") > 0, F.lit(0.0))
    est = total.join(trip, "x", "left").select("x", "compared", "mean_c", "chance", (F.sqrt(sq) * F.when(F.col("mean_c") < 0, -1).otherwise(1)).alias("s"))
    skill = F.coalesce("s", F.sqrt(F.greatest("mean_c", F.lit(0.0))))
    right = F.greatest(skill, F.lit(0.0)) + (1 - F.greatest(skill, F.lit(0.0))) * F.col("chance")
    return est.select(F.col("x").alias("annotator"), skill.alias("skill"), F.least(F.greatest(right, F.lit(floor)), F.lit(ceiling)).alias("accuracy"), "compared")


def weighted_votes(says: DataFrame, rel: DataFrame, least: int = 3, alternatives: int = 8) -> DataFrame:
    """(item, outcome, says, agreement, margin) for items with at least ``least`` says.

    A vote weighs log(accuracy) - log((1-accuracy)/alternatives); an annotator without an
    estimate has accuracy one half.  Ties fall to more votes, then to the smaller text.
    ``agreement`` is the share of pairs of says that agree on the item.
    """
    acc = F.coalesce("accuracy", F.lit(0.5))
    voted = says.join(rel.select("annotator", "accuracy"), "annotator", "left").withColumn("w", F.log(acc) - F.log((1 - acc) / alternatives))
    per_outcome = voted.groupBy("item", "outcome").agg(F.sum("w").alias("score"), F.count("*").alias("votes"))
    per_item = per_outcome.groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), (-F.col("votes")).alias("v"), "outcome"))).alias("r"),
        F.sum("votes").alias("n"), F.sum(F.col("votes") * (F.col("votes") - 1)).alias("agreeing"),
    )
    return per_item.where(F.col("n") >= least).select(
        "item", F.col("r")[0]["outcome"].alias("outcome"), F.col("n").alias("says"), F.round(F.try_divide(F.col("agreeing"), F.col("n") * (F.col("n") - 1)), 6).alias("agreement"),
        F.round(F.coalesce(F.try_element_at("r", F.lit(2))["s"], F.lit(0.0)) - F.col("r")[0]["s"], 6).alias("margin"),
    )


def consensus(labels: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Consensus per item and reliability per annotator; empty input gives empty results."""
    says = cut(current_says(labels))
    rel = cut(reliability(cut(pair_agreement(says))))
    return weighted_votes(says, rel, least), rel
