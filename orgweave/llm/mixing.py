"""Mixing sources to target weights by entropy balancing.

Each document d of source s has a rate r_d: how often it is used.  Of all rates up to the cap that give
every source its target tokens, those with the least relative entropy to one use per document
are exponentially tilted, r_d = min(cap, exp(lambda_s t_d)), t_d its tokens, and the lambda solve a convex dual.
Gradient and curvature are sums over documents, so each Newton step is one aggregation.  Rates become
whole copies by systematic rounding.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.session import cut

#: Where the public tokenizers' files lie; a parameter, the files are never copied.
TOKENIZER_FILE = os.environ.get("ORGWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public byte-level BPE's split pattern.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_name(c: Column) -> Column:
    """Source apart from case, outer blanks and the word separator."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", "_")


def token_counts(docs: DataFrame, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, source, tokens): tokens of the whole text; NULL and empty texts have none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": np.array(n, np.int64)})

    return docs.select("doc_id", "source", "text").mapInPandas(count, "doc_id bigint, source string, tokens bigint")


@dataclass
class Goal:
    source: str
    share: float
    most: int


def goals(weights: DataFrame, bound: int = 100_000) -> list[Goal]:
    """Target share and cap per source; a design table whose size is checked.  Shares of a
    source stated twice count once; NULL shares are 0, NULL caps 1."""
    rows = weights.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} sources")
    seen = {r.s: Goal(r.s, float(r.target_share or 0), int(1 if r.max_repeats is None else r.max_repeats)) for r in sorted(rows, key=str) if r.s is not None}
    return sorted(seen.values(), key=lambda g: g.source)


def lengths(counted: DataFrame) -> DataFrame:
    """(source, tokens, docs): all that the dual needs of the documents, since equal lengths have equal rates."""
    return counted.where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("docs"))


def _rate(lam: Column, tokens: Column, mean: Column, cap: Column) -> Column:
    return F.least(F.exp(F.least(lam * tokens / mean, F.lit(50.0))), cap.cast("double"))


def _dual_table(spark, dual: dict[str, tuple[float, float, int]]) -> DataFrame:  # noqa: ANN001
    rows = [(s, *v) for s, v in dual.items()]
    return F.broadcast(spark.createDataFrame(rows, "source string, lam double, mean double, cap long"))


def _gradient(of: DataFrame, dual: dict[str, tuple[float, float, int]]) -> dict[str, tuple[float, float]]:
    """Per source the tokens that the rates give, and how fast they grow with its dual variable."""
    rate = _rate(F.col("lam"), F.col("tokens"), F.col("mean"), F.col("cap"))
    rows = of.join(_dual_table(of.sparkSession, dual), "source").withColumn("given", F.col("docs") * F.col("tokens") * rate)
    slope = F.when(rate < F.col("cap"), F.col("given") * F.col("tokens") / F.col("mean")).otherwise(0.0)
    return {g.source: (g.t, g.d) for g in rows.groupBy("source").agg(F.sum("given").alias("t"), F.sum(slope).alias("d")).collect()}


def targets(sizes: dict[str, float], wanted: list[Goal], total: float | None) -> dict[str, float]:
    """Tokens per source: shares of the total, where a source can give them within its cap.

    Without ``total`` the mix is as large as the listed sources.  What sources at their cap cannot
    give is spread over the rest in proportion; sources without tokens or share get nothing.
    """
    live = [g for g in wanted if sizes.get(g.source, 0) > 0 and g.share > 0 and g.most > 0]
    total = total or sum(sizes[g.source] for g in live)
    most = {g.source: g.most * sizes[g.source] for g in live}
    capped: set[str] = set()
    while True:
        free = [g for g in live if g.source not in capped]
        left = max(total - sum(most[s] for s in capped), 0)
        mass = sum(g.share for g in free)
        aim = {g.source: left * g.share / mass for g in free}
        over = {s for s, t in aim.items() if t >= most[s]}
        if not over:
            return aim | {s: most[s] for s in capped}
        capped |= over


def balance(of: DataFrame, wanted: list[Goal], total: float | None = None, rounds: int = 60, tolerance: float = 1e-8) -> dict[str, tuple[float, float, int]]:
    """Dual variable, mean tokens and cap per source; a document's rate is min(cap, exp(lam tokens/mean)).

    Of all rates between 0 and the cap that give every source its target tokens, these have the least
    relative entropy to one use per document: the token constraint's multiplier tilts them by
    length, and those of the caps cut the tilt off.  The dual is convex with one variable a source; each
    Newton step takes all gradients and curvatures from one distributed aggregation (a row per listed
    source comes back), and a step that leaves the bracket of the root halves it instead.  A
    source that needs all it has under its cap sits at the cap: the limit of a growing multiplier.
    """
    sizes = {r.source: (float(r.n), float(r.t)) for r in of.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("tokens")).alias("t")).collect()}
    aim = targets({s: t for s, (_, t) in sizes.items()}, wanted, total)
    caps = {g.source: g.most for g in wanted}
    mean = {s: sizes[s][1] / sizes[s][0] for s in aim}
    full = {s for s, t in aim.items() if t >= caps[s] * sizes[s][1] * (1 - 1e-12)}
    lam = {s: 0.0 for s, t in aim.items() if t > 0 and s not in full}
    low, high = dict.fromkeys(lam, -math.inf), dict.fromkeys(lam, math.inf)
    for _ in range(rounds if lam else 0):
        at = _gradient(of, {s: (v, mean[s], caps[s]) for s, v in lam.items()})
        off = {s: aim[s] - at[s][0] for s in lam}
        if max(abs(off[s]) / aim[s] for s in lam) <= tolerance:
            break
        for s, v in lam.items():
            (low if off[s] > 0 else high)[s] = v
            # Newton on the logarithm of the tokens given, which is close to linear in the multiplier.
            step = math.log(aim[s] / at[s][0]) * at[s][0] / at[s][1] if at[s][1] > 0 and at[s][0] > 0 else math.copysign(1.0, off[s])
            new = v + max(-4.0, min(4.0, step))
            if not low[s] < new < high[s]:
                new = (max(low[s], v - 4.0) + min(high[s], v + 4.0)) / 2
            lam[s] = new
    dual = {s: (v, mean[s], caps[s]) for s, v in lam.items()}
    return dual | {s: (math.inf, mean[s], caps[s]) for s in full}


def copies(counted: DataFrame, dual: dict[str, tuple[float, float, int]], seed: int = 0, bucket_docs: int = 4096) -> DataFrame:
    """(doc_id, source, tokens, copies): rates rounded so that each source's tokens come out.

    Within a hash bucket, in the order of their length, the fractional parts of the rates
    add up; a document gets one more copy each time the sum passes a whole one, so each
    length has its share of them.  The running sum is offset by the sums of the buckets before.  A
    source has a bucket for about ``bucket_docs`` documents, so none is ever sorted as a whole.
    No document exceeds its source's cap.
    """
    spark = counted.sparkSession
    known = {s: (min(v, 1e6), m, c) for s, (v, m, c) in dual.items()} or {"": (-1e6, 1.0, 0)}
    rows = counted.where(F.col("tokens") > 0).join(_dual_table(spark, known), "source")
    rows = rows.withColumn("rate", F.round(_rate(F.col("lam"), F.col("tokens"), F.col("mean"), F.col("cap")), 9))
    sizes = rows.groupBy("source").agg(F.ceil(F.count("*") / bucket_docs).alias("buckets"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    rows = rows.join(F.broadcast(sizes), "source").withColumn("h", h).withColumn("b", F.pmod("h", F.col("buckets")))
    rows = rows.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("frac", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    before = rows.groupBy("source", "b").agg(F.sum("frac").alias("f"))
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("source", "b", F.coalesce(F.sum("f").over(run), F.lit(0.0)).alias("ahead"))
    inner = Window.partitionBy("source", "b").orderBy("tokens", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(before, ["source", "b"]).withColumn("sum", F.col("ahead") + F.sum("frac").over(inner))
    extra = F.floor(F.col("sum") + 0.5 + 1e-7) - F.floor(F.col("sum") - F.col("frac") + 0.5 + 1e-7)
    return placed.select("doc_id", "source", "tokens", F.least(F.col("whole") + extra, F.col("cap")).cast("bigint").alias("copies"))


def mix(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 0, tokenizer_file: str = TOKENIZER_FILE) -> tuple[DataFrame, DataFrame]:
    """The mix (documents with at least one copy) and the report of the shares reached.

    Documents of sources that are not listed, of NULL source, or without tokens are not in
    the mix; a doc_id stated twice counts once, with its least source and tokens.  Every listed source has a report row.
    """
    wanted = goals(weights)
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    # Texts are counted where they lie: only numbers are ever shuffled.
    each = token_counts(named.where(F.col("source").isin([g.source for g in wanted])), tokenizer_file)
    counted = cut(each.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens"))
    dual = balance(cut(lengths(counted)), wanted, total)
    used = copies(counted, dual, seed)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(g.source, g.share, g.most, dual[g.source][0] if g.source in dual else None) for g in wanted], "source string, target_share double, max_repeats bigint, tilt double")
    have = counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("source_tokens"))
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    joined = plan.join(have, "source", "left").join(got, "source", "left")
    whole = got.agg(F.greatest(F.coalesce(F.sum("mix_tokens"), F.lit(1)), F.lit(1)).alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    report = joined.select("source", "target_share", "max_repeats", F.round("tilt", 6).alias("tilt"), zero("docs"), zero("source_tokens"), zero("mix_tokens"), zero("most_copies"))
    report = report.withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one").drop("one").withColumn("reached_share", F.round(F.col("mix_tokens") / F.col("all_tokens"), 6)).drop("all_tokens")
    return used.where("copies > 0"), report
