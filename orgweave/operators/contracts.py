"""Contracts on findings and provenance rows, and the register of rendered claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import PLACEHOLDER, scale_violation

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def _codes(*pairs: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in pairs]), lambda c: c.isNotNull())


def blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def iso_date(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(_ISO), F.lit(False)) & F.try_to_timestamp(c).isNotNull()


def finding_codes(df: DataFrame) -> DataFrame:
    """Add ``codes``: every rule that a finding (key, value, value_text, unit, n, computed_by,
    computed_at, source_snapshot, scale_exempt_reason) breaks; an empty array for none."""
    finite = F.col("value").isNull() | (~F.isnan("value") & (F.abs("value") != float("inf")))
    return df.withColumn("codes", F.concat(
        _codes(
            ("key", ~F.coalesce(F.col("key").rlike("^[a-z0-9_]+$"), F.lit(False))), ("value", F.col("value").isNull() & F.col("value_text").isNull()), ("finite", ~finite), ("unit", blank("unit")), ("n", F.coalesce(F.col("n") < 0, F.lit(True))),
            ("computed_by", blank("computed_by")), ("computed_at", ~iso_date("computed_at")), ("source_snapshot", blank("source_snapshot")), ("exempt", F.trim("scale_exempt_reason") == ""),
        ),
        _codes(("scale", scale_violation(F.col("value"), F.col("unit"), F.col("scale_exempt_reason")).isNotNull())),
    ))


def provenance_codes(df: DataFrame) -> DataFrame:
    """Add ``codes`` for provenance rows (script, source_snapshot, query, rows_in, rows_out, run_id, run_at)."""
    texts = [(c, blank(c)) for c in ("script", "source_snapshot", "query", "run_id")]
    counts = [(c, F.coalesce(F.col(c) < 0, F.lit(True))) for c in ("rows_in", "rows_out")]
    return df.withColumn("codes", _codes(*texts, *counts, ("run_at", ~iso_date("run_at"))))


def claims(drafts: DataFrame, findings: DataFrame) -> DataFrame:
    """(draft, pos, at, key, value, unit, n, snapshot, script, sentence): one row per placeholder, in order.

    The sentence that holds the placeholder stands beside it, flattened and cut to 240
    characters; bars are escaped for a table.  Keys without a finding keep NULL values.
    """
    sents = drafts.select("draft", F.posexplode(F.split("text", r"(?<=[.!?])\s|\n[ \t]*\n")).alias("pos", "t"))
    flat = F.trim(F.regexp_replace("t", r"\s+", " "))
    short = F.when(F.length(flat) > 240, F.concat(F.rtrim(F.substring(flat, 1, 237)), F.lit("..."))).otherwise(flat)
    keys = sents.select("draft", "pos", F.replace(short, F.lit("|"), F.lit("\\|")).alias("sentence"), F.posexplode(F.regexp_extract_all("t", F.lit(PLACEHOLDER), F.lit(1))).alias("at", "key"))
    return keys.join(findings.select("key", "value", "unit", "n", F.substring("source_snapshot", 1, 12).alias("snapshot"), F.col("computed_by").alias("script")), "key", "left").select("draft", "pos", "at", "key", "value", "unit", "n", "snapshot", "script", "sentence")
