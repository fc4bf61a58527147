"""Readers and writers: record dumps, JSON lines, manifests, CSV.

Nothing here infers a schema.  Our own data and pinned dumps are read strictly (a surprise is
an error), data from outside permissively with the unreadable rows kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "id string, status string, established int, types array<string>, domains array<string>, names array<struct<value string, types array<string>, lang string>>, "
    "locations array<struct<geonames_id bigint, geonames_details struct<name string, country_code string, country_name string, continent_code string, continent_name string, country_subdivision_code string, country_subdivision_name string, lat double, lng double>>>, "
    "relationships array<struct<type string, id string, label string>>, external_ids array<struct<type string, preferred string, all array<string>>>, links array<struct<type string, value string>>, "
    "admin struct<created struct<date string, schema_version string>, last_modified struct<date string, schema_version string>>"
)


class DumpError(ValueError):
    """A record dump breaks its contract."""


def check_envelope(spark: SparkSession, path: str) -> None:
    """Refuse a dump that is not one JSON array: byte-order mark, other start, anything after the end.

    Only the first and last bytes of each file are looked at.
    """
    ends = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 64).alias("head"), F.expr("substring(content, -64, 64)").alias("tail"))
    for r in ends.collect():
        head, tail = bytes(r.head), bytes(r.tail)
        if head.startswith(b"\xef\xbb\xbf"):
            raise DumpError(f"{r.path}: byte-order mark")
        if not head.lstrip().startswith(b"["):
            raise DumpError(f"{r.path}: no JSON array")
        if not tail.rstrip().endswith(b"]"):
            raise DumpError(f"{r.path}: text after the array, or the array is not closed")


def read_dump(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Records of a JSON-array dump, strict: schema version 2, unique ids, statuses, count.

    The checks are aggregations; nothing but their few results reaches the driver.  Convert
    the result to Parquet once: later reads then prune columns and push filters down.
    """
    check_envelope(spark, path)
    df = spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    facts = df.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("id").isNull() | F.col("status").isNull(), 1)).alias("bare"), F.count(F.when(~F.col("admin.last_modified.schema_version").startswith("2"), 1)).alias("old"),
        F.count(F.when(F.col("names").isNull() | F.col("locations").isNull(), 1)).alias("unlisted"),
    ).first()
    if facts.n == 0:
        raise DumpError("empty dump")
    if expected is not None and facts.n != expected:
        raise DumpError(f"{facts.n} records, {expected} expected")
    for what, k in (("without id or status", facts.bare), ("of an older schema", facts.old), ("without name or location list", facts.unlisted)):
        if k:
            raise DumpError(f"{k} records {what}")
    twice = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise DumpError(f"repeated ids, such as {[r.id for r in twice]}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """JSON lines; blank lines are skipped.  Strict: any bad line is an error.  Else: (rows, bad lines)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), None
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"}).alias("r"))
    return parsed.where("r._bad IS NULL").select("r.*").drop("_bad"), parsed.where("r._bad IS NOT NULL").select("value")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, exclude: str = "manifest*.json") -> DataFrame:
    """(file, digest): content hash of every file below ``path``, manifests left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rel = F.substring_index("path", path.rstrip("/") + "/", -1)
    return files.select(rel.alias("file"), F.sha2("content", 256).alias("digest")).where(~F.col("file").rlike(exclude.replace(".", r"\.").replace("*", ".*") + "$"))


def aggregate_digest(files: DataFrame) -> str:
    """One hash over the sorted ``file:digest`` lines of a manifest; an empty one is an error."""
    line = F.concat_ws(":", "file", "digest")
    r = files.agg(F.count("*").alias("n"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")), 256).alias("d")).first()
    if not r.n:
        raise ValueError("no files")
    return r.d
