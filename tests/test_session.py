"""Durable cuts of lineage."""

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from orgweave import session


def test_stash_keeps_rows_and_types_and_is_removed(spark):
    df = spark.createDataFrame([(1, ["a", None], 1.5), (2, None, None)], "id bigint, names array<string>, v double")
    kept = session.stash(df)
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    folder = Path(urlparse(kept.inputFiles()[0]).path).parent
    assert folder.is_relative_to(Path(urlparse(session.ensure_checkpoint_dir(spark)).path)) and folder.exists()
    session._remove(spark, folder.as_uri())
    assert not folder.exists()


def test_stash_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, t string")
    assert session.stash(df).count() == 0 and session.cut(df.where(F.lit(False))).count() == 0
