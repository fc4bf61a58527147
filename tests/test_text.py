"""Text heuristics on strings with known answers, brute force where SQL has no counterpart."""

import unicodedata

from pyspark.sql import functions as F

from orgweave.functions import ids, text
from orgweave.plans import catalog


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def test_identifiers(spark):
    got = one(spark, ids.canonical_id, "https://ror.org/052gg0110", " 052GG0110 ", "HTTP://ROR.ORG/052gg0110", "ror.org/052gg0110", "052gg011", "https://ror.org/https://ror.org/052gg0110", "152gg0110", "", None)
    assert got == ["https://ror.org/052gg0110"] * 4 + [None] * 5


def test_scripts(spark):
    got = one(spark, text.dominant_script, "東京大学 Tokyo", "東京だいがく", "Московский университет", "جامعة القاهرة", "มหาวิทยาลัย", "서울대학교", "University 東京", "", None, "123")
    assert got == [None, "japanese", "russian_cyrillic", "arabic", "thai", "korean", None, None, None, None]


def test_signals(spark):
    got = one(spark, text.token_signals, "HÔPITAL Général", "附属病院", "National Laboratory of X", "national institute", "Acme Inc.,", "1. A Univ; 2. B", "University of A; Institute B", "University A")
    assert [r.hospital for r in got] == [True, True] + [False] * 6
    assert [r.government for r in got] == [False, False, False, True] + [False] * 4
    assert got[4].company and [r.multi for r in got] == [False] * 5 + [True, True, False]


def test_redaction(spark):
    got = one(spark, text.redact_emails, "a.b+c@x.org; d@y.co.uk", "at home", None)
    assert (got[0].text, got[0].n) == ("redacted@x.org; redacted@y.co.uk", 2) and got[1].n == 0 and got[2].text is None


def test_contains_folded_against_python(spark):
    pairs = [("Université Pierre-et-Marie", "universite pierre et marie"), ("Straße", "strasse"), ("ﬁeld lab", "field"), ("abc", "東京"), ("abc", "d"), (None, "a")]
    df = spark.createDataFrame(pairs, "t string, n string")
    assert [r.x for r in df.select(text.contains_folded("t", "n").alias("x")).collect()] == [True, True, True, True, False, None]


def test_contains_norm_query(spark, tiny):
    fold = lambda v: "".join(ch for ch in unicodedata.normalize("NFKD", v.casefold()) if not unicodedata.combining(ch))
    raw = {r.item_id: r.raw_affiliation for r in spark.read.parquet(f"{tiny}/item.parquet").collect()}
    for r in catalog.contains_norm(spark, tiny).collect():
        assert r.hit == (fold(r.city) in fold(raw[r.item_id]).replace("-", " "))


def test_digits(spark):
    s = "Use `x1` and {{f.a1}} at https://a.b/1 see [t](u2) 10.1234/ab F1 F10 then 42 and 3.5\n```\n99\n```\nend 7x"
    assert one(spark, text.typed_digits, s, "none", None) == [["F10", "42", "3.5", "7x"], [], None]


def test_units(spark):
    assert one(spark, text.unit_family, "Per-Cent", "pp", "ppm", "Proportion", "per  cent of x", "ratio", None) == ["percent", "percent", None, "proportion", "percent", None, None]


def test_sentences_cover_the_text(spark, tiny):
    n = {r.doc_id: r.n for r in catalog.sentences(spark, tiny).groupBy("doc_id").agg(F.sum("len").alias("n")).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r.text and r.text.strip()}
    assert all(n[i] <= len(t) for i, t in docs.items()) and set(n) == set(docs)
