"""Packed fields: written cases, and a round trip through a quoting writer."""

import random

from pyspark.sql import functions as F

from orgweave.operators import packed

CASES = {
    "A, X; B, Y": ["A, X", "B, Y"], "A;; B ; ": ["A", "B"], "A/B Lab, X": ["A/B Lab, X"], "A, X / B, Y // C": ["A, X", "B, Y", "C"], "A | B\nC": ["A", "B", "C"],
    '"U; V, A","B ""N"", Y"': ["U; V, A", 'B "N", Y'], '"U; V, A"; B, Y': ["U; V, A", "B, Y"], '["A, X", "B \\"q\\""]': ["A, X", 'B "q"'], "«S; W, A»; B": ["S; W, A", "B"], "“S; W”; B": ["S; W", "B"],
    "1. A\n2) B": ["A", "B"], "1.A; 2.B, C": ["A", "B, C"], "(1) A, X(2) B": ["A, X", "B"], "(1) A, (2) B": ["A", "B"], "[1] A; [2] B": ["A", "B"], "¹A, X ²B": ["A, X", "B"], "(a) A (b) B": ["A", "B"],
    "· A · B": ["A", "B"], "• A • B": ["A", "B"], "1. A, X": ["A, X"], "A；B": ["A", "B"], "A\tB": ["A", "B"], "": [], "  ": [], ";;": [], '"A; B"': ["A; B"], 'say "A; B': ['say "A', "B"],
}


def split(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.p for r in df.select("i", packed.split_packed(F.col("t")).alias("p")).collect()}


def test_written_cases(spark):
    got = split(spark, list(CASES))
    assert {t: got[i] for i, t in enumerate(CASES)} == CASES


def test_null_long_and_repeated(spark):
    long = "; ".join(f"Dept {i}, Place" for i in range(20000))
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 1), ("c", "p;q", 1), ("c", "p;q", 1), ("d", long, 1)], "k string, t string, pos int")
    rows = packed.explode_packed(df, "k", "t").collect()
    assert sorted((r.k, r.pos, r.part_text) for r in rows if r.k != "d") == [("c", 1, "p"), ("c", 1, "p"), ("c", 2, "q"), ("c", 2, "q")]
    assert [r.pos for r in rows if r.k == "d"] == list(range(1, 20001))
    assert packed.explode_packed(df.limit(0), "k", "t").count() == 0


def test_round_trip_through_csv_quoting(spark):
    r = random.Random(5)
    alphabet = 'ab c;|,"x'
    values, texts = [], []
    for _ in range(200):
        vs = ["v" + "".join(r.choice(alphabet) for _ in range(r.randint(1, 12))).strip() + "e" for _ in range(r.randint(2, 5))]
        values.append(vs)
        texts.append(r.choice([";", " ; ", ",", " | "]).join('"' + v.replace('"', '""') + '"' for v in vs))
    got = split(spark, texts)
    assert [got[i] for i in range(len(texts))] == values
