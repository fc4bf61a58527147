"""The keyed upsert takes all of the new table."""

from orgweave.operators import labels
from orgweave.plans import catalog
from orgweave.session import table


def test_every_customer_is_a_new_row(spark, tiny):
    new = {r.c_custkey for r in table(spark, tiny, "customer").select("c_custkey").collect()}
    old = [r.o_custkey for r in table(spark, tiny, "orders").select("o_custkey").collect()]
    want = {**{k: old.count(k) for k in set(old)}, **dict.fromkeys(new, 0)}
    got = catalog.queries()["keyed_upsert"](spark, tiny).collect()
    assert len(got) == len(want) and {r.key: r.n for r in got} == want


def test_new_rows_replace_and_others_stay(spark):
    old, new = spark.createDataFrame([(1, 5), (2, 6)], "key int, n int"), spark.createDataFrame([(2, 0), (3, 0)], "key int, n int")
    assert sorted(map(tuple, labels.keyed_upsert(old, new, "key").collect())) == [(1, 5), (2, 0), (3, 0)]
