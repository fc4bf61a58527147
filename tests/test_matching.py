"""Scoring rules on rebuilt cases, and the matching size against augmenting paths."""

import random

from pyspark.sql import functions as F

from orgweave.operators import graph, matching, metrics

ORGS = {
    "oxford": "active", "kennedy": "active", "radcliffe": "active", "weston": "inactive", "uhbw": "inactive", "bristol": "active", "sudbury": "inactive", "sciences": "active", "plos_old": "withdrawn", "plos": "active",
    "lasalle": "active", "institute": "active",
}
EDGES = [("oxford", "child", "kennedy"), ("radcliffe", "related", "oxford"), ("weston", "successor", "uhbw"), ("bristol", "predecessor", "uhbw"), ("sudbury", "parent", "sciences"), ("sudbury", "successor", "sciences"), ("plos_old", "successor", "plos"), ("institute", "predecessor", "lasalle")]


def score(spark, decision, gold, assigned):
    org = spark.createDataFrame(list(ORGS.items()), "rid string, status string")
    sym = graph.symmetrise(spark.createDataFrame(EDGES, "src string, rel string, dst string"))
    chain = graph.succession_steps(sym)
    pairs = spark.createDataFrame([("i", "s", a, g) for a in assigned for g in gold], "item_id string, source string, assigned string, gold string")
    rel = matching.pair_relations(pairs, sym, chain, org)
    sides = spark.createDataFrame([("i", "s", decision, sorted(gold), sorted(assigned))], "item_id string, source string, decision string, gold_ids array<string>, assigned_ids array<string>")
    out = {r.rule: (r.outcome, r.tp, r.fp, r.fn) for r in matching.score_sets(sides, rel).collect()}
    return out, {(r.assigned, r.gold): r.relation for r in rel.collect()}


def test_outcomes(spark):
    out, rel = score(spark, "accepted", ["sciences"], ["sudbury"])
    assert rel["sudbury", "sciences"] == "child_of_gold" and set(out.values()) == {("stale", 0, 1, 1)}
    out, rel = score(spark, "accepted", ["bristol"], ["weston"])
    assert rel["weston", "bristol"] == "predecessor_of_gold" and out["exact"][0] == "stale"
    out, _ = score(spark, "accepted", ["oxford"], ["kennedy"])
    assert out["exact"] == ("wrong", 0, 1, 1) and out["parent_child"] == ("correct", 1, 0, 0)
    out, _ = score(spark, "corrected", ["oxford"], ["radcliffe"])
    assert out["parent_child"][0] == "wrong" and out["any_relationship"][0] == "correct"
    out, _ = score(spark, "accepted", ["institute"], ["institute", "lasalle"])
    assert out["exact"] == ("partial", 1, 1, 0)
    out, rel = score(spark, "accepted", ["oxford"], ["nowhere"])
    assert rel["nowhere", "oxford"] == "not_in_dump" and out["any_relationship"][0] == "wrong"
    out, _ = score(spark, "accepted", ["oxford", "plos"], ["oxford"])
    assert out["exact"] == ("collapsed", 1, 0, 1)
    out, _ = score(spark, "accepted", ["oxford"], ["oxford", "kennedy"])
    assert out["parent_child"] == ("over_assigned", 1, 1, 0)
    assert score(spark, "ambiguous", [], ["oxford"])[0]["exact"] == ("gold_ambiguous", None, None, None)
    assert score(spark, "no_ror", [], ["oxford"])[0]["exact"] == ("gold_no_ror", 0, 1, 0)
    assert score(spark, "no_ror", [], [])[0]["exact"] == ("gold_no_ror", None, None, None)
    assert score(spark, "accepted", ["oxford"], [])[0]["exact"] == ("no_assignment", None, None, None)


def _kuhn(partners):
    """Depth-first matching, small inputs only."""
    of = {}

    def place(a, tried):
        for g in partners[a]:
            if g not in tried:
                tried.add(g)
                if g not in of or place(of[g], tried):
                    of[g] = a
                    return True
        return False

    return sum(place(a, set()) for a in range(len(partners)))


def test_matching_size_equals_augmenting_paths(spark):
    r = random.Random(3)
    sides = [[sorted({r.randrange(6) for _ in range(r.randint(0, 3))}) for _ in range(r.randint(0, 14))] for _ in range(150)]
    sides += [[sorted({r.randrange(90) for _ in range(r.randint(0, 3))}) for _ in range(r.randint(0, 120))] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(sides)), "i int, partners array<array<int>>")
    got = {x.i: x.m for x in matching.with_matching(df, "partners", "m").collect()}
    assert got == {i: _kuhn(s) for i, s in enumerate(sides)} == {i: matching._augment(s) for i, s in enumerate(sides)}


def test_more_than_63_gold_ids(spark):
    gold = [f"g{k:03d}" for k in range(70)]
    rows = [(a, g, "exact" if a == g else "none", True, False) for a in gold[:2] + gold[64:66] for g in gold]
    rel = spark.createDataFrame([("i", "s", *r) for r in rows], "item_id string, source string, assigned string, gold string, relation string, active boolean, chained boolean")
    sides = spark.createDataFrame([("i", "s", "corrected", gold, gold[:2] + gold[64:66])], "item_id string, source string, decision string, gold_ids array<string>, assigned_ids array<string>")
    got = {r.rule: (r.outcome, r.tp, r.fp, r.fn) for r in matching.score_sets(sides, rel).collect()}
    assert got["exact"] == ("collapsed", 4, 0, 66)


def test_succession_is_shortest_and_never_reflexive(spark):
    e = spark.createDataFrame([("a", "successor", "b"), ("b", "successor", "a"), ("b", "successor", "c"), ("a", "successor", "c")], "src string, rel string, dst string")
    got = {(r.old, r.new): r.steps for r in graph.succession_steps(graph.symmetrise(e)).collect()}
    assert got == {("a", "b"): 1, ("b", "a"): 1, ("a", "c"): 1, ("b", "c"): 1}


def test_kappa_by_hand(spark):
    rows = [("k", x, y) for x, y in [("a", "a")] * 4 + [("b", "b")] * 3 + [("a", "b")] * 2 + [("b", "a")]] + [("one", "a", "a")] * 3 + [("not", "a", "b")] * 2
    got = {r.g: r.kappa for r in metrics.kappa(spark.createDataFrame(rows, "g string, x string, y string"), "g").collect()}
    assert got == {"k": 0.4, "one": 1.0, "not": 0.0}


def test_active_successors_stop_at_the_first_active(spark):
    org = spark.createDataFrame([("a", "inactive"), ("b", "inactive"), ("c", "active"), ("d", "active")], "rid string, status string")
    e = spark.createDataFrame([("a", "successor", "b"), ("b", "successor", "c"), ("c", "successor", "d"), ("a", "successor", "gone")], "src string, rel string, dst string")
    got = {r.rid: (r.active, r.passed, r.outside) for r in graph.active_successors(graph.symmetrise(e), org).collect()}
    assert got == {"a": ("c", "b", "gone"), "b": ("c", "", "")}


def test_empty_tables(spark):
    sym = graph.symmetrise(spark.createDataFrame([], "src string, rel string, dst string"))
    assert graph.succession_steps(sym).count() == 0 and graph.ancestry(sym).count() == 0
    assert metrics.kappa(spark.createDataFrame([], "g string, x string, y string"), "g").select(F.count("*")).first()[0] == 0
