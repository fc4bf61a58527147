"""Hierarchies against a walk per node."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orgweave.operators import hierarchy


def brute(links):
    up = {}
    for c, u in links:
        if c is not None and u is not None:
            up[c] = min(up.get(c, u), u)
    out = set()
    for x in set(up) | set(up.values()):
        way, seen = [x], {x}
        while way[-1] in up and up[way[-1]] not in seen:
            way.append(up[way[-1]])
            seen.add(way[-1])
        if way[-1] not in up:
            out.add((x, "tree", way[-1], len(way) - 1, "/".join(reversed(way))))
            continue
        ring, y = [], up[way[-1]]
        while y not in ring:
            ring.append(y)
            y = up[y]
        if x in ring:
            out.add((x, "ring", min(ring), 0, x))
        else:
            tail = way[: next(i for i, w in enumerate(way) if w in ring) + 1]
            out.add((x, "below_ring", min(ring), len(tail) - 1, "/".join(reversed(tail))))
    return out


def run(spark, links):
    df = spark.createDataFrame([(c, u, "x") for c, u in links], "child string, up string, path string")
    got = [tuple(r) for r in hierarchy.trees_and_rings(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_fixed_cases(spark):
    cases = [
        [], [(None, "a"), ("a", None)], [("a", "a")], [("a", "a"), ("b", "a"), ("c", "b")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d")],
        [(f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, 40)], [("x", "hub")] * 3 + [(f"k{i}", "hub") for i in range(50)],
    ]
    for links in cases:
        assert run(spark, links) == brute(links)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_functions(spark, seed):
    r = random.Random(seed)
    n = r.randint(1, 25)
    links = [(f"v{i}", f"v{r.randrange(n)}") for i in range(n) if r.random() < 0.9]
    assert run(spark, links) == brute(links)


def test_descendants_and_cycles(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "child string, up string")
    pos = hierarchy.trees_and_rings(df)
    assert {tuple(r) for r in hierarchy.ancestor_pairs(pos).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("x", "z", 1)}
    assert [tuple(r) for r in hierarchy.cycle_report(pos).collect()] == [("x", 2, 1)]
    assert {r.node: r.descendants for r in hierarchy.descendant_counts(pos).collect()} == {"a": 2, "b": 1, "c": 0, "x": 1, "y": 0, "z": 0}


def test_a_child_with_several_parents_keeps_one_and_reports_the_rest(spark):
    links = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "b"), ("d", "c"), ("e", None)], "child string, up string")
    assert {(r.node, r.path) for r in hierarchy.trees_and_rings(links).collect()} == {("a", "a"), ("b", "b"), ("c", "a/c"), ("d", "a/c/d")}
    assert [tuple(r) for r in hierarchy.further_links(links).collect()] == [("c", "b")]
