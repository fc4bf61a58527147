"""Annotator pairs of the label log, and kappa of each pair, against a plain recount."""

from collections import Counter, defaultdict
from itertools import combinations

from orgweave.operators import labels, metrics
from orgweave.plans import catalog
from orgweave.plans import views as V


def _recount(spark, tiny):
    stratum = dict(map(tuple, V.strata(spark, tiny).collect()))
    says = defaultdict(dict)
    for r in V.live_labels(spark, tiny).collect():
        says[r.item_id][r.annotator] = r.decision if r.decision in ("ambiguous", "no_ror") else "ror:" + "|".join(sorted(r.ids))
    return stratum, [(i, a, b, o[a], o[b]) for i, o in says.items() for a, b in combinations(sorted(o), 2)]


def test_every_pair_of_an_item(spark):
    rows = [("i", "u", 3, "accepted", ["b", "a"]), ("i", "v", 1, "no_ror", []), ("i", "w", 2, "corrected", ["a", "b"]), ("j", "u", 4, "ambiguous", []), ("k", "w", 5, "no_ror", []), ("k", "u", 6, "no_ror", [])]
    live = spark.createDataFrame(rows, "item_id string, annotator string, label_id bigint, decision string, ids array<string>")
    got = sorted(map(tuple, labels.annotator_pairs(live).collect()))
    assert got == [("i", "u", "v", "ror:a|b", "no_ror"), ("i", "u", "w", "ror:a|b", "ror:a|b"), ("i", "v", "w", "no_ror", "ror:a|b"), ("k", "u", "w", "no_ror", "no_ror")]
    assert {(r.a, r.b): (r.n, r.same) for r in metrics.kappa(labels.annotator_pairs(live), "a", "b").collect()} == {("u", "v"): (1, 0), ("u", "w"): (2, 2), ("v", "w"): (1, 0)}


def test_pairs_and_kappa_equal_a_recount(spark, tiny):
    stratum, pairs = _recount(spark, tiny)
    assert sorted(map(tuple, catalog.queries()["iaa_pairs"](spark, tiny).collect())) == sorted(pairs)
    by = defaultdict(list)
    for i, a, b, x, y in pairs:
        if i in stratum:
            by[a, b, stratum[i]].append((x, y))
    want = {}
    for k, rows in by.items():
        n, same, cx, cy = len(rows), sum(x == y for x, y in rows), Counter(x for x, _ in rows), Counter(y for _, y in rows)
        met = sum(cx[c] * cy[c] for c in cx)
        want[k] = (n, same, float(same == n) if met == n * n else round((same / n - met / n**2) / (1 - met / n**2), 5))
    got = {(r.a, r.b, r.stratum): (r.n, r.same, r.kappa) for r in catalog.queries()["kappa"](spark, tiny).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-4 for k in want)
