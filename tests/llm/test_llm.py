"""Operators on training data: brute force, exact accounts and held-out accuracy on small fixtures."""

import itertools
import json
import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave.llm import consensus, leakage, lookalike, mixing, queries, quota, readability, variants

LABELS = "label_id bigint, item_id string, annotator string, decision string, ror_ids array<string>, superseded boolean, item string"


# --- consensus ---------------------------------------------------------------------------------


def test_consensus_recovers_truth_and_reliability(spark):
    r = random.Random(1)
    ids = [f"0{c * 6}{n:02d}" for c in "abcdefgh" for n in range(10)]
    acc = {f"ann{k}": a for k, a in enumerate([0.95, 0.9, 0.85, 0.8, 0.75, 0.3, 0.2])}
    truth, rows = {}, []
    for i in range(700):
        truth[f"i{i}"] = t = r.choice(ids)
        for a, p in acc.items():
            if r.random() < 0.8:
                said = t if r.random() < p else r.choice([x for x in ids[:12] if x != t])
                rows.append((len(rows), f"i{i}", a, r.choice(["accepted", "corrected"]), [said.upper()], False, "x"))
    r.shuffle(rows)
    votes, rel = consensus.consensus(spark.createDataFrame(rows, LABELS))
    got = {v.item: v.outcome for v in votes.collect()}
    says = defaultdict(lambda: defaultdict(float))
    for _, i, a, _, (x,), _, _ in rows:
        says[i][x.lower()] += math.log(acc[a] / (1 - acc[a]) * 8)
    informed = np.mean([max(says[i], key=says[i].get) == truth[i] for i in got])
    reached = np.mean([o == "ror:" + truth[i] for i, o in got.items()])
    majority = np.mean([Counter(x.lower() for _, j, _, _, (x,), _, _ in rows if j == i).most_common(1)[0][0] == truth[i] for i in got])
    assert reached >= informed - 0.005 and reached > majority
    est = {x.annotator: x.accuracy for x in rel.collect()}
    assert all(abs(est[a] - p) < 0.08 for a, p in acc.items())


def test_consensus_edge_rows(spark):
    rows = [
        (1, "a", "x", "accepted", ["0aaaaaa11"], False, ""), (1, "a", "x", "accepted", ["0aaaaaa11"], False, ""), (2, "a", "x", "skipped", [], False, ""), (3, "a", "y", "no_ror", ["0aaaaaa11"], False, ""),
        (4, "a", "z", "no_ror", None, False, ""), (5, "a", "w", "no_ror", [], None, ""), (6, "b", "x", "accepted", ["0bbbbbb22", " https://ROR.org/0AAAAAA11 "], False, ""),
        (7, "b", "y", "corrected", ["ror.org/0aaaaaa11", "0bbbbbb22", "0bbbbbb22"], False, ""), (8, "b", "z", "ambiguous", ["0aaaaaa11"], True, ""), (9, None, "x", "no_ror", [], False, ""), (10, "b", "v", None, None, False, ""),
    ]
    says = {(s.item, s.annotator): s.outcome for s in consensus.current_says(spark.createDataFrame(rows, LABELS)).collect()}
    assert says == {("a", "y"): "no_ror", ("a", "z"): "no_ror", ("a", "w"): "no_ror", ("b", "x"): "ror:0aaaaaa11|0bbbbbb22", ("b", "y"): "ror:0aaaaaa11|0bbbbbb22"}
    votes, _ = consensus.consensus(spark.createDataFrame(rows, LABELS))
    assert [(v.item, v.outcome) for v in votes.collect()] == [("a", "no_ror")]
    votes, rel = consensus.consensus(spark.createDataFrame([], LABELS))
    assert votes.count() == 0 and rel.count() == 0


def test_agreement_counts_every_pair(spark):
    r = random.Random(8)
    rows = [(f"i{n}", f"a{k:02d}", r.choice("opqr")) for n in range(2, 40) for k in range(n)]
    got = {(x.a, x.b): (x.n, x.same, round(x.e, 9)) for x in consensus.pair_agreement(spark.createDataFrame(rows, "item string, annotator string, outcome string")).collect()}
    by, own = defaultdict(dict), defaultdict(Counter)
    for i, a, o in rows:
        by[i][a] = o
        own[a][o] += 1
    want = defaultdict(lambda: [0, 0])
    for i in by.values():
        for a, b in itertools.combinations(sorted(i), 2):
            want[a, b][0] += 1
            want[a, b][1] += i[a] == i[b]
    chance = lambda a, b: min(0.99, sum(own[a][o] * own[b][o] for o in own[a]) / own[a].total() / own[b].total())
    assert got == {k: (*v, round(chance(*k), 9)) for k, v in want.items()}


# --- look-alikes -------------------------------------------------------------------------------


def test_lookalike_pairs(spark):
    base = "Café Institute of Optics, Москва и Ко"
    rows = [
        ("k1", base), ("k2", unicodedata.normalize("NFD", base)), ("k3", base.replace(" ", " ")), ("k4", base.replace("Institute", "Inst​itute")), ("k5", base.replace("o", "о")), ("k6", base.replace("Optics", "Ｏｐｔｉｃｓ")),
        ("k7", base.lower()), ("k8", base.replace("é", "e")), ("k9", base + "1"), ("k1", base), (None, base), ("n", None), ("e1", ""), ("e2", "​"), ("d1", "Lab 1"), ("d2", "Lab ¹"), ("d3", "Lab l"), ("c1", "СО"), ("c2", "CO"),
        ("j1", "ガク"), ("j2", "ｶﾞｸ"), ("j3", "ガク"), ("f1", "ofﬁce"), ("f2", "office"),
    ]
    got = {tuple(r) for r in lookalike.lookalike_pairs(spark.createDataFrame([(*x, 0) for x in rows], "id string, txt string, skel int"), "id", "txt").collect()}
    alike = [["k1", "k2", "k3", "k4", "k5", "k6"], ["e1", "e2"], ["c1", "c2"], ["j1", "j2", "j3"], ["f1", "f2"]]
    assert got == {p for g in alike for p in itertools.combinations(sorted(g), 2)}


def test_consistent_form_picks_the_token_script(spark):
    df = spark.createDataFrame([("Universitу of Oxfоrd",), ("Мoсквa",), ("СО in Rome",), ("СО в Риме",), ("CО в Риме",), ("ΟXΕ Αθήνα",), ("ᎪᏴᎬ Lab",), ("Օxford",), ("𝐎𝐱𝐟𝐨𝐫𝐝 Рhysics",), ("Жaba",)], "t string")
    assert [r.form for r in lookalike.normalised(df.coalesce(1), "t").orderBy("t").collect()] == [r for _, r in sorted([("Universitу of Oxfоrd", "University of Oxford"), ("Мoсквa", "Москва"), ("СО in Rome", "CO in Rome"), ("СО в Риме", "СО в Риме"), ("CО в Риме", "СО в Риме"), ("ΟXΕ Αθήνα", "ΟΧΕ Αθήνα"), ("ᎪᏴᎬ Lab", "ABE Lab"), ("Օxford", "Oxford"), ("𝐎𝐱𝐟𝐨𝐫𝐝 Рhysics", "Oxford Physics"), ("Жaba", "Жaba")])]


# --- quotas ------------------------------------------------------------------------------------


def test_flow_meets_targets_and_reports_slack():
    cells = [quota.Cell("a", "", 5, 1, 0.5), quota.Cell("b", "x", 4, 2, 0.3), quota.Cell("b", "", 6, 0, 0.2)]
    out = quota.cell_quotas(cells, {("a", ""): 3, ("b", "x"): 9, ("b", ""): 0, ("zz", ""): 50})
    assert [(q["shortfall"], sum(q["draws"].values())) for q in out] == [(2, 3), (0, 4), (0, 2)]
    out = quota.cell_quotas(cells[:2], {("a", ""): 30, ("b", "x"): 30}, total=8)
    assert [sum(q["draws"].values()) for q in out] == [5, 3]


def _best(cells, available, beyond):
    """Least cost over all draws, by trying every one; margins apart from cells."""
    unit = sorted(available)
    least = None
    for draw in itertools.product(*[range(available[u] + 1) for u in unit]):
        got, cost = dict(zip(unit, draw)), 0
        for c in cells:
            mine = sum(n for (st, sub), n in got.items() if (not c.stratum or st == c.stratum) and (not c.sub or sub == c.sub))
            lo = min(c.floor, c.target)
            cost += quota.FLOOR * max(0, lo - mine) + quota.TARGET * max(0, c.target - max(mine, lo)) + beyond * max(0, mine - c.target)
        least = cost if least is None else min(least, cost)
    return least


def _cost(cells, out, beyond):
    drawn = Counter()
    for q in out:
        drawn.update(q["draws"])
    total = 0
    for c, q in zip(cells, out):
        mine = sum(n for (st, sub), n in drawn.items() if (not c.stratum or st == c.stratum) and (not c.sub or sub == c.sub))
        assert q["shortfall"] == max(0, c.target - mine)
        lo = min(c.floor, c.target)
        total += quota.FLOOR * max(0, lo - mine) + quota.TARGET * max(0, c.target - max(mine, lo)) + beyond * max(0, mine - c.target)
    return total


def test_flow_is_optimal_where_margins_compete():
    # Stratum a may give six rows, its cell x asks for five of them and sub-stratum y for four.
    cells = [quota.Cell("", "y", 4, 3, 0), quota.Cell("a", "", 6, 0, 0), quota.Cell("a", "x", 5, 2, 0), quota.Cell("b", "y", 1, 1, 0)]
    available = {("a", "x"): 5, ("a", "y"): 4, ("b", "y"): 2}
    out = quota.cell_quotas(cells, available)
    assert _cost(cells, out, quota.BEYOND) == _best(cells, available, quota.BEYOND)
    r = random.Random(2)
    for _ in range(60):
        available = {(s, u): r.randint(0, 4) for s in "ab" for u in "xy"}
        picks = [("a", "x"), ("b", "y"), ("a", ""), ("b", ""), ("", "x"), ("", "y")]
        cells = [quota.Cell(s, u, t, r.randint(0, t), 0) for s, u in sorted(r.sample(picks, r.randint(1, 5))) for t in [r.randint(0, 6)]]
        if any((s, u) in available and not any(c.stratum == s or c.sub == u and not c.stratum for c in cells) for s, u in available):
            continue
        got = quota.cell_quotas(cells, available)
        assert _cost(cells, got, quota.BEYOND) == _best(cells, available, quota.BEYOND), (cells, available)


def test_an_item_under_two_strata_is_drawn_once(spark):
    df = spark.createDataFrame([("i", "a", None, False), ("i", "b", None, False), ("j", "b", None, False)], "item_id string, stratum string, sub_stratum string, demo boolean")
    t = spark.createDataFrame([("a", None, 0.5, 5, 1), ("b", None, 0.5, 5, 1)], "stratum string, sub_stratum string, target_share double, target_rows bigint, min_rows bigint")
    assert sorted(tuple(r)[:2] for r in quota.quota_sample(df, t)[0].collect()) == [("i", "a"), ("j", "b")]


def test_sample_is_exact_and_report_counts_distinct_usable_items(spark):
    items = [(f"i{n}", " Big-One " if n % 2 else "BIG_ONE", None, False, 0) for n in range(3000)] + [("i1", "big one", None, False, 0)] + [("d", "big_one", None, True, 0), (None, "big_one", None, False, 0), ("s1", "small", "Sub A", None, 0), ("s2", None, None, False, 0)]
    df = spark.createDataFrame(items, "item_id string, stratum string, sub_stratum string, demo boolean, h int").select("item_id", "stratum", "sub_stratum", "demo")
    t = spark.createDataFrame([("big_one", None, 0.5, 1234, 1), ("small", "sub_a", 0.2, 3, 1)], "stratum string, sub_stratum string, target_share double, target_rows bigint, min_rows bigint")
    sample, report = quota.quota_sample(df, t, seed=7)
    got = [tuple(r) for r in sample.collect()]
    assert len(got) == len(set(got)) == 1235 and Counter(g[1] for g in got) == {"big_one": 1234, "small": 1}
    assert [(r["written"], r["shortfall"]) for r in quota.shortfalls(df, t)] == [(("small", "sub_a"), 2)]
    assert {tuple(r) for r in quota.quota_sample(df, t, seed=7)[0].collect()} == set(got)
    assert quota.quota_sample(df.limit(0), t)[0].count() == 0 and quota.shortfalls(df, t.limit(0)) == []


# --- variants ----------------------------------------------------------------------------------


def _records(spark):
    n = lambda v, t="label": (v, [t], None)
    rows = [
        ("https://ror.org/0aaaaaa11", [n("Kretuvehe University", "ror_display"), n("UKRE", "acronym"), n("Kretu Tech")], "Kretuvehe", "GB"), ("https://ror.org/0bbbbbb22", [n("Royal Society of Kretuvehe", "ror_display"), n("The Kretuvehe Society")], "Kretuvehe", "GB"),
        ("https://ror.org/0cccccc33", [n("National Laboratory of Physics Zudromaja", "ror_display"), n("UKRE", "acronym")], "Zudromaja", "JP"), ("https://ror.org/0dddddd44", [n("Institute of Neurology, Fabrihihu", "ror_display"), n("法大学")], "Fabrihihu", "CN"),
        ("https://ror.org/0eeeeee55", [n("Newman College", "ror_display")], "Newman", "US"), ("https://ror.org/0ffffff66", [n("Newman College", "ror_display")], "Newman", "GB"), ("bad", [n("Other")], None, None),
    ]
    return spark.createDataFrame([(i, v, [(None, (c, k))]) for i, v, c, k in rows], "id string, names array<struct<value string, types array<string>, lang string>>, locations array<struct<geonames_id bigint, geonames_details struct<name string, country_code string>>>")


TYPED = {
    "Kretuvehe University, 12 Road, UK": {"0aaaaaa11"}, "Dept. of X, Univ. of Kretuvehe": {"0aaaaaa11"}, "University Kretuevhe": {"0aaaaaa11"}, "Kretuwehe (Royal Society), Kretuvehe": {"0bbbbbb22"}, "Natl. Lab. of Physics Zudromadzha, Japan": {"0cccccc33"},
    "National Laborratory of Physics Zudromaja; KRETUVEHE UNIVERSITY": {"0cccccc33", "0aaaaaa11"}, "Inst. of Neurology, Fabrihihu": {"0dddddd44"}, "法大学, 12": {"0dddddd44"}, "Newman College": set(), "Newman College, USA": {"0eeeeee55"}, "UKRE": set(),
    "UKRE, Zudromaja": {"0cccccc33"}, "Kretuvehe Garage Startup": set(), "Department of Neurology, Fabrihihu": set(), "": set(), "12345": set(),
}


def test_variants_link_to_the_record_meant(spark):
    names = variants.recorded_names(_records(spark))
    items = [(f"i{k}", t, "x") for k, t in enumerate(TYPED)] + [("i0", list(TYPED)[0], "x"), ("null", None, "x"), (None, "Kretuvehe University", "x")]
    got = defaultdict(set)
    rows = variants.link_items(spark.createDataFrame(items, "item_id string, raw_affiliation string, ror_id string"), names).collect()
    assert len(rows) == len(set(map(tuple, rows)))
    for r in rows:
        got[r.item_id].add(r.ror_id)
    assert {t: got[f"i{k}"] for k, t in enumerate(TYPED)} == TYPED


def test_assignment_is_optimal():
    r = random.Random(2)
    vocabulary = ["institute", "inst", "instruments", "in", "national", "natl", "nat", "laboratory", "lab", "labor", "state", "st", "survey"]
    for _ in range(200):
        name, typed = r.sample(vocabulary, r.randint(1, 4)), r.sample(vocabulary, r.randint(1, 4))
        want = max(sum(variants.similarity(t, w) for w, t in zip(name, p) if t) for p in itertools.permutations([*typed, *[""] * len(name)], len(name)) if True) if all(typed) else 0
        assert variants.assign(name, typed)[0] == pytest.approx(want)


def test_symmetric_deletes_reach_every_single_edit(spark):
    r = random.Random(4)
    keys = ["".join(r.choice("abcdefgh") for _ in range(r.randint(5, 9))) for _ in range(60)]
    typed = [k[:i] + r.choice(["", "x" + k[i], "x"]) + k[i + 1 :] for k in keys for i in [r.randrange(1, len(k))]] + [k[:2] + k[3] + k[2] + k[4:] for k in keys]
    typed = sorted({t for t in typed if len(t) > 3} - set(keys))
    got = {tuple(x) for x in variants.token_links(spark.createDataFrame([(t,) for t in typed], "token string"), spark.createDataFrame([(k,) for k in set(keys)], "key string")).collect()}
    assert {(t, k) for t in typed for k in set(keys) if variants.distance(t, k) <= 1} <= got


# --- leakage -----------------------------------------------------------------------------------


def test_leaks_are_found_under_alteration(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    pool = [word() for _ in range(1500)]
    prompt = "Read the passage below and name every body in it."
    passages = {i: " ".join(r.choice(pool) for _ in range(40)).capitalize() + "." for i in range(1, 21)}
    evals = [(i, (prompt + " " if i % 2 else "") + p) for i, p in passages.items()] + [(99, None), (98, ""), (1, prompt + " " + passages[1])]
    noise = lambda n: " ".join(r.choice(pool[:40]) if r.random() < 0.1 else word() for _ in range(n)) + ". "

    def altered(p, kind):
        ws = p.split()
        if kind == "subst":
            ws = [w if k % 6 else word() for k, w in enumerate(ws, 1)]
        if kind == "drop":
            ws = [w for k, w in enumerate(ws, 1) if k % 9]
        s = " ".join(ws)
        return {"upper": s.upper(), "html": "<p>" + s.replace(" ", "&nbsp;") + "</p>", "zero": s.replace("a", "a​"), "cyr": s.replace("a", "а").replace("o", "о"), "quote": "> " + s.replace(". ", "\n> ")}.get(kind, s)

    docs, want = [(0, None), (-1, ""), (-2, noise(50) + prompt), (-3, noise(20) + " ".join(passages[2].split()[:6]) + " " + noise(20))], set()
    for k, (i, kind) in enumerate(itertools.product(passages, ["plain", "subst", "drop", "upper", "html", "zero", "cyr", "quote"]), 1):
        ws = passages[i].split()
        part = " ".join(ws[5:25]) if kind == "plain" else passages[i]
        docs.append((k, noise(r.randint(0, 60)) + altered(part, kind) + " " + noise(r.randint(0, 60))))
        want.add((k, i))
    docs.append((10_000, noise(30_000) + passages[3] + noise(30)))
    want.add((10_000, 3))
    d = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string")
    e = spark.createDataFrame(evals, "eval_id bigint, text string")
    got = {(x.doc_id, x.eval_id) for x in leakage.find_leaks(d, e).collect()}
    assert got == want
    assert {(x.doc_id, x.eval_id) for x in leakage.find_leaks(d, e, broadcast_bound=0).collect()} == want
    assert leakage.find_leaks(d.limit(0), e).count() == 0


def test_items_that_share_a_passage_leak_together_at_any_size(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    common, own = [word() for _ in range(26)], [[word() for _ in range(4)] for _ in range(2)]
    e = spark.createDataFrame([(k + 1, " ".join(common + own[k]) + ".") for k in (0, 1)] + [(3, " ".join(word() for _ in range(30)))], "eval_id bigint, text string")
    d = spark.createDataFrame([(1, " ".join(common + own[0])), (2, " ".join(word() for _ in range(60)))], "doc_id bigint, text string")
    for bound in (2_000_000, 0):
        assert sorted((x.doc_id, x.eval_id, x.matched) for x in leakage.find_leaks(d, e, broadcast_bound=bound).collect()) == [(1, 1, 30), (1, 2, 26)]


def test_levels_do_not_depend_on_how_the_foreign_side_travels(spark):
    d = "/root/testdata/sf0.001"
    docs, labels, evals = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "level_label", "eval_item"))
    got = [sorted((r.doc_id, r.reading_level) for r in readability.reading_levels(docs, labels, evals, broadcast_bound=b).collect()) for b in (2_000_000, 0)]
    assert got[0] and got[0] == got[1]


def test_every_word_has_a_rarity(spark):
    docs = spark.createDataFrame([("alpha " * 50 + "beta " * 5 + " ".join(f"w{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}" for k in range(1000)),)], "text string")
    rare = readability.word_rarity(docs)
    assert rare("alpha") == pytest.approx(math.log(1055 / 50)) and rare("beta") == pytest.approx(math.log(1055 / 5)) and rare("unheardof") == 12.0
    assert np.mean([rare(f"w{a}{b}c") == pytest.approx(math.log(1055)) for a in "abcdefghij" for b in "abcdefghij"]) > 0.97


# --- mixing ------------------------------------------------------------------------------------


def test_mix_follows_targets_within_caps(spark):
    r = random.Random(3)
    docs, sizes = [], {"a": 600, "b": 200, "c": 20, "Other": 50}
    for s, n in sizes.items():
        for _ in range(n):
            docs.append((len(docs), r.choice([s, s.upper(), f" {s} "]), "word " * r.randint(1, 60), 0))
    docs += [(len(docs), None, "x", 0), (len(docs) + 1, "a", None, 0), (len(docs) + 2, "a", "", 0), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, tokens int")
    w = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.2, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(d, w)
    rows = [x.asDict() for x in used.collect()]
    assert len({x["doc_id"] for x in rows}) == len(rows) and {x["source"] for x in rows} == {"a", "b", "c"}
    caps = {"a": 2, "b": 4, "c": 3}
    assert all(1 <= x["copies"] <= caps[x["source"]] for x in rows)
    rep = {x.source: x for x in report.collect()}
    assert rep["c"].tilt == math.inf and rep["c"].mix_tokens == 3 * rep["c"].source_tokens and rep["none"].mix_tokens == 0
    assert rep["a"].mix_tokens / rep["b"].mix_tokens == pytest.approx(5 / 3, rel=0.03)
    got = Counter()
    for x in rows:
        got[x["source"]] += x["tokens"] * x["copies"]
    assert {s: rep[s].mix_tokens for s in caps} == dict(got)
    assert {tuple(x) for x in mixing.mix(d, w)[0].collect()} == {tuple(x) for x in used.collect()}
    assert mixing.mix(d.limit(0), w)[0].count() == 0


@pytest.mark.parametrize(("total", "most"), [(1000.0, 9), (90.0, 9), (700.0, 2), (799.0, 2), (800.0, 2), (5000.0, 2)])
def test_newton_solves_the_dual(spark, total, most):
    rows = [(i, "s", 1 + i % 7) for i in range(100)]
    have = sum(t for _, _, t in rows)
    dual = mixing.balance(mixing.lengths(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")), [mixing.Goal("s", 1.0, most)], total=total)
    lam, m, cap = dual["s"]
    rates = {t: min(cap, math.exp(min(50, lam * t / m))) for t in range(1, 8)}
    assert sum(rates[t] * t for _, _, t in rows) == pytest.approx(min(total, most * have), rel=1e-6)
    if most * have > total:
        assert abs(lam) > 1e-3 and len(set(rates.values())) > 1  # the tilt tells documents of one source apart
        # Least entropy: no shift between two lengths that keeps the tokens is better.
        entropy = lambda r: sum(r[t] * math.log(r[t]) - r[t] for _, _, t in rows)
        of = Counter(t for _, _, t in rows)
        for a, b in itertools.permutations(range(1, 8), 2):
            moved = dict(rates)
            moved[a] += 1e-4 / of[a] / a
            moved[b] -= 1e-4 / of[b] / b
            if moved[a] <= cap and moved[b] > 0:
                assert entropy(moved) >= entropy(rates) - 1e-9


def test_sources_of_the_test_tables_reach_their_targets(spark):
    d = "/root/testdata/sf0.01"
    _, report = mixing.mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/source_weight.parquet"))
    rows = [r.asDict() for r in report.collect()]
    live = {r["source"]: r for r in rows if r["source_tokens"]}
    total = sum(r["source_tokens"] for r in live.values())
    aim = mixing.targets({s: r["source_tokens"] for s, r in live.items()}, [mixing.Goal(r["source"], r["target_share"], r["max_repeats"]) for r in rows], None)
    assert sum(aim.values()) == pytest.approx(total, rel=1e-9) or all(aim[s] == r["max_repeats"] * r["source_tokens"] for s, r in live.items())
    for s, r in live.items():
        assert r["most_copies"] <= r["max_repeats"] and abs(r["mix_tokens"] - aim[s]) <= 0.01 * aim[s] + 2_000


# --- reading level -----------------------------------------------------------------------------


def test_ordinal_model_on_held_out_rows():
    g = np.random.default_rng(0)
    x = g.normal(size=(1500, 6))
    z = x @ np.array([2.0, -1.5, 0.7, 0, 0, 0]) + g.logistic(size=1500) * 0.4
    y = np.digitize(z, [-3, -1, 1, 3]) + 1
    m = readability.fit(x[:1000], y[:1000])
    assert (m.level(x[1000:]) == y[1000:]).mean() > 0.72 and (abs(m.level(x[1000:]) - y[1000:]) <= 1).mean() > 0.98


def test_which_documents_are_english_prose():
    cases = {
        "This is the map of a town. You should ask the clerk about it before the spring.": True, "# Title\n\n- The staff did not see the old record.\n- They can fix the list by noon.": True, "1 | Univ. A | CA\n2 | Inst. B | US\n3 | Lab. C | GB": False,
        "Die Anschrift der Klinik fehlt im Verzeichnis. Bitte die Kennung vor der Meldung prüfen.": False, "La universidad usa dos grafías. Falta la dirección del hospital en el listado.": False, "移転の後に名称が変わった。": False, "n/a": False, "see above": False,
        "Inextricable: heterogeneity, correspondence. Hence multidimensional underspecification, ergo collaboration and documentation.": True, "- Oxford\n- Bristol\n- Leeds University\n- The Clinic": False,
    }
    assert {t: readability.is_english_prose(readability.text_units(t)) for t in cases} == cases


def test_levels_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/level_label.parquet")
    seen = labels.where("doc_id % 4 <> 0")
    got = {r.doc_id: r.reading_level for r in readability.reading_levels(docs, seen, spark.read.parquet(f"{d}/eval_item.parquet")).collect()}
    held = [(r.doc_id, r.reading_level) for r in labels.where("doc_id % 4 = 0").collect()]
    assert all(i in got for i, _ in held)
    assert np.mean([abs(got[i] - y) <= 1 for i, y in held]) > 0.93 and np.mean([got[i] == y for i, y in held]) > 0.55
    empty = spark.createDataFrame([], labels.schema)
    assert readability.reading_levels(docs, empty).count() == 0 and readability.reading_levels(docs.limit(0), labels).count() == 0


# --- queries -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_and_repeat_no_row(spark, tiny, name):
    df = queries.queries()[name](spark, tiny)
    rows = [json.dumps(r.asDict(), default=str, sort_keys=True) for r in df.collect()]
    assert len(rows) == len(set(rows))


def test_shortfall_query_equals_plain_counts(spark, tiny):
    norm = lambda s: "_".join((s or "").strip().lower().replace("-", " ").replace("_", " ").split())
    have = defaultdict(set)
    for r in spark.read.parquet(f"{tiny}/item.parquet").where(F.col("stratum").isNotNull()).collect():
        if not r.demo:
            have[norm(r.stratum), ""].add(r.item_id)
            have[norm(r.stratum), norm(r.sub_stratum)].add(r.item_id)
    want = {(t.stratum, t.sub_stratum or "", t.target_rows - n) for t in spark.read.parquet(f"{tiny}/strata_target.parquet").collect() if (n := len(have[norm(t.stratum), norm(t.sub_stratum)])) < t.target_rows}
    assert {tuple(r) for r in queries.p5_found(spark, tiny).collect()} == want
