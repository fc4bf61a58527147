"""Nested records against a plain recursive walk."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orgweave.operators import nested
from orgweave.plans import general


def leaves(doc, sid):
    out = set()
    while isinstance(doc, (dict, list)) and not (isinstance(doc, dict) and "items" in doc):
        if isinstance(doc, list):
            doc = doc[0] if doc else None
        else:
            doc = doc.get("response") or doc.get("data")
    if not isinstance(doc, dict):
        return out
    as_list = lambda v: v if isinstance(v, list) else [] if v is None else [v]
    for i, item in enumerate(as_list(doc.get("items"))):
        o = (item or {}).get("organization")
        if isinstance(o, str):
            try:
                o = json.loads(o)
            except ValueError:
                o = None
        for j, n in enumerate(as_list((o or {}).get("names"))):
            if n and n.get("value") is not None:
                out.add((sid, i, "name", j, 0, n["value"]))
        for j, n in enumerate(as_list((o or {}).get("external_ids"))):
            for k, v in enumerate(as_list((n or {}).get("all"))):
                if v is not None:
                    out.add((sid, i, "external_id", j, k, v))
        for j, n in enumerate(as_list((o or {}).get("locations"))):
            if n and n.get("geonames_id") is not None:
                out.add((sid, i, "geonames_id", j, 0, str(n["geonames_id"])))
    return out


def test_found_equals_recursive_walk(spark, tiny):
    want = set()
    for r in spark.read.parquet(f"{tiny}/raw_response.parquet").collect():
        try:
            want |= leaves(json.loads((r.payload or "").lstrip("﻿")), r.response_id)
        except ValueError:
            pass
    for r in spark.read.parquet(f"{tiny}/matcher_response.parquet").collect():
        want |= leaves({"items": [i.asDict(True) if i else None for i in r["items"] or []]}, r.response_id)
    got = [tuple(r) for r in general.p1_found(spark, tiny).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_shapes_nulls_and_unreadable(spark):
    good = {"items": [None, {"organization": {"names": {"value": "A"}, "external_ids": [None, {"all": "x"}, {"all": [None, "y"]}], "locations": {"geonames_id": "7"}}}]}
    rows = [
        (1, json.dumps(good)), (1, json.dumps(good, indent=1)), (2, "﻿" + json.dumps({"data": good})), (3, json.dumps([good])), (4, None), (5, ""), (6, "{"), (7, "[]"), (8, "null"),
        (9, json.dumps({"items": [{"organization": json.dumps(good["items"][1]["organization"])}]})), (10, "[" * 5000), (None, json.dumps(good)),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "response_id bigint, payload string, path int")
    t = nested.triples_from_json(df, "response_id", "payload", lists=general._LISTS, embedded=(general._ORG,), envelopes=("response", "data"), keep=tuple(general.LEAVES.values()))
    got = {(r.record_id, r.path.rpartition(".")[2], tuple(r.ordinals), r.value) for r in t.collect()}
    for i, at in ((1, 1), (2, 1), (3, 1), (9, 0)):
        assert {(i, "value", (at, 0), "A"), (i, "all[]", (at, 1, 0), "x"), (i, "all[]", (at, 2, 1), "y"), (i, "geonames_id", (at, 0), "7")} <= got
    assert {r[0] for r in got} == {1, 2, 3, 9, None}


def test_struct_and_json_agree_and_tables_link(spark):
    schema = "id bigint, items array<struct<organization struct<names array<struct<value string, types array<string>>>>>>"
    data = [(1, [None, ([("n1", ["a", None, "b"]), None, (None, [])],)]), (2, None), (3, [])]
    data = [(i, v if v is None else [x if x is None else (x,) for x in v]) for i, v in data]
    df = spark.createDataFrame(data, schema)
    a = nested.triples_from_struct(df, "id", "items", root="items")
    b = nested.triples_from_json(df.select("id", F.to_json(F.struct("items"), {"ignoreNullFields": "false"}).alias("j")), "id", "j")
    key = lambda t: sorted((r.record_id, r.path, tuple(r.ordinals), r.value) for r in t.collect())
    assert key(a) == key(b)
    tables = nested.shred_tables(a, ["items[].organization.names[].value", "items[].organization.names[].types[]"])
    names, types = tables["items[].organization.names[]"], tables["items[].organization.names[].types[]"]
    assert [tuple(r.ordinals) for r in names.collect()] == [(1, 0)]
    assert {(tuple(r.parent_ordinals), r.types) for r in types.collect()} == {((1, 0), "a"), ((1, 0), "b")}


def test_every_member_of_a_wrapping_list_counts(spark):
    texts = {1: '{"data": [{"x": {"a": 1}}, {"x": {"a": 2}}]}', 2: '[{"x": {"a": 1}}, null, 3, {"x": {"a": 2}}]', 3: '{"x": {"a": 9}, "data": {"response": [{"x": {"a": 1}}, {"x": {"a": 2}}]}, "y": 1}'}
    df = spark.createDataFrame(list(texts.items()), "id bigint, payload string")
    t = nested.triples_from_json(df, "id", "payload", envelopes=("response", "data"))
    assert sorted((r.record_id, r.member, r.path, r.value) for r in t.collect()) == [(i, m, "x.a", str(m + 1)) for i in texts for m in (0, 1)]
    assert {(r.record_id, r.member, r.a) for r in nested.pivot_group(t, "", ["x.a"]).select("record_id", "member", F.col("x_a").alias("a")).collect()} == {(i, m, str(m + 1)) for i in texts for m in (0, 1)}


@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.floats(allow_nan=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20), st.sampled_from([None, 1]))
@settings(max_examples=150, deadline=None)
def test_events_rebuild_the_document(doc, indent):
    text = json.dumps(doc, indent=indent)
    assert _built(text) == json.loads(text)


def _built(text):
    root, stack, keys = [], [], []
    for kind, value in nested.events(text):
        if kind == nested._KEY:
            keys[-1] = value
        elif kind == nested._CLOSE:
            stack.pop(), keys.pop()
        else:
            new = {} if value == "{" else [] if kind == nested._OPEN else value
            if not stack:
                root.append(new)
            elif isinstance(stack[-1], list):
                stack[-1].append(new)
            else:
                stack[-1][keys[-1]] = new
            if kind == nested._OPEN:
                stack.append(new), keys.append(None)
    return root[0]


def test_events_refuse_what_json_refuses():
    for text in ("", "{", "[1,]", '{"a":1,}', "[1 2]", '{"a" 1}', "{a:1}", "[1]]", '"a', "tru", "01", "-", '{"a":}', "[,1]", "1 1", '["a\n"]'):
        for parse in (json.loads, _built):
            try:
                parse(text)
            except ValueError:
                continue
            raise AssertionError((parse, text))


def test_empty_input(spark):
    df = spark.createDataFrame([], "response_id bigint, payload string")
    assert nested.triples_from_json(df, "response_id", "payload").count() == 0
