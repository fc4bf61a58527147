"""Strict readers, manifests, contracts and the streaming label log."""

import hashlib
import json

import pytest

from orgweave.operators import contracts
from orgweave.sources import records
from orgweave.streaming import labels


def rec(i, **k):
    return {"id": i, "status": "active", "names": [], "locations": [], "admin": {"last_modified": {"date": "2024-01-01", "schema_version": "2.1"}}, **k}


def test_dump_reader_is_strict(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps([rec("a"), rec("b")]))
    assert records.read_dump(spark, str(p), 2).count() == 2
    bad = {
        "bom": "﻿" + json.dumps([rec("a")]), "object": json.dumps(rec("a")), "tail": json.dumps([rec("a")]) + " x", "empty": "[]", "twice": json.dumps([rec("a"), rec("a")]), "status": json.dumps([rec("a", status=None)]),
        "schema": json.dumps([rec("a", admin={"last_modified": {"schema_version": "1.0"}})]), "names": json.dumps([rec("a", names=None)]),
    }
    for k, text in bad.items():
        q = tmp_path / f"{k}.json"
        q.write_text(text)
        with pytest.raises(records.DumpError):
            records.read_dump(spark, str(q))
    with pytest.raises(records.DumpError):
        records.read_dump(spark, str(p), 3)


def test_jsonl_and_manifest(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": "x"}\n{bad\n')
    good, bad = records.read_jsonl(spark, str(p), "a int", strict=False)
    assert [r.a for r in good.collect()] == [1] and bad.count() == 2
    d = tmp_path / "m"
    (d / "s").mkdir(parents=True)
    (d / "b.txt").write_text("2")
    (d / "s" / "a.txt").write_text("1")
    (d / "manifest.json").write_text("{}")
    want = {n: hashlib.sha256(v.encode()).hexdigest() for n, v in (("b.txt", "2"), ("s/a.txt", "1"))}
    m = records.manifest(spark, str(d))
    assert {r.file: r.digest for r in m.collect()} == want
    assert records.aggregate_digest(m) == hashlib.sha256("".join(f"{k}:{v}\n" for k, v in sorted(want.items())).encode()).hexdigest()
    with pytest.raises(ValueError):
        records.aggregate_digest(m.limit(0))
    records.write_jsonl(good, str(tmp_path / "out"))
    records.write_csv(good, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().a == "1"


def test_contracts(spark):
    schema = "key string, value double, value_text string, unit string, n bigint, computed_by string, computed_at string, source_snapshot string, scale_exempt_reason string"
    ok = ("a_1", 5.0, None, "percent", 3, "s.py", "2026-01-02T03:04:05+00:00", "abc", None)
    rows = [ok, ("A", *ok[1:]), (*ok[:1], 0.5, *ok[2:]), (*ok[:1], 0.5, *ok[2:8], "tiny"), (*ok[:4], -1, *ok[5:]), (*ok[:6], "2026-13-40", *ok[7:]), (*ok[:1], float("nan"), *ok[2:]), (None,) * 9]
    got = [r.codes for r in contracts.finding_codes(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got[:7] == [[], ["key"], ["scale"], [], ["n"], ["computed_at"], ["finite"]] and {"key", "value", "unit", "n"} <= set(got[7])
    p = spark.createDataFrame([("s", "x", "q", 1, 2, "r", "2026-01-02"), ("", "x", "q", -1, None, "r", "no")], "script string, source_snapshot string, query string, rows_in bigint, rows_out bigint, run_id string, run_at string")
    assert [r.codes for r in contracts.provenance_codes(p.coalesce(1)).collect()] == [[], ["script", "rows_in", "rows_out", "run_at"]]
    drafts = spark.createDataFrame([("d", "We saw {{f.a_1}} | and {{f.zz}}. Then\n\nmore {{f.a_1}}.")], "draft string, text string")
    c = contracts.claims(drafts, spark.createDataFrame([ok], schema)).orderBy("pos", "at").collect()
    assert [(r.key, r.value) for r in c] == [("a_1", 5.0), ("zz", None), ("a_1", 5.0)] and c[0].sentence == "We saw {{f.a_1}} \\| and {{f.zz}}."


def test_stream_equals_batch(spark, tiny, tmp_path):
    src = tmp_path / "labels"
    spark.read.parquet(f"{tiny}/label_event.parquet").repartition(3).write.parquet(str(src))
    q = labels.live_labels(labels.label_stream(spark, str(src), "4000 days")).writeStream.outputMode("complete").format("memory").queryName("live_says").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) is not False
    key = lambda df: sorted((r.item_id, r.annotator, r.label_id, tuple(r.ids), r.live) for r in df.collect())
    assert key(spark.table("live_says")) == key(labels.live_labels(spark.read.parquet(f"{tiny}/label_event.parquet").dropDuplicates(["label_id"])))
