"""Lineage queries against plain Python."""

import datetime as dt

import __spark_entry__ as entry


def test_audit_trail_has_every_entity(spark, tmp_path):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2)
    rows = [(i, (5, 21, 4000, None)[i % 4], at(i), "view") for i in range(230)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((tuple(x) for x in entry.queries()["l1_audit_trail"](spark, str(tmp_path)).collect()), key=str)
    want = [(i, u, e) for k in (5, 21, 4000, None) for i, u, _, e in sorted((x for x in rows if x[1] == k), key=lambda x: x[2::-2], reverse=True)[:50]]
    assert got == sorted(want, key=str) and len(got) == 200


def test_field_diff_has_every_column(spark, tmp_path):
    rows = [
        (1, 10, "I", 1, "Acme", None, "1", True), (1, 20, "U", 2, "Acme Inc", "9", "1", True), (1, 20, "U", 3, "Acme Inc", "9", "1", True), (1, 30, "U", 4, "Acme Inc", None, "2", False),
        (1, 40, "D", 5, "Acme Inc", None, "2", False), (1, 50, "I", 6, "New", None, "3", True), (2, 15, "I", 7, "Other", None, None, None),
    ]
    spark.createDataFrame(rows, "vendor_id long, change_seq long, op string, captured_at long, display_name string, ein string, phone string, is_active boolean").write.parquet(f"{tmp_path}/staged_vendors.parquet")
    got = entry.queries()["l6_field_diff"](spark, str(tmp_path))
    assert got.columns == ["vendor_id", "change_seq", "field", "before", "after"]
    assert {tuple(x) for x in got.collect()} == {
        (1, 20, "display_name", "Acme", "Acme Inc"), (1, 20, "ein", None, "9"), (1, 30, "ein", "9", None), (1, 30, "phone", "1", "2"), (1, 30, "is_active", "true", "false")
    }
    assert got.count() == 5
