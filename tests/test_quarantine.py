"""Ingest of CSV files with bad records."""

from datetime import date
from decimal import Decimal

from haulage.sources import schemas
from haulage.sources.quarantine import ingest, ingest_folder


def _write(path, lines, encoding="utf-8"):
    path.write_bytes(("\r\n".join(lines) + "\r\n").encode(encoding))


def test_bad_records_are_set_aside(spark, tmp_path):
    _write(tmp_path / "caps.csv", ["﻿Plant ID,Daily Capacity ", "P1,5", "P2, 6 ", "P3,many", "P4", "P5,7,8", ",", "P6,", "P7,2.5",
                                   "P8,99999999999", "P3,many", "P1,5"])
    out = ingest(spark, str(tmp_path / "caps.csv"), "wh_capacities")
    assert out.accepted.schema.simpleString() == schemas.WH_CAPACITIES.simpleString()
    assert sorted(map(tuple, out.accepted.collect()), key=repr) == [("P1", 5), ("P1", 5), ("P2", 6), ("P6", None), (None, None)]
    rejects = [(r.rule, r.column_name, r.value, r.record) for r in out.rejects.collect()]
    assert sorted(rejects, key=repr) == sorted([
        ("field_count", None, None, "P4"), ("field_count", None, None, "P5,7,8"),
        *[("unreadable_value", "daily_capacity", "many", "P3,many")] * 2,
        ("unreadable_value", "daily_capacity", "2.5", "P7,2.5"), ("unreadable_value", "daily_capacity", "99999999999", "P8,99999999999")], key=repr)
    assert {r.source_file.rsplit("/", 1)[1] for r in out.rejects.collect()} == {"caps.csv"}
    assert {r.table_name for r in out.rejects.collect()} == {"wh_capacities"}


def order(**values):
    return ",".join(str(values.get(f.name, "")) for f in schemas.ORDER_LIST.fields)


def test_dates_and_several_faults_in_a_record(spark, tmp_path):
    head = ",".join(f.name for f in schemas.ORDER_LIST.fields)
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "a.csv", [head, order(order_id=1, order_date="26/05/2013", weight="1.25"), order(order_id=2, order_date="2013-05-26")])
    _write(tmp_path / "in" / "b.csv", [head, order(order_id="x", order_date="31/02/2013", weight="heavy", unit_quantity=3)])
    out = ingest(spark, str(tmp_path / "in"), "order_list", date_format="dd/MM/yyyy")
    [good] = out.accepted.collect()
    assert (good.order_id, good.order_date, good.weight) == (1, date(2013, 5, 26), Decimal("1.2500"))
    faults = sorted((r.source_file[-5:], r.column_name, r.value) for r in out.rejects.collect())
    assert faults == [("a.csv", "order_date", "2013-05-26"), ("b.csv", "order_date", "31/02/2013"), ("b.csv", "order_id", "x"), ("b.csv", "weight", "heavy")]


def test_folder_and_empty_files(spark, tmp_path):
    for table, schema in schemas.STAGING.items():
        _write(tmp_path / f"{table}.csv", [",".join(f.name for f in schema.fields)])
    _write(tmp_path / "wh_costs.csv", ["WH,Cost/unit", "P1,0.5", "P2,free"])
    staging, rejects = ingest_folder(spark, str(tmp_path))
    assert staging.wh_costs.count() == 1 and staging.order_list.count() == 0
    assert [(r.table_name, r.column_name, r.value) for r in rejects.collect()] == [("wh_costs", "cost_per_unit", "free")]
