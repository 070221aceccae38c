"""CSV ingest in the shape of the source files: BOM, CRLF, foreign headers, blank record."""

import os

from pyspark.sql import functions as F

from haulage.operators.clean import clean
from haulage.operators.dims import dim_plant, dim_port
from haulage.sources.csv import read_source_folder, read_staging_csv, write_staging_csv


def _write(path, header, rows):
    body = "\r\n".join([header] + rows) + "\r\n"
    with open(path, "wb") as f:
        f.write(b"\xef\xbb\xbf" + body.encode("utf-8"))


def make_folder(tmp_path):
    plants = [f"PLANT{n:02d}" for n in range(1, 8)]
    _write(tmp_path / "plant_port.csv", "Plant Code,Port",
           [f"{p},PORT0{(i % 3) + 1}" for i, p in enumerate(plants)] + ["PLANT01,PORT04"])
    _write(tmp_path / "vmi_customers.csv", "Plant Code,Customers",
           ["PLANT02,V55_1", "PLANT02,V555_2", "PLANT05,V55_1"])
    _write(tmp_path / "wh_capacities.csv", "Plant ID,Daily Capacity ",
           [f"{p},{10 * (i + 1)}" for i, p in enumerate(plants)])
    _write(tmp_path / "wh_costs.csv", "WH,Cost/unit",
           [f"{p},0.{40 + i}" for i, p in enumerate(plants)] + [","])
    return str(tmp_path)


def test_read_source_folder(spark, tmp_path):
    st = read_source_folder(spark, make_folder(tmp_path))
    assert st.plant_port.count() == 8
    assert st.vmi_customers.select("customer_id").distinct().count() == 2
    costs = st.wh_costs.collect()
    assert len(costs) == 8 and (None, None) in [tuple(r) for r in costs]   # the ',' record
    assert str(st.wh_costs.schema["cost_per_unit"].dataType) == "DecimalType(12,4)"
    c = clean(st)
    assert c.wh_costs.count() == 7                                          # dropped by clean
    plants = dim_plant(c).orderBy("plant_key").collect()
    assert [(r.plant_key, r.plant_code) for r in plants] == \
        [(n, f"PLANT{n:02d}") for n in range(1, 8)]
    assert plants[0].daily_capacity == 10 and float(plants[0].cost_per_unit) == 0.40
    assert dim_port(c).count() == 4


def test_header_is_not_trusted(spark, tmp_path):
    _write(tmp_path / "caps.csv", "Whatever,Else ", ["PLANT01,5"])
    df = read_staging_csv(spark, str(tmp_path / "caps.csv"), "wh_capacities")
    assert df.columns == ["plant_id", "daily_capacity"]
    assert df.first().daily_capacity == 5


def test_codes_are_standardised(spark, tmp_path):
    _write(tmp_path / "pp.csv", "Plant Code,Port", [" plant01 ,port01"])
    st = clean(read_source_folder(spark, make_folder(tmp_path)))
    raw = read_staging_csv(spark, str(tmp_path / "pp.csv"), "plant_port")
    from haulage.operators.clean import clean_table
    assert tuple(clean_table("plant_port", raw).first()) == ("PLANT01", "PORT01")
    assert st.plant_port.where(F.col("plant_code") != F.upper(F.trim("plant_code"))).count() == 0


def test_round_trip(spark, tmp_path):
    from fixtures import edge_staging
    st = edge_staging(spark)
    path = os.path.join(str(tmp_path), "orders_csv")
    write_staging_csv(st.order_list, path, "order_list")
    back = read_staging_csv(spark, path, "order_list")
    assert back.exceptAll(st.order_list).count() == 0
    assert st.order_list.exceptAll(back).count() == 0


def test_optimization_dataset_sink(spark, tmp_path):
    from conftest import SF_SMALL
    from haulage.plans.star import star_for
    from haulage.sources.tables import write_optimization_dataset
    star = star_for(spark, SF_SMALL)
    out = write_optimization_dataset(star, str(tmp_path / "options"))
    assert "_SUCCESS" in os.listdir(tmp_path / "options")
    assert any(p.startswith("service_level=") for p in os.listdir(tmp_path / "options"))
    from haulage.operators.costmodel import carrier_options
    from haulage.config import CostConfig
    assert out.count() == carrier_options(star.shipments, star.fact_freight_rates,
                                          star.dim_plant, CostConfig()).count()


def test_star_from_a_csv_folder(spark, tmp_path):
    """All seven staging tables from CSV files give the same answers as the same rows in memory."""
    from fixtures import edge_staging
    from haulage.config import CostConfig
    from haulage.operators.clean import clean
    from haulage.plans.evaluation import total_historical_cost
    from haulage.plans.registry import all_queries
    from haulage.plans.star import build_star, register_staging
    from haulage.session import scratch_path
    from haulage.sources.csv import TABLE_FILES, read_csv_folder
    st = edge_staging(spark)
    folder = tmp_path / "csv"
    for t, f in TABLE_FILES.items():
        write_staging_csv(getattr(st, t), str(folder / f), t)
    name = register_staging(spark, str(folder), read_csv_folder(spark, str(folder)))
    got = all_queries()["total_historical_cost"](spark, name).first()
    want = total_historical_cost(build_star(clean(st), scratch_path(spark, "csv-ref")),
                                 CostConfig()).first()
    assert got == want


def test_command_line(spark, tmp_path, capsys):
    from conftest import SF_SMALL
    from haulage.__main__ import main
    assert main(["list"]) == 0
    assert "cost_reduction" in capsys.readouterr().out.split()
    out = str(tmp_path / "cr")
    assert main(["run", "cost_reduction", "--parquet-dir", SF_SMALL, "--out", out,
                 "--format", "csv"]) == 0
    back = spark.read.option("header", True).csv(out).collect()
    assert len(back) == 1 and float(back[0]["historical_total_cost"]) > 0
    assert main(["run", "no_such_query", "--parquet-dir", SF_SMALL]) == 2
    assert not spark.sparkContext._jsc.sc().isStopped()


def test_white_space_and_empty_codes(spark):
    from haulage.operators.clean import clean_table
    raw = spark.createDataFrame([(" ", " "), ("\tplant01", "port01\u000b"), ("PLANT02", ""), (None, None)], "plant_code string, port string")
    assert sorted(map(tuple, clean_table("plant_port", raw).collect()), key=repr) == [("PLANT01", "PORT01"), ("PLANT02", None)]


def test_untidy_files_are_untidy(spark, tmp_path):
    from haulage.sources.csv import write_untidy_vmi
    vmi = spark.createDataFrame([(f"PLANT{i:02d}", f"CUST_{i}") for i in range(40)], "plant_code string, customer_id string")
    write_untidy_vmi(vmi, str(tmp_path / "vmi"), files=2)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "vmi").glob("part-*")))
    assert raw.count(b"\xef\xbb\xbfPlant Code,Customers\r\n") == 2 and raw.count(b"\n") == raw.count(b"\r\n")
    assert b"plant0" in raw and b"\tplant" in raw and b"  PLANT" in raw and b"\n,\r\n" in raw


def test_saved_star_answers_in_a_new_session(spark, tmp_path):
    from haulage.plans import star as S
    from haulage.plans.registry import all_queries
    star = S.star_for(spark, "/root/testdata/sf0.001")
    S.save_star(star, "modeling_test", str(tmp_path / "modeling"))
    before = set(tmp_path.rglob("*"))
    other = spark.newSession()
    q = all_queries()
    # by the catalog, and as an application without this catalog would
    for name in (S.open_star(other, "modeling_test"), S.open_star(other, location=str(tmp_path / "modeling"))):
        for key in ("capacity_fit", "total_historical_cost", "model_tables"):
            assert sorted(map(tuple, q[key](other, name).collect())) == sorted(map(tuple, q[key](spark, "/root/testdata/sf0.001").collect()))
    assert set(tmp_path.rglob("*")) == before
    spark.sql("DROP DATABASE modeling_test CASCADE")
