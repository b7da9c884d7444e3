"""Sources and helpers: CSV sheet import, guarded seed, first row, JSON export, clocks."""

import json
import os

from pyspark.sql import functions as F

from helpdeck import schemas as S
from helpdeck.functions import dates as D
from helpdeck.operators import changes as CH
from helpdeck.sources import io as IO
from helpdeck.sources.tables import first_row, load_if_empty


def test_csv_sheet_import(spark, tmp_path):
    path = str(tmp_path / "sheet")
    rows = [("A1", "Kipas", "X", "12 bulan"), ("A1", "Kipas Baru", "Y", ""), ("", "Tanpa Kode", "Z", "1")]
    spark.createDataFrame(rows, "`Kode Barang` string, `Nama Produk` string, Tipe string, Garansi string") \
        .coalesce(1).write.option("header", True).csv(path)
    sheet = IO.read_sheet_csv(spark, path)
    c = CH.product_import_counts(sheet).first()
    assert (c.imported, c.skipped) == (2, 1)
    products = S.rows(spark, S.PRODUCTS, [{"id": 3, "kode_barang": "A1", "nama_produk": "old", "garansi_bulan": 6}])
    got = [tuple(r) for r in CH.product_import(products, sheet, "2024-01-31 20:30:00").select("id", "nama_produk", "tipe", "garansi_bulan")
           .collect()]
    assert got == [(3, "Kipas Baru", "Y", 0)]


def test_load_if_empty(spark):
    seed = spark.createDataFrame([(1,), (2,)], "id long")
    empty = spark.createDataFrame([], "id long")
    full = spark.createDataFrame([(9,)], "id long")
    assert sorted(r.id for r in load_if_empty(empty, seed).collect()) == [1, 2]
    assert [r.id for r in load_if_empty(full, seed).collect()] == [9]


def test_first_row(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id long, v string")
    assert [tuple(r) for r in first_row(df, F.desc("id")).collect()] == [(3, "c")]
    assert first_row(df.limit(0), "id").count() == 0


def test_export_json(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a/b")], "id long, n string, s string")
    path = str(tmp_path / "out")
    IO.export_json(df, path)
    lines = [json.loads(line) for f in os.listdir(path) if f.endswith(".json")
             for line in open(os.path.join(path, f))]
    assert lines == [{"id": 1, "s": "a/b"}]


def test_clock_helpers(spark):
    df = spark.range(1)
    r = df.select(D.wib_text("2024-01-31 20:30:00").alias("wib"), D.today_str("2024-01-31 20:30:00").alias("today"),
                  D.default_expiry(None, "2024-01-31 20:30:00").alias("exp"),
                  D.default_expiry("2030-01-01", "2024-01-31 20:30:00").alias("given"),
                  D.first_weekday(2024, 2).alias("fw"), D.days_in_month(2024, 2).alias("dim")).first()
    assert r.wib == "2024-02-01 03:30:00"
    assert r.today == "31/01/2024"
    assert (r.exp, r.given) == ("2024-03-01", "2030-01-01")
    assert (r.fw, r.dim) == (4, 29)      # 1 Feb 2024 is a Thursday
    assert D.step_month(2024, 12, 1) == (2025, 1) and D.step_month(2024, 1, -1) == (2023, 12)
