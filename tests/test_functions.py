"""Golden cases for the scalar rules (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from helpdeck.functions import dates as D
from helpdeck.functions import labels as L
from helpdeck.functions import text as T
from helpdeck.operators.filters import contains_like, sqlite_like


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def col_values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_normalize_phone(spark):
    df = one_col(spark, ["0812-3", "+62 812", "8123", "", None, "abc"])
    assert col_values(df, T.normalize_phone("x")) == ["628123", "62812", None, None, None, None]


def test_trim_str(spark):
    df = one_col(spark, ["\t a \t", " b ", "﻿c﻿", "x" * 600, None, "  d e  "])
    out = col_values(df, T.trim_str("x", 500))
    assert out[:3] == ["a", "b", "c"]
    assert out[3] == "x" * 500
    assert out[4] == ""
    assert out[5] == "d e"


def test_zero_pad_never_truncates(spark):
    df = one_col(spark, [7, 1000000, 123456], "long")
    assert col_values(df, T.zero_pad("x", 6)) == ["000007", "1000000", "123456"]


def test_digits_int(spark):
    df = one_col(spark, ["12.5 bulan", "", None, "abc", "24"])
    assert col_values(df, T.digits_int("x")) == [125, 0, 0, 0, 24]


def test_round_half_up(spark):
    df = one_col(spark, [0.25, -0.25, 1.05, None], "double")
    assert col_values(df, D.round_half_up("x", 1)) == [0.3, -0.2, 1.1, None]


def test_text_dates(spark):
    df = one_col(spark, ["05/03/2024", "2024-03-05", "", "x", "2024-02-31", None])
    got = [str(v) if v else None for v in col_values(df, D.text_date("x"))]
    assert got == ["2024-03-05", "2024-03-05", None, None, None, None]
    assert col_values(df, D.iso_to_dmy("x")) == ["05/03/2024", "05/03/2024", None, "x", "31/02/2024", None]
    assert col_values(df, D.dmy_to_iso("x")) == ["2024-03-05", "2024-03-05", None, "x", "2024-02-31", None]


def test_reassembled_parity(spark):
    df = one_col(spark, ["05/03/2024", "2024-03-05"])
    assert col_values(df, D.reassembled_iso("x")) == ["2024-03-05", "3-05-4--20"]


def test_like_ascii_case_and_wildcards(spark):
    df = one_col(spark, ["Tokopedia", "TOKO", "É", "é", "a%b", "a_b", "a\\b", "axb"])
    assert col_values(df, contains_like("x", "toko")) == [True, True, False, False, False, False, False, False]
    assert col_values(df, sqlite_like("x", "é")) == [False, False, False, True, False, False, False, False]
    # caller's % and _ stay wildcards, a backslash is literal
    assert col_values(df, sqlite_like("x", "a_b")) == [False, False, False, False, True, True, True, True]
    assert col_values(df, sqlite_like("x", "a\\b")) == [False] * 6 + [True, False]


def test_labels(spark):
    df = spark.createDataFrame([("on_progress", "Shopee", "Toko A"), ("rejected", "  ", ""), (None, None, None),
                                ("waiting", "", "Toko B")], "s string, m string, t string")
    out = df.select(L.status_label("s"), L.handled_label("s"), L.purchase_channel("m", "t"),
                    T.status_upper("s")).collect()
    assert [tuple(r) for r in out] == [
        ("On Progress", "SUDAH", "Shopee / Toko A", "ON PROGRESS"),
        ("Rejected", "-", "-", "REJECTED"),
        ("Unknown", "BELUM", "-", None),
        ("Waiting", "BELUM", "Toko B", "WAITING"),
    ]


def test_text_lines_and_extension(spark):
    df = one_col(spark, [" a \n\n b\r\n \t \nc", None])
    assert col_values(df, T.text_lines("x")) == [["a", "b", "c"], []]
    f = one_col(spark, ["x/photo.JPG", ".bashrc", "a.tar.gz", "noext", "file."])
    assert col_values(f, T.file_extension("x")) == [".JPG", "", ".gz", "", "."]


def test_app_link(spark):
    df = spark.createDataFrame([("https://x.org//",), ("",), (None,)], "u string")
    assert col_values(df, T.app_link(F.col("u"), "/a")) == ["\nhttps://x.org/a", "", ""]
