"""Scalar functions: sizes, rounding, cursors, hex round trip."""

from pyspark.sql import functions as F

from logloom.functions import formatting as FM
from logloom.functions.cursor import decode_cursor, encode_cursor
from logloom.functions.hexcodec import hex_col, hex_to_bytes


def test_readable_size(spark):
    vals = [0, 1, 1023, 1024, 1536, 1048575, 1048576, 1152, 5 * 1024 ** 3 + 1]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "b bigint")
    out = [r.s for r in df.select(FM.readable_size("b").alias("s")).collect()]
    assert out == ["0.00 B", "1.00 B", "1023.00 B", "1.00 KiB", "1.50 KiB", "1024.00 KiB",
                   "1.00 MiB", "1.13 KiB", "5.00 GiB", "0 B"]


def test_ratio_half_even_and_percent(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (10, 4), (1, 0), (2675, 1000)], "n bigint, d bigint")
    r = df.select(FM.ratio_half_even("n", "d").alias("r"), FM.percent_half_up("n", "d").alias("p")).collect()
    assert [x.r for x in r] == [0.12, 0.38, 2.5, 0.0, 2.68]
    assert [x.p for x in r] == [12.5, 37.5, 250.0, 0.0, 267.5]


def test_cursor_round_trip(spark):
    df = spark.createDataFrame([("17000000:3",), ("5",), ("abc",)], "c string")
    b, i = decode_cursor("c")
    out = df.select(b.alias("b"), i.alias("i"), encode_cursor(b, i).alias("e")).collect()
    assert [(r.b, r.i, r.e) for r in out] == [(17000000, 3, "17000000:3"), (5, 0, "5:0"), (0, 0, "0:0")]


def test_hex_round_trip(spark):
    df = spark.createDataFrame([("0x00ff",), ("0x",), (None,)], "h string")
    out = [r.x for r in df.select(hex_col(hex_to_bytes("h"), "x")).collect()]
    assert out == ["0x00ff", "0x", None]


def test_bad_request_literals_raise(spark):
    import pytest

    from logloom.operators import filters as P
    df = spark.createDataFrame([(b"\x00" * 32, b"\x00" * 20)], "topic0 binary, address binary")
    with pytest.raises(ValueError):
        P.by_topic0(df, "0xzz")
    with pytest.raises(ValueError):
        P.by_topic0(df, "0x" + "1" * 65)
    with pytest.raises(ValueError):
        P.by_address(df, "")
    assert P.by_topic0(df, "0x0").count() == 1
    assert P.by_address(df, "0X0").count() == 1
