"""Converters, hashing and parsing against tables of values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slicewright.functions import converters, hashing
from slicewright.sources.csv import BadLine, fields_of

BAD = object()
CASES = [
    ("float64", [("1.50", 1.5), ("-inf", float("-inf")), ("5e-1", 0.5), ("", 0.0), ("1.5d", BAD), ("x", BAD)]),
    ("float32", [("1.2", 1.2000000476837158)]),
    ("float64i", [("1.5garbage", 1.5), ("junk", 0.0)]),
    ("int32_10", [("27", 27), ("027", 27), (" \r27 ", 27), ("", 0), ("2147483648", BAD), ("-2147483648", BAD), ("-2147483647", -2147483647), ("1O", BAD)]),
    ("int64_10", [("36893488147419103231", BAD), (str(2**63), BAD), (str(-(2**63)), BAD), (str(2**63 - 1), 2**63 - 1)]),
    ("int32_8", [("33", 27), ("033", 27), ("9", BAD)]),
    ("int32_16", [("1b", 27), ("0x1b", 27), ("-0x1B", -27), ("1g", BAD)]),
    ("int32_0", [("27", 27), ("033", 27), ("0x1b", 27)]),
    ("int32_10i", [("27garbage", 27), ("garbage", 0)]),
    ("bits32_10", [("4294967295", 2**32 - 1), ("4294967296", BAD), ("-1", BAD)]),
    ("bits64_10", [(str(2**64 - 1), 2**64 - 1), (str(2**64), BAD), ("-1", BAD)]),
    ("strbool", [(x, False) for x in ("", "0", "FALSE", "f", "FaLSe", "no", "off", "NIL", "NULL")] + [(x, True) for x in ("y", "jao", " ", "true")]),
    ("floatbool", [("0", False), ("-0", False), ("1", True), ("1004", True), ("0.00001", True), ("inf", True), ("-1", True), ("", False), ("0.00", False), ("x", BAD)]),
    ("floatint32e", [("1.99", 1), ("-3000", -3000), ("1e10", BAD), ("nan", BAD), ("-7.89", -7)]),
    ("floatint32s", [("1e10", 2147483647), ("-2.2e9", -2147483647), ("1e100", 2147483647), ("-7.89", -7)]),
    ("floatint64s", [("1e100", 2**63 - 1), ("-1e100", -(2**63 - 1)), ("12.5", 12)]),
    ("floatint64ei", [("1.half", 1), ("1e100", BAD)]),
    ("date:%Y-%m-%d", [("2020-02-29", dt.date(2020, 2, 29)), ("2019-02-29", BAD), ("", BAD), ("2020-01-01x", BAD)]),
    ("datei:%Y-%m-%d", [("2020-01-01x", dt.date(2020, 1, 1))]),
    ("datetime:%d/%m/%y %H.%M", [("01/02/69 03.04", dt.datetime(1969, 2, 1, 3, 4)), ("01/02/68 23.59", dt.datetime(2068, 2, 1, 23, 59))]),
    ("datetime:%J", [("-2005", dt.datetime(1969, 12, 31, 23, 59, 57, 995000))]),
    ("datetime:%H:%M:%S.%f", [("12:00:01.5", dt.datetime(1970, 1, 1, 12, 0, 1, 500000)), ("12:00:60.5", BAD)]),
    ("datetime:%d %b %Y", [("3 Mar 2001", dt.datetime(2001, 3, 3))]),
    ("time:%H:%M", [("01:02", 3720000000), ("25:00", BAD)]),
    ("ascii:strict", [("bar", "bar"), ("blä", BAD)]),
    ("ascii", [("blä", "bl\\303\\244"), ("\\bar", "\\bar")]),
    ("ascii:encode", [("\\bar", "\\134bar")]),
    ("unicodestrip:utf-8", [(" \tblå\n", "blå")]),
    ("json", [("null", "null"), ('{"a": [1, 2]}', '{"a": [1, 2]}'), ("nope", BAD)]),
]


@pytest.mark.parametrize(("kind", "values"), CASES, ids=[k for k, _ in CASES])
def test_converters(spark, kind, values):
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(values)], "k int, x string")
    got = {r["k"]: r["t"] for r in rows.select("k", converters.converter(kind)(F.col("x")).alias("t")).collect()}
    for k, (text, wanted) in enumerate(values):
        if wanted is BAD:
            assert not got[k]["ok"], (text, got[k])
        else:
            assert got[k]["ok"] and got[k]["value"] == wanted, (text, got[k])


def test_timezone_and_comma(spark):
    rows = spark.createDataFrame([("2020-09-30 13:44", "1,5"), ("2020-02-22 12:44", "1.0")], "t string, c string")
    t = converters.converter("datetime:%Y-%m-%d %H:%M", timezone="Europe/Stockholm")(F.col("t"))
    c = converters.converter("float64", comma=True)(F.col("c"))
    got = rows.select(t["value"].alias("t"), c["ok"].alias("ok"), c["value"].alias("c")).collect()
    assert [r["t"].time() for r in got] == [dt.time(11, 44)] * 2
    assert [(r["ok"], r["c"]) for r in got] == [(True, 1.5), (False, None)]


def test_number(spark):
    rows = spark.createDataFrame([("42",), ("42.000",), ("43.",), ("1.5",), ("9" * 60,), ("0x1",), ("1e999",)], "x string")
    got = [r["t"] for r in rows.select(converters.converter("number")(F.col("x")).alias("t")).collect()]
    assert [int(t["value"]["i"]) for t in got[:3]] == [42, 42, 43]
    assert got[3]["value"]["d"] == 1.5
    assert got[4]["value"]["s"] == "9" * 60
    assert not got[5]["ok"]
    assert not got[6]["ok"]


def test_codec_and_complex(spark):
    rows = spark.createDataFrame([(b"bl\xe4", "1+2j"), (b"ok", "x")], "b binary, z string")
    t, z = converters.converter("unicode:latin-1")(F.col("b")), converters.converter("complex64")(F.col("z"))
    got = rows.select(t.alias("t"), z.alias("z")).collect()
    assert [r["t"]["value"] for r in got] == ["blä", "ok"]
    assert (got[0]["z"]["value"]["re"], got[0]["z"]["value"]["im"], got[1]["z"]["ok"]) == (1.0, 2.0, False)


def test_names_have_converters():
    for name in converters.NAMES:
        assert converters.converter(name)
    with pytest.raises(ValueError, match="no type"):
        converters.converter("int31_10")


def test_siphash_published_vectors():
    data = bytes(range(15))
    assert hashing.siphash24(data) == 0xA129CA6149BE45E5
    assert hashing.siphash24(b"") == 0x726FDB47DD0E0E31


def test_equal_values_hash_alike():
    for a, b in ((1, 1.0), (0, None), ("", 0.0), (False, 0), (True, 1), ("foo", b"foo")):
        assert hashing.slice_of(a, 23) == hashing.slice_of(b, 23)


def test_sip_slices_in_engine(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(50)] + [(None, None)], "i long, d double")
    for r in rows.select(hashing.sip_slice(F.col("i"), 7).alias("i"), hashing.sip_slice(F.col("d"), 7).alias("d"), F.col("i").alias("v")).collect():
        assert r["i"] == r["d"] == hashing.slice_of(r["v"], 7)


@pytest.mark.parametrize(
    ("line", "quotes", "wanted"),
    [
        (b"1,'a,'a", False, [b"1", b"'a", b"'a"]),
        (b'4,"d""",d"', True, [b"4", b'd"', b'd"']),
        (b"5, 'e',\" 'e'\"", True, [b"5", b" 'e'", b" 'e'"]),
        (b"2,,''", True, [b"2", b"", b""]),
        (b'2,"b,"b', True, None),
        (b"3,'c'c','c'c'", True, None),
    ],
)
def test_fields(line, quotes, wanted):
    if wanted is None:
        with pytest.raises(BadLine):
            fields_of(line, b",", quotes)
    else:
        assert fields_of(line, b",", quotes) == wanted
