"""Converters from text to typed values.

Each is a function from a string column to a struct ``(ok, value)``, so a whole row converts in one pass and what to do about
bad values is a decision of its own. A text is matched as a whole, but for white space around it; converters
whose name ends in ``i`` take the longest valid start and ignore the rest. Empty text is zero for numbers and bad for dates.
Hexadecimal floats are bad here; text after a zero byte is not cut off.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
_DIGITS = {10: "[0-9]+", 8: "[0-7]+", 16: "(?:0[xX])?[0-9a-fA-F]+", 0: "(?:0[xX][0-9a-fA-F]+|[0-9]+)"}
_FLOAT = r"(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])"
# The words that count as false.
FALSE_WORDS = ["false", "0", "f", "no", "off", "nil", "null", ""]
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def pair(ok: Column, value: Column) -> Column:
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, value).alias("value"))


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def _start(x: Column, pattern: str) -> Column:
    return F.regexp_extract(x, f"^[ \\t-\\r]*([+-]?{pattern})", 1)


def integer(bits: int, signed: bool, base: int, loose: bool = False):
    """Whole numbers in base 10, 8, 16, or 0 for the prefix to tell; the least signed value stands for None and is bad."""

    def convert(x: Column) -> Column:
        text = _start(x, _DIGITS[base]) if loose else _trim(x)
        empty = text == ""
        shaped = text.rlike(f"^[+-]?{_DIGITS[base]}$")
        negative, body = text.startswith("-"), F.regexp_replace(text, "^[+-]", "")
        if base == 0:
            octal = body.rlike("^0[0-7]+$")
            shaped = shaped & (body.rlike("^(0[xX].*|0|[1-9][0-9]*)$") | octal)
            value = F.when(body.rlike("^0[xX]"), _based(body, 16)).when(octal, _based(body, 8)).otherwise(body.try_cast("decimal(38,0)"))
        elif base == 10:
            value = body.try_cast("decimal(38,0)")
        else:
            value = _based(body, base)
        value = F.when(negative, -value).otherwise(value)
        high = 2 ** (bits - signed) - 1
        low = -high if signed else 0
        kind = ("int" if bits == 32 else "bigint") if signed else ("bigint" if bits == 32 else "decimal(20,0)")
        fits = shaped & (value >= F.lit(low).cast("decimal(38,0)")) & (value <= F.lit(str(high)).cast("decimal(38,0)"))
        if not signed:
            fits = fits & ~negative
        return pair(empty | fits, F.when(empty, F.lit(0).cast(kind)).otherwise(value.try_cast(kind)))

    return convert


def _based(body: Column, base: int) -> Column:
    digits = F.regexp_replace(body, "^(0[xX])?0*" if base == 16 else "^0*", "")
    short = F.length(digits) <= (16 if base == 16 else 21)
    return F.when(short, F.conv(F.when(short & (digits != ""), digits).otherwise("0"), base, 10).cast("decimal(38,0)"))


def _double(x: Column, loose: bool, comma: bool = False) -> tuple[Column, Column]:
    if comma:
        x = F.when(~x.contains("."), F.translate(x, ",", ".")).otherwise("x" if not loose else "")
    text = _start(x, _FLOAT) if loose else _trim(x)
    ok = (text == "") | text.rlike(f"^[+-]?{_FLOAT}$")
    return ok, F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))


def floating(bits: int, loose: bool = False, comma: bool = False):
    def convert(x: Column) -> Column:
        ok, value = _double(x, loose, comma)
        return pair(ok, value.cast("float" if bits == 32 else "double"))

    return convert


def float_to_int(bits: int, saturate: bool, loose: bool = False, comma: bool = False):
    """Truncated; beyond the range an error, or the nearest end of it. The error range of 64 bits is that of exact doubles."""

    def convert(x: Column) -> Column:
        ok, value = _double(x, loose, comma)
        most = 2**31 - 1 if bits == 32 else 2**63 - 1
        kind = "int" if bits == 32 else "bigint"
        whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
        if saturate:
            top = float(most)
            return pair(ok & ~F.isnan(value), F.when(value >= top, F.lit(most)).when(value <= -top, F.lit(-most)).otherwise(whole).cast(kind))
        limit = float(most if bits == 32 else 2**53)
        inside = ok & ~F.isnan(value) & (F.abs(F.when(F.abs(value) < 1e300, F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))).otherwise(F.lit(None))) <= limit)
        return pair(F.coalesce(inside, F.lit(False)), F.when(F.abs(value) <= limit + 1, whole).cast(kind))

    return convert


def word_bool(x: Column) -> Column:
    return pair(x.isNotNull(), ~F.lower(x).isin(FALSE_WORDS))


def float_bool(loose: bool = False, comma: bool = False):
    def convert(x: Column) -> Column:
        ok, value = _double(x, loose, comma)
        return pair(ok, value != 0.0)

    return convert


# ---- dates and times ----

_FIELDS = {"Y": r"(\d{1,4})", "y": r"(\d{1,2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "e": r"(\d{1,2})", "H": r"(\d{1,2})", "I": r"(\d{1,2})", "M": r"(\d{1,2})", "S": r"(\d{1,2})", "f": r"(\d{1,6})", "J": r"(-?\d+)", "s": r"(-?\d+)", "p": r"([AaPp][Mm])"}
_MACROS = {"D": "%m/%d/%y", "T": "%H:%M:%S", "R": "%H:%M", "F": "%Y-%m-%d"}


def date_pattern(fmt: str) -> tuple[str, list[str]]:
    """A regular expression for a date format, and the fields that its groups hold."""
    for key, macro in _MACROS.items():
        fmt = fmt.replace(f"%{key}", macro)
    out, fields, at = "", [], 0
    while at < len(fmt):
        c = fmt[at]
        if c == "%":
            at += 1
            c = fmt[at]
            if c in "bBh":
                out += r"\s*([A-Za-z]{3,9})"
                fields.append("b")
            elif c == "%":
                out += "%"
            elif c in "nt":
                out += r"\s*"
            elif c in _FIELDS:
                out += ("" if c in "fJ" else r"\s*") + _FIELDS[c]
                fields.append("d" if c == "e" else c)
            else:
                raise ValueError(f"%{c} is not supported in {fmt!r}")
        elif c.isspace():
            out += r"\s*"
        else:
            out += re.sub(r"([^\w\s])", r"\\\1", c)
        at += 1
    return out, fields


def moment(kind: str, fmt: str, loose: bool = False, timezone: str | None = None):
    """datetime, date or time by a date format; what a format leaves out is of 1970-01-01 00:00:00. Times are microseconds of the day."""
    pattern, fields = date_pattern(fmt)
    whole = f"^{pattern}" + ("" if loose else "$")

    def convert(x: Column) -> Column:
        ok = x.rlike(whole)
        get = {f: F.regexp_extract(x, whole, k + 1) for k, f in enumerate(fields)}
        number = lambda f, default: F.when(ok, get[f].try_cast("int")).otherwise(default) if f in get else F.lit(default)
        if "J" in get or "s" in get:
            at = F.timestamp_millis(get["J"].try_cast("bigint")) if "J" in get else F.timestamp_seconds(get["s"].try_cast("bigint"))
            stamp = at.cast("timestamp_ntz")
        else:
            year = number("Y", 1970)
            if "y" in get:
                year = number("y", 70) + F.when(number("y", 70) < 69, 2000).otherwise(1900)
            month = number("m", 1)
            if "b" in get:
                month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(get["b"], 1, 3))).cast("int")
            hour = number("H", 0)
            if "I" in get:
                hour = number("I", 12) % 12 + F.when(F.lower(get["p"]) == "pm", 12).otherwise(0) if "p" in get else number("I", 12) % 12
            second = number("S", 0)
            ok = ok & (second < 60)
            micros = F.rpad(get["f"], 6, "0").try_cast("int") if "f" in get else F.lit(0)
            stamp = F.try_make_timestamp_ntz(year, month, number("d", 1), hour, number("M", 0), (second + F.coalesce(micros, F.lit(0)) / F.lit(1000000)).cast("decimal(16,6)"))
        if timezone and "J" not in get and "s" not in get:
            stamp = F.to_utc_timestamp(stamp.cast("timestamp"), timezone).cast("timestamp_ntz")
        if kind == "date":
            value = stamp.cast("date")
        elif kind == "time":
            value = F.hour(stamp).cast("bigint") * F.lit(3_600_000_000) + F.minute(stamp).cast("bigint") * F.lit(60_000_000) + (F.extract(F.lit("SECOND"), stamp) * 1_000_000).cast("bigint")
        else:
            value = stamp
        return pair(ok & stamp.isNotNull(), value)

    return convert


# ---- text ----


def _strip(x: Column, strip: bool) -> Column:
    return _trim(x) if strip else x


def text(strip: bool = False):
    return lambda x: pair(x.isNotNull(), _strip(x, strip))


def ascii_text(mode: str = "replace", strip: bool = False):
    """``replace`` writes bytes above 127 as backslash and octal, ``encode`` the backslash too, ``strict`` makes them bad."""

    @F.pandas_udf("string")
    def octal(values):
        keep = set(range(128)) - ({92} if mode == "encode" else set())
        return values.map(lambda v: None if v is None else "".join(chr(b) if b in keep else f"\\{b:03o}" for b in v.encode("utf-8", "surrogateescape")))

    def convert(x: Column) -> Column:
        x = _strip(x, strip)
        plain = x.rlike(r"^[\x00-\x7F]*$")
        return pair(plain, x) if mode == "strict" else pair(x.isNotNull(), octal(x))

    return convert


def decoded(codec: str, mode: str = "strict", strip: bool = False):
    """Bytes in any of Python's codecs; UTF-8 stays in the engine."""

    @F.pandas_udf("string")
    def decode(values):
        def one(v):
            if v is None:
                return None
            try:
                return bytes(v).strip(SPACES.encode()).decode(codec, mode) if strip else bytes(v).decode(codec, mode)
            except (UnicodeDecodeError, LookupError):
                return None

        return values.map(one)

    def convert(x: Column) -> Column:
        if codec.lower() in ("utf-8", "utf8") and mode in ("strict", "replace"):
            value = F.try_validate_utf8(x.cast("string")) if mode == "strict" else F.make_valid_utf8(x.cast("string"))
            value = _strip(value, strip)
        else:
            value = decode(x.cast("binary"))
        return pair(value.isNotNull(), value)

    return convert


# ---- numbers of any size, complex, json ----


def number(only_int: bool = False):
    """struct(i, d, s): a whole number of up to 38 digits, a float, or the digits of a larger whole number."""

    def convert(x: Column) -> Column:
        t = _trim(x)
        whole = t.rlike(r"^[+-]?[0-9]+(\.0*)?$")
        digits = F.regexp_replace(F.regexp_replace(t, r"\.0*$", ""), r"^\+", "")
        bare = F.regexp_replace(digits, "^(-?)0+(?=[0-9])", "$1")
        small = whole & (F.length(F.regexp_replace(bare, "^-", "")) <= 38)
        huge = whole & ~small & (F.length(bare) <= 304)
        real = t.rlike(f"^[+-]?{_FLOAT}$") & ~whole
        d = t.try_cast("double")
        real = real & (~F.abs(d).eqNullSafe(F.lit(float("inf"))) | t.rlike("(?i)inf"))
        ok = (t == "") | small | huge | (F.lit(not only_int) & real)
        value = F.struct(F.when(t == "", F.lit(0).cast("decimal(38,0)")).when(small, bare.try_cast("decimal(38,0)")).alias("i"), F.when(real, d).alias("d"), F.when(huge, bare).alias("s"))
        return pair(ok, value)

    return convert


def complex_number(bits: int):
    @F.pandas_udf("struct<ok:boolean,re:double,im:double>")
    def parse(values):
        import numpy as np
        import pandas as pd

        def one(v):
            try:
                z = complex(v)
                return (True, float(np.float32(z.real)), float(np.float32(z.imag))) if bits == 32 else (True, z.real, z.imag)
            except (ValueError, TypeError):
                return False, None, None

        return pd.DataFrame([one(v) for v in values], columns=["ok", "re", "im"])

    def convert(x: Column) -> Column:
        p = parse(x)
        kind = "float" if bits == 32 else "double"
        return pair(p["ok"], F.struct(p["re"].cast(kind).alias("re"), p["im"].cast(kind).alias("im")))

    return convert


def json_text(x: Column) -> Column:
    """JSON kept as text; a JSON null is a value."""
    return pair(F.try_parse_json(x).isNotNull(), x)


def converter(name: str, comma: bool = False, timezone: str | None = None):
    """The converter of a type name, such as ``int32_10``, ``floatint64si``, ``datetime:%Y-%m-%d`` or ``unicode:utf-8/strict``."""
    head, _, tail = name.partition(":")
    if m := re.fullmatch(r"(int|bits)(32|64)_(0|8|10|16)(i?)", name):
        return integer(int(m[2]), m[1] == "int", int(m[3]), bool(m[4]))
    if m := re.fullmatch(r"float(32|64)(i?)", name):
        return floating(int(m[1]), bool(m[2]), comma)
    if m := re.fullmatch(r"floatint(32|64)([es])(i?)", name):
        return float_to_int(int(m[1]), m[2] == "s", bool(m[3]), comma)
    if m := re.fullmatch(r"floatbool(i?)", name):
        return float_bool(bool(m[1]), comma)
    if m := re.fullmatch(r"(datetime|date|time)(i?)", head):
        if tail:
            return moment(m[1], tail, bool(m[2]), timezone if m[1] == "datetime" else None)
    if m := re.fullmatch(r"ascii(strip)?", head):
        return ascii_text(tail or "replace", bool(m[1]))
    if m := re.fullmatch(r"unicode(strip)?", head):
        codec, _, mode = tail.partition("/")
        return decoded(codec or "utf-8", mode or "strict", bool(m[1]))
    if name in ("bytes", "bytesstrip"):
        return text(name == "bytesstrip")
    if name in ("number", "number:int"):
        return number(name == "number:int")
    if name in ("complex32", "complex64"):
        return complex_number(int(name[-2:]))
    found = {"strbool": word_bool, "json": json_text}.get(name)
    if found is None:
        raise ValueError(f"no type {name!r}")
    return found


#: All names without parameters, and one of each with.
NAMES = (
    ["complex64", "complex32", "float64", "float32", "float64i", "float32i", "strbool", "floatbool", "floatbooli", "bytes", "bytesstrip", "number", "number:int", "json"]
    + [f"floatint{b}{m}{i}" for b in (64, 32) for m in "es" for i in ("", "i")]
    + [f"{k}{b}_{base}{i}" for k in ("int", "bits") for b in (64, 32) for base in (0, 8, 10, 16) for i in ("", "i")]
    + [f"{k}{i}:%Y" for k in ("datetime", "date", "time") for i in ("", "i")]
    + [f"unicode{s}:utf-8" for s in ("", "strip")]
    + [f"ascii{s}{m}" for s in ("", "strip") for m in ("", ":replace", ":encode", ":strict")]
)
