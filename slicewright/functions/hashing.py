"""Which slice a value belongs to.

Values of any type become bytes first, so that equal values hash alike whatever their type: None, '', 0, 0.0 and False are
slice 0, whole floats are their integers, and text is its UTF-8. ``sip_slice`` uses SipHash-2-4 in Python, once for each distinct value of a batch; ``md5_slice`` needs no Python and has a twin in SQL.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = bytes(range(16))


def siphash24(data: bytes, key: bytes = KEY) -> int:
    """SipHash-2-4 of one byte string, as published."""
    mask = (1 << 64) - 1
    k0, k1 = struct.unpack("<QQ", key)
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]
    turn = lambda x, n: (x << n | x >> (64 - n)) & mask

    def mix(times: int) -> None:
        for _ in range(times):
            for a, b, c, d, p, q in ((0, 1, 2, 3, 13, 16), (2, 1, 0, 3, 17, 21)):
                v[a] = (v[a] + v[b]) & mask
                v[c] = (v[c] + v[d]) & mask
                v[b] = turn(v[b], p) ^ v[a]
                v[d] = turn(v[d], q) ^ v[c]
                v[a] = turn(v[a], 32)

    padded = data + bytes(7 - len(data) % 8) + bytes([len(data) & 255])
    for (word,) in struct.iter_unpack("<Q", padded):
        v[3] ^= word
        mix(2)
        v[0] ^= word
    v[2] ^= 255
    mix(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def canonical(value) -> bytes:
    """The bytes that a value hashes as; empty ones are slice 0."""
    if value is None or value == "" or value == b"" or value == 0:
        return b""
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (bool, np.bool_)):
        value = int(value)
    if isinstance(value, (float, np.floating)) and float(value).is_integer():
        value = int(value)
    if isinstance(value, (int, np.integer)):
        value = int(value)
        return struct.pack("<q", value) if -(1 << 63) <= value < 1 << 63 else value.to_bytes(value.bit_length() // 8 + 1, "little", signed=True)
    if isinstance(value, (float, np.floating)):
        return struct.pack("<d", float(value))
    return str(value).encode()


def slice_of(value, slices: int) -> int:
    data = canonical(value)
    return siphash24(data) % slices if data else 0


def sip_slice(column: Column, slices: int) -> Column:
    """The slice of each value by SipHash, distinct values of a batch hashed once."""

    @F.pandas_udf("int")
    def place(values):
        import pandas as pd

        codes, found = pd.factorize(values, use_na_sentinel=True)
        table = np.array([slice_of(v, slices) for v in found] + [0], np.int32)
        return pd.Series(table[codes])

    return place(column)


def md5_slice(column: Column, slices: int) -> Column:
    """The slice by the first 32 bits of the md5 of the value's text; None, and text of zero, is slice 0."""
    text = column.cast("string")
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % slices
    return F.when(text.isNull() | text.isin("", "0", "0.0", "false"), 0).otherwise(part).cast("int")
