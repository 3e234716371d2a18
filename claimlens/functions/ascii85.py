"""Ascii85 decoding as a native column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def decode_ascii85(token: Column) -> Column:
    """UTF-8 text of an Ascii85 token; null where the token is not valid Ascii85.

    Whitespace is ignored, ``z`` stands for four zero bytes at a group boundary, a short last group is
    padded with ``u`` and loses as many bytes, and undecodable bytes become U+FFFD.
    """
    packed = F.translate(token, " \t\n\r\x0b", "")
    # Every z must follow whole groups of five, counted from the start or from the z before it.
    legal = packed.rlike(r"\A(?:z|[!-u]{5})*+[!-u]{0,4}\z")
    digits = F.replace(packed, F.lit("z"), F.lit("!!!!!"))
    pad = F.pmod(-F.length(digits), F.lit(5))

    def group_hex(group: Column) -> Column:
        value = F.lit(0).cast("bigint")
        for k in range(5):
            value = value * 85 + F.ascii(F.substring(group, k + 1, 1)) - 33
        # A group beyond four bytes is an error and stays null.
        return _bind(value, lambda v: F.when(v < 2**32, F.lpad(F.hex(v), 8, "0")))

    def decoded(padded: Column) -> Column:
        groups = F.filter(F.split(padded, r"(?<=\G.{5})"), lambda g: g != "")
        return F.transform(groups, group_hex)

    def text(parts: Column) -> Column:
        data = F.unhex(F.array_join(parts, ""))
        kept = F.substring(data, F.lit(1), F.size(parts) * 4 - pad)
        return F.when(~F.exists(parts, lambda p: p.isNull()), F.make_valid_utf8(kept.cast("string")))

    padded = F.concat(digits, F.repeat(F.lit("u"), pad))
    return F.when(legal, _bind(decoded(padded), text))
