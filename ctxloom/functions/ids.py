"""Identifiers as fixed-width lower-case hex strings, which sort like the numbers they stand for."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_MS, MAX_RANDOM = (1 << 48) - 1, (1 << 80) - 1


def hex_of(number: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(number.cast("long"))), width, "0")


def block_id(ts_ms: Column, random: Column) -> Column:
    """48 bits of milliseconds, then 80 random bits (of which a long fills 63)."""
    return F.concat(hex_of(ts_ms, 12), hex_of(random, 20))


def timestamp_ms(block: Column) -> Column:
    return F.conv(F.substring(block, 1, 12), 16, 10).cast("long")


def is_id(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{32}$")


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def make_block_id(ts_ms: int, random: int) -> str:
    return f"{min(ts_ms, (1 << 64) - 1) & MAX_MS:012x}{random & MAX_RANDOM:020x}"


def parse_id(text: str | int) -> str:
    """Decimal, 0x-prefixed hex, or 32 bare hex digits, as 32 hex digits."""
    if isinstance(text, int):
        number = text
    elif re.fullmatch("[0-9a-fA-F]{32}", text):
        return text.lower()
    elif re.fullmatch("0[xX][0-9a-fA-F]+", text):
        number = int(text, 16)
    elif re.fullmatch("[0-9]+", text):
        number = int(text)
    else:
        raise ValueError(f"not an id: {text!r}")
    if not 0 <= number < 1 << 128:
        raise ValueError(f"not a 128-bit id: {text!r}")
    return f"{number:032x}"
