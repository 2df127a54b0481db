"""Byte-level column functions: variable-length integers, netstrings, hexadecimal and object names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_binary(text: str) -> Column:
    return F.lit(text.encode()).cast("binary")


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2, "0"))


def leb128(n: Column | str, groups: int = 9) -> Column:
    """Unsigned LEB128 of a non-negative BIGINT, up to 7 * ``groups`` bits; null stays null."""
    n = (F.col(n) if isinstance(n, str) else n).cast("long")
    parts = []
    for i in range(groups):
        low = F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127))
        more = F.when(n >= F.lit(1 << 7 * (i + 1)), F.lit(128)).otherwise(F.lit(0)) if i < 8 else F.lit(0)
        byte = _byte(low + more)
        parts.append(byte if i == 0 else F.when(n >= F.lit(1 << 7 * i), byte).otherwise(F.lit(b"")))
    return F.concat(*parts)


def read_leb128(data: bytes, at: int) -> tuple[int, int]:
    """The number at a position and the position after it; ValueError if cut short."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a variable-length integer is cut short")
        n |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return n, at


def netstring(x: Column | str) -> Column:
    """``{bytes}:{x},`` as BINARY; the length counts bytes."""
    x = (F.col(x) if isinstance(x, str) else x).cast("binary")
    return F.concat(F.octet_length(x).cast("string").cast("binary"), as_binary(":"), x, as_binary(","))


def read_netstring(data: bytes, at: int) -> tuple[bytes, int]:
    colon = data.find(b":", at)
    if colon < 0 or not data[at:colon].isdigit():
        raise ValueError("a netstring has no length")
    end = colon + 1 + int(data[at:colon])
    if data[end : end + 1] != b",":
        raise ValueError("a netstring is not closed")
    return data[colon + 1 : end], end + 1


def lower_hex(b: Column | str) -> Column:
    return F.lower(F.hex(b))


def abbreviated(b: Column | str, digits: int = 8) -> Column:
    return F.substring(lower_hex(b), 1, digits)


def object_name(digest: Column | str) -> Column:
    """The name of an object in a flat object store: base64 of ``BLOB`` and the digest."""
    return F.base64(F.concat(as_binary("BLOB"), F.col(digest) if isinstance(digest, str) else digest))


def shard_path(digest: Column | str) -> Column:
    """``aa/bb/rest`` of the digest's hexadecimal digits."""
    h = lower_hex(digest)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.substr(h, F.lit(5)))


def parse_digest(text: Column | str, size: int = 32) -> Column:
    """A digest from exactly 2 * size hexadecimal digits; anything else is an error."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNull() | text.rlike(f"^[0-9a-fA-F]{{{2 * size}}}$"), F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("not a digest: "), text)).cast("binary"))


def joined(values: Column) -> Column:
    """The concatenation of an ARRAY<BINARY>."""
    return F.aggregate(values, F.lit(b""), lambda a, x: F.concat(a, x))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
