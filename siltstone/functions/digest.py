"""Pluggable hashes and the digest of an object's canonical form.

Canonical form: hash name, a zero byte, then as LEB128 the hash size, the
blob's length, the number of references and 0, then the blob's hash and the
references' digests.  An object's digest is the hash of that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.binary import as_binary, joined, leb128, read_leb128


@dataclass(frozen=True)
class Hash:
    """A named hash: as a column function and as a Python function on bytes."""

    name: str
    size: int
    column: Callable[[Column], Column]
    of: Callable[[bytes], bytes]


def _sha3(b: Column) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else hashlib.sha3_256(x).digest())

    return run(b)


HASHES: dict[str, Hash] = {}


def register_hash(h: Hash) -> None:
    """Make a hash known by its name, which must be free of NUL."""
    if "\0" in h.name:
        raise ValueError("a hash's name has no NUL")
    HASHES[h.name] = h


register_hash(Hash("SHA-3-256", 32, _sha3, lambda b: hashlib.sha3_256(b).digest()))
register_hash(Hash("SHA-2-256", 32, lambda b: F.unhex(F.sha2(b, 256)), lambda b: hashlib.sha256(b).digest()))
NATIVE = "SHA-2-256"


def canonical(blob: Column, refs: Column | None, name: str = NATIVE) -> Column:
    """The canonical form of an object; ``refs`` is an ARRAY<BINARY>, or None for no references."""
    h = HASHES[name]
    count = F.size(refs).cast("long") if refs is not None else F.lit(0)
    parts = [as_binary(h.name + "\0"), leb128(F.lit(h.size), 2), leb128(F.octet_length(blob), 5), leb128(count, 5), as_binary("\0"), h.column(blob)]
    return F.concat(*parts, *([joined(refs)] if refs is not None else []))


def object_digest(blob: Column, refs: Column | None = None, name: str = NATIVE) -> Column:
    return HASHES[name].column(canonical(blob, refs, name))


def encode_canonical(blob: bytes, refs: list[bytes], name: str) -> bytes:
    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    h = HASHES[name]
    return h.name.encode() + b"\0" + number(h.size) + number(len(blob)) + number(len(refs)) + number(0) + h.of(blob) + b"".join(refs)


def digest_of(blob: bytes, refs: list[bytes], name: str) -> bytes:
    return HASHES[name].of(encode_canonical(blob, refs, name))


def decode_canonical(data: bytes, expect: str | None = None) -> dict:
    """hash_name, blob_len, blob_digest, refs; ValueError for another hash, size or length."""
    zero = data.index(b"\0")
    name, at = data[:zero].decode(), zero + 1
    if expect is not None and name != expect:
        raise ValueError(f"the hash is {name}, not {expect}")
    size, at = read_leb128(data, at)
    if name in HASHES and HASHES[name].size != size:
        raise ValueError("the hash has another size")
    blob_len, at = read_leb128(data, at)
    count, at = read_leb128(data, at)
    _, at = read_leb128(data, at)
    if len(data) != at + size * (count + 1):
        raise ValueError("the number of references is wrong")
    parts = [data[at + i * size : at + (i + 1) * size] for i in range(count + 1)]
    return {"hash_name": name, "blob_len": blob_len, "blob_digest": parts[0], "refs": parts[1:]}


def decoded_canonical(data: Column) -> Column:
    """STRUCT of what ``decode_canonical`` gives."""

    @F.pandas_udf("struct<hash_name: string, blob_len: bigint, blob_digest: binary, refs: array<binary>>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_canonical(x) for x in s], columns=["hash_name", "blob_len", "blob_digest", "refs"])

    return run(data)
