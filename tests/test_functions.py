import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import binary, digest, state, text


@pytest.mark.parametrize(("n", "expected"), [(0, "00"), (127, "7f"), (128, "8001"), (8192, "8040"), (16384, "808001"), (2**62, "808080808080808040")])
def test_leb128(spark, n, expected):
    got = spark.range(1).select(binary.leb128(F.lit(n)).alias("b")).first()["b"]
    assert bytes(got).hex() == expected
    assert binary.read_leb128(bytes(got), 0) == (n, len(got))


@given(st.lists(st.binary(max_size=4096), max_size=4))
def test_netstrings_round_trip(parts):
    data = b"".join(b"%d:%s," % (len(p), p) for p in parts)
    at, out = 0, []
    while at < len(data):
        part, at = binary.read_netstring(data, at)
        out.append(part)
    assert out == parts


@pytest.mark.parametrize("data", [b"", b"3:ab,", b"x:a,", b"1:a;"])
def test_bad_netstrings(data):
    with pytest.raises(ValueError):
        binary.read_netstring(data, 0)


VECTORS = [
    (b"", [], "SHA-3-256", "d9171588bd66db74762f6a67b2e3cc2eb8ac9a17ce0ca17e3b062b824102154d"),
    (b"hello", [], "SHA-3-256", "0a2298e847b2df760c3a4f16164e0cec2b2e7b1ccc45571f2dbbfc8262cbbe46"),
    (b"world", [], "SHA-3-256", "921dbcc89cb686cef4fdcb0ed917e5ead10eece73a21eef42163fe8757f30d77"),
    (b"hello", [], "SHA-2-256", "f1276ac29e98b9d993a638d48def40ec6e7a4cb2cb0df121e7825fc76cdd84e7"),
]


@pytest.mark.parametrize(("blob", "refs", "name", "expected"), VECTORS)
def test_digest_vectors(spark, blob, refs, name, expected):
    assert digest.digest_of(blob, refs, name).hex() == expected
    row = spark.createDataFrame([(blob, refs)], "blob binary, refs array<binary>").select(digest.object_digest(F.col("blob"), F.col("refs"), name).alias("d")).first()
    assert bytes(row["d"]).hex() == expected


def test_large_and_tree_vectors():
    h, w = (digest.digest_of(x, [], "SHA-3-256") for x in (b"hello", b"world"))
    large = digest.digest_of(b"0 5 0\n5 10 1\n10 15 0\n", [h, w], "SHA-3-256")
    assert large.hex() == "cb231bfefd4e05c4301b6b9e42b2239b131d490fdd6df69fa02a1b2f9c5dc13e"
    tree = digest.digest_of(b"12:0 data 5 0 a,\n12:0 data 5 0 b,\n12:1 data 5 0 c,\n", [h, w], "SHA-3-256")
    assert tree.hex() == "2169b70c37a1aa8fb898cc93a0eb69846af6c8f013723c06c9679794c8268e12"


@given(st.binary(max_size=1024), st.lists(st.binary(min_size=32, max_size=32), max_size=50))
def test_canonical_round_trip(blob, refs):
    back = digest.decode_canonical(digest.encode_canonical(blob, refs, "SHA-3-256"), "SHA-3-256")
    assert back == {"hash_name": "SHA-3-256", "blob_len": len(blob), "blob_digest": hashlib.sha3_256(blob).digest(), "refs": refs}


def test_canonical_rejects_other_hash_and_bad_length():
    data = digest.encode_canonical(b"x", [b"\1" * 32], "SHA-3-256")
    with pytest.raises(ValueError):
        digest.decode_canonical(data, "SHA-2-256")
    with pytest.raises(ValueError):
        digest.decode_canonical(data[:-1])
    with pytest.raises(ValueError):
        digest.register_hash(digest.Hash("a\0b", 1, lambda c: c, lambda b: b))


@given(st.text(max_size=200))
def test_literals_round_trip(s):
    escaped = text.escape_literal(s)
    assert escaped.isascii() and "\n" not in escaped
    assert text.unescape_literal(escaped) == s


@given(st.integers(0, 2**33), st.integers(-23 * 60, 22 * 60))
@settings(max_examples=50)
def test_rfc2822_round_trip(seconds, minutes):
    assert text.parse_rfc2822(text.format_rfc2822(seconds, minutes * 60)) == (seconds, minutes * 60)


def test_rfc2822_column_equals_python(spark):
    rows = [(1518430830, 0), (0, 5400), (951782400, -12600), (4102444799, 3600)]
    got = spark.createDataFrame(rows, "s long, o int").select(text.rfc2822("s", "o").alias("x")).collect()
    assert [r["x"] for r in got] == [text.format_rfc2822(s, o) for s, o in rows]


@pytest.mark.parametrize(("ref", "kind", "remote", "branch"), [("HEAD", "head", None, None), ("master", "local", None, "master"), ("origin/é_1", "remote", "origin", "é_1"), ("a/b/c", None, None, None), ("", None, None, None), ("a b", None, None, None)])
def test_references(spark, ref, kind, remote, branch):
    got = spark.createDataFrame([(ref,)], "r string").select(text.parse_ref("r").alias("p")).first()["p"]
    assert (tuple(got) if got else (None, None, None)) == (kind, remote, branch)
    if kind is None:
        with pytest.raises(ValueError):
            text.ref_parts(ref)
    else:
        assert text.ref_parts(ref) == (kind, remote, branch)


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.py", "a.py", True), ("*.py", "d/a.py", False), ("**/*.py", "d/e/a.py", True), ("**/*.py", "a.py", True), ("d/**", "d/e/f", True), ("[!a]?", "bc", True), ("{x,yy}.t", "yy.t", True), ("a+b", "aab", False)])
def test_globs(spark, glob, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(text.matches_glob("p", glob).alias("m")).first()["m"] is hit


def test_paths(spark):
    row = spark.createDataFrame([("/a//b/c",)], "p string").select(text.split_path("p").alias("p")).select("p", text.strip_base(F.col("p"), ["a"]).alias("s"), F.hex(text.encode_path("p")).alias("e")).first()
    assert row["p"] == ["a", "b", "c"] and row["s"] == ["b", "c"] and bytes.fromhex(row["e"]) == b"1:a,1:b,1:c,"
    with pytest.raises(Exception, match="leaves its root"):
        spark.createDataFrame([(["a", ".."],)], "p array<string>").select(text.guarded("p")).collect()
    with pytest.raises(Exception, match="not a digest"):
        spark.createDataFrame([("zz",)], "h string").select(binary.parse_digest("h")).collect()


INODE = "struct<timestamp_ns: bigint, generation: bigint, number: bigint, version: bigint, ctime_ns: bigint, mtime_ns: bigint>"


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        ((9, 0, 1, None, 5, 5), (12, 0, 1, None, 5, 5), True),
        ((9, 0, 1, None, 5, 5), (12, 0, 2, None, 5, 5), False),
        ((9, 0, 1, None, 5, 5), (12, 0, 1, None, 5, 6), False),
        ((5, 0, 1, None, 5, 5), (12, 0, 1, None, 5, 5), None),
        ((5, 0, 1, None, 5, 5), (12, 0, 1, None, 6, 5), False),
        ((5, 0, 1, 7, None, None), (5, 0, 1, 7, None, None), True),
        ((5, 0, 1, 7, None, None), (5, 0, 1, 8, None, None), False),
        ((5, 0, 1, 7, None, None), (9, 0, 1, None, 5, 5), None),
    ],
)
def test_inode_unchanged(spark, old, new, expected):
    df = spark.createDataFrame([(old, new)], f"o {INODE}, n {INODE}")
    assert df.select(state.inode_unchanged(F.col("o"), F.col("n")).alias("u")).first()["u"] is expected
