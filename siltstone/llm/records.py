"""Token ids as length-delimited binary records with checksums and a separate offset index.

A shard ``<name>.rec`` is a run of frames, each for one document::

    u64 n | u32 masked crc32 of those 8 bytes | n bytes | u32 masked crc32 of those n bytes

all little-endian.  The n bytes are a flag byte (1: ids take 4 bytes, else 2;
2: the doc_id is null), the i64 doc_id, the u32 number of ids, and the ids.
Masking rotates a checksum by 15 bits and adds a constant, so that a file of
checksums does not check itself.  ``<name>.idx`` is the magic ``SILTIDX1``, the
u64 number of records, then as many u64 frame offsets and one more, the file's
end: any record can be read alone, in any order.

Shards hold ascending ranges of doc_id and ascending doc_ids within (nulls
first; equal doc_ids in any order, over several shards if there are many).  Each
task writes under a fresh name and the manifest, a table with a row for each
shard, lists what successful tasks wrote, so a lost or repeated task leaves
nothing that a reader sees.  Beyond ``PLENTY`` shards they become larger, up to
``LARGEST`` times, so that a large input has a bounded number of them.

Defined results: a null or empty text is the end id alone; repeated rows are
written each; an empty table gives an empty manifest.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.packing import END_ID, end_marked
from siltstone.llm.shared import file_system, narrow_batches, new_path, partitions_for, write_table
from siltstone.llm.tokens import encoder

MASK = 0xA282EAD8
_MAGIC = b"SILTIDX1"
PLENTY, LARGEST = 8192, 32
_HEAD = struct.Struct("<BqI")
MANIFEST = "shard long, path string, records long, tokens long, bytes long, low long, high long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return _HEAD.pack(wide | 2 * (doc_id is None), doc_id or 0, len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = _HEAD.unpack_from(payload)
    return None if flags & 2 else doc_id, np.frombuffer(payload, "<u4" if flags & 1 else "<u2", n, _HEAD.size)


def write_records(docs: DataFrame, tokenizer_path: str, folder: str | None = None, shard_bytes: int = 16 << 20, end_id: int = END_ID) -> DataFrame:
    """Encode every text and write it; returns the manifest, one row per shard; ``shard`` has their order by doc_id.

    ``shard_bytes``: stored input bytes per shard.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    folder = folder or new_path(spark, "records")
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name, enc = f"shard-{uuid.uuid4().hex}", encoder(tokenizer_path)
        offsets, tokens, low, high = [0], 0, None, None
        with fs.open_output_stream(f"{base}/{name}.rec") as out:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for slab, e in enc.encode(batch.column(1)):
                    ids, begins = end_marked(e.ids, e.first, end_id)
                    frames = [frame(serialize(doc_ids[slab.first + k], ids[begins[k] : begins[k + 1]])) for k in range(len(slab))]
                    out.write(b"".join(frames))
                    for f in frames:
                        offsets.append(offsets[-1] + len(f))
                    tokens += len(ids)
                known = [x for x in doc_ids if x is not None]
                if known:
                    low, high = known[0] if low is None else low, known[-1]
        if len(offsets) == 1:
            fs.delete_file(f"{base}/{name}.rec")
            return
        with fs.open_output_stream(f"{base}/{name}.idx") as out:
            out.write(_MAGIC + struct.pack("<Q", len(offsets) - 1) + np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "path": f"{folder}/{name}", "records": len(offsets) - 1, "tokens": tokens, "bytes": offsets[-1], "low": low, "high": high}])

    shards = partitions_for(docs, shard_bytes)
    if shards > PLENTY:
        shards = max(PLENTY, partitions_for(docs, LARGEST * shard_bytes))
    salt = F.xxhash64(F.monotonically_increasing_id())  # deals the rows of a frequent doc_id
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", salt.alias("salt")).repartitionByRange(shards, "doc_id", "salt").sortWithinPartitions("doc_id")
    return write_table(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")


def _frames(stream, offsets: np.ndarray, block: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
    """Payloads in file order, verified, read in blocks."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        stream.seek(int(offsets[i]))
        data = stream.read(int(offsets[j] - offsets[i]))
        for k in range(i, j):
            yield k, _payload(data[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]])
        i = j


def _payload(data: bytes) -> bytes:
    n, head = struct.unpack_from("<QI", data)
    if masked(data[:8]) != head or len(data) != n + 16 or struct.unpack_from("<I", data, n + 12)[0] != masked(data[12 : n + 12]):
        raise ValueError("a record's checksum or length is wrong")
    return data[12 : n + 12]


def read_index(path: str) -> np.ndarray:
    fs, at = file_system(path)
    with fs.open_input_file(f"{at}.idx") as f:
        data = f.read()
    if data[:8] != _MAGIC or len(data) != 8 * (3 + struct.unpack_from("<Q", data, 8)[0]):
        raise ValueError(f"{path}.idx is no index")
    return np.frombuffer(data, "<u8", offset=16).astype(np.int64)


def read_some(path: str, which: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of a shard by number, in the order asked for."""
    offsets = read_index(path)
    fs, at = file_system(path)
    out = []
    with fs.open_input_file(f"{at}.rec") as f:
        for k in which:
            f.seek(int(offsets[k]))
            out.append(deserialize(_payload(f.read(int(offsets[k + 1] - offsets[k])))))
    return out


def read_records(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every record of the shards: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    start: the ids before it in the order of the manifest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["before"].to_pylist(), strict=True):
                fs, at = file_system(path)
                rows: list[tuple] = []
                with fs.open_input_file(f"{at}.rec") as f:
                    for _, payload in _frames(f, read_index(path)):
                        doc_id, ids = deserialize(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] * with_ids)))
                        start += len(ids)
                        if len(rows) >= 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    in_order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, of which there are a bounded number
    listed = write_table(manifest.select("path", F.coalesce(F.sum("tokens").over(in_order), F.lit(0)).alias("before")), "starts")
    shards = listed.count()
    tasks = max(1, min(shards, max(4 * spark.sparkContext.defaultParallelism, shards // 16)))
    return listed.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
