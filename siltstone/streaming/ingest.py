"""Streaming ingestion: chunking byte streams as they arrive, and storing objects batch by batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions.digest import NATIVE, object_digest
from siltstone.operators.chunk import Parameters, candidates, choose
from siltstone.sources.store import Store

CHUNK = "stream string, ordinal long, start long, end long, blob binary"


def advance(state: tuple[int, int, bytes], data: bytes, p: Parameters, last: bool) -> tuple[tuple[int, int, bytes], list[tuple[int, int, int, bytes]]]:
    """Feed bytes to an open chunk: the new state (ordinal, start, open bytes) and the finished (ordinal, start, end, blob).

    Cuts depend only on the bytes since the last cut, so the open chunk is all the state there is.  The open
    bytes held no cut, so only the window before the new ones is looked at again.
    """
    ordinal, start, held = state
    before = np.frombuffer(held[-p.window :], np.uint8)
    ends = candidates(np.frombuffer(data, np.uint8), p, before) + len(held)
    cuts = choose(ends[ends % p.stride == 0], p.window)
    held += data
    out = []
    ranges = list(zip([0, *cuts], [*cuts, len(held)], strict=True))
    whole = ranges if last and (ranges[-1][1] > ranges[-1][0] or not (ordinal or ranges[:-1])) else ranges[:-1]
    for a, b in whole:
        out.append((ordinal, start + a, start + b, held[a:b]))
        ordinal += 1
    done = whole[-1][1] if whole else 0
    return (ordinal, start + done, held[done:]), out


def chunk_stream(arrivals: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Chunks of unbounded streams from rows (stream, seq, data, last).

    Rows of a stream arrive in order of seq over the micro-batches; within one
    they are sorted.  A row with ``last`` closes its stream and gives the rest.
    """

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, b"")
        now = (now[0], now[1], bytes(now[2]))
        rows = pd.concat(list(frames)).sort_values("seq")
        out, closed = [], False
        waiting = []
        for data, last in zip(rows["data"], rows["last"], strict=True):
            waiting.append(bytes(data or b""))
            if last:
                now, found = advance(now, b"".join(waiting), p, True)
                out, waiting, closed = out + found, [], True
        if waiting:
            now, found = advance(now, b"".join(waiting), p, False)
            out += found
        if closed:
            state.remove()
        else:
            state.update(now)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["stream", "ordinal", "start", "end", "blob"])

    return arrivals.groupBy("stream").applyInPandasWithState(run, CHUNK, "ordinal long, start long, held binary", "append", GroupStateTimeout.NoTimeout)


def store_chunks(chunks: DataFrame, store: Store, checkpoint: str, hash_name: str = NATIVE):
    """Start a query that puts finished chunks into a store; a repeated batch adds nothing, since puts are idempotent."""

    def put(batch: DataFrame, _: int) -> None:
        smalls = batch.select(object_digest(F.col("blob"), None, hash_name).alias("digest"), F.lit(hash_name).alias("hash_name"), "blob", F.octet_length("blob").cast("long").alias("blob_len"), F.array().cast("array<binary>").alias("refs"))
        store.put(smalls)

    return chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
