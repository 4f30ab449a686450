"""Bit filters of hashes: which of many rows a join can need, told in the tasks from at most MAX_BITS bits.

A filter never stops a hash of its set; what it lets through wrongly is dropped by the join that follows. Its size is bounded
whatever the set's: beyond about four million hashes it only stops less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BITS = 1 << 26


def _slots(t: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(n_bits - 1)
    return (t & mask).astype(np.int64), (t >> np.uint64(32) & mask).astype(np.int64)


def passes(bits: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b = _slots(t, 8 * len(bits))
    return (bits[a >> 3] >> (a & 7).astype(np.uint8) & bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def bit_filter(of: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bytes of a filter for the distinct hashes of(t long): about 16 bits each, max_bits at most."""
    n = of.count()
    n_bits = min(max_bits, max(1 << 16, 1 << (16 * n).bit_length()))
    chunk = min(n_bits, 1 << 19)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64), n_bits)))
            yield pa.RecordBatch.from_arrays([pa.array(slots // chunk), pa.array(slots % chunk)], ["chunk", "slot"])

    def fill(group: pa.Table) -> pa.Table:
        held = np.zeros(chunk, np.uint8)
        held[group["slot"].to_numpy()] = 1
        return pa.table({"chunk": group["chunk"][:1], "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    # distinct: a chunk's group has no more rows than the chunk has bits.
    rows = of.mapInArrow(place, "chunk long, slot long").distinct().groupBy("chunk").applyInArrow(fill, "chunk long, bits binary").collect()
    bits = np.zeros(n_bits // 8, np.uint8)
    for row in rows:
        at = row["chunk"] * chunk // 8
        bits[at : at + chunk // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits
