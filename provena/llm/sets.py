"""Sets of word shingles as hashes, and the check of pairs of texts on their full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.bits import bit_filter, passes
from provena.llm.common import as_bytes, materialise
from provena.sources.shared import drop

#: Classes of hashes by whose parity sets are told apart.
BITS = 512


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct signed hashes of the shingles."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[shingle - 1 :] - 1).tolist()
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64).view(np.int64))


def _let_through(hashed: Column, bits: np.ndarray) -> Column:
    @F.arrow_udf(T.BooleanType())
    def run(h: pa.Array) -> pa.Array:
        return pa.array(passes(bits, h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return run(hashed)


def _both_similar(a: Column, b: Column, shingle: int) -> Column:
    """Whether two texts' full sets have a Jaccard similarity of 4/5 or more."""

    @F.arrow_udf(T.BooleanType())
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last = [], (None, None)
        for x, y in zip(as_bytes(left), as_bytes(right), strict=True):
            if last[0] != x:
                last = (x, shingle_set(x, shingle))
            one, other = last[1], shingle_set(y, shingle)
            shared = len(one) + len(other) - len(np.union1d(one, other))
            out.append(9 * shared >= 4 * (len(one) + len(other)))
        return pa.array(out, pa.bool_())

    return run.asNondeterministic()(a, b)


def similar_links(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of keys of rows(k, text) whose full sets have a Jaccard similarity of 4/5 or more, as a written table.

    Texts are exchanged, not sets, which are larger, and only those of pairs: a bit filter of bounded size stops the others before the exchange.
    """
    pairs = materialise(pairs, "pairs")
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "wanted")
    bits = bit_filter(wanted.select(F.xxhash64("k")))
    texts = materialise(rows.where(_let_through(F.xxhash64("k"), bits)).join(wanted.hint("merge"), "k", "left_semi").select("k", "text"), "texts")
    of = lambda x: texts.select(F.col("k").alias(x), F.col("text").alias(f"text_{x}"))
    similar = pairs.join(of("b").hint("merge"), "b").join(of("a").hint("merge"), "a").where(_both_similar(F.col("text_a"), F.col("text_b"), shingle))
    found = materialise(similar.select("a", "b"), "links")
    drop(pairs, wanted, texts)
    return found
