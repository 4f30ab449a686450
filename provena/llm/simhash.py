"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

The fingerprint is cut into blocks. Two fingerprints that differ in d bits agree in at least
blocks - d of them, so close pairs share the bits of some choice of that many blocks. Fingerprints
are joined on these bits and pairs are verified. Identical fingerprints are one node throughout, so
copies are never paired.

A bucket with more than `dense` fingerprints is not paired. Its fingerprints are linked through
midpoints instead: two fingerprints at distance d <= 4 have a common midpoint at distance <= 2 from
both, and any two that share such a midpoint are at distance <= 4. Each fingerprint of a large
bucket emits its 2,081 neighbours within two bits, and each midpoint links its fingerprints to the
least of them: no link is lost and rows grow with the number of fingerprints, not of pairs.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows share a component; null ids take part in
links but are never a component's id unless it has no other; of equal fingerprints the smallest id counts; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import as_bytes, materialise, partitions
from provena.operators.graph import components
from provena.sources.shared import drop, release, tables_of

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 8
DENSE = 32


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is set if set in over half of the shingles' XXH64 (seed 42)."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[shingle - 1 :] - 1).tolist()
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(d, shingle) for d in as_bytes(texts)], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return run.asNondeterministic()(text.cast("string"))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _long_array(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'bigint({_signed(v)})' for v in values)})")


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of nodes(fp long) that connect all pairs within max_bits.

    Every pair outside of large buckets is given; within these, enough links to connect them.
    """
    masks = _block_masks(blocks)
    chosen = list(combinations(range(blocks), blocks - max_bits))
    #: Of all the choices of blocks that a pair shares, only the first counts: blocks skipped before its last must differ.
    skipped = [[masks[j] for j in range(c[-1]) if j not in c] for c in chosen]
    width = max(map(len, skipped))
    gaps = F.array(*[_long_array(s + [-1] * (width - len(s))) for s in skipped])
    pick = F.posexplode(_long_array([sum(masks[j] for j in c) for c in chosen])).alias("choice", "mask")
    # One row a fingerprint is small and would be gathered into few tasks; each row makes len(chosen) keys. Dealt
    # without a key: a repartition by fp is what the grouping already did, and Spark leaves it out.
    spread = nodes.select("fp").repartition(partitions(nodes.sparkSession))
    keys = spread.select("fp", pick).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    shared = keys.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes rows after an explode as those before it and would broadcast them: what follows joins by merging, nothing goes through the driver.
    members = materialise(keys.join(shared.hint("merge"), ["choice", "bits"]), "buckets")

    small = members.where(F.col("n") <= dense).drop("n")
    left, right = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        left.join(right.hint("merge"), ["choice", "bits"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits))
        .where(F.forall(gaps[F.col("choice")], lambda g: differ.bitwiseAND(g) != 0))
        .select("a", "b")
    )

    half = max_bits // 2
    if max_bits % 2:
        raise ValueError("midpoints need an even number of bits")
    flips = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)]
    crowd = members.where(F.col("n") > dense).select("fp").distinct()
    dealt = crowd.repartition(partitions(nodes.sparkSession))  # few rows by now, but each makes len(flips)
    around = dealt.select("fp", F.explode(_long_array(flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    met = around.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select("mid", "b")
    through = around.join(met.hint("merge"), "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(through)


def classes(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """(fp, label, component_id) of the distinct fingerprints of prints(doc_id, fp long): component_id is the smallest doc_id
    reachable over links, label the component's least fingerprint, which is never null."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    with tables_of(prints.sparkSession) as made:
        labels = components(near_links(nodes, max_bits, blocks, dense))
        joined = nodes.join(labels.hint("merge"), nodes.fp == labels.id, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    # Both written first: a join of tables is one that AQE may split where a component is large, a join with an aggregation is not.
    grouped = materialise(joined, "nodes")
    release(prints.sparkSession, made)
    class_ids = materialise(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    found = materialise(grouped.join(class_ids.hint("merge"), "label").select("fp", "label", "component_id"), "classes")
    drop(grouped, class_ids)
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp long, label, component_id) of every row, as classes."""
    prints = materialise(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("fp")), "prints")
    return prints.join(classes(prints, max_bits, blocks, dense).hint("merge"), "fp").select("doc_id", "fp", "label", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
