"""MinHash near-duplicates by tensored banding: table keys are pairs from two small collections of hashes.

A document's set is that of the XXH64 hashes (seed 42) of its word shingles, lower-cased. Each of the two collections has TABLES
keys of WIDTH minima. The key of table (i, j) is the i-th key of the first and the j-th of the second, so 2 * 24 * 3 = 144 minima stand
for 576 tables of 6. Two sets of similarity s agree somewhere in a collection with probability 1 - (1 - s^3)^24: a pair at 0.8 is missed with
a probability of about 7 in 100 million, a closer pair with less. A pair shares a table if and only if it agrees in both collections, so no
table keys are made: rows meet by the keys of the first collection and carry those of the second, and documents without a shared key on both sides
are left out; a bit filter of bounded size tells.

Equal sets are one node throughout. Candidates are verified on the full sets (9 * shared >= 4 * (n_a + n_b), that is a Jaccard similarity of 4/5
or more). First, in rounds, each node meets one node of another component with which it shares a key of a collection: that connects most of a
large group of near copies, with 48 keys a node instead of 576. Rounds go on while keys of many nodes still hold several components and would
make more pairs than there are keys. Then the nodes whose keys on both sides are shared with other components meet, and every pair that agrees
in both collections, is not connected yet, and whose sizes and parity bitmaps allow the similarity, is made once and verified. So no candidate is
lost, and a large group of near copies is not paired with itself.

Defined results: a null text, an empty one or one without words has an empty set: linked with nothing, a component of its own. A
text of fewer words than a shingle is one shingle. Repeated rows share a component; null ids take part in links, but are a component's
id only where it has no other. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.bits import bit_filter, passes
from provena.llm.common import as_bytes, materialise
from provena.llm.sets import BITS, shingle_set, similar_links
from provena.operators.graph import components
from provena.sources.shared import drop

SHINGLE = 4
TABLES = 24
WIDTH = 3
#: After the first round only keys that more nodes than this share go through rounds, of which there are so many at most.
DENSE = 32
ROUNDS = 3
#: Shingles whose minima are taken at once.
STEP = 512
LONGS = T.ArrayType(T.LongType())
SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("u", LONGS), T.StructField("v", LONGS), T.StructField("bitmap", LONGS)])


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


class Sketcher:
    """Keys of both collections of a set; each collection's key i is made of WIDTH minima of its own."""

    def __init__(self, tables: int = TABLES, width: int = WIDTH):
        n = 2 * tables * width
        self.tables, self.width = tables, width
        self.factors, self.turns, self.weights = _odd(n, 1), _odd(n, 2), _odd(width, 3)
        self.places = _odd(2 * tables, 4)

    def keys(self, found: np.ndarray) -> np.ndarray:
        """2 * tables keys of a set that is not empty: first those of one collection, then those of the other."""
        h = found.view(np.uint64)
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), STEP):
            part = (h[at : at + STEP, None] ^ self.turns) * self.factors
            np.minimum(least, part.min(axis=0), out=least)
        packed = (_mixed(least).reshape(-1, self.width) * self.weights).sum(axis=1, dtype=np.uint64)
        return _mixed(packed ^ self.places)


def sketch(text: Column, shingle: int = SHINGLE, tables: int = TABLES, width: int = WIDTH) -> Column:
    """(n, key, u, v, bitmap): size and 128-bit digest of the text's set, its keys in both collections, and its hashes' parities by 512 classes."""

    @F.arrow_udf(SKETCH)
    def run(texts: pa.Array) -> pa.Array:
        made, n, digest, u, v, bitmaps = Sketcher(tables, width), [], [], [], [], []
        for data in as_bytes(texts):
            found = shingle_set(data, shingle)
            keys = made.keys(found).view(np.int64) if len(found) else np.empty(0, np.int64)
            n.append(len(found))
            digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            u.append(keys[: len(keys) // 2])
            v.append(keys[len(keys) // 2 :])
            bitmaps.append(np.packbits((np.bincount((found & (BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64))
        longs = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), longs(u), longs(v), longs(bitmaps)], SKETCH.names)

    return run.asNondeterministic()(text.cast("string"))


def _kept(keys: Column, bits: np.ndarray) -> Column:
    """The keys of an array that the filter lets through."""

    @F.arrow_udf(LONGS)
    def run(held: pa.Array) -> pa.Array:
        sizes = np.diff(held.offsets.to_numpy())
        flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        kept = passes(bits, flat.view(np.uint64))
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat[kept]))

    return run.asNondeterministic()(keys)


class Verifier:
    """Verifies pairs (a, b) of nodes against the texts of rows(k, text), with figures from nodes(k, n, bitmap)."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, shingle: int):
        self.rows, self.nodes, self.shingle = rows, nodes, shingle

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and bitmaps allow the similarity; each hash of one set alone flips one bit."""
        of = lambda x: self.nodes.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"map_{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(PLAUSIBLE).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, as a written table."""
        return similar_links(pairs, self.rows, self.shingle)


APART = "aggregate(zip_with(map_a, map_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
PLAUSIBLE = f"5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b) and 9 * {APART} <= n_a + n_b"


def _labelled(keys: DataFrame, labels: DataFrame | None) -> DataFrame:
    """keys with l, the component of k."""
    if labels is None:
        return keys.withColumn("l", F.col("k"))
    return keys.join(labels.select(F.col("id").alias("k"), "label"), "k", "left").select(*keys.columns, F.coalesce("label", "k").alias("l"))


def _rounds(halves: DataFrame, verifier: Verifier, dense: int, rounds: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """(links, labels, open keys) after rounds over halves(h, k), the keys that nodes share: most of a crowd is connected by few pairs a node."""
    links, labels, goes_on = None, None, True
    for turn in range(rounds + 1):
        now = _labelled(halves, labels)
        now = now if labels is None else materialise(now, "labelled")
        member = F.struct("l", F.xxhash64("k", F.lit(turn)).alias("x"), "k")
        ends = now.groupBy("h").agg(F.min(member).alias("low"), F.max(member).alias("high"), F.count("*").alias("size")).where("low.l < high.l")
        ends = materialise(ends, "open-keys")
        if turn == rounds or not goes_on:
            break
        met = ends if turn == 0 else ends.where(F.col("size") > dense)
        n_open, squares = met.agg(F.count("*"), F.sum(F.col("size").cast("double") * F.col("size") / 2)).first()
        # Another round pays where the pairs of crowds that it may spare are more than the rows that it reads.
        if not n_open or turn and squares <= halves.count():
            break
        partner = F.when(F.col("l") > F.col("low.l"), F.col("low.k")).otherwise(F.col("high.k"))
        # The node that most of a node's keys offer.
        offers = now.join(met, "h").groupBy("k", partner.alias("with")).agg(F.count("*").alias("c"))
        one = offers.groupBy("k").agg(F.max(F.struct("c", F.xxhash64("with", F.lit(turn)).alias("x"), "with")).alias("p"))
        pairs = one.select(F.least("k", "p.with").alias("a"), F.greatest("k", "p.with").alias("b")).distinct()
        pairs = materialise(verifier.plausible(pairs), "round-pairs")
        found = verifier.links(pairs)
        # Nor does it pay where few pairs are similar.
        goes_on = turn == 0 or 4 * found.count() >= pairs.count()
        if labels is not None:
            drop(now)
        drop(ends, pairs)
        links = found if links is None else links.unionByName(found)
        labels = materialise(components(links), "labels")
    if labels is not None:
        drop(now)
    return links, labels, ends.select("h")


def _meetings(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of rows(k, l, n, bitmap, u, v) of two components that agree in both collections, if sizes and bitmaps allow the similarity.

    Rows meet by the first collection's keys and carry what they have of the second. A pair is made with the first key that both have, so none is made twice.
    """
    placed = rows.select("k", "l", "n", "bitmap", "v", "u", F.posexplode("u").alias("at", "h")).withColumn("earlier", F.slice("u", F.lit(1), F.col("at"))).drop("u", "at")
    of = lambda x: placed.select("h", F.col("k").alias(x), *[F.col(c).alias(f"{name}_{x}") for c, name in (("l", "l"), ("n", "n"), ("bitmap", "map"), ("v", "v"), ("earlier", "earlier"))])
    once = "arrays_overlap(v_a, v_b) and not arrays_overlap(earlier_a, earlier_b)"
    # By merging: Spark sizes rows after an explode as those before it and would broadcast them.
    return of("a").join(of("b").hint("merge"), "h").where(f"a < b and l_a <> l_b and {PLAUSIBLE} and {once}").select("a", "b")


def _connected(nodes: DataFrame, verifier: Verifier, dense: int, rounds: int) -> DataFrame | None:
    """(id, label) of the nodes(k, n, u, v, bitmap) that similar pairs connect; None if there are none."""
    halves = nodes.select("k", F.explode(F.concat("u", "v")).alias("h"))
    shared = materialise(halves.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
    passing = nodes.select("k", F.explode(_kept(F.concat("u", "v"), bit_filter(shared))).alias("h"))
    # The filter spares the exchange of keys of one node; the few that it lets through wrongly go by the join.
    held = materialise(passing.join(shared.hint("merge"), "h"), "halves")
    links, labels, apart = _rounds(held, verifier, dense, rounds)

    # Nodes with keys on both sides that several components still hold meet each other.
    bits = bit_filter(apart)
    kept = nodes.select("k", "n", "bitmap", _kept(F.col("u"), bits).alias("u"), _kept(F.col("v"), bits).alias("v")).where("size(u) > 0 and size(v) > 0")
    rows = materialise(_labelled(kept, labels), "open-rows")
    drop(shared, held, apart)
    rest = materialise(_meetings(rows), "rest")
    drop(rows)
    if rest.isEmpty():
        return labels
    more = verifier.links(rest)
    return components(more if links is None else links.unionByName(more))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, tables: int = TABLES, width: int = WIDTH, dense: int = DENSE, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs; component_id is the smallest doc_id reachable over links."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("k"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), "rows")
    marks = materialise(rows.select("k", "doc_id", sketch(F.col("text"), shingle, tables, width).alias("s")).select("k", "doc_id", "s.*"), "marks")
    classes = materialise(marks.where("n > 0").groupBy("key").agg(F.min("k").alias("k"), F.min("doc_id").alias("least")), "classes")
    nodes = materialise(marks.select("k", "n", "u", "v", "bitmap").join(classes.select("k"), "k", "left_semi"), "nodes")

    labels = _connected(nodes, Verifier(rows.select("k", "text"), nodes, shingle), dense, rounds)
    grouped = _labelled(classes, labels).select("key", "least", F.col("l").alias("label"))
    # Both written first: a join of tables is one that AQE may split where a component is large, a join with an aggregation is not.
    grouped = materialise(grouped, "grouped")
    least = materialise(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    of_key = materialise(grouped.join(least, "label").select("key", "component_id"), "of-key")
    out = marks.select("doc_id", "n", "key").join(of_key, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, row_number() OVER () AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, k, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS s
  FROM split
), classes AS (
  SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS (
  SELECT c, n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.c < b.c AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(c, r) AS (
  SELECT c, c FROM classes UNION SELECT reach.c, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), least AS (
  SELECT c, min(r) AS component_id FROM reach GROUP BY c
)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON classes.c = least.c
"""
