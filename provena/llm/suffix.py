"""Exact substring deduplication: bytes covered by a 200-byte string that occurs elsewhere are removed.

The suffixes of a text that matter are sampled without loss. Every window of LENGTH bytes has one anchor, the
leftmost of its GRAM-byte grams with the least hash. Equal windows have equal anchors at equal
places, so only anchors whose gram occurs twice in the corpus can stand in repeated windows; the others are
dropped after counting grams over all documents. What an anchor owns is a segment, the union
of its windows. It is keyed by the suffix from the anchor on, then its left context backwards.

Keys are sorted by a distributed merge sort that knows common prefixes. Tasks sort the keys of their
documents into runs, collapse equal ones, and front-code the runs (shared prefix length and rest)
before the exchange. A key that is in a run twice is repeated: the task says so itself and sends the key without its places, so
that a passage held by a third of all documents is one entry a run. Each reducer merges its runs with a loser tree whose nodes
keep the length of the prefix shared with the last winner: unequal lengths decide without looking at a byte, equal ones
compare from there on. A key equal to the one before is a repeated segment.

Different keys that share the gram are neighbours, and the prefixes known from the merge make them a tree by right context. Its
branches are joined from the deepest up; a branch keeps its segments in the order of their left contexts, and each segment of
the smaller branch meets only its two neighbours in the larger one. No other segment shares more to both sides, so all shared
windows of n segments are found with about n log n comparisons, and windows are never listed one by one.

A group is one task's, so a gram with more than HOT occurrences is dealt by the whole key instead. The windows of its segments are
counted by their 128-bit content hash in an aggregation, which splits and pre-aggregates whatever a gram holds.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows that repeat id and
text are occurrences of each other; matches never cross documents; the remaining bytes need not be
valid UTF-8 and are given as bytes; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import as_bytes, materialise

LENGTH = 200
GRAM = 32
HOT = 1 << 16
BUFFER = 4 << 20
RUN_BYTES = 48 << 20
END = b"\xff"  # between right and left context; no byte of UTF-8

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of `gram` (a power of two) bytes."""
    h = TABLE[data]
    step, power = 1, BASE
    while step < gram:
        h = h[:-step] * np.uint64(power) + h[step:]
        power = power * power % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def owned(data: np.ndarray, stops: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first window, number of windows) per segment of the texts that end at stops."""
    grams = length - gram + 1
    if len(data) < length:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    h = gram_hashes(data, gram)
    place = np.uint64(24)
    low = (h >> place << place) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= grams:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < grams:
        low = np.minimum(low[: -(grams - span)], low[grams - span :])
    anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(anchor), dtype=np.int64)
    text = np.searchsorted(stops, starts, side="right")
    fits = starts + length <= stops[text]
    new = np.empty(len(anchor), dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    sizes = np.add.reduceat(fits, first)
    first, sizes = first[sizes > 0], sizes[sizes > 0]
    return h[anchor[first]], anchor[first], first, sizes


def _buffers(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, slice); long texts are cut into slices that overlap by a window."""
    held, size = [], 0
    for k, data in enumerate(texts):
        for at in range(0, max(1, len(data) - length + 1), BUFFER):
            part = data[at : at + BUFFER + length - 1]
            if len(part) < length:
                continue
            held.append((k, at, part))
            size += len(part)
            if size >= BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(keyed: DataFrame) -> DataFrame:
    """(h, d, n, pack) for each segment of keyed(d, n, text); pack holds anchor, left width and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for held in _buffers(as_bytes(batch.column(2)), LENGTH):
                stops = np.cumsum([len(x) for _, _, x in held])
                h, anchor, first, count = owned(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), stops)
                at = np.searchsorted(stops, first, side="right")
                offset = np.array([o for _, o, _ in held]) - np.concatenate([[0], stops[:-1]])
                k = np.array([k for k, _, _ in held])[at]
                pack = (anchor + offset[at]) << 17 | (anchor - first) << 9 | count << 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d[k]), pa.array(n[k]), pa.array(pack)], names=["h", "d", "n", "pack"])

    return keyed.select("d", "n", "text").where(F.col("n") >= LENGTH).mapInArrow(run, "h long, d long, n int, pack long")


def unpack(pack: int) -> tuple[int, int, int, bool]:
    """(anchor, bytes left of it in the first window, windows, hot)"""
    return pack >> 17, pack >> 9 & 255, pack >> 1 & 255, bool(pack & 1)


def key_of(data: bytes, anchor: int, left: int, windows: int) -> bytes:
    return data[anchor : anchor - left + windows - 1 + LENGTH] + END + data[anchor - left : anchor][::-1]


def shared_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, of which `at` bytes are known."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    lo, hi = at, end - 1
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


PACKED = ["lcps", "sizes", "rests", "counts", "hot", "d", "n", "starts", "own_d", "own_n", "own_lo", "own_hi"]
RUN = "part int, " + ", ".join(f"{c} binary" for c in PACKED)


def last_window(key: bytes) -> int:
    """Number of the last window of a key's segment."""
    return len(key) - 1 - LENGTH


def front_code(part: int, entries: list[tuple[bytes, bool, list[tuple[int, int, int]]]]) -> dict:
    """One run: sorted distinct keys. A key with one occurrence (d, n, first window) keeps it; the windows of one with
    several are repeated, which the run's own spans say, and two stand for its count."""
    lcps, rests, last = [], [], b""
    lone, own = [], []
    for key, _, found in entries:
        lcp = shared_prefix(last, key)
        lcps.append(lcp)
        rests.append(key[lcp:])
        last = key
        if len(found) == 1:
            lone.append(found[0])
        else:
            own += [(d, n, start, start + last_window(key)) for d, n, start in found]
    d, n, starts = zip(*lone, strict=True) if lone else ((), (), ())
    own_d, own_n, own_lo, own_hi = zip(*own, strict=True) if own else ((), (), (), ())
    long = lambda x: np.array(x, np.int64).tobytes()
    return {
        "part": part, "lcps": np.array(lcps, np.uint16).tobytes(), "sizes": np.array([len(r) for r in rests], np.uint16).tobytes(), "rests": b"".join(rests),
        "counts": np.array([min(2, len(f)) for _, _, f in entries], np.uint8).tobytes(), "hot": np.array([x for _, x, _ in entries], np.uint8).tobytes(),
        "d": long(d), "n": np.array(n, np.int32).tobytes(), "starts": long(starts),
        "own_d": long(own_d), "own_n": np.array(own_n, np.int32).tobytes(), "own_lo": long(own_lo), "own_hi": long(own_hi),
    }


def read_run(row: dict) -> Iterator[tuple[int, bytes, bool, int, tuple[int, int, int] | None]]:
    """(prefix shared with the key before, key, hot, one or two occurrences, the place of a lone one) in order."""
    d, n, starts = np.frombuffer(row["d"], np.int64), np.frombuffer(row["n"], np.int32), np.frombuffer(row["starts"], np.int64)
    at = seen = 0
    key, rests = b"", row["rests"]
    columns = (np.frombuffer(row[c], t).tolist() for c, t in (("lcps", np.uint16), ("sizes", np.uint16), ("counts", np.uint8), ("hot", np.uint8)))
    for lcp, size, count, hot in zip(*columns, strict=True):
        key = key[:lcp] + rests[at : at + size]
        at += size
        if count == 1:
            yield lcp, key, bool(hot), 1, (int(d[seen]), int(n[seen]), int(starts[seen]))
            seen += 1
        else:
            yield lcp, key, bool(hot), 2, None


class LoserTree:
    """Merge of sorted runs. A node keeps the loser and the prefix it shares with the key that beat it."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs = runs
        self.heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.lcp = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = self._play(a, b)
        self.losers[node] = lose
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); both lcps are against the same key before, the loser's then against the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.lcp[a], self.lcp[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[1], y[1]
        p = shared_prefix(s, t, p)
        if p == len(s) or p < len(t) and s[p] < t[p]:
            self.lcp[b] = p
            return a, b
        self.lcp[a] = p
        return b, a

    def __iter__(self) -> Iterator[tuple]:
        """The heads of all runs in order, each with the prefix shared with the key before it in that order."""
        while (head := self.heads[win := self.winner]) is not None:
            yield self.lcp[win], *head[1:]
            self.heads[win] = following = next(self.runs[win], None)
            self.lcp[win] = following[0] if following else 0
            node = (win + self.size) >> 1
            while node:
                rival = self.losers[node]
                best, worst = self._play(win, rival)
                self.losers[node] = worst
                win = best
                node >>= 1
            self.winner = win


RUN_SCHEMA = pa.schema([("part", pa.int32())] + [(c, pa.binary()) for c in PACKED])


def sorted_runs(parts: int):
    """Batches of (packs, d, n, text) to front-coded runs, one a partition whenever RUN_BYTES are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            by_part: dict[int, list] = {}
            for key in sorted(held):
                hot, found = held[key]
                part = xxhash.xxh64_intdigest(key if hot else key[:GRAM]) % parts
                by_part.setdefault(part, []).append((key, hot, found))
            rows = [front_code(p, entries) for p, entries in by_part.items()]
            return pa.RecordBatch.from_pylist(rows, schema=RUN_SCHEMA)

        for batch in batches:
            for packs, d, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(3)), strict=True):
                for pack in packs:
                    anchor, left, windows, hot = unpack(pack)
                    key = key_of(data, anchor, left, windows)
                    entry = held.get(key)
                    if entry is None:
                        held[key] = (hot, [(d, n, anchor - left)])
                        size += len(key) + 300
                    else:
                        entry[1].append((d, n, anchor - left))
                        size += 100
                    if size > RUN_BYTES:
                        yield flush()
                        held, size = {}, 0
        if held:
            yield flush()

    return run


MERGED = "d long, n int, lo long, hi long, w binary, c int"


class _Rows:
    """Rows of MERGED: spans of repeated windows, or single windows still to be counted."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.tables: list[pa.Table] = []

    def span(self, place: tuple[int, int, int], lo: int, hi: int) -> None:
        self.rows.append((place[0], place[1], place[2] + lo, place[2] + hi, None, None))

    def own(self, row: dict) -> None:
        """The spans that a run knows itself."""
        columns = [np.frombuffer(row[c], np.int32 if c == "own_n" else np.int64) for c in ("own_d", "own_n", "own_lo", "own_hi")]
        n = len(columns[0])
        self.tables.append(pa.table([*map(pa.array, columns), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names=NAMES))

    def windows(self, key: bytes, place: tuple[int, int, int] | None) -> None:
        """Every window of a segment, with its place if it has but one."""
        right, _, left = key.partition(END)
        data = left[::-1] + right
        for i in range(len(data) - LENGTH + 1):
            w = xxhash.xxh3_128_digest(data[i : i + LENGTH])
            if place is None:
                self.rows.append((None, None, None, None, w, 2))
            else:
                self.rows.append((place[0], place[1], place[2] + i, place[2] + i, w, 1))

    def table(self) -> pa.Table:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * 6
        return pa.concat_tables([*self.tables, pa.table([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=NAMES)])


NAMES = ["d", "n", "lo", "hi", "w", "c"]


def settle(group: list[tuple[int, bytes, tuple[int, int, int] | None]], rows: _Rows) -> None:
    """Spans of the windows that a gram's different segments share: group has, in order, the prefix shared with the one
    before, the key, and the segment's place (None: it is repeated whole and only a partner for others).

    Neighbouring branches are joined by falling shared prefix. A later, shallower meeting shares less to the right, so it
    only counts where it shares more to the left than all before.
    """
    n = len(group)
    rights, lefts = [], []
    for _, key, _ in group:
        right, _, left = key.partition(END)
        rights.append(len(right))
        lefts.append(left)
    order = sorted(range(n), key=lefts.__getitem__)
    branch: list[list[int] | None] = [None] * n
    for rank, k in enumerate(order):
        branch[k] = [rank]
    best, parent = [-1] * n, list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def meet(i: int, j: int, depth: int) -> None:
        left, right = shared_prefix(lefts[i], lefts[j]), min(depth, rights[i], rights[j])
        if left + right >= LENGTH:
            for k in (i, j):
                if left > best[k]:
                    best[k] = left
                    if (place := group[k][2]) is not None:
                        rows.span(place, len(lefts[k]) - left, len(lefts[k]) + right - LENGTH)

    for k in sorted(range(1, n), key=lambda k: -group[k][0]):
        a, b = root(k - 1), root(k)
        if len(branch[a]) > len(branch[b]):
            a, b = b, a
        small, large = branch[a], branch[b]
        for x in small:
            at = bisect_left(large, x)
            for y in large[max(0, at - 1) : at + 1]:
                meet(order[x], order[y], group[k][0])
        if 16 * len(small) < len(large):
            for x in small:
                large.insert(bisect_left(large, x), x)
        else:
            branch[b] = sorted(large + small)  # two ascending parts: one pass
        branch[a], parent[a] = None, b


def merge_part(table: pa.Table) -> pa.Table:
    rows = _Rows()
    group: list[tuple[int, bytes, tuple | None]] = []

    def close() -> None:
        nonlocal group
        if len(group) > 1:
            settle(group, rows)
        group = []

    def different(lcp: int, key: bytes, hot: bool, count: int, places: list) -> None:
        """The next key, with all its occurrences."""
        for place in places if count > 1 else ():
            rows.span(place, 0, last_window(key))
        lone = places[0] if count == 1 else None
        if hot:
            rows.windows(key, lone)
            return
        if lcp < GRAM:
            close()
        group.append((lcp, key, lone))

    runs = table.to_pylist()
    for row in runs:
        rows.own(row)
    held: list | None = None
    for lcp, key, hot, count, place in LoserTree([read_run(r) for r in runs]):
        if held is None or lcp < len(key) or lcp < len(held[1]):
            if held is not None:
                different(*held)
            held = [lcp, key, hot, 0, []]
        held[3] += count
        if place is not None:
            held[4].append(place)
    if held is not None:
        different(*held)
    close()
    return rows.table()


def keyed_docs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), own.alias("text")).select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("d"), F.octet_length("text").alias("n")
    )


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(d, n, spans): the first and last windows of runs of repeated windows, packed as first << 32 | last."""
    key = ["d", "n"]
    sampled = materialise(anchors(keyed), "anchors")
    # Written first: a join with a table is one that AQE may split where a gram is hot, a join with an aggregation is not.
    counted = materialise(sampled.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "grams")
    again = sampled.join(counted, "h").select(*key, (F.col("pack") + (F.col("c") > HOT).cast("int")).alias("pack"))
    wanted = materialise(again.groupBy(*key).agg(F.collect_set("pack").alias("packs")), "wanted")
    total = wanted.agg(F.coalesce(F.sum(F.size("packs")), F.lit(0)).alias("n")).first()["n"]
    parts = max(8, total * 400 // (8 << 20))

    runs = keyed.join(wanted, key).select("packs", *key, "text").mapInArrow(sorted_runs(parts), RUN)
    merged = materialise(runs.groupBy("part").applyInArrow(merge_part, MERGED), "merged")
    windows = merged.where("w is not null")
    twice = materialise(windows.groupBy("w").agg(F.sum("c").alias("times")).where("times > 1").select("w"), "repeated-windows")
    found = windows.where("d is not null").select(*key, "lo", "hi", "w").join(twice, "w").select(*key, "lo", "hi")
    spans = merged.where("w is null").select(*key, "lo", "hi").unionByName(found)
    return spans.groupBy(*key).agg(F.collect_set(F.shiftleft("lo", 32).bitwiseOR(F.col("hi"))).alias("spans"))


CUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def cut(text: Column, spans: Column, keep_bytes: bool) -> Column:
    @F.arrow_udf(CUT)
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in CUT.names]
        for data, packed in zip(as_bytes(texts), spans.to_pylist(), strict=True):
            removed: list[list[int]] = []
            for lo, hi in sorted((p >> 32, (p & 0xFFFFFFFF) + LENGTH) for p in packed or ()):
                if removed and lo <= removed[-1][1]:
                    removed[-1][1] = max(hi, removed[-1][1])
                else:
                    removed.append([lo, hi])
            at, left = 0, []
            for lo, hi in removed:
                left.append(data[at:lo])
                at = hi
            left.append(data[at:])
            rest = b"".join(left)
            row = (len(data), len(data) - len(rest), len(removed), hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], CUT.names)

    return run.asNondeterministic()(text, spans)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs."""
    keyed = keyed_docs(docs, doc_id, text)
    joined = keyed.join(repeated_spans(keyed), ["d", "n"], "left")
    return joined.select("doc_id", cut(F.col("text"), F.col("spans"), keep_bytes).alias("c")).select("doc_id", "c.*")
