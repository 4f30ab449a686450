"""Benchmark decontamination: documents that contain windows of benchmark items.

A prefix-filtered set join, done by Spark as a join of tables. A window is 13 consecutive words of an item, or
the whole of a shorter item; its tokens are its shingles of TOKEN words (or the whole window, if shorter).

1. The benchmark becomes a table of distinct windows with their items, and a table of their tokens.
2. One pass over the documents counts these tokens. The rarest token of each window, by these counts, is its prefix: a
   document that contains the window contains that token.
3. A second pass gives the places of prefix tokens in the documents, with the words around. They are joined with the windows
   on the token. Where the token stands fixes where its window would begin: windows that would begin before the text or
   end after it are dropped (length and positional bounds), and the rest is compared word by word.

Both passes ask a bit filter which tokens can matter. It has at most MAX_BITS bits (8 MB), however large the benchmark is: what it lets
through wrongly costs time and is dropped by the joins. Nothing else of the benchmark or the corpus goes through the driver.

Defined results: a null or empty text has no words and is clean; an item without words has no
window; rows of an item id are one item; a null item id marks hits but is not counted as an item;
an empty table of documents gives no rows, one of items contaminates nothing; repeated rows of documents are judged one by one; a text may have any length; other columns pass through under any name,
but `judged` replaces columns named like those that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.bits import MAX_BITS, bit_filter, passes
from provena.llm.common import as_bytes, materialise

WINDOW = 13
TOKEN = 3
#: Texts are hashed in groups of so many bytes, and places of tokens share their words within so many words.
GROUP_BYTES = 2 << 20
STRETCH = 256
#: Bytes of words stay (A-Z as a-z, all beyond ASCII too); every other byte becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_rng = np.random.default_rng(13)
BYTE, PLACE = (_rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, TOKEN + 1))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop) of the words of a folded text, computed in pieces that end between words."""
    found, at = [], 0
    while at < len(folded):
        stop = folded.find(b" ", at + GROUP_BYTES)
        stop = len(folded) if stop < 0 else stop
        piece = np.frombuffer(folded, np.uint8, stop - at, at)
        inside = piece != 32
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, stops = edges[::2], edges[1::2]
        if len(starts):
            sizes = stops - starts
            first = np.cumsum(sizes) - sizes
            power = np.multiply.accumulate(np.full(sizes.max(), BASE))
            place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
            found.append((_mixed(np.add.reduceat(BYTE[piece[inside]] * power[place], first)), starts + at, stops + at))
        at = stop
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def tokens(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of `width` words."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):  # products of 64 bits wrap around
        return _mixed(sum(hashes[k : k + n] * PLACE[k] for k in range(width)) + np.uint64(width) * PLACE[TOKEN])


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) with about GROUP_BYTES together, or one longer text."""
    first, size = 0, 0
    for k, data in enumerate(texts):
        if size and size + len(data) > GROUP_BYTES:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(data) + 1
    if texts:
        yield first, texts[first:]


class _Words:
    """The words of a group of texts and, by width, the tokens that lie within one text."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts).translate(FOLD)
        self.hashes, self.starts, self.stops = word_hashes(self.data)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.owner = np.searchsorted(begins, self.starts, side="right") - 1
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts

    def wanted(self, widths: list[int], bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, tokens) that the filter lets through."""
        for width in widths:
            t = tokens(self.hashes, width)
            places = np.flatnonzero(passes(bits, t))
            places = places[self.owner[places] == self.owner[places + width - 1]]
            yield places, t[places]

    def text(self, lo: int, hi: int) -> str:
        return b" ".join(self.data[self.starts[lo] : self.stops[hi - 1]].split()).decode()


# --- the join -------------------------------------------------------------------------------------

WINDOWS = "item string, body string, size int, tokens array<long>"
PLACES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "stretches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("first", T.LongType()),
                        T.StructField("words", T.StringType()),
                        T.StructField("places", T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("at", T.LongType())]))),
                    ]
                )
            ),
        ),
    ]
)


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """WINDOWS of every row of the benchmark: the window's words, and its tokens in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = words_of(data)
                if not words:
                    continue
                hashes = word_hashes(b" ".join(words))[0]
                size = min(width, len(words))
                t = tokens(hashes, min(TOKEN, size)).view(np.int64)
                each = size - min(TOKEN, size) + 1
                at = range(len(words) - size + 1)
                for lo in range(0, len(at), 1024):
                    part = at[lo : lo + 1024]
                    columns = [[item] * len(part), [b" ".join(words[i : i + size]).decode() for i in part], [size] * len(part), [t[i : i + each] for i in part]]
                    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "body", "size", "tokens"])

    return benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).mapInArrow(cut, WINDOWS)


def token_counts(docs: DataFrame, text: str, widths: list[int], bits: np.ndarray) -> DataFrame:
    """(t, n): occurrences in docs of each token that the filter lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _groups(as_bytes(batch.column(0))):
                for _, t in _Words(texts).wanted(widths, bits):
                    t, n = np.unique(t, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], ["t", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def places(text: Column, widths: list[int], bits: np.ndarray, width: int = WINDOW) -> Column:
    """A struct PLACES of a text: its words, and where tokens stand that the filter lets through, with `width` words to both sides."""

    @F.arrow_udf(PLACES)
    def run(texts: pa.Array) -> pa.Array:
        counts, found = [], []
        for _, group in _groups(as_bytes(texts)):
            words = _Words(group)
            each = list(words.wanted(widths, bits))
            at = np.concatenate([np.empty(0, np.int64), *(p for p, _ in each)])
            t = np.concatenate([np.empty(0, np.uint64), *(h for _, h in each)]).view(np.int64)
            order = np.argsort(at, kind="stable")
            rows: list[list[dict]] = [[] for _ in group]
            for place, token in zip(at[order].tolist(), t[order].tolist(), strict=True):
                own = int(words.owner[place])
                begin, end = int(words.first[own]), int(words.first[own] + words.counts[own])
                held = rows[own][-1] if rows[own] else None
                if held is None or place - held["from"] > STRETCH:
                    held = {"from": place, "lo": max(begin, place - width), "places": []}
                    rows[own].append(held)
                held["hi"] = min(end, place + width)
                held["places"].append({"t": token, "at": place - held["lo"]})
            for own, stretches in enumerate(rows):
                begin = int(words.first[own])
                found.append([{"first": s["lo"] - begin, "words": words.text(s["lo"], s["hi"]), "places": s["places"]} for s in stretches])
            counts += words.counts.tolist()
        place_type = pa.list_(pa.struct([("t", pa.int64()), ("at", pa.int64())]))
        kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.string()), ("places", place_type)]))]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((counts, found), kinds, strict=True)], PLACES.names)

    return run.asNondeterministic()(text.cast("string"))


def prefixed(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, width: int, max_bits: int) -> tuple[DataFrame, list[int]]:
    """(windows (t, place, size, body, items) with the rarest token t of each and its place, widths of tokens)."""
    windows = materialise(item_windows(benchmark, item_id, item_text, width), "windows")
    one = windows.groupBy("body").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.array_compact(F.collect_set("item")).alias("items"))
    one = materialise(one, "bodies")
    widths = sorted(r["w"] for r in one.select(F.least("size", F.lit(TOKEN)).alias("w")).distinct().collect())
    known = materialise(one.select(F.explode("tokens").alias("t")).distinct(), "tokens")
    counted = materialise(token_counts(docs, text, widths, bit_filter(known, max_bits)).join(known, "t", "left_semi"), "counts")
    each = one.select("body", F.posexplode("tokens").alias("place", "t")).join(counted, "t", "left")
    rarest = each.groupBy("body").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t", "place")).alias("p"))
    return materialise(one.drop("tokens").join(rarest, "body").select("p.t", "p.place", "size", "body", "items"), "prefixes"), widths


def hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WINDOW, max_bits: int = MAX_BITS, keep: list[str] | None = None,
) -> DataFrame:
    """(row, n_words, spans, items) for every row of docs: `row` is a struct of its columns (of `keep`, where given),
    `spans` are the words that windows occupy as (start, stop), `items` the ids of their items; both null if none."""
    prefixes, widths = prefixed(docs, benchmark, text, item_id, item_text, width, max_bits)
    bits = bit_filter(prefixes.select("t").distinct(), max_bits)
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    seen = materialise(docs.select(F.monotonically_increasing_id().alias("nth"), kept, places(F.col(text), widths, bits, width).alias("p")).select("nth", "row", "p.*"), "seen")

    stretches = seen.where("size(stretches) > 0").select("nth", F.explode("stretches").alias("s"))
    at = stretches.select("nth", "s.first", F.split("s.words", " ").alias("words"), F.explode("s.places").alias("q")).select("nth", "first", "words", "q.*")
    met = at.join(prefixes, "t").withColumn("start", F.col("at") - F.col("place"))
    fits = met.where("start >= 0 and start + size <= size(words)")
    same = fits.where("array_join(slice(words, cast(start + 1 as int), size), ' ') = body")
    found = materialise(same.select("nth", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("start") + F.col("size")).alias("stop"), "items"), "hits")
    spans = found.groupBy("nth").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    items = found.select("nth", F.explode("items").alias("item")).distinct().groupBy("nth").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = materialise(spans.join(items, "nth", "left"), "found")
    return seen.select("nth", "row", "n_words").join(both, "nth", "left").drop("nth")


def covered(spans: Column) -> Column:
    """Words in the union of spans sorted by start."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["stop"]).alias("end"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.coalesce(F.aggregate(spans, zero, step)["n"], F.lit(0).cast("long"))


def verdicts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(row, n_words, n_hit, items, contaminated): a twentieth of the words hit, one at least."""
    found = hits(docs, benchmark, **options).withColumn("n_hit", covered(F.col("spans")))
    return found.select(
        "row", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def judged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with _n_words, _n_hit, _items and _contaminated."""
    own = ["n_words", "n_hit", "items", "contaminated"]
    found = verdicts(docs, benchmark, **options)
    return found.select(*[F.col(f"row.`{c}`") for c in found.schema["row"].dataType.names if c not in {f"_{x}" for x in own}], *[F.col(c).alias(f"_{c}") for c in own])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated."""
    return verdicts(docs, benchmark, **options).where(~F.col("contaminated")).select("row.*")


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


ORACLE = r"""
with fold as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 13) as size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as body
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0)
), places as (
  select rid, w, i, size from (select rid, w, unnest(range(1, len(w) + 1)) as i from fold), (select distinct size from windows) where i + size - 1 <= len(w)
), hits as (
  select p.rid, p.i, p.size, x.item_id from places p join windows x on x.size = p.size and x.body = array_to_string(p.w[p.i:p.i + p.size - 1], ' ')
), words as (
  select rid, count(distinct j) as n_hit from (select rid, unnest(range(i, i + size)) as j from (select distinct rid, i, size from hits)) group by rid
), found as (
  select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, item_id from hits where item_id is not null) group by rid
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from fold left join words using (rid) left join found using (rid)
"""
