"""Two tokenizers' tokens of one text, aligned: which tokens overlap, which share a group, and how common each pair of ids is.

Tokens are rows of a sparse token-byte incidence matrix, one for each tokenizer, in compressed rows (`Csr`) built by hand. The row product
A * Bt (Gustavson's: each entry of a row of A adds a row of Bt) gives the overlap links: which token pairs share bytes, and how
many. Two neighbouring A tokens are of one group if they share a B token, so groups end where tokens of both sides end. Group-incidence
matrices, multiplied in the same way, give the shared-group links. Documents of a batch are one matrix, up to SLICE bytes: a document's end is an
end for both sides. Where a group has very many pairs, its rows are first put together by id, and a product is made in pieces of
bounded size.

Over the corpus: each document is encoded once and its id pairs, with their numbers of links, are written. Pairs are counted in
how many documents they occur by one aggregation. A document's figures need the counts of its own pairs: those of the most common pairs, at most TOP, are sent
to the tasks, since they would be hot keys of a join; all others are joined. Both ways give the same figures, for any TOP.

Encoding: a piece model without pieces that go on after a word's end never merges over a space that follows another character, so the
parts between are encoded one by one and kept in a cache of bounded size. A byte-level vocabulary whose ids follow the order of its merges is encoded by
rank. Texts with characters outside of the plain ranges, on which pattern engines may differ, take the model's own way.

Defined results: a text that is null or empty, or whose joined tokens differ from space + text on either side, has no tokens: zeros and no
digest. Repeated rows and null ids are documents like others, each counted for its pairs. Ties of the highest count are all best. Very long
texts are encoded whole. An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import new_path
from provena.llm.tokens import pretoken_pattern, vocabulary_dir

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
CACHE = 1 << 17
LONGEST = 64
#: Bytes of text whose tokens are one matrix, entries of one product, and pairs of a group from which its rows are put together by id.
SLICE = 1 << 17
ENTRIES = 1 << 22
WIDE = 1 << 10
#: Pairs whose counts are sent to the tasks, at most: 16 bytes each.
TOP = 1 << 19
#: An id of either side has so many bits at most.
ID_BITS = 20
#: Characters on whose classes pattern engines agree.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*"


@dataclass(frozen=True)
class Csr:
    """A sparse matrix by rows: row i has the columns indices[indptr[i]:indptr[i + 1]] with these values."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @classmethod
    def of_rows(cls, rows: np.ndarray, indices: np.ndarray, values: np.ndarray, n: int, columns: int) -> Csr:
        """From entries in the order of their rows."""
        return cls(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), indices, values, columns)

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        return Csr.of_rows(self.indices[order], self.rows[order], self.values[order], self.columns, len(self.indptr) - 1)


def products(a: Csr, b: Csr, entries: int = ENTRIES) -> Iterator[tuple[int, Csr]]:
    """Rows of a * b, from row `first` on, in pieces that a bounded number of entries goes into (or one row)."""
    widths = np.diff(b.indptr)
    reach = np.concatenate([[0], np.cumsum(widths[a.indices])])[a.indptr]
    first, n = 0, len(a.indptr) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(reach, reach[first] + entries, "right")) - 1)
        mine = slice(a.indptr[first], a.indptr[last])
        picked = a.indices[mine]
        sizes = widths[picked]
        rows = np.repeat(np.repeat(np.arange(last - first), np.diff(a.indptr[first : last + 1])), sizes)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(b.indptr[picked], sizes) + inside
        keys, values = rows * b.columns + b.indices[at], np.repeat(a.values[mine], sizes) * b.values[at]
        if len(keys) and (np.diff(keys) < 0).any():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        begins = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0])) if len(keys) else np.empty(0, np.int64)
        kept = keys[begins]
        yield first, Csr.of_rows(kept // b.columns, kept % b.columns, np.add.reduceat(values, begins) if len(begins) else values, last - first, b.columns)
        first = last


def _joined(parts: Iterator[tuple[int, Csr]], columns: int) -> Csr:
    found = list(parts)
    if not found:
        return Csr(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), columns)
    sizes = np.concatenate([np.diff(p.indptr) for _, p in found])
    return Csr(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p.indices for _, p in found]), np.concatenate([p.values for _, p in found]), columns)


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens that follow each other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(total), np.ones(total, np.int64), total)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """A tokens by B tokens: the bytes that two tokens share."""
    a, b = incidence(a_lengths), incidence(b_lengths)
    return _joined(products(a, b.transposed()), len(b_lengths))


def groups_of(links: Csr) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token: neighbours of A are of one group if the last B token of one is the first of the next."""
    if not len(links.indices):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = links.indices[links.indptr[:-1]], links.indices[links.indptr[1:] - 1]
    of_a = np.cumsum(np.concatenate([[0], (first[1:] != last[:-1]).astype(np.int64)]))
    of_b = np.empty(links.columns, np.int64)
    of_b[links.indices] = of_a[links.rows]
    return of_a, of_b


def _narrowed(ids: np.ndarray, group: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, group, number) in the order of groups: a row for each token, and in wide groups for each id."""
    if not wide.any():
        return ids, group, np.ones(len(ids), np.int64)
    many = wide[group]
    keys, numbers = np.unique(group[many] << ID_BITS | ids[many], return_counts=True)
    ids, group = np.concatenate([ids[~many], keys & (1 << ID_BITS) - 1]), np.concatenate([group[~many], keys >> ID_BITS])
    numbers, order = np.concatenate([np.ones(int((~many).sum()), np.int64), numbers]), np.argsort(group, kind="stable")
    return ids[order], group[order], numbers[order]


def shared_pairs(a_ids: np.ndarray, b_ids: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, doc: np.ndarray, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Keys doc << 40 | a << 20 | b, sorted, and numbers of shared-group links; doc[g] is the document of group g, below 2^23."""
    n = len(doc)
    wide = np.bincount(of_a, minlength=n) * np.bincount(of_b, minlength=n) > WIDE
    a, b = _narrowed(a_ids, of_a, wide), _narrowed(b_ids, of_b, wide)
    groups_a = Csr(np.arange(len(a[0]) + 1), a[1], a[2], n)
    groups_b = Csr(np.arange(len(b[0]) + 1), b[1], b[2], n).transposed()
    keys, numbers = [], []
    for first, links in products(groups_a, groups_b, entries):
        row = first + links.rows
        found = doc[a[1][row]] << 2 * ID_BITS | a[0][row] << ID_BITS | b[0][links.indices]
        k, inverse = np.unique(found, return_inverse=True)
        keys.append(k)
        numbers.append(np.bincount(inverse, links.values, len(k)).astype(np.int64))
    if len(keys) <= 1:
        return (keys[0], numbers[0]) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(numbers), len(k)).astype(np.int64)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Side:
    """One tokenizer: `whole` gives the ids of a text that begins with a space; `fast`, where there is one, does so for texts of plain characters."""

    def __init__(self, spell: list[bytes], whole: Callable[[str], list[int]], fast: Callable[[str], np.ndarray | None] | None = None):
        self.spell, self.whole, self.fast = spell, whole, fast
        self.lengths = np.array([len(s) for s in spell], np.int64)

    def ids(self, text: str, plain: bool) -> np.ndarray | None:
        """Ids of the text; None if they do not spell it."""
        if plain and self.fast:
            held = self.fast(text)
            if held is not None:
                return held.astype(np.int64)
        found = self.whole(text)
        return np.array(found, np.int64) if b"".join([self.spell[i] for i in found]) == text.encode() else None


class _Parts(dict):
    """Ids of parts of texts, as bytes of 32-bit numbers. A part that its ids do not spell is None."""

    def __init__(self, encode: Callable[[str], list[int]], spell: list[bytes]):
        super().__init__()
        self.encode, self.spell = encode, spell

    def __missing__(self, part: str) -> bytes | None:
        ids = self.encode(part)
        held = array("I", ids).tobytes() if b"".join([self.spell[i] for i in ids]) == part.encode() else None
        if len(part) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[part] = held
        return held


def _byte_level(file: bytes) -> _Side:
    import tiktoken

    model = json.loads(file)["model"]
    byte, vocabulary, merges = _byte_of(), model["vocab"], model["merges"]
    spell = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        spell[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    made = []

    def whole(text: str) -> list[int]:
        if not made:  # large, and few texts need it
            from tokenizers import Tokenizer

            made.append(Tokenizer.from_str(file.decode()))
            made[0].encode_special_tokens = True
        return made[0].encode(text, add_special_tokens=False).ids

    # Where ids follow the order of merges, they are ranks, and a plain text may be encoded by rank.
    if any(vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
        return _Side(spell, whole)
    ranks = {s: i for i, s in enumerate(spell) if i < 256 + len(merges)}
    by_rank = tiktoken.Encoding("ranks", pat_str=pretoken_pattern(), mergeable_ranks=ranks, special_tokens={})
    return _Side(spell, whole, lambda text: by_rank.encode_to_numpy(text, disallowed_special=()))


def _pieces(file: bytes) -> _Side:
    import re

    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_proto=file)
    names = [made.id_to_piece(i) for i in range(made.get_piece_size())]
    spell = [bytes([int(p[3:5], 16)]) if made.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    blank = [made.piece_to_id("▁")]

    def whole(text: str) -> list[int]:
        return made.encode(text[1:]) or blank  # the model adds the first space itself, but makes nothing of an empty text

    if any(re.search("[^▁]▁", p) for i, p in enumerate(names) if not (made.is_byte(i) or made.is_control(i) or made.is_unknown(i))):
        return _Side(spell, whole)
    known, parts = _Parts(whole, spell), re.compile(" +[^ ]*").findall

    def fast(text: str) -> np.ndarray | None:
        held = list(map(known.__getitem__, parts(text)))
        return None if None in held else np.frombuffer(b"".join(held), np.uint32)

    return _Side(spell, whole, fast)


@lru_cache(maxsize=2)
def _sides(a_file: bytes, b_file: bytes) -> tuple[_Side, _Side]:
    sides = _byte_level(a_file), _pieces(b_file)
    if max(len(s.spell) for s in sides) > 1 << ID_BITS:
        raise ValueError(f"a vocabulary has over 2^{ID_BITS} ids")
    return sides


@lru_cache(maxsize=2)
def _words(a: int, b: int) -> list[bytes]:
    """Decimal ids with the mark that follows: A's with a comma, A's with a bar, B's with a comma, B's with a semicolon."""
    return [b"%d%s" % (i, mark) for n, marks in ((a, (b",", b"|")), (b, (b",", b";"))) for mark in marks for i in range(n)]


def digests(a_ids: np.ndarray, b_ids: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, size_a: int, size_b: int) -> list[str]:
    """SHA-256 of each document's groups, `a1,a2|b1;a3|b2,b3`."""
    words = _words(size_a, size_b)
    n_groups = int(of_a[-1]) + 1 if len(of_a) else 0
    last_a, last_b = (np.concatenate([np.diff(g) != 0, [True]]) if len(g) else np.empty(0, bool) for g in (of_a, of_b))
    before_b = np.concatenate([[0], np.cumsum(np.bincount(of_b, minlength=n_groups))])
    through_a = np.cumsum(np.bincount(of_a, minlength=n_groups))
    text = np.empty(len(a_ids) + len(b_ids), np.int64)
    text[np.arange(len(a_ids)) + before_b[of_a]] = a_ids + np.where(last_a, size_a, 0)
    text[np.arange(len(b_ids)) + through_a[of_b]] = 2 * size_a + b_ids + np.where(last_b, size_b, 0)
    out, at = [], 0
    for size in (a_sizes + b_sizes).tolist():
        held = b"".join([words[i] for i in text[at : at + size].tolist()])
        out.append(hashlib.sha256(held[:-1]).hexdigest() if size else "")
        at += size
    return out


def _struct(longs: str, *rest: T.StructField) -> T.StructType:
    return T.StructType([*[T.StructField(n, T.LongType()) for n in longs.split()], *rest])


def _ints(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.IntegerType()) for n in names.split()]


INTS = T.ArrayType(T.IntegerType())
ALIGNED = _struct("n_a n_b n_groups n_links", T.StructField("groups_sha256", T.StringType()), *[T.StructField(n, INTS) for n in "abm"])
LINKS = T.ArrayType(T.StructType(_ints("a_at b_at a b bytes group")))
SCORED = _struct("n_best count_sum", T.StructField("rest", T.ArrayType(_struct("pair", *_ints("m")))))


def _encoded(texts: list[str | None], sides: tuple[_Side, _Side]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Ids of both sides for each text, in slices of bounded size."""
    import re

    plain, held, size = re.compile(PLAIN), ([], []), 0
    for text in texts:
        spaced = f" {text}" if text else ""
        usual = plain.fullmatch(spaced) is not None
        found = [s.ids(spaced, usual) if spaced else None for s in sides]
        empty = any(f is None for f in found)
        for side, ids in zip(held, found, strict=True):
            side.append(np.empty(0, np.int64) if empty else ids)
        size += 4 * len(spaced) if not usual else len(spaced)
        if size >= SLICE:
            yield held
            held, size = ([], []), 0
    if held[0]:
        yield held


def _laid_out(held: tuple[list, list], sides: tuple[_Side, _Side]):
    """Ids, sizes by document, overlap links and groups of a slice of documents."""
    a_ids, b_ids = (np.concatenate(ids) for ids in held)
    a_sizes, b_sizes = (np.array([len(x) for x in ids], np.int64) for ids in held)
    links = overlap_links(sides[0].lengths[a_ids], sides[1].lengths[b_ids])
    return a_ids, b_ids, a_sizes, b_sizes, links, *groups_of(links)


def _files(paths: list[str]) -> tuple[bytes, bytes]:
    a, b = (Path(p).read_bytes() for p in paths)
    json.loads(a)  # a broken file fails here and not in every task
    return a, b


def default_paths() -> list[str]:
    return [f"{vocabulary_dir()}/{name}" for name in FILES]


def _aligned_column(text: Column, paths: list[str]) -> Column:
    files = _files(paths)

    @F.arrow_udf(ALIGNED)
    def run(texts: pa.Array) -> pa.Array:
        sides, pieces = _sides(*files), []
        for held in _encoded(texts.to_pylist(), sides):
            a_ids, b_ids, a_sizes, b_sizes, _, of_a, of_b = _laid_out(held, sides)
            n_docs, n_groups = len(a_sizes), int(of_a[-1]) + 1 if len(of_a) else 0
            doc_of_a = np.repeat(np.arange(n_docs), a_sizes)
            doc = np.zeros(n_groups, np.int64)
            doc[of_a] = doc_of_a
            per_group = np.bincount(of_a, minlength=n_groups) * np.bincount(of_b, minlength=n_groups)
            links = np.zeros(n_docs, np.int64)
            np.add.at(links, doc, per_group)
            keys, numbers = shared_pairs(a_ids, b_ids, of_a, of_b, doc)
            offsets = pa.array(np.searchsorted(keys >> 2 * ID_BITS, np.arange(n_docs + 1)).astype(np.int32))
            mask = (1 << ID_BITS) - 1
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys >> ID_BITS & mask, keys & mask, numbers)]
            sha = digests(a_ids, b_ids, of_a, of_b, a_sizes, b_sizes, len(sides[0].spell), len(sides[1].spell))
            counts = [pa.array(x) for x in (a_sizes, b_sizes, np.bincount(doc, minlength=n_docs), links)]
            pieces.append(pa.StructArray.from_arrays([*counts, pa.array(sha), *lists], ALIGNED.names))
        return pa.concat_arrays(pieces) if pieces else pa.array([], pieces_type())

    def pieces_type() -> pa.DataType:
        return pa.struct([(n, pa.int64()) for n in ALIGNED.names[:4]] + [("groups_sha256", pa.string())] + [(n, pa.list_(pa.int32())) for n in "abm"])

    return run.asNondeterministic()(text.cast("string"))


def overlaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: list[str] | None = None) -> DataFrame:
    """(doc_id, a_at, b_at, a, b, bytes, group): every pair of tokens of a document that share bytes, by their places, with the bytes shared."""
    files = _files(paths or default_paths())

    @F.arrow_udf(LINKS)
    def run(texts: pa.Array) -> pa.Array:
        sides, out = _sides(*files), []
        for held in _encoded(texts.to_pylist(), sides):
            a_ids, b_ids, a_sizes, b_sizes, links, of_a, _ = _laid_out(held, sides)
            rows = links.rows
            doc = np.repeat(np.arange(len(a_sizes)), a_sizes)
            first_a, first_b = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
            first_group = np.array([of_a[at] if n else 0 for at, n in zip(first_a, a_sizes, strict=True)], np.int64)
            d = doc[rows]
            columns = (rows - first_a[d], links.indices - first_b[d], a_ids[rows], b_ids[links.indices], links.values, of_a[rows] - first_group[d])
            entries = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], LINKS.elementType.names)
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(len(a_sizes) + 1)).astype(np.int32)), entries))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([(n, pa.int32()) for n in LINKS.elementType.names])))

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(run.asNondeterministic()(F.col(text).cast("string"))).alias("_link")).select("doc_id", "_link.*")


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: list[str] | None = None) -> DataFrame:
    """A written table of (k, doc_id, figures, a, b, m): a row a document, its distinct id pairs and how many links each has."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("k"), F.col(doc_id).alias("doc_id"), _aligned_column(F.col(text), paths or default_paths()).alias("v")).select("k", "doc_id", "v.*")
    path = new_path(spark, "aligned")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """A written table of (pair, a, n, best): in how many documents the pair of ids is linked, and whether no pair of the same A id is in more."""
    spark = aligned.sparkSession
    pair = F.shiftleft(F.col("p.a").cast("long"), ID_BITS) + F.col("p.b")
    path, best_path = new_path(spark, "pair-counts"), new_path(spark, "best-counts")
    counted = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy(pair.alias("pair")).agg(F.count("*").alias("n"))
    counted.withColumn("a", F.shiftright("pair", ID_BITS).cast("int")).write.parquet(path)
    counts = spark.read.schema("pair long, n long, a int").parquet(path)
    # One row an A id: as many as the vocabulary has at most.
    counts.groupBy("a").agg(F.max("n").alias("most")).write.parquet(best_path)
    most = spark.read.schema("a int, most long").parquet(best_path)
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _common(counts: DataFrame, top: int) -> DataFrame:
    """The most common pairs of counts, at most `top`: those of the highest classes of n that fit together, eight classes an octave."""
    size = F.floor(8 * F.log2("n")).cast("int")
    room, least = top, None
    for row in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["size"]
    return counts.where(F.lit(False) if least is None else size >= least)


def scored(aligned: DataFrame, counts: DataFrame, top: int = TOP) -> DataFrame:
    """(k, n_best, count_sum) of each document of aligned: links whose pair is the A id's most common, and the counts of all links' pairs together."""
    common = _common(counts, top).toArrow()
    pairs = common["pair"].to_numpy()
    order = np.argsort(pairs)
    known = pairs[order]
    n, best = common["n"].to_numpy()[order], common["best"].to_numpy()[order]

    @F.arrow_udf(SCORED)
    def run(a: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        sizes = np.diff(a.offsets.to_numpy())
        flat_a, flat_b, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b, m))
        pair, doc = flat_a << ID_BITS | flat_b, np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        has = known[at] == pair if len(known) else np.zeros(len(pair), bool)
        sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
        np.add.at(sums[0], doc[has], times[has] * best[at[has]])
        np.add.at(sums[1], doc[has], times[has] * n[at[has]])
        left = np.concatenate([[0], np.cumsum(np.bincount(doc[~has], minlength=len(sizes)))]).astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.array(pair[~has]), pa.array(times[~has].astype(np.int32))], ["pair", "m"])
        return pa.StructArray.from_arrays([pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(left), rest)], SCORED.names)

    own = aligned.select("k", run.asNondeterministic()("a", "b", "m").alias("s")).select("k", "s.*")
    path = new_path(aligned.sparkSession, "scored")
    own.write.option("compression", "zstd").parquet(path)
    own = aligned.sparkSession.read.schema(own.schema).parquet(path)
    rest = own.select("k", F.explode("rest").alias("p")).select("k", "p.*")
    times = F.when(F.col("best"), F.col("m")).otherwise(0)
    more = rest.join(counts, "pair").groupBy("k").agg(F.sum(times).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_sum"))
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.join(more, "k", "left").select("k", (F.col("n_best") + nought("more_best")).alias("n_best"), (F.col("count_sum") + nought("more_sum")).alias("count_sum"))


def alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: list[str] | None = None, top: int = TOP) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs."""
    aligned = align(docs, doc_id, text, paths)
    scores = scored(aligned, pair_counts(aligned), top)
    return aligned.join(scores, "k").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
