"""Quality rules as a short-circuit cascade.

Base figures are computed for every document. The further rules run one after another, each only
on the documents that every earlier rule kept. Their order is fitted: on a bounded sample of documents that pass the base
rule, the cost and the rejection rate of each rule are measured, and rules run by falling rejections per second.
The verdict is the conjunction of all rules, so the order changes the cost and never the result.

Defined results: a null or empty text has no words and fails the base rule; texts are read whole;
rows are judged one by one, so repeated rows, ties, null ids and further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import CONTINUATION, WHITE, as_bytes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))

VERDICT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words covered by n-word windows that occur twice or more, first occurrence included."""
    if len(words) <= n:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    windows = len(ids) - n + 1
    code = ids[:windows]
    for k in range(1, n):
        if len(seen) >= 1 << 20:  # keep products of two codes within 64 bits
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(seen) + ids[k : k + windows]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(windows, dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = order[twice]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + n, -1)
    return int(np.count_nonzero(np.cumsum(marks[:-1])))


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


def base_figures(data: bytes) -> Base:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    return Base(
        len(words),
        len(data.translate(None, WHITE + CONTINUATION)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


@dataclass(frozen=True)
class Rule:
    """rejects(text bytes, base figures) is true for a document that must go."""

    name: str
    rejects: Callable[[bytes, Base], bool]


def _mostly_capitals(data: bytes, _: Base) -> bool:
    small = len(data) - len(data.translate(None, LETTERS[26:]))
    capital = len(data) - len(data.translate(None, LETTERS[:26]))
    return capital > small


def _one_word_rules(data: bytes, base: Base) -> bool:
    words = data.split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return 10 * max(counts.values(), default=0) > 4 * base.n_words


def _no_letters(data: bytes, base: Base) -> bool:
    """Over two in ten words have neither an ASCII letter nor a character beyond ASCII."""
    kept = data.translate(bytes(c if c in WHITE else 97 if c in LETTERS or c >= 128 else 48 for c in range(256)))
    return 10 * sum(b"a" not in w for w in kept.split()) > 2 * base.n_words


def _lines(data: bytes) -> list[bytes]:
    return [x.strip(WHITE) for x in data.split(b"\n") if x.strip(WHITE)]


#: How list items begin and how cut-off lines end.
BULLETS = ("-", "*", "•")
ELLIPSES = ("...", "…")
_bullets, _ellipses = (tuple(x.encode() for x in y) for y in (BULLETS, ELLIPSES))


def _mostly_list(data: bytes, base: Base) -> bool:
    """Over nine in ten lines are list items."""
    return 10 * sum(x.startswith(_bullets) for x in _lines(data)) > 9 * base.n_lines


def _cut_off(data: bytes, base: Base) -> bool:
    """Over three in ten lines end in an ellipsis."""
    return 10 * sum(x.endswith(_ellipses) for x in _lines(data)) > 3 * base.n_lines


RULES = (
    Rule("symbols", lambda d, b: 10 * b.n_symbols > b.n_words),
    Rule("repeated_lines", lambda d, b: 2 * b.n_dup_lines > b.n_lines),
    Rule("word_length", lambda d, b: not 2 * b.n_words <= b.word_chars <= 20 * b.n_words),
    Rule("exclamation", lambda d, b: 10 * d.count(b"!") > 3 * b.n_words),
    Rule("capitals", _mostly_capitals),
    Rule("letters", _no_letters),
    Rule("placeholder", lambda d, b: b"lorem ipsum" in d.lower()),
    Rule("one_word", _one_word_rules),
    Rule("list", _mostly_list),
    Rule("cut_off", _cut_off),
)


def fit_order(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", sample_rows: int = 512, sample_bytes: int = 1 << 16) -> list[Rule]:
    """Rules by falling rejections per second, as measured on a bounded sample of documents that the base rule keeps.

    The sample is at most `sample_rows` documents of at most `sample_bytes` (32 MB together) from the first partitions
    that have them: Spark reads one partition, and more only while rows are missing. It decides about time alone.
    """
    rules = list(rules)
    own = F.col(text).cast("string")
    sample = docs.select(own.alias("t")).where(F.octet_length("t").between(1, sample_bytes)).limit(sample_rows).collect()
    texts = [row["t"].encode() for row in sample]
    kept = [(d, b) for d, b in ((d, base_figures(d)) for d in texts) if not b.failed]
    rate = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule.rejects(d, b) for d, b in kept)
        rate.append(rejected / max(time.perf_counter() - began, 1e-9))
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate[k], k))]


def verdict(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """A struct column with the base figures and the cascade's verdict; runs `rules` in the given order."""
    rules = list(rules)

    @F.arrow_udf(VERDICT)
    def judge(texts: pa.Array) -> pa.Array:
        data = as_bytes(texts)
        figures = [base_figures(d) for d in data]
        alive = [i for i, b in enumerate(figures) if not b.failed]
        for rule in rules:
            alive = [i for i in alive if not rule.rejects(data[i], figures[i])]
        kept = np.zeros(len(data), dtype=bool)
        kept[alive] = True
        columns = [
            pa.array([b.n_words for b in figures], pa.int64()),
            pa.array([b.word_chars for b in figures], pa.int64()),
            pa.array([b.n_symbols for b in figures], pa.int64()),
            pa.array([b.n_dup_lines for b in figures], pa.int64()),
            pa.array([b.n_repeat_words for b in figures], pa.int64()),
            pa.array([b.failed for b in figures], pa.bool_()),
            pa.array(kept),
        ]
        return pa.StructArray.from_arrays(columns, VERDICT.names)

    return judge.asNondeterministic()(text.cast("string"))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Iterable[Rule] = RULES, order: Iterable[Rule] | None = None) -> DataFrame:
    """doc_id, the base figures, base_failed and kept for every row of docs; `order` runs rules as given instead of fitting."""
    order = fit_order(docs, rules, text) if order is None else order
    judged = docs.select(F.col(doc_id).alias("doc_id"), verdict(F.col(text), order).alias("v"))
    return judged.select("doc_id", "v.*")


def keep_good(docs: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """The rows of docs that the cascade keeps, with their own columns."""
    judged = docs.select(F.struct("*").alias("_row"), verdict(F.col(text), fit_order(docs, rules, text))["kept"].alias("_kept"))
    return judged.where("_kept").select("_row.*")


ORACLE = r"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), words as (
  select rid, unnest(w) as word, generate_subscripts(w, 1) as i from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs)
), windows as (
  select rid, i, word, lead(word, 1) over o as w1, lead(word, 2) over o as w2 from words window o as (partition by rid order by i)
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, word, w1, w2) as n from windows where w2 is not null) where n > 1
), covered as (
  select rid, count(*) as n from (select rid, i from twice union select rid, i + 1 from twice union select rid, i + 2 from twice) group by rid
), per_word as (
  select rid, count(*) as n_words, sum(length(word)) as word_chars, sum((not regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]'))::int) as bare from words group by rid
), most as (
  select rid, max(n) as n from (select rid, word, count(*) as n from words group by all) group by rid
), lines as (
  select rid, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as n_list,
    len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) as n_cut_off
  from (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from docs)
), base as (
  select d.doc_id, d.text, coalesce(p.n_words, 0)::bigint as n_words, coalesce(p.word_chars, 0)::bigint as word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, l.n_lines, l.n_dup_lines::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(p.bare, 0) as bare, coalesce(m.n, 0) as most, n_list, n_cut_off
  from docs d join lines l using (rid) left join per_word p using (rid) left join covered c using (rid) left join most m using (rid)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (10 * n_symbols > n_words) and not (2 * n_dup_lines > n_lines) and word_chars between 2 * n_words and 20 * n_words
    and not (10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words)
    and length(regexp_replace(text, '[^A-Z]', '', 'g')) <= length(regexp_replace(text, '[^a-z]', '', 'g'))
    and not (10 * bare > 2 * n_words) and not contains(translate(text, 'LOREMIPSU', 'loremipsu'), 'lorem ipsum') and not (10 * most > 4 * n_words)
    and not (10 * n_list > 9 * n_lines) and not (10 * n_cut_off > 3 * n_lines) as kept
from judged
"""
