"""Line deduplication by repeated chunks of neighbouring lines. DataFrame functions only.

This departs from content-defined chunks, which a rolling hash over line hashes would cut where it meets a residue: a passage of two to
six lines in new surroundings rarely holds two such cuts, and those are the passages to find (README has the figures). Here every two
neighbouring lines that hold a word, with the blank lines between, are a chunk, so that a chunk depends on its own lines alone, lines that come or go
elsewhere move none, and a repeated passage is the union of its chunks. All lines of a chunk whose bytes stand at an earlier place (by doc_id,
then text hash and line) are marked. Runs of marked lines with fewer than LEAST_WORDS words stay: two short lines that two texts
share by chance are no passage.

Hashes only nominate. The least and the greatest text of each repeated hash are compared byte by byte, which pre-aggregates; only
where they differ are the chunks of that hash grouped by their bytes. A chunk that overlaps its own first copy
stays. The first place of a line always stays, since an earlier chunk would hold an earlier one.

Defined results: a null text stays null, has no lines and loses none; an empty text is one empty line; an empty table gives no rows; rows that
repeat both doc_id and text are one document and are treated alike; null ids sort last; a document may lose all
its lines and then has the empty text; other columns pass through under any name, but _n_lines and _n_removed_lines are replaced.
Single lines are never removed, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import WORD, materialise

LEAST_WORDS = 10
HAS_WORD = r"[^\x20\x09-\x0D]"
KEY = ["id", "k1", "k2"]


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `lines` and `chunks`, an array of (start, stop): lines that hold a word, each with the next such line, from 1."""
    worded = f"filter(transform(lines, (x, i) -> if(x rlike r'{HAS_WORD}', i + 1, 0)), i -> i > 0)"
    pairs = "zip_with(slice(worded, 1, greatest(size(worded) - 1, 0)), slice(worded, 2, size(worded)), (a, b) -> struct(a as start, b as stop))"
    split = docs.withColumn("lines", F.split(F.col(text), "\n", -1)).withColumn("worded", F.expr(worded))
    return split.withColumn("chunks", F.expr(pairs)).drop("worded")


def bodies(chunks: str, *more: str) -> Column:
    """The chunks with their text, and further fields of theirs; rows carry no array of all lines."""
    fields = "".join(f", c.{m} as {m}" for m in more)
    return F.expr(f"transform({chunks}, c -> struct(c.start as start, c.stop as stop, array_join(slice(lines, c.start, c.stop - c.start + 1), '\\n') as body{fields}))")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, id, k1, k2): the row as a struct, its id, and 128 bits over its text."""
    t = F.col(text).cast("string")
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"))


def _text(text: str) -> Column:
    return F.col("row")[text].cast("string")


def _place(*more: str) -> Column:
    return F.struct(F.col("id").isNull().alias("none"), *KEY, "start", *more)


def _is_later() -> Column:
    """Not the first place, nor one that overlaps it."""
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    return ~same | (F.col("start") > F.col("first.stop"))


def repeated_chunks(keyed: DataFrame, text: str = "text") -> DataFrame:
    """keyed with `marks`, an array of (start, stop, h, later) of the chunks whose hash is repeated, null if none; written."""
    # explode_outer: for a plain explode Spark adds a filter on the array, which computes it twice, within its own lambdas.
    found = chunked(keyed.select(*KEY, _text(text).alias("t")), "t").select(*KEY, F.explode_outer(bodies("chunks")).alias("c")).where("c is not null").select(*KEY, "c.*")
    slim = materialise(found.select(*KEY, "start", "stop", F.xxhash64("body").alias("h")).distinct(), "chunks")
    # Written first: a join with a table is one that AQE may split where a chunk is hot, a join with an aggregation is not.
    first = slim.groupBy("h").agg(F.count("*").alias("n"), F.min(_place("stop")).alias("first")).where("n > 1")
    first = materialise(first.drop("n"), "firsts")
    marked = slim.join(first, "h").groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop", "h", _is_later().alias("later"))).alias("marks"))
    marked = materialise(marked.select(F.col("id").alias("m_id"), F.col("k1").alias("m1"), F.col("k2").alias("m2"), "marks"), "marked")
    # A merge at every size: the plan, and what it shuffles, does not change as tables grow.
    joined = keyed.join(marked.hint("merge"), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    return materialise(joined.drop("m_id", "m1", "m2"), "marked-texts")


def _marked_bodies(marked: DataFrame, text: str) -> DataFrame:
    split = marked.where("marks is not null").select(*KEY, "marks", F.split(_text(text), "\n", -1).alias("lines"))
    return split.select(*KEY, F.explode_outer(bodies("marks", "h")).alias("c")).select(*KEY, "c.*")


def compared(marked: DataFrame, text: str = "text") -> DataFrame:
    """marked with `gone`, an array of (start, stop) of the chunks whose bytes stand at an earlier place."""
    extremes = _marked_bodies(marked, text).groupBy("h").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    differ = materialise(extremes.where("least <> most").select("h"), "differ")
    by_hash = F.expr("transform(filter(marks, m -> m.later), m -> struct(m.start as start, m.stop as stop))")
    if differ.isEmpty():
        return marked.select("row", by_hash.alias("gone"))
    own = materialise(_marked_bodies(marked, text).join(differ, "h"), "same-hash")
    first = materialise(own.groupBy("h", "body").agg(F.min(_place("stop")).alias("first")), "first-bytes")
    exact = own.join(first, ["h", "body"]).groupBy(*KEY).agg(
        F.collect_set(F.struct("start", "stop")).alias("judged"), F.collect_set(F.when(_is_later(), F.struct("start", "stop"))).alias("late")
    )
    exact = materialise(exact.select(F.col("id").alias("m_id"), F.col("k1").alias("m1"), F.col("k2").alias("m2"), "judged", "late"), "exact")
    joined = marked.join(exact, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    gone = F.when(F.col("judged").isNull(), by_hash).otherwise(F.array_union(F.array_except(by_hash, "judged"), "late"))
    return joined.select("row", gone.alias("gone"))


def runs(lines: str, gone: str, least_words: int) -> Column:
    """The runs of neighbouring lines of the array `gone` of (start, stop) that hold least_words words or more, as such an array."""
    lost = f"array_sort(array_distinct(flatten(transform({gone}, c -> sequence(c.start, c.stop)))))"
    starts = "filter(lost, (x, i) -> i = 0 or get(lost, i - 1) < x - 1)"
    stops = "filter(lost, (x, i) -> i = size(lost) - 1 or get(lost, i + 1) > x + 1)"
    both = f"transform(array({lost}), lost -> zip_with({starts}, {stops}, (a, b) -> struct(a as start, b as stop)))[0]"
    words = f"regexp_count(array_join(slice({lines}, r.start, r.stop - r.start + 1), '\\n'), r'{WORD}')"
    return F.expr(f"filter({both}, r -> {words} >= {least_words})")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with `text` less its repeated passages of two or more lines that hold a word and least_words words, and _n_lines and _n_removed_lines."""
    cut = compared(repeated_chunks(_keyed(docs, doc_id, text), text), text).withColumn("lines", F.split(_text(text), "\n", -1))
    cut = cut.withColumn("gone", F.when(F.size("gone") > 0, runs("lines", "gone", least_words)))
    lost = "flatten(transform(gone, c -> sequence(c.start, c.stop)))"
    cut = cut.withColumn("stay", F.when(F.size("gone") > 0, F.expr(f"array_except(sequence(1, size(lines)), {lost})")))
    kept = F.when(F.col("stay").isNull(), _text(text)).otherwise(F.expr("array_join(transform(stay, i -> lines[i - 1]), '\\n')"))
    own = [F.col(f"row.`{c}`") if c != text else kept.alias(text) for c in docs.columns if c not in ("_n_lines", "_n_removed_lines")]
    n_lines = F.coalesce(F.array_size("lines"), F.lit(0)).cast("long")
    removed = F.when(F.col("stay").isNull(), 0).otherwise(F.array_size("lines") - F.array_size("stay")).cast("long")
    return cut.select(*own, n_lines.alias("_n_lines"), removed.alias("_n_removed_lines"))


ORACLE = r"""
with docs as (
  select distinct doc_id, text, string_split(text, chr(10)) as l from documents where text is not null
), lines as (
  select doc_id, text, unnest(l) as line, generate_subscripts(l, 1) as i from docs
), worded as (
  select doc_id, text, i as start, lead(i) over (partition by doc_id, text order by i) as stop from lines where regexp_matches(line, '[^\x20\x09-\x0D]')
), chunks as (
  select w.doc_id, w.text, start, stop, array_to_string(d.l[start:stop], chr(10)) as body
  from worded w join docs d on w.doc_id is not distinct from d.doc_id and w.text = d.text where stop is not null
), ranked as (
  select *, first(doc_id) over f as first_id, first(text) over f as first_text, first(stop) over f as first_stop from chunks window f as (partition by body order by doc_id nulls last, text, start)
), marked as (
  select distinct doc_id, text, unnest(range(start, stop + 1)) as i from ranked where not (doc_id is not distinct from first_id and text = first_text) or start > first_stop
), runs as (
  select doc_id, text, i, i - row_number() over (partition by doc_id, text order by i) as run from marked
), sized as (
  select r.*, sum(len(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+'))) over (partition by r.doc_id, r.text, run) as n_words
  from runs r join lines l on l.doc_id is not distinct from r.doc_id and l.text = r.text and l.i = r.i
), gone as (
  select doc_id, text, i from sized where n_words >= 10
), kept as (
  select l.doc_id, l.text, count(*) as n_lines, count(g.i) as n_removed_lines, coalesce(string_agg(line, chr(10) order by l.i) filter (where g.i is null), '') as body
  from lines l left join gone g on l.doc_id is not distinct from g.doc_id and l.text = g.text and l.i = g.i group by l.doc_id, l.text
)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed_lines, 0)::bigint as n_removed_lines, sha256(k.body) as kept_sha256
from documents d left join kept k on d.doc_id is not distinct from k.doc_id and d.text = k.text
"""
