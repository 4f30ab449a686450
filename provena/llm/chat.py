"""Chat formatting by quotation linking.

Messages quote others with leading '>' marks. Each line's quote level is the number of its marks;
runs of lines of one level, cut at blank lines, are passages. Passages are normalised (lower case,
white space collapsed, so re-wrapped quotes agree) and hashed. The hash of a quoted passage is joined
to the messages that say it themselves: to the first one in the same conversation if that is
earlier, else to the first one of another conversation. Originals are reduced to the first of each conversation and
the first two conversations per hash before the join, so a passage that a third of all messages say or quote pairs once a quote.

The parent of a message is the source of its least nested linked passage, else the previous turn of its
conversation where there is one. Conversations come back as one row a message in reply order, with its text without
quotes and without the lines that announce them. Reply order is depth first: a turn is followed by the turns
that answer it, the earlier before the later, each with what answers it in turn. A turn answers the turn of the same conversation
that its first message (by text hash) links to, else the previous turn; turns with neither begin threads of their own.

Depth-first places are found without a task a conversation: runs of turns that each answer the one before are one segment, and the
tour through the segments is summed by pointer doubling, a join a round, with the logarithm of the longest tour as rounds.

Defined results: a null text is an empty message; a null turn, or one that is no whole number, sorts first and has no previous turn;
rows with a null conversation form one; rows that repeat conversation, turn and text share their
links and are messages of their own; messages of one turn stand together, by text hash and role; conversation ids may have any
type that sorts; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import materialise, row_key, running_total

MARKS = re.compile(r"^((?:[ \t]*>)+) ?(.*)$", re.S)
ANNOUNCES = re.compile(r"\bwrote:\s*$", re.I)

PARSED = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("own", T.ArrayType(T.StringType())),
        T.StructField(
            "quotes",
            T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("nth", T.IntegerType()), T.StructField("hash", T.StringType())])),
        ),
    ]
)


def passage_hash(passage: str) -> str:
    return hashlib.md5(" ".join(passage.lower().split()).encode()).hexdigest()


def parse(text: str) -> tuple[str, list[str], list[tuple[int, int, str]]]:
    """(text without quotes, hashes of own passages, (level, number, hash) of quoted passages)."""
    levels: list[tuple[int, str]] = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        levels.append((m[1].count(">"), m[2]) if m else (0, line))
    kept = [
        (level, line)
        for k, (level, line) in enumerate(levels)
        if not (ANNOUNCES.search(line) and k + 1 < len(levels) and levels[k + 1][0] > level)
    ]
    passages: list[tuple[int, list[str]]] = []
    last = None
    for level, line in kept:
        if not line.strip():
            last = None
        elif last == level:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
            last = level
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(line for level, line in kept if level == 0)).strip("\n")
    own = sorted({passage_hash("\n".join(x)) for level, x in passages if level == 0})
    quotes = [(level, k, passage_hash("\n".join(x))) for k, (level, x) in enumerate(passages) if level > 0]
    return body, own, quotes


def parsed(text: Column) -> Column:
    @F.arrow_udf(PARSED)
    def run(texts: pa.Array) -> pa.Array:
        found = [parse(t or "") for t in texts.to_pylist()]
        quote = pa.struct([("level", pa.int32()), ("nth", pa.int32()), ("hash", pa.string())])
        quotes = [[{"level": a, "nth": b, "hash": h} for a, b, h in q] for _, _, q in found]
        columns = [pa.array([b for b, _, _ in found], pa.string()), pa.array([o for _, o, _ in found], pa.list_(pa.string())), pa.array(quotes, pa.list_(quote))]
        return pa.StructArray.from_arrays(columns, PARSED.names)

    return run.asNondeterministic()(text.cast("string"))


def _sources(said: DataFrame) -> DataFrame:
    """(key, n_linked, near, far) of messages with linked quotes: the source of the least nested one, as a turn of the
    own conversation (near) or as (conv, here, ck) in another one (far)."""
    quotes = said.where("size(quotes) > 0").select("ck", "turn", "key", F.explode("quotes").alias("q")).distinct()
    quotes = materialise(quotes.select("ck", "turn", "key", "q.level", "q.nth", F.col("q.hash").alias("h")), "quotes")
    if quotes.isEmpty():
        none = F.lit(None).cast("long")
        far = F.struct(said["conv"], none.alias("here"), said["ck"])
        return said.limit(0).select("key", none.alias("n_linked"), none.alias("near"), far.alias("far"))
    own = said.select("ck", "conv", "turn", F.explode("own").alias("h"))
    # Written first: joins of tables are ones that AQE may split where a passage is hot.
    here = materialise(own.groupBy("ck", "conv", "h").agg(F.min("turn").alias("here")), "here")
    place = F.struct("conv", "here", "ck")
    first = materialise(here.groupBy("h").agg(F.min(place).alias("first")), "first")
    second = here.join(first, "h").where("ck <> first.ck").groupBy("h").agg(F.min(place).alias("second"))
    there = materialise(first.join(second, "h", "left"), "there")
    tied = quotes.join(here.select("ck", "h", "here"), ["ck", "h"], "left").join(there, "h", "left")
    near = F.when(F.col("here") < F.col("turn"), F.col("here"))
    far = F.when(near.isNull(), F.when(F.col("first.ck") != F.col("ck"), F.col("first")).otherwise(F.col("second")))
    linked = tied.withColumns({"near": near, "far": far})
    found = linked.where("near is not null or far is not null").groupBy("key").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", "nth", "near", "far")).alias("best"))
    return found.select("key", "n_linked", "best.near", "best.far")


def tour_sums(tour: DataFrame) -> DataFrame:
    """Rows (ck, seg, up, s_seg, s_up, d) of linked lists, with d summed from the row to the end of its list.

    Pointer doubling: every round each row adds what its successor has and skips to the successor's successor.
    """
    tour = materialise(tour, "tour")
    while not tour.where("s_seg is not null").isEmpty():
        after = tour.select("ck", F.col("seg").alias("s_seg"), F.col("up").alias("s_up"), F.col("s_seg").alias("n_seg"), F.col("s_up").alias("n_up"), F.col("d").alias("more"))
        step = tour.join(after, ["ck", "s_seg", "s_up"], "left")
        tour = materialise(step.select("ck", "seg", "up", F.col("n_seg").alias("s_seg"), F.col("n_up").alias("s_up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")), "tour")
    return tour


def reply_order(turns: DataFrame) -> DataFrame:
    """(ck, turn, seg, before) of turns(ck, turn, parent, n), unique by ck and turn: the number of the turn's segment, and how
    many messages (n a turn) stand before the segment in depth-first order. parent is an earlier turn of ck or null."""
    one = F.lit(1).cast("long")
    headed = turns.withColumn("head", (~F.coalesce(F.col("parent") == F.col("turn") - 1, F.lit(False))).cast("long"))
    numbered = materialise(running_total(headed, ["ck"], ["turn"], "head", "seg"), "segments")
    sizes = numbered.groupBy("ck", "seg").agg(F.sum("n").alias("size"))
    several = materialise(sizes.groupBy("ck").agg(F.max("seg").alias("most"), F.sum("size").alias("total")).where("most > 1"), "several")
    if several.isEmpty():  # every conversation is one thread in turn order
        return numbered.select("ck", "turn", "seg", F.lit(0).cast("long").alias("before"))
    whose = numbered.select("ck", F.col("turn").alias("parent"), F.col("seg").alias("p_seg"))
    heads = numbered.where("head = 1").select("ck", "seg", "turn", "parent").join(several, "ck", "left_semi").join(whose, ["ck", "parent"], "left")
    # Of a segment's answers those to its later turns come first, since the segment goes on before earlier turns are answered again.
    heads = heads.select("ck", "seg", F.coalesce("p_seg", F.lit(0)).alias("p_seg"), F.coalesce(-F.col("parent"), F.lit(0)).alias("late"), "turn", one.alias("one"))
    children = materialise(running_total(heads, ["ck", "p_seg"], ["late", "turn"], "one", "rank").select("ck", "seg", "p_seg", "rank").join(sizes, ["ck", "seg"]), "children")
    first = children.where("rank = 1").select("ck", F.col("p_seg").alias("seg"), F.col("seg").alias("child"))
    following = children.select("ck", "p_seg", (F.col("rank") - 1).alias("rank"), F.col("seg").alias("sibling"))
    down = children.join(first, ["ck", "seg"], "left").select(
        "ck", "seg", F.lit(0).alias("up"), F.coalesce("child", "seg").alias("s_seg"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("s_up"), F.col("size").alias("d")
    )
    up = children.join(following, ["ck", "p_seg", "rank"], "left").select(
        "ck", "seg", F.lit(1).alias("up"), F.coalesce("sibling", F.when(F.col("p_seg") > 0, F.col("p_seg"))).alias("s_seg"),
        F.when(F.col("sibling").isNotNull(), 0).when(F.col("p_seg") > 0, 1).alias("s_up"), F.lit(0).cast("long").alias("d"),
    )
    placed = tour_sums(down.unionByName(up)).where("up = 0").join(several, "ck").select("ck", "seg", (F.col("total") - F.col("d")).alias("before"))
    return numbered.select("ck", "turn", "seg").join(placed, ["ck", "seg"], "left").select("ck", "turn", "seg", F.coalesce("before", F.lit(0)).cast("long").alias("before"))


def link_quotes(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, position, reply_conv_id, reply_turn, n_quotes, n_linked, text) for every message."""
    conv, at = F.col(conv_id), F.col(turn).try_cast("long")
    ck = F.when(conv.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), conv.cast("string")))
    read = messages.select(
        ck.alias("ck"), conv.alias("conv"), at.alias("turn"), F.col(role).alias("role"), row_key(F.concat_ws("|", conv.cast("string"), at), F.col(text)).alias("key"), parsed(F.col(text)).alias("p")
    )
    said = materialise(read.select("ck", "conv", "turn", "role", "key", "p.body", "p.own", "p.quotes"), "messages")
    linked = materialise(said.drop("own").join(materialise(_sources(said), "sources"), "key", "left"), "linked")

    turns = linked.groupBy("ck", "turn").agg(F.count("*").alias("n"), F.min(F.struct("key", "near"))["near"].alias("near"))
    turns = materialise(turns, "turns")
    # The greatest smaller turn: numbers may have gaps. A turn's number in its conversation is a distributed running total.
    placed = materialise(running_total(turns.where("turn is not null").select("ck", "turn", F.lit(1).cast("long").alias("one")), ["ck"], ["turn"], "one", "place"), "turn-places")
    after = placed.select("ck", (F.col("place") + 1).alias("place"), F.col("turn").alias("previous"))
    known = turns.join(placed.join(after, ["ck", "place"]).select("ck", "turn", "previous"), ["ck", "turn"], "left")
    known = materialise(known.select("ck", "turn", "n", "previous", F.coalesce("near", "previous").alias("parent")), "answers")
    order = reply_order(known.drop("previous")).select(F.col("ck").alias("c"), F.col("turn").alias("t"), "seg", "before")
    order = order.join(known.select("ck", "turn", "previous"), (F.col("c") == F.col("ck")) & F.col("t").eqNullSafe(F.col("turn"))).select("c", "t", "seg", "before", "previous")
    whole = linked.join(materialise(order, "order"), (F.col("ck") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).select(
        "ck", "conv", "turn", "role", "key", "body", "near", "far", "previous", "n_linked", F.size("quotes").cast("long").alias("n_quotes"), "seg", "before", F.lit(1).alias("one")
    )
    placed = running_total(whole, ["ck", "seg"], ["turn", "key", "role"], "one", "nth")
    own = F.coalesce("near", F.when(F.col("far").isNull(), F.col("previous")))
    return placed.select(
        F.col("conv").alias("conv_id"), "turn", "role", (F.col("before") + F.col("nth") - 1).cast("long").alias("position"),
        F.when(own.isNotNull(), F.col("conv")).otherwise(F.col("far.conv")).alias("reply_conv_id"), F.coalesce(own, F.col("far.here")).alias("reply_turn"),
        "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("body").alias("text"),
    )


ORACLE = r"""
with m as (
  select row_number() over () as rid, conv_id as conv, turn::bigint as turn, role, text,
    md5(concat_ws('|', conv_id, turn) || case when text is null then '-' else '+' || text end) as key from conversations
), raw as (
  select rid, generate_subscripts(l, 1) as i, unnest(l) as line from (select rid, string_split(coalesce(text, ''), chr(10)) as l from m)
), marked as (
  select *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+) ?', 1), '[^>]', '', 'g')) as level from raw
), lines as (
  select rid, i, level, case when level > 0 then regexp_replace(line, '^(?:[ \t]*>)+ ?', '') else line end as body, lead(level) over (partition by rid order by i) as next_level from marked
), kept as (
  select *, trim(regexp_replace(body, '\s+', ' ', 'g')) = '' as blank from lines where not (regexp_matches(body, '(?i)\bwrote:\s*$') and coalesce(next_level > level, false))
), started as (
  select *, not blank and coalesce(lag(blank) over w or lag(level) over w <> level, true) as starts from kept window w as (partition by rid order by i)
), passages as (
  select rid, level, nth - 1 as nth, trim(regexp_replace(lower(string_agg(body, ' ' order by i)), '\s+', ' ', 'g')) as passage
  from (select *, sum(starts::int) over (partition by rid order by i) as nth from started) where not blank group by rid, level, nth
), bodies as (
  select rid, trim(regexp_replace(string_agg(body, chr(10) order by i), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) as body from kept where level = 0 group by rid
), own as (
  select distinct m.conv, m.turn, p.passage from passages p join m using (rid) where level = 0
), here as (select conv, passage, min(turn) as here from own group by all
), there as (select *, row_number() over (partition by passage order by conv nulls first) as k from here
), quotes as (
  select m.rid, q.level, q.nth, case when h.here < m.turn then {'conv': m.conv, 'turn': h.here} when t.passage is not null and t.conv is distinct from m.conv then {'conv': t.conv, 'turn': t.here} when u.passage is not null then {'conv': u.conv, 'turn': u.here} end as source,
    case when h.here < m.turn then h.here end as near
  from passages q join m using (rid) left join here h on h.conv is not distinct from m.conv and h.passage = q.passage
    left join there t on t.passage = q.passage and t.k = 1 left join there u on u.passage = q.passage and u.k = 2 where q.level > 0
), parents as (
  select rid, count(*) as n_quotes, count(source) as n_linked, first(source order by level, nth) filter (where source is not null) as parent,
    first(near order by level, nth) filter (where source is not null) as near from quotes group by rid
), turns as (select conv, turn, lag(turn) over (partition by conv order by turn) as before from (select distinct conv, turn from m where turn is not null)
), joined as (
  select m.*, coalesce(b.body, '') as body, coalesce(p.n_quotes, 0) as n_quotes, coalesce(p.n_linked, 0) as n_linked, coalesce(p.parent, case when t.before is not null then {'conv': m.conv, 'turn': t.before} end) as reply, p.near, t.before as previous
  from m left join bodies b using (rid) left join parents p using (rid) left join turns t on t.conv is not distinct from m.conv and t.turn = m.turn
), answers as (
  select conv, turn, coalesce(first(near order by key), first(previous)) as parent from joined group by all
), paths as (
  with recursive walk as (
    select conv, turn, [coalesce(turn, -1)] as path from answers where parent is null
    union all select a.conv, a.turn, w.path || [a.turn] from walk w join answers a on a.conv is not distinct from w.conv and a.parent = w.turn
  ) select * from walk
)
select j.conv as conv_id, j.turn, role, row_number() over (partition by j.conv order by path, key, role nulls first) - 1 as position, reply.conv as reply_conv_id, reply.turn as reply_turn,
  n_quotes::bigint as n_quotes, n_linked::bigint as n_linked, body as text
from joined j join paths w on w.conv is not distinct from j.conv and w.turn is not distinct from j.turn
"""
