"""URL filters over time: captures against the list entries that were active when they were fetched.

A list entry says from when on a pattern (a host with all its subdomains, or a host with a path
prefix) is blocked, allowed or no longer listed. Entries of a pattern become validity intervals that
end where the next one begins. An as-of join evaluates every capture against the entries active at
its fetch time; the most specific pattern decides (a path over a host, then the longer one).
DataFrame functions only.

Intervals are cut at month ends and joined on (pattern, month), so a pattern with a long history costs a
capture only the entries of its own month. Captures are joined once per distinct (url, time).

Defined results: a null or unparsable url or a null time matches nothing and is kept; entries with
a null pattern, action or date are void; of entries of a pattern with one date, block goes before
allow before remove; repeated captures are judged alike; empty lists keep everything; urls may have any length. Columns of the
captures pass through, but _host, _pattern, _action and _kept replace columns named so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import materialise

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, starts, ends) of entries(pattern, action, listed_on date); ends is exclusive."""
    rank = F.array_position(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), F.col("action"))
    valid = entries.where("pattern is not null and listed_on is not null and action in ('block', 'allow', 'remove')")
    one = valid.groupBy("pattern", "listed_on").agg(F.min_by("action", rank).alias("action"))
    following = F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on"))
    ends = F.coalesce(following, F.lit(FOREVER).cast("date"))
    return one.select("pattern", "action", F.col("listed_on").alias("starts"), ends.alias("ends")).where("action <> 'remove'")


def judge_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """captures with _host, _pattern and _action of the deciding entry (null: none) and _kept."""
    spans = materialise(intervals(entries), "intervals")
    bounds = captures.agg(F.min(fetched_on).alias("lo"), F.max(fetched_on).alias("hi")).first()
    n_labels = F.size(F.split(F.split("pattern", "/")[0], r"\."))
    shape = spans.agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("depth"), F.coalesce(F.min(n_labels), F.lit(1)).alias("least")).first()
    depth = shape["depth"]
    lo, hi = (F.lit(bounds[k]).cast("date") for k in ("lo", "hi"))
    month = lambda c: F.trunc(c, "MM")
    months = F.sequence(month(F.greatest("starts", lo)), month(F.least(F.date_sub("ends", 1), hi)), F.expr("interval 1 month"))
    by_month = spans.where((F.col("starts") <= hi) & (F.col("ends") > lo)).select("pattern", "action", "starts", "ends", F.explode(months).alias("month"))

    asked = captures.select(F.col(url).alias("u"), F.col(fetched_on).alias("t")).where("u is not null and t is not null").distinct()
    split = asked.withColumn("h", host_of(F.col("u"))).where("h is not null").withColumn("labels", F.split("h", r"\.")).withColumn("parts", path_parts(F.col("u")))
    # No shorter name than the lists have: a bare top-level domain would be one key of a third of all captures.
    hosts = F.expr(f"transform(filter(sequence(1, size(labels)), i -> size(labels) - i + 1 >= {shape['least']}), i -> array_join(slice(labels, i, size(labels)), '.'))")
    paths = F.expr(f"transform(sequence(1, least(size(parts), {depth})), i -> concat(h, '/', array_join(slice(parts, 1, i), '/')))")
    deep = F.when(F.least(F.size("parts"), F.lit(depth)) > 0, paths).otherwise(F.array().cast("array<string>"))
    keys = split.select("u", "t", F.explode(F.concat(hosts, deep)).alias("pattern")).withColumn("month", month("t"))
    active = keys.join(by_month, ["pattern", "month"]).where("starts <= t and t < ends")
    weight = F.struct(F.col("pattern").contains("/").alias("deep"), F.length("pattern").alias("long"), "pattern", "action")
    best = materialise(active.groupBy("u", "t").agg(F.max(weight).alias("best")), "decided")
    own = ["_host", "_pattern", "_action", "_kept"]
    rows = captures.select(F.struct("*").alias("row"), F.col(url).alias("u"), F.col(fetched_on).alias("t")).join(best, ["u", "t"], "left")
    kept = [F.col("row")[c].alias(c) for c in captures.columns if c not in own]
    verdict = ~F.coalesce(F.col("best.action") == "block", F.lit(False))
    return rows.select(*kept, host_of(F.col("u")).alias("_host"), F.col("best.pattern").alias("_pattern"), F.col("best.action").alias("_action"), verdict.alias("_kept"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch time: one is derived from the page's id."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', int(pmod(page_id, 366)))").alias("fetched_on"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries about the hosts, domains and first path segments that occur in pages."""
    h = pages.select(host_of(F.col("url")).alias("host"), F.element_at(path_parts(F.col("url")), 1).alias("part")).where("host is not null")
    domain = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    many = h.where("host like '%.%.%'")
    names = h.select(F.col("host").alias("pattern")).union(many.select(domain)).union(h.where("part is not null").select(F.concat_ws("/", "host", "part"))).distinct()
    seed = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 8), 16, 10).cast("long")
    turns = names.withColumn("seed", seed).select("pattern", "seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("turn"))
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (F.floor(F.col("seed") / F.expr("array(1, 3, 9)")[F.col("turn")]) % 3 + 1).cast("int"))
    day = (F.col("seed") % 120 + 110 * F.col("turn")).cast("int")
    return turns.select("pattern", action.alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day).alias("listed_on"))


ORACLE = r"""
with captures as (
  select page_id, url, (date '2024-01-01' + (page_id % 366)::int) as t,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts
  from pages
), names as (
  select host as pattern from captures where host is not null
  union select array_to_string(string_split(host, '.')[-2:], '.') from captures where host like '%.%.%'
  union select host || '/' || parts[1] from captures where host is not null and len(parts) > 0
), seeds as (
  select pattern, ('0x' || substr(md5(pattern), 1, 8))::bigint as seed from names
), entries as (
  select pattern, ['block', 'allow', 'remove'][((seed // [1, 3, 9][turn + 1]) % 3 + 1)::int] as action,
    date '2024-01-01' + (seed % 120 + 110 * turn)::int as starts
  from seeds, (select unnest([0, 1, 2]) as turn)
), spans as (
  select *, lead(starts, 1, date '9999-12-31') over (partition by pattern order by starts) as ends from entries
), hits as (
  select c.url, c.t, s.pattern, s.action,
    row_number() over (partition by c.page_id, c.url, c.t order by (s.pattern like '%/%') desc, length(s.pattern) desc, s.pattern desc) as k, c.page_id
  from captures c join spans s on s.starts <= c.t and c.t < s.ends and s.action <> 'remove'
    and (s.pattern = c.host or c.host like '%.' || s.pattern or s.pattern = c.host || '/' || c.parts[1])
)
select c.page_id, strftime(c.t, '%Y-%m-%d') as fetched_on, c.host, h.pattern, h.action, coalesce(h.action <> 'block', true) as kept
from captures c left join hits h on h.k = 1 and c.page_id = h.page_id and c.url = h.url
"""
