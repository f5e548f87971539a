"""URL filters by a temporal list join, with DataFrame operations only.

A list is a table of dated events: an entry (key and action) is added or
removed on a day. Consecutive events of one entry become validity intervals.
Every capture is evaluated against the entries active at its fetch time: its
host, each parent domain and its first path segment are looked up by an
equi-join on the key with the interval as the residual condition. The longest
matching key decides; at equal keys an allowing entry wins.

The lookup joins narrow rows, the interval table is written before the join
so that both sides have an exchange of their own and Spark splits a hot host,
and the page bodies are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import cut, table

#: Host and first path segment of an absolute URL.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]+)"

FIRST_DAY = "2024-01-01"
LAST_DAY = "9999-12-31"


def intervals(events: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) from events (key, action, event, at).

    An entry is active from an ``add`` until the day of the next ``remove``.
    Adding an active entry and removing an inactive one change nothing; of
    several events of one entry on a day, ``remove`` takes effect last. Events
    with a null key, action or day are ignored.
    """
    entry = Window.partitionBy("key", "action").orderBy("at", "event")
    state = (
        events.where("key is not null and action is not null and at is not null and event in ('add', 'remove')")
        .groupBy("key", "action", "at")
        .agg(F.max("event").alias("event"))
        .withColumn("before", F.lag("event").over(entry))
        .where("before is null or before <> event")
    )
    return (
        state.withColumn("valid_to", F.coalesce(F.lead("at").over(entry), F.lit(LAST_DAY).cast("date")))
        .where("event = 'add'")
        .select("key", "action", F.col("at").alias("valid_from"), "valid_to")
    )


def lookup_keys(url):
    """Keys that may decide a URL: its host and parent domains of two labels or more, and host with first path segment."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    segment = F.regexp_extract(url, SEGMENT, 1)
    with_path = F.when(segment != "", F.array(F.concat(host, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(parents, with_path)).otherwise(F.array(F.lit("")))


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Verdict of every capture (page_id, url, fetched) under the list at that time.

    Returns page_id, host, fetched, verdict (``block``, ``allow`` or
    ``unlisted``), entry (the deciding key) and n_active, the number of active
    entries that match. A null or malformed URL has a null host and is
    unlisted, and so is a capture with a null fetch day; neither takes part in
    the lookup. Repeated captures give repeated results. Other columns are left
    out, whatever their names; an empty table gives no rows, an empty list
    leaves all unlisted.
    """
    active = cut(intervals(events), "list-intervals")
    hosted = captures.select("page_id", "url", F.nullif(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), "fetched")
    known = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    rest = hosted.where(~known).select("page_id", "host", "fetched", F.lit("unlisted").alias("verdict"), F.lit(None).cast("string").alias("entry"), F.lit(0).cast("long").alias("n_active"))
    keyed = hosted.where(known).withColumn("rid", F.monotonically_increasing_id()).select("rid", "page_id", "host", "fetched", F.explode(lookup_keys(F.col("url"))).alias("key"))
    matched = keyed.join(active, (keyed["key"] == active["key"]) & (keyed["fetched"] >= active["valid_from"]) & (keyed["fetched"] < active["valid_to"]), "left").select(
        "rid", "page_id", "host", "fetched", active["key"].alias("entry"), "action"
    )
    best = F.max(F.when(F.col("entry").isNotNull(), F.struct(F.length("entry").alias("n"), (F.col("action") == "allow").alias("allow"), "entry")))
    looked_up = (
        matched.groupBy("rid")
        .agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("fetched").alias("fetched"), best.alias("best"), F.count("entry").alias("n_active"))
        .select(
            "page_id",
            "host",
            "fetched",
            F.when(F.col("best").isNull(), "unlisted").when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"),
            F.col("best.entry").alias("entry"),
            "n_active",
        )
    )
    return looked_up.unionByName(rest)


def _number(column: str) -> str:
    """A number from 0 to 2**32 - 1 that both engines derive from a text."""
    return f"cast(conv(substring(md5({column}), 1, 8), 16, 10) as bigint)"


def captures(pages: DataFrame) -> DataFrame:
    """The pages as captures; the table has no fetch day, so it is derived from the id."""
    return pages.select("page_id", "url", F.expr(f"date_add(date'{FIRST_DAY}', cast(pmod(page_id * 37, 366) as int))").alias("fetched"))


def derived_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, parent domains and paths that occur in ``pages``.

    No public list is at hand, so its events follow from a digest of each key:
    a third of the hosts are blocked for a while, some of them again later, a
    quarter of the parent domains from some day on, and a sixth of the paths
    allowed for good.
    """
    host, segment = F.lower(F.regexp_extract("url", HOST, 1)), F.regexp_extract("url", SEGMENT, 1)
    parts = pages.select(host.alias("host"), segment.alias("segment")).where("host <> ''").distinct()
    hosts = parts.select("host").distinct().selectExpr("host as key", f"{_number('host')} as n").where("n % 3 = 0")
    parents = parts.select(F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".").alias("key")).where("instr(key, '.') > 0").distinct().selectExpr("key", f"{_number('key')} as n").where("n % 4 = 1")
    paths = parts.where("segment <> ''").select(F.concat("host", "segment").alias("key")).distinct().selectExpr("key", f"{_number('key')} as n").where("n % 6 = 2")
    day = f"date_add(date'{FIRST_DAY}', cast({{}} as int))"
    added = hosts.selectExpr("key", "'block' as action", "'add' as event", f"{day.format('n % 200')} as at")
    removed = hosts.selectExpr("key", "'block' as action", "'remove' as event", f"{day.format('n % 200 + 10 + n % 90')} as at")
    again = hosts.where("n % 5 = 0").selectExpr("key", "'block' as action", "'add' as event", f"{day.format('n % 200 + 130')} as at")
    broad = parents.selectExpr("key", "'block' as action", "'add' as event", f"{day.format('n % 300')} as at")
    allowed = paths.selectExpr("key", "'allow' as action", "'add' as event", f"{day.format('n % 250')} as at")
    return added.unionByName(removed).unionByName(again).unionByName(broad).unionByName(allowed)


def filter_pages(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return evaluate(captures(pages), derived_events(pages))


#: The same evaluation for DuckDB.
SQL = rf"""
with parts as (
  select page_id, url, lower(regexp_extract(url, '{HOST}', 1)) as host, regexp_extract(url, '{SEGMENT}', 1) as segment,
         (date '{FIRST_DAY}' + cast((page_id * 37 % 366 + 366) % 366 as integer))::date as fetched, row_number() over () as rid
  from pages),
keys as (
  select distinct 'host' as kind, host as key from parts where host <> ''
  union select distinct 'parent', array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') from parts where host <> ''
  union select distinct 'path', host || segment from parts where host <> '' and segment <> ''),
numbered as (select kind, key, ('0x' || substr(md5(key), 1, 8))::bigint as n from keys where kind <> 'parent' or contains(key, '.')),
events as (
  select key, 'block' as action, 'add' as event, n % 200 as day from numbered where kind = 'host' and n % 3 = 0
  union all select key, 'block', 'remove', n % 200 + 10 + n % 90 from numbered where kind = 'host' and n % 3 = 0
  union all select key, 'block', 'add', n % 200 + 130 from numbered where kind = 'host' and n % 3 = 0 and n % 5 = 0
  union all select key, 'block', 'add', n % 300 from numbered where kind = 'parent' and n % 4 = 1
  union all select key, 'allow', 'add', n % 250 from numbered where kind = 'path' and n % 6 = 2),
days as (select key, action, day, max(event) as event from events group by all),
changes as (select *, lag(event) over (partition by key, action order by day) as before from days),
states as (
  select key, action, event, day, lead(day) over (partition by key, action order by day) as until
  from changes where before is null or before <> event),
spans as (
  select key, action, (date '{FIRST_DAY}' + cast(day as integer))::date as valid_from,
         coalesce((date '{FIRST_DAY}' + cast(until as integer))::date, date '{LAST_DAY}') as valid_to
  from states where event = 'add'),
lookups as (
  select rid, fetched, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') as key
  from parts, lateral (select unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) as i) where host <> ''
  union all select rid, fetched, host || segment from parts where host <> '' and segment <> ''),
hits as (
  select rid, s.key as entry, s.action, row_number() over (partition by rid order by length(s.key) desc, s.action, s.key desc) as k,
         count(*) over (partition by rid) as n
  from lookups l join spans s on l.key = s.key and l.fetched >= s.valid_from and l.fetched < s.valid_to)
select p.page_id, nullif(p.host, '') as host, p.fetched, coalesce(h.action, 'unlisted') as verdict, h.entry, coalesce(h.n, 0) as n_active
from parts p left join hits h on p.rid = h.rid and h.k = 1
"""
