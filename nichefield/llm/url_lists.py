"""URL filters with dated lists: each capture is judged by the entries that were active when it was fetched.

An entry is an event (list, kind, pattern, at, action): list is ``block`` or ``allow``, kind ``domain`` (the host and
all below it), ``host`` (that host only) or ``prefix`` (host and leading path segments), action ``add`` or ``remove``.
Events of one pattern become validity intervals [at, next event): the as-of join is then an equality on the keys that
a URL can match, with the fetch time inside the interval. The longest active pattern decides, ``block`` before
``allow`` where both are equal.

Defined cases: of several events of a pattern at one time a removal wins; a null or odd url and a null fetch time match
nothing (verdict ``none``); very long urls are read whole; an empty table gives an empty one; null patterns, kinds, lists or times are no entries; repeated captures are judged each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, table

#: Intervals that may be broadcast (some 100 bytes each); beyond that the join shuffles and splits hot keys.
BROADCAST_INTERVALS = 200_000


#: What surrounds a url; its host, in brackets or not, behind the last @ of the authority; its path; dots behind a host.
BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:@\x00-\x20]+)"
PATH = r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]+(/[^?#]*)"
DOTS = r"\.+$"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): when each entry was active; ``until`` is null for entries still active."""
    known = entries.where("list in ('block', 'allow') and kind in ('domain', 'host', 'prefix') and pattern is not null and at is not null and action in ('add', 'remove')")
    events = known.groupBy("list", "kind", F.regexp_replace(F.lower("pattern"), DOTS, "").alias("pattern"), "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    later = W.partitionBy("list", "kind", "pattern").orderBy("at")
    return events.withColumn("until", F.lead("at").over(later)).where("not removed").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def url_parts(url):
    """Host and path segments, lower-cased; an empty host where the url has none.

    Blanks around the url, a name and password before the host, a port and dots behind it do not count; the scheme may be missing.
    """
    low = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), BLANKS, "")
    host = F.regexp_replace(F.regexp_extract(low, HOST, 1), DOTS, "")
    return host, F.filter(F.split(F.regexp_extract(low, PATH, 1), "/"), lambda s: s != "")


def judge(captures: DataFrame, entries: DataFrame, ident: str = "page_id", url: str = "url", fetched: str = "fetched",
          broadcast_intervals: int = BROADCAST_INTERVALS) -> DataFrame:
    """(ident, host, fetched, n_active, verdict, decided_by) of every capture."""
    active = checkpointed(intervals(entries))
    figures = active.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)).alias("depth")).first()
    host, segments = url_parts(F.col(url))
    rows = captures.select(F.col(ident), F.col(url), F.col(fetched), F.monotonically_increasing_id().alias("_row"))
    rows = checkpointed(rows.select("_row", F.col(ident).alias("_id"), F.col(fetched).alias("_at"), host.alias("host"), segments.alias("_segments")))
    labels = F.split("host", r"\.")
    # Only as many path segments as the deepest prefix has can match.
    reach = F.least(F.size("_segments"), F.lit(figures["depth"] or 0))
    keys = F.concat(
        F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"))),
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"))),
        F.transform(F.when(reach > 0, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.col("host"), F.array_join(F.slice("_segments", F.lit(1), i), "/")).alias("pattern"))))
    wanted = rows.where("host <> '' and _at is not null").select("_row", "_at", F.explode(keys).alias("k")).select("_row", "_at", "k.kind", "k.pattern")
    side = F.broadcast(active) if figures["n"] <= broadcast_intervals else active.hint("merge")
    hits = wanted.join(side, ["kind", "pattern"]).where("since <= _at and (until is null or _at < until)")
    best = F.max(F.struct(F.length("pattern").alias("size"), (F.col("list") == "block").alias("block"), "list", "kind", "pattern"))
    found = hits.groupBy("_row").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    return rows.join(found, "_row", "left").select(
        F.col("_id").alias(ident), "host", F.col("_at").alias(fetched), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_active"),
        F.coalesce("best.list", F.lit("none")).alias("verdict"),
        F.concat_ws(":", "best.kind", "best.pattern").alias("decided_by"))


def listed(pages: DataFrame) -> DataFrame:
    """Dated list entries drawn from the pages' own hosts and paths by a hash, as the tables hold no list."""
    host, segments = url_parts(F.col("url"))
    base = pages.select(host.alias("host"), segments.alias("s")).where("host <> ''")
    names = base.select(F.lit("host").alias("kind"), F.col("host").alias("pattern")).unionByName(
        base.select(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''")).unionByName(
        base.where("size(s) > 0").select(F.lit("prefix").alias("kind"), F.concat_ws("/", "host", F.get("s", F.lit(0))).alias("pattern")))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "pattern")), 1, 6), 16, 10).cast("bigint")
    chosen = names.distinct().withColumn("h", h).where("h % 3 < 2")
    at = F.col("h") % 365
    events = F.array(F.struct(at.alias("at"), F.lit("add").alias("action")), F.struct((at + 60).alias("at"), F.lit("remove").alias("action")),
                     F.struct((at + 90).alias("at"), F.lit("add").alias("action")))
    return chosen.select(F.when(F.col("h") % 5 == 0, "allow").otherwise("block").alias("list"), "kind", "pattern",
                         F.explode(F.slice(events, F.lit(1), (F.col("h") % 3 * 2 + 1).cast("int"))).alias("e")).select("list", "kind", "pattern", "e.at", "e.action")


def op7_url_lists(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages.withColumn("fetched", F.col("page_id") * 37 % 500), listed(pages))


QUERIES = {"op7_url_lists": op7_url_lists}
ORACLES = {"op7_url_lists": rf"""
    with u as (select page_id, regexp_replace(lower(coalesce(url, '')), '{BLANKS}', '', 'g') as url from pages),
    p as materialized (
        select page_id, page_id * 37 % 500 as fetched, regexp_replace(regexp_extract(url, '{HOST}', 1), '{DOTS}', '') as host,
               list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') as s from u),
    names as (select 'host' as kind, host as pattern from p where host <> ''
              union select 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) from p where regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
              union select 'prefix', host || '/' || s[1] from p where host <> '' and len(s) > 0),
    chosen as (select * from (select kind, pattern, ('0x' || substr(md5(kind || '|' || pattern), 1, 6))::bigint as h from names) where h % 3 < 2),
    events as (select case when h % 5 = 0 then 'allow' else 'block' end as list, kind, pattern, h % 365 + e.d as day, e.action
               from chosen, (values (0, 'add', 0), (60, 'remove', 1), (90, 'add', 1)) as e(d, action, k) where e.k <= h % 3),
    spans as (select list, kind, pattern, day as since, lead(day) over (partition by list, kind, pattern order by day) as until, action from events),
    active as materialized (select * from spans where action = 'add'),
    keys as (select page_id, fetched, 'host' as kind, host as pattern from p where host <> ''
             union all select page_id, fetched, 'domain', array_to_string(l[i:], '.') from (
                 select page_id, fetched, string_split(host, '.') as l, unnest(range(1, len(string_split(host, '.')) + 1)) as i from p where host <> '')
             union all select page_id, fetched, 'prefix', host || '/' || array_to_string(s[:i], '/') from (
                 select page_id, fetched, host, s, unnest(range(1, len(s) + 1)) as i from p where host <> '')),
    hits as (select k.page_id, a.list, a.kind, a.pattern from keys k join active a on k.kind = a.kind and k.pattern = a.pattern
             where a.since <= k.fetched and (a.until is null or k.fetched < a.until)),
    best as (select page_id, count(*) over (partition by page_id) as n, list, kind, pattern,
                    row_number() over (partition by page_id order by length(pattern) desc, list desc, kind desc, pattern desc) as r from hits)
    select p.page_id, p.host, p.fetched, coalesce(b.n, 0) as n_active, coalesce(b.list, 'none') as verdict,
           coalesce(b.kind || ':' || b.pattern, '') as decided_by
    from p left join best b on b.page_id = p.page_id and b.r = 1"""}
