"""The URL list query. The tables hold no list and no fetch times: both are derived from
the pages' URLs and ids, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import url_lists
from docloom.llm.base import table

# kind, one value in so many is listed, days until removed, days until listed again
LISTED = (("domain", 3, 60, 120), ("section", 7, 45, 100), ("url", 11, 30, 200))


def number(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 6), 16, 10).cast("int")


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated additions and removals of some of the pages' domains, sections and URLs."""
    host, url = url_lists.url_host(F.col("url")), F.col("url")
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    values = pages.select(
        F.inline(
            F.array(
                url_lists.key("domain", host),
                url_lists.key("domain", parent),
                url_lists.key("section", url_lists.section(url)),
                url_lists.key("url", url_lists.bare_url(url)),
            )
        )
    )
    values = values.where(F.length("value") > 0).distinct().withColumn("n", number(F.col("value")))
    parts = []
    for kind, one_in, removed, again in LISTED:
        own = values.where((F.col("kind") == kind) & (F.col("n") % one_in == 0))
        day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n") % 200)


        def dated_entry(action: str, at: Column) -> Column:
            return F.struct(F.lit(action).alias("action"), at.alias("at"))

        dated = F.array(
            dated_entry("add", day),
            F.when(F.col("n") % 2 == 0, dated_entry("remove", F.date_add(day, removed))),
            F.when(F.col("n") % 4 == 0, dated_entry("add", F.date_add(day, again))),
        )
        parts.append(own.select("kind", "value", F.inline(F.filter(dated, lambda e: e.isNotNull()))))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def op10_temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a capture, judged by the lists as they were when it was fetched."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int"))
    return url_lists.evaluate(pages.withColumn("fetched_at", fetched), derived_entries(pages))


_LIST_ROWS = " union all ".join(
    f"""select kind, value, unnest([{{'action': 'add', 'at': day}},
        case when n % 2 = 0 then {{'action': 'remove', 'at': day + {removed}}} end,
        case when n % 4 = 0 then {{'action': 'add', 'at': day + {again}}} end]) e
        from numbered where kind = '{kind}' and n % {one_in} = 0"""
    for kind, one_in, removed, again in LISTED
)

SQL = f"""
with captures as (
    select page_id, url, date '2024-01-01' + (page_id * 7919 % 366)::int fetched_at,
        nullif(regexp_replace(lower(regexp_extract(url,
            '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\\.$', ''), '') host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/', 1) first,
        regexp_replace(url, '#.*', '') bare
    from pages),
sections as (select *, case when first <> '' then host || '/' || first || '/' end section from captures),
listable as (
    select 'domain' kind, host value from sections
    union select 'domain', regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) from sections
    union select 'section', section from sections
    union select 'url', bare from sections),
numbered as (
    select kind, value, ('0x' || substr(md5(value), 1, 6))::int n,
        date '2024-01-01' + ('0x' || substr(md5(value), 1, 6))::int % 200 as day
    from listable where length(value) > 0),
rows_ as ({_LIST_ROWS}),
entries as (select distinct kind, value, e.action as act, e.at as at_ from rows_ where e is not null),
spans as (
    select *, lead(at_) over (partition by kind, value order by at_, act) until from entries),
active as (select * from spans where act = 'add' and (until is null or until > at_)),
hits as (
    select distinct c.page_id, a.kind, a.value, a.at_
    from sections c join active a on (a.kind = 'url' and a.value = c.bare
        or a.kind = 'section' and a.value = c.section)
        and a.at_ <= c.fetched_at and (a.until is null or c.fetched_at < a.until)
    union
    select distinct c.page_id, a.kind, a.value, a.at_
    from (select *, unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)),
            lambda i: array_to_string(list_slice(string_split(host, '.'), i, 999), '.'))) d
        from sections) c
    join active a on a.kind = 'domain' and a.value = c.d
        and a.at_ <= c.fetched_at and (a.until is null or c.fetched_at < a.until)),
best as (
    select *, row_number() over (partition by page_id order by
        case kind when 'url' then 2 when 'section' then 1 else 0 end desc, length(value) desc) r
    from hits)
select c.page_id, c.url, c.fetched_at, c.host, b.page_id is not null blocked,
    b.kind, b.value, b.at_ listed_at
from sections c left join best b on b.page_id = c.page_id and b.r = 1
"""
