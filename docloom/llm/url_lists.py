"""URL filters by lists that change over time.

List entries are dated: an entry adds a value to the list or removes it. Per value they
become validity intervals, from an addition to the value's next entry. Captures are joined
as of their fetch time: a capture is blocked if one of its keys lies in an interval that
holds then. Keys of a URL, most specific last: every domain its host lies in (two labels at
least), its host and first path segment (`section`), the URL without its fragment (`url`).

Everything is DataFrame functions. No group grows with one hot value: intervals are found
month by month, and the join's key is (value, month), whose large partitions Spark can split.
Distinct (url, time) pairs are evaluated once, however many captures share them.

A null or unparsable URL has no keys and is not blocked; a null time is never inside an
interval. Repeated captures each keep their row. Entries with a null value, time or action
are left out, repeated ones count once, and at one time a removal comes after an addition.
Host names over 253 characters are not valid and have no domain keys. With an empty list
nothing is blocked. Captures' other columns stay; added ones are `host`, `blocked`, `kind`,
`value` and `listed_at`, and a clash of names is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED = ("host", "blocked", "kind", "value", "listed_at")
LEVELS = ("domain", "section", "url")


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def bare_url(url: Column) -> Column:
    return F.regexp_replace(url, "#.*", "")


def section(url: Column) -> Column:
    """Host and first path segment, such as ``host/en/``; null without one."""
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    return F.when(first != "", F.concat(url_host(url), F.lit("/"), first, F.lit("/")))


def domains(host: Column) -> Column:
    """The host and the domains above it, down to two labels."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    named = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.length(host) <= 253, named).otherwise(F.array().cast("array<string>"))


def key(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, listed_at, until) from entries (kind, value, action, at).

    ``until`` is null for an interval without end. The next entry of a value is found inside
    its month first, then among the first entries of its later months.
    """
    clean = (
        entries.select("kind", "value", "action", "at")
        .where(F.col("value").isNotNull() & F.col("at").isNotNull())
        .where(F.col("kind").isin(*LEVELS) & F.col("action").isin("add", "remove"))
        .distinct()
        .withColumn("month", month(F.col("at")))
    )
    by = ["kind", "value"]
    inside = Window.partitionBy(*by, "month").orderBy("at", "action")
    across = Window.partitionBy(*by).orderBy("month")
    months = (
        clean.groupBy(*by, "month")
        .agg(F.min("at").alias("first"))
        .withColumn("following", F.lead("first").over(across))
        .drop("first")
    )
    return (
        clean.withColumn("until", F.lead("at").over(inside))
        .join(months, [*by, "month"])
        .withColumn("until", F.coalesce("until", "following"))
        .where((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
        .select(*by, F.col("at").alias("listed_at"), "until")
    )


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with the most specific list entry active at fetch time, if any."""
    clash = set(ADDED) & set(captures.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    asked = captures.select(F.col(url).alias("_url"), F.col(at).alias("_at")).distinct()
    asked = asked.where(F.col("_url").isNotNull() & F.col("_at").isNotNull())
    keys = F.concat(
        F.transform(
            F.coalesce(domains(url_host(F.col("_url"))), F.array().cast("array<string>")),
            lambda d: key("domain", d),
        ),
        F.array(
            key("section", section(F.col("_url"))),
            key("url", bare_url(F.col("_url"))),
        ),
    )
    wanted = asked.select("_url", "_at", F.inline(keys)).where(F.col("value").isNotNull())
    wanted = wanted.withColumn("month", month(F.col("_at")))
    # Intervals are cut at months, no further than captures reach.
    first, last = asked.agg(F.min("_at")).scalar(), asked.agg(F.max("_at")).scalar()
    low = F.greatest(month(F.col("listed_at")), month(first))
    high = F.least(month(F.coalesce(F.col("until"), last)), month(last))
    cut = (
        intervals(entries)
        .withColumns({"_low": low, "_high": high})
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("month", F.explode(F.sequence("_low", "_high")))
        .drop("_low", "_high")
    )
    level = F.when(F.col("kind") == "url", 2).when(F.col("kind") == "section", 1).otherwise(0)
    best = F.max_by(
        F.struct("kind", "value", "listed_at"), F.struct(level, F.length("value"))
    ).alias("_best")
    held = (F.col("listed_at") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    found = wanted.join(cut, ["kind", "value", "month"]).where(held).groupBy("_url", "_at").agg(best)
    joined = captures.join(
        found, (F.col(url) == F.col("_url")) & (F.col(at) == F.col("_at")), "left"
    )
    return joined.select(
        *(captures[c] for c in captures.columns),
        url_host(captures[url]).alias("host"),
        F.col("_best").isNotNull().alias("blocked"),
        F.col("_best.kind").alias("kind"),
        F.col("_best.value").alias("value"),
        F.col("_best.listed_at").alias("listed_at"),
    )
