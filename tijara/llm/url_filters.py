"""URL filters by a temporal list join (DataFrame functions only).

A list is a log of dated entries: on a day a pattern (a domain with all below
it, a host, a path prefix or one URL) is put on a list or taken off.  Entries
become validity intervals [from, to); every capture is turned into the patterns
that could name it, and an as-of join by pattern finds the entries active when
it was fetched.

A capture has a handful of patterns (parents of its host, prefixes of its path)
of a few bytes each, so the join moves keys, never pages.  A domain that a
third of all captures share meets only its own few intervals: the join yields
at most one row for each capture, list and pattern, and its skew is split by
adaptive execution since nothing after it needs the key together.

Cases: a null or unparsable URL has no pattern and is never listed; a capture
without a time matches nothing; entries without list, pattern, day or action
are ignored; an entry put on twice stays on, one taken off that is not on has
no effect; on one day taking off comes after putting on; repeated captures are
judged alike, each in its own row; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dots."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.rtrim(host, F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns(host: Column, path: Column) -> Column:
    """All patterns that name a URL, as strings with their kind in front."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(
        F.lit("domain:"), F.array_join(F.slice(labels, i, n), ".")))
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    k = F.size(steps)
    prefixes = F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.concat(
        F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    one = F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("url:"), host, path))
    return F.when(host != "", F.array_distinct(F.concat(domains, one, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, day, action) -> (list, pattern, since, until): spans on the list."""
    e = (entries.select("list", "pattern", F.col("day").cast("date").alias("day"), F.lower("action").alias("action"))
         .filter("list is not null and pattern is not null and day is not null and action in ('add', 'remove')"))
    # The last word of a day counts: taking off comes after putting on.
    e = e.groupBy("list", "pattern", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("day")
    e = e.withColumn("before", F.lag("action").over(w)).filter((F.col("action") != F.coalesce("before", F.lit("remove"))))
    e = e.withColumn("until", F.lead("day").over(w))
    return e.filter("action = 'add'").select("list", "pattern", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: capture (unique), url, fetched (date).  Adds host, lists (names
    of the lists that the capture is on, sorted) and n_entries."""
    spans = intervals(entries)
    c = captures.withColumn("host", host_of(F.col("url")))
    keys = c.select("capture", "fetched", F.explode(patterns(F.col("host"), path_of(F.col("url")))).alias("key"))
    on = (F.col("key") == F.col("pattern")) & (F.col("since") <= F.col("fetched")) & (
        F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    hits = (keys.join(spans, on).groupBy("capture").agg(
        F.array_sort(F.collect_set("list")).alias("lists"), F.count("*").alias("n_entries")).withColumnRenamed("capture", "of"))
    return c.join(hits, F.col("capture") == F.col("of"), "left").drop("of").withColumns({
        "lists": F.array_join(F.coalesce("lists", F.array().cast("array<string>")), ","),
        "n_entries": F.coalesce("n_entries", F.lit(0))})


# ---------------------------------------------------------------- derived log

#: Words in host names and the list that such hosts are put on.
TOPICS = (("gambling", "casino|bet"), ("pharma", "pill|pharma"), ("ads", "ads|track|click"))
#: Share (of 256) of other hosts and of path prefixes that the review list names at some time.
REVIEWED = 24


def _day(text: Column, first: str, days: int) -> Column:
    """A day in a range of days, drawn from a hash of a text."""
    return F.date_add(F.to_date(F.lit(first)), (F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int") % days))


def derived_captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``: page_id, url and a fetch day drawn from the id."""
    p = pages.select("page_id", "url").withColumn("capture", F.monotonically_increasing_id())
    return write_shared(p.withColumn("fetched", _day(F.concat(F.lit("f"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))), "2024-01-01", 366)), "captures")


def derived_entries(captures: DataFrame) -> DataFrame:
    """A log of list entries from the hosts and path prefixes that occur."""
    c = captures.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), "^/([^/]+)", 1).alias("step"))
    c = c.filter("host <> ''")
    hosts = c.select(F.regexp_replace("host", "^(?:www|m|blog)[.]", "").alias("site")).distinct()
    topic = F.lit(None).cast("string")
    for name, words in reversed(TOPICS):
        topic = F.when(F.col("site").rlike(words), name).otherwise(topic)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("r"), "site")), 1, 2), 16, 10).cast("int") < REVIEWED
    by_site = hosts.select(F.coalesce(topic, F.when(drawn, "review")).alias("list"), F.concat(F.lit("domain:"), "site").alias("pattern"))
    paths = c.filter("step <> ''").select(F.concat(F.lit("path:"), "host", F.lit("/"), "step").alias("pattern")).distinct()
    by_path = paths.filter(F.conv(F.substring(F.md5(F.concat(F.lit("p"), "pattern")), 1, 2), 16, 10).cast("int") < REVIEWED).select(
        F.lit("review").alias("list"), "pattern")
    named = by_site.filter("list is not null").unionByName(by_path)
    # Put on in the first half, taken off within the second half of the year, some put on again.
    text = F.concat_ws("|", "list", "pattern")
    log = named.select("list", "pattern", F.explode(F.array(
        F.struct(_day(F.concat(F.lit("a"), text), "2023-10-01", 270).alias("day"), F.lit("add").alias("action")),
        F.struct(_day(F.concat(F.lit("b"), text), "2024-06-30", 120).alias("day"), F.lit("remove").alias("action")),
        F.struct(_day(F.concat(F.lit("c"), text), "2024-11-01", 200).alias("day"), F.lit("add").alias("action")))).alias("x"))
    return write_shared(log.select("list", "pattern", "x.day", "x.action"), "entries")
