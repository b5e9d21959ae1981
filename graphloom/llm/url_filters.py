"""URL filters by a temporal list join: dated list entries become validity intervals, captures meet those active at fetch time.

An entry change (kind, pattern, action, changed_at) says what a list holds from then on: 'block', 'allow', or 'remove',
which ends what was there. kind is 'host' (exact), 'domain' (the host and all below it) or 'prefix' (host and start of the
path, cut at a slash). Intervals are half open, [valid_from, valid_to). A capture gives one key for each host suffix
and path prefix, so finding entries is an equi-join; the interval that holds the fetch time is found inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Order of the three kinds; a capture's verdict is that of its most specific active entry.
KINDS = ("domain", "host", "prefix")
#: Intervals and captures meet by the month too, so that a long history of one key is not gone through by each of its captures.
PERIOD_DAYS = 32
#: Parts into which the captures of one key are dealt (an entry for a whole domain may meet a third of them), and entries' names that are broadcast at most.
SALTS, MOST_NAMES = 16, 100_000
#: Where no end is known.
FOREVER = "9999-12-31 00:00:00"


def pattern_key(kind: Column, pattern: Column) -> Column:
    """The pattern in the form that capture_keys gives it."""
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, "^[^/]*", 0)), r"\.+$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(pattern, "(?s)^[^/]*(.*)$", 1), "/+", "/"), "(?<=.)/$", "")
    return F.when(kind == "prefix", F.concat(host, F.when(path == "", "/").otherwise(path))).otherwise(F.regexp_replace(F.lower(pattern), r"\.+$", ""))


def validity_intervals(changes: DataFrame) -> DataFrame:
    """(kind, pattern, action, valid_from, valid_to) from changes(kind, pattern, action, changed_at).

    A change ends the one before it on the same kind and pattern. Of changes at one time that with the greatest
    action by name counts (remove, block, allow). Changes with a null in any column, and unknown kinds or actions, are left out; a repeated one
    changes nothing. Patterns are brought to the form of the captures' keys: the host in lower case without closing dots, a
    prefix's path, whose case counts, without closing or doubled slashes ('host/' for all of a host).
    """
    rows = changes.select("kind", pattern_key(F.col("kind"), F.col("pattern")).alias("pattern"), "action", "changed_at").dropna()
    rows = rows.where(F.col("kind").isin(*KINDS) & F.col("action").isin("block", "allow", "remove"))
    rows = rows.groupBy("kind", "pattern", "changed_at").agg(F.max("action").alias("action"))
    by_time = Window.partitionBy("kind", "pattern").orderBy("changed_at")
    rows = rows.withColumn("valid_to", F.coalesce(F.lead("changed_at").over(by_time), F.to_timestamp(F.lit(FOREVER))))
    return rows.where("action != 'remove'").select("kind", "pattern", "action", F.col("changed_at").alias("valid_from"), "valid_to")


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port or closing dot; an IPv6 address keeps its brackets. '' if the URL has none."""
    raw = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]*)", 1)
    return F.coalesce(F.regexp_replace(raw, r"\.+$", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """The path without query and fragment, '/' if there is none."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(raw == "", "/").otherwise(F.coalesce(raw, F.lit("/")))


def capture_keys(host: Column, path: Column) -> Column:
    """An array of (kind, pattern, depth): every entry that could match. depth: labels or path parts; deeper is more specific. An address has no domain above it."""
    labels = F.when(host.rlike(r"^(\[.*|[0-9.]+)$"), F.array(host)).otherwise(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".").alias("pattern"), i.alias("depth")))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern"), i.alias("depth")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"), F.lit(0).alias("depth")))
    return F.when(host != "", F.concat(suffixes, exact, prefixes)).otherwise(F.slice(exact, 1, 0))


def filter_urls(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures(capture_id, url, fetched_at) with (host, matches, kind, pattern, verdict).

    matches: the active entries met; kind and pattern: the most specific one (prefix over host over domain, then the deeper); verdict:
    its action, 'none' without one. A null or unparsable URL and a null fetch time meet no entry. Repeated rows are
    returned as often as they come. The captures' other columns are left out.
    """
    period = lambda t: F.floor(F.unix_timestamp(t) / (86400 * PERIOD_DAYS))
    order = F.create_map(*(F.lit(x) for pair in zip(KINDS, range(len(KINDS)), strict=True) for x in pair))
    rows = captures.select("capture_id", "url", "fetched_at", url_host(F.col("url")).alias("host"))
    wanted = rows.select("host", url_path(F.col("url")).alias("path"), "fetched_at").where("host != '' AND fetched_at IS NOT NULL").distinct()
    keyed = wanted.select("host", "path", "fetched_at", F.explode(capture_keys(F.col("host"), F.col("path"))).alias("k")).select("host", "path", "fetched_at", "k.*", period(F.col("fetched_at")).alias("period"))
    last = captures.agg(F.max("fetched_at").alias("t")).select(period(F.col("t"))).first()[0]  # no interval is dealt to periods after the last capture
    spans = validity_intervals(changes).withColumn("first", period(F.col("valid_from"))).where(F.col("first") <= F.lit(last).cast("long"))
    names = spans.select("kind", "pattern").distinct()
    keyed = keyed.join(F.broadcast(names) if names.limit(MOST_NAMES + 1).count() <= MOST_NAMES else names, ["kind", "pattern"], "left_semi")  # most keys are in no list
    salt = F.pmod(F.xxhash64("path", "fetched_at"), F.lit(SALTS)).cast("int")
    spans = spans.select("kind", "pattern", "action", "valid_from", "valid_to", F.explode(F.sequence("first", F.least(period(F.col("valid_to")), F.lit(last).cast("long")))).alias("period"))
    spans = spans.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    met = keyed.withColumn("salt", salt).join(spans, ["kind", "pattern", "period", "salt"]).where("fetched_at >= valid_from AND fetched_at < valid_to")
    best = F.max(F.struct(order[F.col("kind")].alias("o"), "depth", "kind", "pattern", "action"))
    verdicts = met.groupBy("host", "path", "fetched_at").agg(F.count(F.lit(1)).alias("matches"), best.alias("best"))
    verdicts = verdicts.select("host", "path", "fetched_at", "matches", "best")
    out = rows.withColumn("path", url_path(F.col("url"))).join(verdicts, ["host", "path", "fetched_at"], "left")
    return out.select("capture_id", "host", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"), F.coalesce(F.col("best.action"), F.lit("none")).alias("verdict"))
