"""Reports over the visit log (path, visitor, referer_host, device, created_at), the usage log and the key registry.

as_of is always a parameter (a date or timestamp column), so that reports don't depend on the clock. Aggregates have
partial sums before their shuffle; date predicates are plain comparisons that reach a date-partitioned scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bundles import safe_cut

from ..functions.tokens import hmac_sha256

# Modes of analysis, and the allowance of requests for each (requests, seconds).
MODES = ("url", "site", "code", "git")
BUDGETS = {"url": (40, 600), "crawl": (10, 180), "code": (60, 600), "git": (60, 600), "api": (500, 600)}
BOT = "bot"


def normalise_path(path: Column) -> Column:
    """Up to ``?`` or ``#`` (those at the start are left out), with a leading slash, without ``index.php`` at the end, at most 255 bytes."""
    cut = F.regexp_extract(path, r"^[?#]*([^?#]*)", 1)
    rooted = F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut))
    return safe_cut(F.regexp_replace(rooted, r"(?i)/index\.php$", "/"), 255)


def referer_host(referer: Column, own_host: Column) -> Column:
    """Lower-case host of a referer; null when there is none, or when it is the site itself, with or without ``www.``."""
    host = F.lower(F.regexp_extract(referer, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    bare = F.regexp_replace(F.lower(own_host), r"^www\.", "")
    return F.when((host != "") & (F.regexp_replace(host, r"^www\.", "") != bare), host)


def device_of(agent: Column) -> Column:
    """desktop, mobile, tablet, bot or other, by the user agent; a bot is a bot on any device."""
    a = F.lower(F.coalesce(agent, F.lit("")))
    return (
        F.when(a == "", "other").when(a.rlike("bot|crawl|spider|slurp|curl|wget|python|headless|preview|monitor"), BOT).when(a.rlike("ipad|tablet|kindle|silk") | a.rlike("android(?!.*mobile)"), "tablet")
        .when(a.rlike("mobi|iphone|ipod|android"), "mobile").when(a.rlike("windows|macintosh|linux|x11|cros"), "desktop").otherwise("other")
    )


def visitor_token(ip: Column, agent: Column, day: Column, secret: Column) -> Column:
    """A daily pseudonym of 16 hex digits that can't be traced back without the secret: a keyed hash whose key has the day in it."""
    return F.left(hmac_sha256(F.concat_ws("\n", ip, agent), F.concat_ws("\n", secret, day.cast("string"))), F.lit(16))


def within_days(ts: Column, days: int, as_of: Column) -> Column:
    """In the last ``days`` calendar days, today included."""
    return (ts >= F.date_sub(as_of, days - 1).cast("timestamp")) & (ts < F.date_add(as_of, 1).cast("timestamp"))


def daily(visits: DataFrame, days: int, as_of: Column, bots: bool = False) -> DataFrame:
    """(day, views, visitors) of the days that have visits."""
    rows = visits.filter(within_days(F.col("created_at"), days, as_of))
    if not bots:
        rows = rows.filter(F.col("device") != BOT)
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors"))


def fill_days(counts: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Every day of the window, oldest first, with zeros where nothing happened."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(as_of, days - 1), as_of)).alias("day"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("visitors", F.lit(0)).alias("visitors"))


def bar_widths(filled: DataFrame) -> DataFrame:
    """Each day's views and visitors as percentages of the window's greatest number."""
    top = Window.partitionBy()
    most = F.greatest(F.max("views").over(top), F.max("visitors").over(top))
    width = lambda c: F.when(most > 0, F.least(F.lit(100.0), F.round(F.col(c) * 100 / most, 1))).otherwise(0.0)
    return filled.select("day", width("views").alias("views_width"), width("visitors").alias("visitors_width"))


def summary(visits: DataFrame, days: int, as_of: Column) -> DataFrame:
    """One row: views, the sum of daily visitors, bot visits, and the first of the busiest days."""
    by_day = daily(visits, days, as_of)
    total = by_day.agg(F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.coalesce(F.sum("visitors"), F.lit(0)).alias("visitors"), F.max(F.struct("views", -F.unix_date("day"))).alias("_top"))
    robots = visits.filter(within_days(F.col("created_at"), days, as_of) & (F.col("device") == BOT)).agg(F.count("*").alias("bots"))
    return total.crossJoin(robots).select("views", "visitors", "bots", F.date_from_unix_date((-F.col("_top.col2")).cast("int")).alias("busiest"))  # one row each


def top_paths(visits: DataFrame, days: int, as_of: Column, n: int = 20) -> DataFrame:
    rows = visits.filter(within_days(F.col("created_at"), days, as_of) & (F.col("device") != BOT))
    return rows.groupBy("path").agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors")).orderBy(F.desc("views"), "path").limit(n)


def top_referrers(visits: DataFrame, days: int, as_of: Column, n: int = 15) -> DataFrame:
    rows = visits.filter(within_days(F.col("created_at"), days, as_of) & (F.col("device") != BOT) & F.col("referer_host").isNotNull())
    return rows.groupBy("referer_host").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "referer_host").limit(n)


def by_device(visits: DataFrame, days: int, as_of: Column) -> DataFrame:
    return visits.filter(within_days(F.col("created_at"), days, as_of)).groupBy("device").agg(F.count("*").alias("views"))


def by_hour(visits: DataFrame, days: int, as_of: Column) -> DataFrame:
    """24 rows, zeros included."""
    rows = visits.filter(within_days(F.col("created_at"), days, as_of) & (F.col("device") != BOT)).groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("views"))
    hours = visits.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(rows, "hour", "left").select("hour", F.coalesce("views", F.lit(0)).alias("views"))


def prune(visits: DataFrame, as_of: Column, keep_days: int = 90) -> DataFrame:
    """What remains after retention; fewer than one day means the default of 90."""
    return visits.filter(F.col("created_at") >= F.date_sub(as_of, keep_days if keep_days >= 1 else 90).cast("timestamp"))


def usage_total(usage: DataFrame, days: int, now: Column) -> DataFrame:
    """Requests of the last days of 24 hours each."""
    return usage.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days))).agg(F.count("*").alias("requests"))


def usage_by_mode(usage: DataFrame, days: int, now: Column) -> DataFrame:
    """Requests for each mode, zeros included."""
    rows = usage.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days))).groupBy("mode").agg(F.count("*").alias("requests"))
    modes = usage.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    return modes.join(rows, "mode", "left").select("mode", F.coalesce("requests", F.lit(0)).alias("requests"))


def top_hosts(usage: DataFrame, days: int, now: Column, n: int = 10, key: int | None = None) -> DataFrame:
    rows = usage.filter((F.col("created_at") >= now - F.make_dt_interval(F.lit(days))) & F.col("target_host").isNotNull())
    if key is not None:
        rows = rows.filter(F.col("api_key_id") == key)
    return rows.groupBy("target_host").agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "target_host").limit(n)


def count_for_key(usage: DataFrame, key: int, now: Column, days: int = 30) -> DataFrame:
    """Requests of one key in the last days of 24 hours each."""
    return usage_total(usage.filter(F.col("api_key_id") == key), days, now)


def budgets(spark) -> DataFrame:
    """(mode, allowed, seconds): the allowance of requests of each mode."""
    return spark.createDataFrame([(m, n, s) for m, (n, s) in BUDGETS.items()], "mode string, allowed int, seconds int")


def over_budget(usage: DataFrame) -> DataFrame:
    """(mode, target, slot, requests, allowed) of the fixed slots of time in which a target was asked for more often than its mode allows."""
    rows = usage.join(F.broadcast(budgets(usage.sparkSession)), "mode")  # five rows
    slot = F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / F.col("seconds"))
    counts = rows.groupBy("mode", F.col("target_host").alias("target"), slot.alias("slot"), "allowed").agg(F.count("*").alias("requests"))
    return counts.filter(F.col("requests") > F.col("allowed"))


def key_lines(text: DataFrame, col: str = "value") -> DataFrame:
    """(key) of a key file's lines: blank ones and those that begin with # are left out."""
    return text.select(F.trim(F.regexp_replace(col, r"^[\s\x00]+|[\s\x00]+$", "")).alias("key")).filter((F.col("key") != "") & ~F.col("key").startswith("#"))


def new_keys(names: DataFrame, secrets: Column, created: Column) -> DataFrame:
    """(name, key_hash, created_at, revoked_at) of keys to add: only the hash of a secret is kept."""
    return names.select("name", F.sha2(secrets, 256).alias("key_hash"), created.alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))


def revoke(keys: DataFrame, revoked: DataFrame, at: Column) -> DataFrame:
    """keys with revoked_at set for the ids in ``revoked``, where it isn't already."""
    gone = revoked.select("id", F.lit(True).alias("_gone")).distinct()
    return keys.join(gone, "id", "left").withColumn("revoked_at", F.coalesce("revoked_at", F.when(F.col("_gone"), at))).drop("_gone")


def record_visits(requests: DataFrame, secret: Column, own_host: Column) -> DataFrame:
    """Visit rows (path, visitor, referer_host, device, created_at) of requests (path, ip, agent, referer, at)."""
    token = visitor_token(F.col("ip"), F.col("agent"), F.to_date("at"), secret)
    return requests.select(normalise_path(F.col("path")).alias("path"), token.alias("visitor"), referer_host(F.col("referer"), own_host).alias("referer_host"), device_of(F.col("agent")).alias("device"), F.col("at").alias("created_at"))


def record_usage(requests: DataFrame) -> DataFrame:
    """Usage rows (source, api_key_id, mode, target, target_host, created_at) of requests of any mode: 2,048 bytes of the target, 255 of its host."""
    host = F.regexp_extract("target", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return requests.select("source", "api_key_id", "mode", safe_cut(F.col("target"), 2048).alias("target"), F.when(host != "", safe_cut(host, 255)).alias("target_host"), F.col("at").alias("created_at"))


def key_report(keys: DataFrame, usage: DataFrame) -> DataFrame:
    """Every key with its number of requests and its last one; active keys first, then the newest."""
    used = usage.filter("api_key_id is not null").groupBy("api_key_id").agg(F.count("*").alias("requests"), F.max("created_at").alias("last_used"))
    rows = keys.join(used, keys["id"] == used["api_key_id"], "left").drop("api_key_id")
    return rows.withColumn("requests", F.coalesce("requests", F.lit(0))).orderBy(F.col("revoked_at").isNull().desc(), F.desc("created_at"), "id")


def lookup_key(keys: DataFrame, secret_hash: Column) -> DataFrame:
    """The active key with a hash, if any."""
    return keys.filter((F.col("key_hash") == secret_hash) & F.col("revoked_at").isNull()).limit(1)
