"""URL rules by a sorted sweep over reversed hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pangrove.llm.common import session_partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the top down, each closed by \\x01, the least character a key holds.

    So a host's key is a prefix of each subdomain's, and a rule's host stands
    for the interval from its key to the key with the last \\x01 raised to \\x02.
    """
    labels = F.reverse(F.split(F.translate(host, "\x00\x01\x02", "\x03\x03\x03"), "\\."))
    return F.concat(F.array_join(labels, "\x01"), F.lit("\x01"))


def _boundaries(rules: DataFrame) -> DataFrame:
    """``(key, stack)``: where the active rules change, and the rules active from there.

    A rule's interval opens with its own rules on top of its parents' and
    closes with its parents' alone; a stack lists the longest rule first.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "action"
    ).distinct()
    frame = F.struct(
        (-F.length(F.concat("host", "path"))).alias("order"), (-F.length("host")).alias("host_order"),
        (F.col("action") != "block").alias("milder"), "host", "path", "action",
    )
    frames = rules.groupBy("host").agg(F.collect_set(frame).alias("frames"))
    labels = F.split("host", "\\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    above = frames.select(F.col("host").alias("below"), F.explode(ancestors).alias("host")).join(frames, "host")
    merge = lambda which: F.array_sort(F.flatten(F.collect_list(F.when(which, F.col("frames")))))
    stacks = above.groupBy("below").agg(merge(F.lit(True)).alias("own"), merge(F.col("host") != F.col("below")).alias("parents"))
    key = reversed_host(F.col("below"))
    closing = F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("\x02"))
    return stacks.select(key.alias("key"), F.col("own").alias("stack")).union(stacks.select(closing, "parents"))


def _splits(keys: DataFrame, n: int) -> list[str]:
    """``n - 1`` keys, at most, that part ``keys`` evenly: from the 32 n of least hash."""
    some = [r[0] for r in keys.orderBy(F.xxhash64("key"), "key").limit(32 * n).collect()]
    some.sort(key=lambda s: s.encode("utf-8"))
    return sorted({some[len(some) * k // n] for k in range(1, n)} if some else (), key=lambda s: s.encode("utf-8"))


def _bucket(key: Column, splits: list[str]) -> Column:
    """How many splits are no greater than ``key``, by halving steps."""
    if not splits:
        return F.lit(0)
    array, n = F.lit(splits), len(splits)
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at),
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", buckets: int | None = None
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` has ``host, path, action``.  A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest fitting
    rule (host and path together) wins, on a tie the longer host, then block.
    Where none fits, ``rule`` is null and the verdict ``default``.

    Sort-merge range join: urls and rule boundaries are sorted by the reversed
    host; a sweep carries the stack of active nested rules from the last
    boundary to the urls behind it.  Buckets part the order by keys sampled
    from the urls, salted behind the host, so one host, or one url, spreads
    over many; each bucket begins with the stack that is active there.  There
    are ``buckets`` of them, four for each of the session's partitions if that
    is not given, and each holds an equal share of the urls.

    Null urls and urls without ``://`` have an empty host and path.  Repeated
    rows come out once each; an empty table of pages or rules is fine.
    """
    spark = pages.sparkSession
    salt = F.hex(F.xxhash64(F.col(id_col), F.col(url_col)))
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), salt.alias("salt"))
    urls = urls.select("id", "host", "path", F.concat(reversed_host(F.col("host")), F.lit("\x00"), "salt").alias("key"))
    urls = written(urls, "urls")
    bounds = written(_boundaries(rules), "url-rules")
    n = buckets or 4 * session_partitions(spark)
    splits = _splits(urls.select("key"), n)
    bounds = bounds.withColumn("bucket", _bucket(F.col("key"), splits))
    # Each bucket's last stack, then what each bucket begins with: a row a bucket.
    last = bounds.groupBy("bucket").agg(F.max_by("stack", "key").alias("stack"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        spark.range(len(splits) + 1).select(F.col("id").cast("int").alias("bucket"))
        .join(last, "bucket", "left")
        .select("bucket", F.lit("").alias("key"), F.last("stack", ignorenulls=True).over(before).alias("stack"))
    )
    events = bounds.select("bucket", "key", "stack").unionByName(seeds).select("bucket", "key", "stack", F.lit(False).alias("is_url"))
    rows = urls.withColumn("bucket", _bucket(F.col("key"), splits)).withColumn("is_url", F.lit(True))
    sweep = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionByName(events, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
    fits = lambda r: (
        ((F.col("host") == r["host"]) | ((r["host"] != "") & F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))))
        & F.startswith(F.col("path"), r["path"])
    )
    best = F.get(F.filter("active", fits), 0)
    return swept.where("is_url").withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path",
        F.concat(F.col("best.host"), F.col("best.path")).alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
