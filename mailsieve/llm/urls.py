"""URL rules by a sorted sweep over reversed hosts.

A host's key is its labels from the last to the first, each with a dot behind it, so a rule's
host and all its subdomains are the keys of one interval: from ``net.example.`` to, without
it, ``net.example/``.  Intervals nest or are apart.  Opening and closing events are sorted
among the distinct hosts, and the stack of rules open at a host is the one its last event
left.  The sorted keys are dealt in even ranges; each range hands its last stack on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsieve.functions.shared import buckets, cut

RANGE_HOSTS = 50_000
MOST_RANGES = 2_000
SAMPLE_PER_RANGE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a url without ``://``; only A-Z are lower-cased in the host."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def stacks(rules: DataFrame) -> DataFrame:
    """For each rule host: its key, its parent's key and all rules open at it, its own included.

    ``rules(action, rule)``, a rule being host and path as in ``example.net/en/``; the path is
    from the first slash on.
    """
    split = rules.select(
        "rule", "action",
        F.translate(F.regexp_extract("rule", "^([^/]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("path"),
    ).select(
        host_key(F.col("host")).alias("key"),
        F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "action", "rule", "path").alias("entry"),
    )
    own = split.groupBy("key").agg(F.collect_set("entry").alias("own"))
    labels = F.split(F.col("key").substr(F.lit(1), F.length("key") - 1), r"\.")
    above = own.select(
        "key", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n"), labels.alias("labels")
    ).select("key", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("n")), "."), F.lit(".")).alias("outer"))
    found = above.join(own.select(F.col("key").alias("outer"), "own"), "outer")
    return found.groupBy("key").agg(
        F.max(F.when(F.col("outer") != F.col("key"), F.col("outer"))).alias("parent"),
        F.flatten(F.collect_list("own")).alias("stack"),
    )


def open_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``key`` and ``stack`` of every host at which a rule is open.  ``hosts(key)`` is distinct."""
    none = F.array().cast("array<struct<size:int,host_size:int,action:string,rule:string,path:string>>")
    nodes = cut(stacks(rules), "rules")
    outer = nodes.select(F.col("key").alias("parent"), F.col("stack").alias("back"))
    closing = nodes.select("key", "parent").join(outer, "parent", "left")
    end = F.concat(F.col("key").substr(F.lit(1), F.length("key") - 1), F.lit("/"))
    events = nodes.select("key", F.lit(0).alias("kind"), "stack").unionByName(
        closing.select(end.alias("key"), F.lit(0).alias("kind"), F.coalesce("back", none).alias("stack"))
    )
    count = hosts.count()
    ranges = min(MOST_RANGES, buckets(count, RANGE_HOSTS))
    # only where the ranges are cut depends on this sample, as in Spark's own range partitioning
    every = max(1, count // (ranges * SAMPLE_PER_RANGE))
    some = sorted(r["key"] for r in hosts.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).collect()) if ranges > 1 else []
    bounds = [some[len(some) * i // ranges] for i in range(1, ranges)] if some else []
    rows = hosts.select("key", F.lit(1).alias("kind"), F.lit(None).cast(nodes.schema["stack"].dataType).alias("stack"))
    rows = rows.unionByName(events)
    if bounds:
        edges = F.lit(bounds)
        rows = rows.withColumn("range", F.size(F.filter(edges, lambda b: b <= F.col("key"))))
    else:
        rows = rows.withColumn("range", F.lit(0))
    # what each range leaves behind, handed on over the few ranges
    ends = rows.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("last"))
    spans = rows.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range")).join(ends, "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("range", F.last("last", ignorenulls=True).over(before).alias("carry"))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("top", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    swept = swept.join(F.broadcast(carried), "range")  # at most MOST_RANGES rows
    return swept.select("key", F.coalesce("top", "carry").alias("stack")).where(F.size("stack") > 0)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url)``.

    Of the rules that fit, the longest wins; of equal ones that with the longer host, then
    block.  Where none fits the rule is null and the verdict is ``default``; so it is for a
    null url.  Repeated rows are judged each on their own.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    hosts = cut(rows.where("key != ''").select("key").distinct(), "hosts")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)
    return rows.join(open_rules(hosts, rules), "key", "left").select(
        "page_id", "host", "path", best["rule"].alias("rule"),
        F.coalesce(best["action"], F.lit(default)).alias("verdict"),
    )
