"""URL rules by a sort-merge range join, in DataFrame functions only.

A rule is a host and a path prefix; it fits a url on that host or a subdomain whose path begins with the
prefix.  Both are prefixes of a canonical key: of the host's labels in reverse order, and of the path.  A
prefix is an interval of sorted keys, and intervals of prefixes are nested or disjoint.  `sweep` sorts keys
and interval ends together and keeps, by a running sum of +1 and -1, the depth of the stack of active
intervals; the innermost interval active at a key is the last one that began at the key's depth.

First the distinct hosts are swept against the rules' hosts, then the distinct (host, path) pairs against the
paths of every rule host that is active for them.  The longest rule string wins; of equally long ones, the longer
host; `block` wins over `allow` for one and the same rule.  What no rule fits gets the default verdict.

Scale: keys are made distinct before the shuffle, so a hot url or host is one row.  A sweep runs within a group
(the top-level label, or the rule host); a group of many keys is cut by a hash of the key into parts of about
`part_rows` keys, each of which gets the group's intervals, and no part is smaller than the group's interval
count, so intervals are never copied to more rows than there are keys.  The only joins are on equal keys, where
Spark splits skewed partitions.

Defined results: a null url, or one without "://", has empty host and path and takes the default verdict;
repeated rows each get their row; columns of pages stay as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cluster

#: the parts of a url: host and path
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, r))})" for r in rules)
    return spark.sql(f"select * from values {rows} as rules(host, path, verdict)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _host_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot after it: a.b.com -> com.b.a."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, intervals: DataFrame, part_rows: int) -> DataFrame:
    """points (grp, key, ...) with `within`: the longest interval (grp, key) of their group that is a prefix of the key, or null.

    points have distinct (grp, key); so have intervals."""
    n_points = points.groupBy("grp").agg(F.count("*").alias("n_points"))
    n_rules = intervals.groupBy("grp").agg(F.count("*").alias("n_rules"))
    parts = n_points.join(n_rules, "grp").select("grp", F.ceil(F.col("n_points") / F.greatest(F.col("n_rules"), F.lit(part_rows))).cast("int").alias("parts"))
    carried = [c for c in points.columns if c not in ("grp", "key")]
    events = ["grp", "part", "at", "kind", "step", "began", "key", *carried]
    starts = (
        intervals.join(parts, "grp")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("at", F.encode("key", "utf-8"))
        # (position, kind, step) of both ends; no key that begins with the prefix sorts after prefix and 0xFF
        .withColumn("edge", F.explode(F.array(F.struct(F.col("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.concat("at", F.unhex(F.lit("FF"))).alias("at"), F.lit(2).alias("kind"), F.lit(-1).alias("step")))))
        .select("grp", "part", "edge.at", "edge.kind", "edge.step", F.when(F.col("edge.kind") == 0, F.col("key")).alias("began"), F.lit(None).cast("string").alias("key"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried])
    )
    keyed = points.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts").cast("long")).cast("int"))
    keyed = keyed.withColumns({"at": F.encode("key", "utf-8"), "kind": F.lit(1), "step": F.lit(0), "began": F.lit(None).cast("string")}).select(*events)
    order = ["at", "kind"]
    deep = F.sum("step").over(Window.partitionBy("grp", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = F.last("began", ignorenulls=True).over(Window.partitionBy("grp", "part", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = keyed.unionByName(starts.select(*events)).withColumn("depth", deep).withColumn("within", top)
    return swept.filter("kind = 1").select("grp", "key", *carried, F.when(F.col("depth") > 0, F.col("within")).alias("within"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", part_rows: int = 2000) -> DataFrame:
    """All columns of pages and __host, __path, __rule, __verdict; where pages has a column of such a name, the new one has an underscore more."""
    host, path = host_and_path(F.col("url").cast("string"))
    given, pages = pages, pages.select(cluster.as_row(pages), host.alias("__host"), path.alias("__path"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow

    # which rule hosts are active for each host: the innermost, and those around it
    rule_hosts = rules.select("host").distinct()
    top_label = lambda c: F.substring_index(c, ".", -1)
    hosts = pages.filter("__host <> ''").select(F.col("__host").alias("host")).distinct()
    innermost = sweep(hosts.select(top_label("host").alias("grp"), _host_key(F.col("host")).alias("key"), "host"), rule_hosts.select(top_label("host").alias("grp"), _host_key(F.col("host")).alias("key")), part_rows)
    labels = F.split("host", r"\.")
    around = (
        rule_hosts.withColumn("outer", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
        .join(rule_hosts.select(F.col("host").alias("outer")), "outer", "left_semi")
        .select(_host_key(F.col("host")).alias("within"), F.col("outer").alias("grp"))
    )
    active = innermost.filter("within is not null").select("host", "within").join(around, "within").select("host", "grp")

    # within each of those hosts, the innermost path rule
    urls = pages.filter("__host <> ''").select(F.col("__host").alias("host"), F.col("__path").alias("path")).distinct().join(active, "host")
    keys = urls.select("grp", F.col("path").alias("key")).distinct()
    by_path = sweep(keys, rules.select(F.col("host").alias("grp"), F.col("path").alias("key")), part_rows)
    fitting = by_path.filter("within is not null").join(rules.select(F.col("host").alias("grp"), F.col("path").alias("within"), "verdict"), ["grp", "within"])
    rule = F.struct(F.length(F.concat("grp", "within")).alias("size"), F.length("grp").alias("host_size"), F.concat("grp", "within").alias("rule"), "verdict")
    best = (
        urls.join(fitting.withColumnRenamed("key", "path"), ["grp", "path"])
        .groupBy("host", "path")
        .agg(F.max(rule).alias("best"))
        .select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("best.rule").alias("__rule"), F.col("best.verdict").alias("__verdict"))
    )
    return (
        pages.join(best, (F.col("__host") == F.col("__h")) & (F.col("__path") == F.col("__p")), "left")
        .withColumn("__verdict", F.coalesce("__verdict", F.lit(default)))
        .select(*cluster.of_row(given), *[F.col(c).alias(cluster.free_name(given.columns, c)) for c in ("__host", "__path", "__rule", "__verdict")])
    )


ORACLE_SQL = rf"""
with p as (select row_number() over () as n, page_id,
  translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '{URL}', 2), '') as path from pages),
r as (select * from (values {", ".join(map(str, RULES))}) as t(rule_host, rule_path, rule_verdict)),
f as (select p.*, r.rule_host || r.rule_path as rule, rule_verdict,
  row_number() over (partition by n order by length(r.rule_host || r.rule_path) desc nulls last, length(r.rule_host) desc) as k
  from p left join r on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from f where k = 1
"""
