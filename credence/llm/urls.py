"""URL rules by a sort-merge range join (operator 9), DataFrame functions only.

A host is written with its labels reversed (``net,example,``), so a rule for a
host and its subdomains is an interval of keys, and intervals of different
rules are nested or apart.  The distinct hosts and the interval bounds are
sorted by range; a sweep keeps the stack of open rules as one column for each
depth: a bound at depth d sets or ends level d and all deeper ones, so the
open rule at level k is the last bound of depth k or less.  What is open at the
start of a range block comes from the bounds of the blocks before it.  The
stack of a host is then joined to its urls, where the longest rule whose path
fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm.blocks import materialize

# The rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
HIGHEST = "\U0010FFFF"       # sorts after every label
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or a url."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, verdict of (``host/path``, ``block`` or ``allow``) pairs; any table of that form will do."""
    return spark.createDataFrame(rules, "rule string, verdict string")


def _bounds(rules: DataFrame) -> DataFrame:
    """Two bounds for each rule host: key, kind (0 begins, 2 ends), depth, and the rules that begin."""
    host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), UPPER, LOWER)
    by_host = (rules.where(F.col("rule").isNotNull())
               .select(host.alias("host"), F.struct(F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("path"), "rule", "verdict").alias("r"))
               .groupBy("host").agg(F.sort_array(F.collect_set("r")).alias("rules")))
    keyed = by_host.select(host_key(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("depth"), "rules")
    nothing = F.lit(None).cast(keyed.schema["rules"].dataType)
    return (keyed.select("key", F.lit(0).alias("kind"), "depth", "rules")
            .unionByName(keyed.select(F.concat("key", F.lit(HIGHEST)).alias("key"), F.lit(2).alias("kind"), "depth", nothing.alias("rules"))))


def open_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and the array of all rules whose interval holds it (hosts with none are left out)."""
    bounds = materialize(_bounds(rules))
    deepest = bounds.agg(F.max("depth").alias("d")).first()["d"] or 0       # labels of a host name: at most 127
    if not deepest:
        return hosts.select("host", F.array().cast("array<struct<path:string,rule:string,verdict:string>>").alias("stack")).limit(0)
    points = bounds.withColumn("host", F.lit(None).cast("string")).unionByName(
        hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("depth"),
                     F.lit(None).cast(bounds.schema["rules"].dataType).alias("rules"), "host"))
    dealt = materialize(points.repartitionByRange("key").withColumn("block", F.spark_partition_id()))
    levels = range(1, deepest + 1)

    def level(k: int) -> Column:
        """What a bound says about level k: its rules, none, or (null) nothing."""
        return F.when(F.col("depth") <= k, F.struct(F.when(F.col("depth") == k, F.col("rules")).alias("rules")))

    so_far = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.select("block", "host", *[F.last(level(k), ignorenulls=True).over(so_far).alias(f"level_{k}") for k in levels])
    ends = dealt.where("depth is not null").groupBy("block").agg(*[F.max_by(level(k), F.when(F.col("depth") <= k, F.struct("key", "kind"))).alias(f"end_{k}") for k in levels])
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)      # one row for each block
    blocks = dealt.select("block").distinct().join(ends, "block", "left")
    carried = blocks.select("block", *[F.last(f"end_{k}", ignorenulls=True).over(earlier).alias(f"carry_{k}") for k in levels])
    none = F.array().cast(bounds.schema["rules"].dataType)
    stack = F.concat(*[F.coalesce(F.coalesce(F.col(f"level_{k}"), F.col(f"carry_{k}"))["rules"], none) for k in levels])
    return (swept.where("host is not null").join(carried, "block").select("host", stack.alias("stack")).where(F.size("stack") > 0))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every row.

    A rule fits its host and all subdomains if the path starts with the rule's
    (from its first ``/`` on); the longest fitting rule wins, of equal rules
    with different verdicts ``block``.  Without a fitting rule, rule is null
    and the verdict ``default``.  A null url, or one without ``://``, has an
    empty host and path.  Rows may repeat; an empty table of pages gives an
    empty result, an empty table of rules ``default`` for all.  Other columns
    are not read.  The rules of one host name are held in one array.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    stacks = open_rules(urls.select("host").distinct(), rules)
    fitting = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return (urls.join(stacks, "host", "left").withColumn("best", best)
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
