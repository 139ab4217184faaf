"""URL filter: host suffixes and path prefixes of every URL against allow and block rules.

A rule is a host and a path. It fits a URL whose host is the rule's host or lies
below it and whose path starts with the rule's path. The longest fitting rule
decides; of rules of one length the one with the longer host, then block.

How: every distinct (host, path) is expanded into host-suffix + path-prefix
expressions of those lengths that occur in the rules, each expression is joined
by equality on a 32-bit hash prefix, and only candidates are confirmed by the
full SHA-256 digest. Nothing is collected: the planner broadcasts the rules if
it measures them as small, and else shuffles both sides by the hash prefix.

Defined results: a null URL or one without ``://`` has an empty host and path;
an empty host fits no rule; repeated rows all get their verdict; repeated rules
count once. Columns of the input stay, and the added ones replace columns of the
same name.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADDED = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH_BITS = 32


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add ``host`` and ``path``."""
    rest = df.withColumn("__url", F.coalesce(F.col(url).cast("string"), F.lit(""))).withColumn("__rest", _after_scheme(F.col("__url")))
    host = F.regexp_extract("__rest", r"\A([^/?#]*)", 1)
    return (
        rest.withColumn("__path", F.regexp_extract("__rest", r"\A[^/?#]*([^?#]*)", 1))
        .withColumn("__host", F.translate(host, UPPER, LOWER))
        .drop(*(c for c in ADDED if c in df.columns), "__url", "__rest")
        .withColumnsRenamed({"__host": "host", "__path": "path"})
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table: (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _hashed(expression: Column) -> tuple[Column, Column]:
    digest = F.sha2(expression, 256)
    return F.substring(digest, 1, HASH_BITS // 4), digest


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row for each distinct expression; block wins over allow for the same one."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    whole = rules.where(host != "").select(
        F.concat(host, F.coalesce("path", F.lit(""))).alias("__rule"),
        F.length(host).alias("__host_chars"),
        F.length(F.coalesce("path", F.lit(""))).alias("__path_chars"),
        F.size(F.split(host, r"\.")).alias("__labels"),
        F.col("verdict").alias("__verdict"),
    )
    short, digest = _hashed(F.concat_ws(" ", F.col("__rule"), "__host_chars"))
    return whole.groupBy("__rule", "__host_chars", "__path_chars", "__labels").agg(F.max("__verdict").alias("__verdict")).select(
        "*", short.alias("__short"), digest.alias("__digest")
    )


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (``default`` if none fits)."""
    rows = split_url(df, url)
    fixed = prepared_rules(rules)
    # lengths that occur in rules: their number is bounded by the longest rule, not by the number of rules
    shapes = fixed.agg(F.sort_array(F.collect_set("__labels")), F.sort_array(F.collect_set("__path_chars"))).first()
    labels, chars = ([F.lit(int(x)) for x in shape] for shape in shapes)
    if not labels:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    distinct = rows.select("host", "path").where(F.col("host") != "").distinct()
    suffixes = F.transform(
        F.filter(F.array(*labels), lambda n: n <= F.size(F.split("host", r"\."))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    )
    prefixes = F.transform(F.filter(F.array(*chars), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    short, digest = _hashed(F.concat_ws(" ", F.concat("__suffix", "__prefix"), F.length("__suffix")))
    expressions = (
        distinct.select("host", "path", F.explode(suffixes).alias("__suffix"), prefixes.alias("__prefixes"))
        .select("host", "path", "__suffix", F.explode("__prefixes").alias("__prefix"))
        .select("host", "path", short.alias("__short"), digest.alias("__own"))
    )
    best = F.max(F.struct(F.length("__rule"), "__host_chars", "__verdict", "__rule")).alias("__best")
    fits = expressions.join(fixed, "__short").where(F.col("__own") == F.col("__digest")).groupBy("host", "path").agg(best)
    return rows.join(fits, ["host", "path"], "left").select(
        *(c for c in rows.columns if c not in ("host", "path")),
        "host",
        "path",
        F.col("__best.__rule").alias("rule"),
        F.coalesce("__best.__verdict", F.lit(default)).alias("verdict"),
    )
